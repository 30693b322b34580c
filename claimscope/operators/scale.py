"""Building blocks that hold when one key has a large share of all rows.

* ``lookup_join`` / ``spread_join``: join to a smaller table without sending a hot key to one task.
* ``ordered_counts`` / ``ordered_rows``: exact positions in a sorted order, without a one-task window.
* ``summed_for`` / ``maybe_listed``: sums and rows restricted to listed ids, without shuffling unsummed rows by id.

They run small jobs while they build their plan; what the driver gets is bounded by the constants below, not by the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.session import cut

# A side is broadcast only if it is measured to have at most this many rows, and this many bytes.
MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20
# The HOT_KEYS most frequent keys are spread if they have at least HOT_ROWS rows; any other key has < 1/HOT_KEYS of all rows.
# A summary of HOT_TRACKED counters finds them: it misses no key of over 0.05 % of all rows.
HOT_KEYS, HOT_TRACKED = 512, 8192
HOT_ROWS = 100_000
SALTS = 64
# A Bloom filter has at most this many words of 64 bits, and about BLOOM_BITS bits an id; where ids are too many for that, there is none.
BLOOM_WORDS = 1 << 20
BLOOM_BITS, BLOOM_HASHES = 12, 4
# Up to this many distinct values, counted beforehand, one task orders them.
ONE_TASK_VALUES = 100_000


def key_list(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def lookup_join(
    big: DataFrame, small: DataFrame, on: str | Sequence[str], how: str = "inner",
    spread_by: Sequence[str] | None = None, max_broadcast_rows: int | None = None,
) -> DataFrame:
    """Join to a smaller table, which is written once: broadcast if it is small as measured, else ``spread_join``."""
    keys = key_list(on)
    small = cut(small)
    if is_small(small, max_broadcast_rows):
        return big.join(F.broadcast(small), keys, how)
    if how in ("inner", "left_semi"):
        big = maybe_listed(big, small, keys)
    return spread_join(big, small, keys, how, spread_by)


def maybe_listed(rows: DataFrame, listed: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """The rows whose key may be among those of the stored table ``listed``: all that are, and a per cent or so of the others.

    A Bloom filter of the keys is put together as an aggregate (bits are joined to words, words to one array of at most 8 MB), stored, and reaches the
    rows as a subquery's value, ahead of the exact join that must follow. Null keys are never listed. With too many keys
    for the filter all rows are returned.
    """
    condition = _may_be_listed(rows, listed, on)
    return rows if condition is None else rows.where(condition)


def split_listed(rows: DataFrame, listed: DataFrame, on: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of ``maybe_listed``, and all others; none of these is listed, so they need no join and no shuffle."""
    condition = _may_be_listed(rows, listed, on)
    if condition is None:
        return rows, rows.where(F.lit(False))
    return rows.where(condition), rows.where(~F.coalesce(condition, F.lit(False)))


def _may_be_listed(rows: DataFrame, listed: DataFrame, on: str | Sequence[str]) -> Column | None:
    """The filter of ``maybe_listed`` as a condition on ``rows``; None with too many keys."""
    keys = key_list(on)
    types = dict(rows.dtypes)
    n = listed.count()
    words = 1 << max(0, (max(1, n) * BLOOM_BITS // 64).bit_length())
    if words > BLOOM_WORDS:
        return None
    places = [F.pmod(F.xxhash64(F.lit(i), *[F.col(k).cast(types[k]) for k in keys]), F.lit(64 * words)) for i in range(BLOOM_HASHES)]
    valued = listed.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    bits = valued.select(F.explode(F.array(*places)).alias("place")).select(
        F.shiftright("place", 6).alias("word"), F.expr("SHIFTLEFT(1L, CAST(place % 64 AS INT))").alias("bit")
    )
    filled = rows.sparkSession.range(words).withColumnRenamed("id", "word").join(bits.groupBy("word").agg(F.bit_or("bit").alias("bits")), "word", "left")
    entry = F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    filter_ = cut(filled.agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["bits"]).alias("bits"))).scalar()
    found = [F.getbit(F.element_at(filter_, (F.shiftright(place, 6) + 1).cast("int")), (place % 64).cast("int")) == 1 for place in places]
    known = [F.col(k).isNotNull() for k in keys]
    condition = known[0]
    for part in [*known[1:], *found]:
        condition = condition & part
    return condition


def is_small(df: DataFrame, max_rows: int | None = None) -> bool:
    """Whether a stored table has few enough rows and bytes to be broadcast; text counts with its length, other values with 16."""
    wide = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            wide = wide + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        elif kind[:5] in ("array", "map<", "struc"):
            wide = wide + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0))
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(wide), F.lit(0)).alias("bytes")).first()
    return found["rows"] <= (MAX_BROADCAST_ROWS if max_rows is None else max_rows) and found["bytes"] <= MAX_BROADCAST_BYTES


def summed_for(rows: DataFrame, ids: DataFrame, on: str, *summaries: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """Summaries of ``rows``, grouped by ``on`` and more, for the listed ids alone.

    Few ids are broadcast, and restrict the rows before they are summed. Of many, a filter takes out most other rows, and the sums are
    restricted: then what is shuffled by id is summed before, so no id has many rows, and nothing is salted.
    """
    listed = cut(ids.select(on).distinct())
    if is_small(listed):
        restricted = rows.join(F.broadcast(listed), on, "left_semi")
        return [summary(restricted) for summary in summaries]
    likely = maybe_listed(rows, listed, on)
    return [summary(likely).join(listed, on, "left_semi") for summary in summaries]


def spread_join(
    big: DataFrame, small: DataFrame, on: str | Sequence[str], how: str = "inner",
    spread_by: Sequence[str] | None = None, counts: DataFrame | None = None,
) -> DataFrame:
    """Equi-join in which the rows of a hot key of ``big`` are spread over ``SALTS`` tasks.

    Only rows of ``small`` with a hot key are replicated, once per salt. ``spread_by`` are columns of ``big`` that
    vary within a key (default: all). Hot keys are found by the query itself, in a subquery that returns at most ``HOT_KEYS`` key hashes: from
    ``counts``, the rows per key as (keys, n), where they are known already; else from a summary of frequent items, which
    tasks make of their rows and which is merged, so that no row per key is shuffled to find them.
    """
    keys = key_list(on)
    types = dict(big.dtypes)
    small = small.withColumns({key: F.col(key).cast(types[key]) for key in keys})
    key = F.xxhash64(*[F.col(name).cast(types[name]) for name in keys])
    if counts is None:
        frequent = big.agg(F.call_function("approx_top_k", key, F.lit(HOT_KEYS), F.lit(HOT_TRACKED)).alias("found"))
        hot = frequent.select(F.transform(F.filter("found", lambda x: x["count"] >= HOT_ROWS), lambda x: x["item"]).alias("hot")).scalar()
    else:
        hot = counts.where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n")).limit(HOT_KEYS).agg(F.collect_list(key).alias("hot")).scalar()
    is_hot = F.array_contains(hot, key)
    salt = F.pmod(F.xxhash64(F.lit("salt"), *(spread_by or big.columns)), F.lit(SALTS)).cast("int")
    left = big.withColumn("_salt", F.when(is_hot, salt).otherwise(F.lit(0)))
    every_salt = F.sequence(F.lit(0), F.lit(SALTS - 1))
    right = small.withColumn("_salt", F.explode(F.when(is_hot, every_salt).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def bucket_number(df: DataFrame) -> int:
    """How many ranges an ordered step is split into: as many as shuffle partitions, within bounds."""
    return max(8, min(512, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def ordered_counts(df: DataFrame, value: str, group: str | None = None, buckets: int | None = None) -> DataFrame:
    """Distinct non-null values with their place in ascending order: (group, value, ties, before, n).

    ``ties`` rows have the value, ``before`` rows of the group a smaller one, ``n`` rows a value at all. Rows are
    first counted per value; the counts are written once. Distinct values are then cut into ranges of about equal
    size at approximate quantiles (the cut only affects balance, never the result), and each range adds up its own
    counts. ``group`` must be a column of few values, such as the name of a feature.
    """
    spark = df.sparkSession
    buckets = buckets or bucket_number(df)
    rows = df.where(F.col(value).isNotNull()).select(
        F.col(group).alias("_group") if group else F.lit("").alias("_group"), F.col(value).alias("_value")
    )
    counts = cut(rows.groupBy("_group", "_value").agg(F.count(F.lit(1)).alias("ties")))
    names = [F.col("_group").alias(group)] if group else []
    columns = [*names, F.col("_value").alias(value), "ties", "before", "n"]
    # The driver gets at most `buckets` numbers per group here and below.
    cuts = counts.groupBy("_group").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(
        F.col("_value").cast("double"), [i / buckets for i in range(1, buckets)], F.lit(100 * buckets)
    ).alias("cuts")).collect()
    if max((row["n"] for row in cuts), default=0) <= ONE_TASK_VALUES:
        upwards = Window.partitionBy("_group").orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return counts.withColumns({
            "before": F.sum("ties").over(upwards) - F.col("ties"),
            "n": F.sum("ties").over(Window.partitionBy("_group")),
        }).select(*columns)
    group_type = dict(counts.dtypes)["_group"]
    cut_points = spark.createDataFrame(
        [(row["_group"], [float(point) for point in row["cuts"]]) for row in cuts],
        f"_group {group_type}, cuts array<double>",
    )
    placed = counts.join(F.broadcast(cut_points), "_group").select(
        "_group", "_value", "ties",
        F.size(F.filter("cuts", lambda cut_point: cut_point < F.col("_value"))).alias("bucket"),
    )
    sums = placed.groupBy("_group", "bucket").agg(F.sum("ties").alias("rows")).collect()
    totals: dict = {}
    starts = []
    for row in sorted(sums, key=lambda item: item["bucket"]):
        start = totals.get(row["_group"], 0)
        starts.append((row["_group"], row["bucket"], start))
        totals[row["_group"]] = start + row["rows"]
    offsets = spark.createDataFrame(
        [(name, bucket, start, totals[name]) for name, bucket, start in starts],
        f"_group {group_type}, bucket int, offset bigint, n bigint",
    )
    inside = (
        Window.partitionBy("_group", "bucket").orderBy("_value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        placed.join(F.broadcast(offsets), ["_group", "bucket"])
        .withColumn("before", F.col("offset") + F.sum("ties").over(inside) - F.col("ties"))
        .select(*columns)
    )


def ordered_rows(df: DataFrame, keys: Sequence[str], values: Sequence[Column], buckets: int | None = None) -> DataFrame:
    """The place in ascending order of each row's values, for several series of values at once: (keys, series, before, ties, n).

    ``series`` is the place of the value in ``values`` (doubles); ``before`` rows have a smaller value of it, ``ties`` rows the same, ``n`` rows any; nulls have no place.
    Each series is cut at approximate quantiles, and rows are counted per range. A value that is a cut itself has a range of
    its own, whose count is all that its rows need: so however many rows share a value, none of them is sorted. The other rows
    are shuffled once, by range, and ordered within it. The cuts only affect the balance, never the result.
    """
    spark = df.sparkSession
    buckets = buckets or bucket_number(df)
    names = [f"_v{i}" for i in range(len(values))]
    wide = df.select(*keys, *[value.alias(name) for name, value in zip(names, values, strict=True)])
    parts = [i / buckets for i in range(1, buckets)]
    # The driver gets at most `buckets` numbers per series here, twice as many below.
    found = wide.agg(*[F.struct(F.count(n).alias("n"), F.percentile_approx(n, parts, F.lit(100 * buckets)).alias("cuts")).alias(n) for n in names]).first()

    def long(frame: DataFrame, *more: str) -> DataFrame:
        entries = [F.struct(F.lit(i).alias("series"), F.col(n).alias("value"), *[F.col(f"{m}{i}").alias(m) for m in more]) for i, n in enumerate(names)]
        return frame.select(*keys, F.inline(F.array(*entries))).where(F.col("value").isNotNull())

    if max(found[n]["n"] for n in names) <= ONE_TASK_VALUES:
        upwards = Window.partitionBy("series").orderBy("value")
        placed = long(wide).withColumns({
            "before": (F.rank().over(upwards) - 1).cast("bigint"), "ties": F.count(F.lit(1)).over(Window.partitionBy("series", "value")),
            "n": F.count(F.lit(1)).over(Window.partitionBy("series")),
        })
        return placed.select(*keys, "series", "before", "ties", "n")
    splits = [[-math.inf, *sorted({float(c) for c in found[n]["cuts"] or [] if math.isfinite(c)} or {0.0}), math.inf] for n in names]
    binned = Bucketizer(splitsArray=splits, inputCols=names, outputCols=[f"bin{i}" for i in range(len(names))], handleInvalid="keep").transform(wide)
    edges = spark.createDataFrame(
        [(i, float(b), low) for i, own in enumerate(splits) for b, low in enumerate(own)], "series int, bin double, low double"
    )
    rows = long(binned, "bin").join(F.broadcast(edges), ["series", "bin"]).withColumn("inside", F.col("value") > F.col("low")).drop("low")
    sizes = rows.groupBy("series", "bin", "inside").agg(F.count(F.lit(1)).alias("size")).collect()
    starts, totals = [], [0] * len(names)
    for row in sorted(sizes, key=lambda r: (r["series"], r["bin"], r["inside"])):
        starts.append((row["series"], row["bin"], row["inside"], totals[row["series"]], row["size"]))
        totals[row["series"]] += row["size"]
    offsets = spark.createDataFrame(
        [(*start, totals[start[0]]) for start in starts], "series int, bin double, inside boolean, offset bigint, size bigint, n bigint"
    )
    rows = rows.join(F.broadcast(offsets), ["series", "bin", "inside"])
    on_cut = rows.where("not inside").select(*keys, "series", F.col("offset").alias("before"), F.col("size").alias("ties"), "n")
    upwards = Window.partitionBy("series", "bin").orderBy("value")
    between = rows.where("inside").withColumns({
        "before": F.col("offset") + F.rank().over(upwards) - 1, "ties": F.count(F.lit(1)).over(Window.partitionBy("series", "bin", "value"))
    })
    return on_cut.unionByName(between.select(*keys, "series", "before", "ties", "n"))
