"""Exact quantiles of many columns and groups: sketches bound the order statistics, counts decide them."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.session import cut

# A sketch of this size is off by less than 0.0008 of all places, with 99 % confidence; brackets reach further on either side.
SKETCH_SIZE = 4000
SKETCH_MARGIN = 0.002
# The driver gets a sketch's values at this many places, and its ends.
SKETCH_STEPS = 2000
# Brackets that hold more values are sketched again before their values are counted one by one.
BRACKET_VALUES = 1_000_000
Bracket = tuple[float, float | None]  # lowest and highest value; None: no upper end


@dataclass
class Series:
    """One group's values of one column: the brackets in which they are looked at, and what a scan found there.

    Region 2 i + 1 is bracket i, region 2 i the gap below it.
    """

    brackets: list[Bracket] = field(default_factory=lambda: [(-math.inf, None)])
    sizes: dict[int, int] = field(default_factory=dict)
    values: dict[int, list[float]] = field(default_factory=dict)  # a region's sketch at its steps

    @property
    def n(self) -> int:
        return sum(self.sizes.values())

    def starts(self) -> list[tuple[int, int, int]]:
        """(region, number of values below it, number in it), upwards."""
        found, start = [], 0
        for region in sorted(self.sizes):
            found.append((region, start, self.sizes[region]))
            start += self.sizes[region]
        return found

    def wanted(self, probabilities: Mapping[str, float]) -> dict[int, list[int]]:
        """For each region, the places in it that decide a quantile, counted from the region's start."""
        places = sorted({round_(p * (self.n - 1)) for p in probabilities.values() for round_ in (math.floor, math.ceil)})
        found = {region: [place - start for place in places if start <= place < start + size] for region, start, size in self.starts()}
        return {region: inside for region, inside in found.items() if inside}

    def narrow(self, wanted: Mapping[int, Sequence[int]], margin: float) -> int:
        """Put a bracket around each wanted place; returns how many different values they are expected to hold at most."""
        found: list[Bracket] = []
        held = 0
        for region, places in wanted.items():
            size, values = self.sizes[region], self.values.get(region)
            low, high = self._ends(region)
            if values is None:  # no sketch of it: a gap, or a bracket whose values were counted
                found.append((low, high))
                held += size
                continue
            for place in places:
                below, above = place / size - margin, (place + 1) / size + margin
                found.append((
                    values[math.floor(below * SKETCH_STEPS)] if below > 0 else low, values[math.ceil(above * SKETCH_STEPS)] if above < 1 else high,
                ))
                held += 1 if found[-1][0] == found[-1][1] else math.ceil(size * min(1.0, 2 * margin + 2 / SKETCH_STEPS))
        joined: list[Bracket] = []
        for low, high in sorted(found, key=lambda bracket: bracket[0]):
            if joined and (joined[-1][1] is None or low <= joined[-1][1]):
                joined[-1] = (joined[-1][0], None if joined[-1][1] is None or high is None else max(joined[-1][1], high))
            else:
                joined.append((low, high))
        self.brackets = joined
        return held

    def _ends(self, region: int) -> Bracket:
        if region % 2:
            return self.brackets[region // 2]
        low = self.brackets[region // 2 - 1][1] if region else -math.inf
        return (-math.inf if low is None else low), (self.brackets[region // 2][0] if region // 2 < len(self.brackets) else None)


def _regions(doubles: DataFrame, columns: Sequence[str], series: Mapping[tuple, Series], kind: str | None) -> DataFrame:
    """(_group, _series, _region, _value) of all non-null values; values in gaps come without value. ``kind``: type of the group, if there are groups."""
    if not series:  # the first scan: one bracket for everything
        entries = [F.struct(F.lit(i).alias("_series"), F.lit(1).alias("_region"), F.col(f"`{c}`").alias("_value")) for i, c in enumerate(columns)]
        return doubles.select("_group", F.inline(F.array(*entries))).where(F.col("_value").isNotNull())
    groups = list({group: None for group, _ in series})
    whole = Series().brackets
    lists = [[series[g, i].brackets if (g, i) in series else whole for i in range(len(columns))] for g in groups]
    most = [max(len(own[i]) for own in lists) for i in range(len(columns))]
    # NaN is above all numbers, so nothing lies above it.
    flat = [
        [edge for i in range(len(columns)) for low, high in [*own[i], *[(None, None)] * (most[i] - len(own[i]))]
         for edge in (low, math.nan if high is None and low is not None else high)] for own in lists
    ]
    names = [(i, f"_low{i}_{j}", f"_high{i}_{j}") for i in range(len(columns)) for j in range(most[i])]
    if kind is None:
        given = {name: F.lit(value) for name, value in zip([n for _, *pair in names for n in pair], flat[0], strict=True)}
        placed = doubles
    else:
        # A row per group, with two numbers per column and bracket.
        edges = doubles.sparkSession.createDataFrame(
            [(group, *own) for group, own in zip(groups, flat, strict=True)], f"_name {kind}, " + ", ".join(f"{n} double" for _, *pair in names for n in pair)
        )
        placed = doubles.join(F.broadcast(edges), F.col("_group").eqNullSafe(F.col("_name")))
        given = {n: F.col(n) for _, *pair in names for n in pair}
    entries = []
    for i, column in enumerate(columns):
        value, region = F.col(f"`{column}`"), F.lit(0)
        for own, low, high in names:
            if own == i:
                region = region + F.coalesce((value >= given[low]).cast("int") + (value > given[high]).cast("int"), F.lit(0))
        entries.append(F.struct(F.lit(i).alias("_series"), region.alias("_region"), value.alias("_value")))
    rows = placed.select("_group", F.inline(F.array(*entries))).where(F.col("_value").isNotNull())
    return rows.withColumn("_value", F.when(F.col("_region") % 2 == 1, F.col("_value")))


def column_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Mapping[str, float], group: str | None = None) -> DataFrame:
    """Exact, linearly interpolated quantiles of several columns: (group if given, column, one column per name in ``probabilities``).

    A scan sketches every column; the sketches put a bracket around each order statistic that is wanted. The next scan counts the values outside of
    the brackets and, one by one, those inside: some thousandths of all, so that neither the values nor the distinct values of a column are
    shuffled. Columns so long that their brackets hold over ``BRACKET_VALUES`` are sketched again inside of them. Counts decide
    every place: a sketch that is off costs one more scan, and never changes a result. ``group`` must be a column of few values: the
    driver holds some thousand numbers per group and column. Nulls don't count, a group without values gives no
    row; NaN is the largest value.
    """
    columns = list(columns)
    spark, kind = df.sparkSession, dict(df.dtypes)[group] if group else "string"
    doubles = df.select((F.col(group) if group else F.lit("")).alias("_group"), *[F.col(c).cast("double").alias(c) for c in columns])
    # As text: a column per step would take longer to build than the sketches.
    steps = F.expr("ARRAY(" + ", ".join(f"{step / SKETCH_STEPS!r}D" for step in range(SKETCH_STEPS + 1)) + ")")
    series: dict[tuple, Series] = {}
    by, expected, margin = ["_group", "_series", "_region"], None, SKETCH_MARGIN
    counted = False
    while True:
        rows = _regions(doubles, columns, series, kind if group else None)
        if counted:
            counts = cut(rows.groupBy(*by, "_value").agg(F.count(F.lit(1)).alias("ties")))
            found = counts.groupBy(*by).agg(F.sum("ties").alias("size"), F.lit(None).cast("array<double>").alias("values"))
        else:
            # NaN would be left out of a sketch.
            sketch = F.kll_sketch_agg_double(F.when(F.isnan("_value"), F.lit(math.inf)).otherwise(F.col("_value")), SKETCH_SIZE)
            sketched = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("size"), F.count("_value").alias("inside"), sketch.alias("sketch"))
            found = sketched.select(*by, "size", F.when(F.col("inside") > 0, F.kll_sketch_get_quantile_double("sketch", steps)).alias("values"))
        for own in series.values():
            own.sizes, own.values = {}, {}
        for row in found.collect():
            own = series.setdefault((row["_group"], row["_series"]), Series())
            own.sizes[row["_region"]] = row["size"]
            if row["values"] is not None:
                own.values[row["_region"]] = row["values"]
        wanted = {name: own.wanted(probabilities) for name, own in series.items()}
        missed = any(region % 2 == 0 for places in wanted.values() for region in places)
        if counted and not missed or not series:
            break
        if missed:  # the sketch was off by more than the margin
            margin = 2 * max(margin, 1 / SKETCH_STEPS)
        before, expected = expected, max(own.narrow(wanted[name], margin) for name, own in series.items())
        # One more sketch only where it is needed, and as long as sketches help.
        counted = expected <= BRACKET_VALUES or not missed and before is not None and expected > before / 2
    if not series:
        names = [(F.lit(None).cast(kind).alias(group))] if group else []
        return doubles.limit(0).select(*names, F.lit("").alias("column"), *[F.lit(0.0).alias(p) for p in probabilities])
    starts = spark.createDataFrame(
        [(name[0], name[1], columns[name[1]], region, start, own.n) for name, own in series.items() for region, start, _ in own.starts() if region % 2],
        f"_name {kind}, _column int, column string, _bracket int, start bigint, n bigint",
    )
    same = F.col("_group").eqNullSafe(F.col("_name")) & (F.col("_series") == F.col("_column")) & (F.col("_region") == F.col("_bracket"))
    upwards = Window.partitionBy(*by).orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = counts.where(F.col("_region") % 2 == 1).join(F.broadcast(starts), same)
    ordered = inside.withColumn("before", F.col("start") + F.sum("ties").over(upwards) - F.col("ties"))
    return _interpolated(ordered, {"_group": group} if group else {}, probabilities)


def _interpolated(ordered: DataFrame, groups: Mapping[str, str], probabilities: Mapping[str, float]) -> DataFrame:
    """Quantiles from counted values (column, _value, ties, before, n) that cover all wanted places."""

    def at(position: Column) -> Column:
        covers = (F.col("before") <= position) & (position < F.col("before") + F.col("ties"))
        return F.max(F.when(covers, F.col("_value")))

    aggregates, results = [F.max("n").alias("_n")], []
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col("n") - 1)
        aggregates += [at(F.floor(position)).alias(f"_lo_{name}"), at(F.ceil(position)).alias(f"_hi_{name}")]
        share = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        results.append(F.when(low == high, low).otherwise(low + (high - low) * (share - F.floor(share))).alias(name))
    found = ordered.groupBy(*groups, "column").agg(*aggregates)
    return found.select(*[F.col(own).alias(name) for own, name in groups.items()], "column", *results)
