"""Skew-safe joins, ranks and lists give the plain results when their large-data paths are forced."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimscope.operators import quantiles, ranking, scale
from claimscope.session import cut


@pytest.fixture
def skewed(spark):
    rng = np.random.default_rng(1)
    n = 3000
    key = np.where(rng.random(n) < 0.4, "hot", [f"k{i}" for i in rng.integers(0, 300, n)])
    value = np.where(rng.random(n) < 0.35, 0.0, np.round(rng.normal(size=n), 2))
    frame = pd.DataFrame({"id": [f"i{i:05d}" for i in range(n)], "key": key, "value": value})
    return frame, cut(spark.createDataFrame(frame))


@pytest.fixture
def forced(monkeypatch):
    monkeypatch.setattr(scale, "HOT_ROWS", 5)
    monkeypatch.setattr(scale, "ONE_TASK_VALUES", 0)
    monkeypatch.setattr(scale, "MAX_BROADCAST_ROWS", 0)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_join(skewed, forced, how):
    _, df = skewed
    small = df.select("key").distinct().where(F.col("key") != "k7").withColumn("size", F.length("key"))
    for joined in (
        scale.spread_join(df, small, "key", how, spread_by=["id"]),
        scale.lookup_join(df, small, "key", how, spread_by=["id"]),
    ):
        plain = df.join(small, "key", how)
        assert sorted(joined.select(sorted(joined.columns)).collect()) == sorted(plain.select(sorted(plain.columns)).collect())


def test_spread_join_splits_the_hot_key(skewed, forced):
    _, df = skewed
    small = df.select("key").distinct()
    counts = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    joined = scale.spread_join(df, small, "key", "left", spread_by=["id"], counts=counts)
    assert joined.count() == 3000
    assert "_salt" in joined._jdf.queryExecution().toString()


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_filter_of_many_ids(spark, monkeypatch, kind):
    """Nothing listed is lost, few others pass, nulls don't; joins and sums give what they give without it."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 97 > 0, F.col("id") % 20_000).cast(kind).alias("key"), F.col("id").alias("v"))
    listed = cut(spark.range(0, 20_000, 10).select(F.col("id").cast("string").alias("key")).union(spark.createDataFrame([(None,)], "key string")))
    passed = scale.maybe_listed(rows, listed, "key")
    exact = rows.join(listed, "key", "left_semi")
    assert passed.join(listed, "key", "left_semi").count() == exact.count() > 0
    assert passed.count() < 1.2 * exact.count() and passed.where("key IS NULL").count() == 0
    monkeypatch.setattr(scale, "MAX_BROADCAST_ROWS", 0)
    joined = scale.lookup_join(rows, listed, "key", "left_semi", spread_by=["v"])
    assert sorted(r["v"] for r in joined.collect()) == sorted(r["v"] for r in exact.collect())
    summed = scale.summed_for(rows, listed, "key", lambda df: df.groupBy("key").agg(F.sum("v").alias("s")))[0]
    want = exact.groupBy("key").agg(F.sum("v").alias("s"))
    assert sorted(summed.collect()) == sorted(want.collect())
    monkeypatch.setattr(scale, "BLOOM_WORDS", 1)
    assert scale.maybe_listed(rows, listed, "key").count() == 40_000


def test_many_hot_keys_are_found_without_a_group_by(spark, monkeypatch):
    """200 keys with a two-hundredth of half of all rows each: none is in one task, and the single keys stay where they are."""
    monkeypatch.setattr(scale, "HOT_ROWS", 100)
    big = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 400).otherwise(F.col("id") + 1000).alias("key"), F.col("id").alias("v"))
    small = big.select("key").distinct().withColumn("w", F.col("key") * 2)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")
    old = {name: spark.conf.get(name) for name in names}
    try:
        spark.conf.set(names[0], -1)
        spark.conf.set(names[1], "false")
        joined = cut(scale.spread_join(big, small, "key", spread_by=["v"]).withColumn("task", F.spark_partition_id()))
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    assert joined.count() == 200_000 and joined.where("w != 2 * key").count() == 0
    tasks = joined.groupBy("key").agg(F.count_distinct("task").alias("tasks"), F.count(F.lit(1)).alias("n"))
    assert {r["n"] for r in tasks.where("key < 400").collect()} == {500} and tasks.where("key < 400 AND tasks = 1").count() == 0
    assert tasks.where("key < 400").count() == 200
    text = scale.spread_join(big, small, "key", spread_by=["v"])._jdf.queryExecution().toString()
    assert "approx_top_k" in text


def test_spread_join_with_null_keys_and_other_key_type(spark, forced):
    big = spark.createDataFrame([(1, "a"), (None, "b"), (1, "c")], "key bigint, id string")
    small = spark.createDataFrame([(1, 5)], "key int, v int")
    rows = scale.spread_join(big, small, "key", "left", spread_by=["id"]).orderBy("id").collect()
    assert [(row["id"], row["v"]) for row in rows] == [("a", 5), ("b", None), ("c", 5)]


@pytest.mark.parametrize("kind, desc", [("average_floor", True), ("min", True), ("pct", False), ("min", False)])
def test_global_rank(skewed, forced, kind, desc):
    frame, df = skewed
    ranked = ranking.global_rank(df, "value", kind, "rank", desc, spread_by=["id"]).toPandas().sort_values("id")
    expected = {
        "average_floor": frame["value"].rank(ascending=not desc).astype(int),
        "min": frame["value"].rank(ascending=not desc, method="min"),
        "pct": frame["value"].rank(ascending=not desc, pct=True),
    }[kind]
    assert np.allclose(ranked["rank"].to_numpy(float), expected.to_numpy(float))


def test_global_rank_same_for_small_and_large_path(skewed, monkeypatch):
    _, df = skewed
    small = ranking.global_rank(df, "value", "average_floor", "rank", spread_by=["id"]).orderBy("id").collect()
    monkeypatch.setattr(scale, "ONE_TASK_VALUES", 0)
    assert ranking.global_rank(df, "value", "average_floor", "rank", spread_by=["id"]).orderBy("id").collect() == small


def test_rank_of_null_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 1.0)], "id string, value double")
    rows = ranking.global_rank(df, "value", "average_floor", "rank", spread_by=["id"]).orderBy("id").collect()
    assert [row["rank"] for row in rows] == [1, None, 1]


RANKS = {
    "most": ranking.Rank("value", "average_floor"), "least": ranking.Rank("value", "min", desc=False), "tied": ranking.Rank("few"),
    "share": ranking.Rank("few", "pct", desc=False), "gaps": ranking.Rank("gap", "average_floor"), "none": ranking.Rank("empty"),
}


@pytest.mark.parametrize("large", [False, True])
def test_several_ranks_in_one_pass(skewed, monkeypatch, large):
    """Ranks with few values, a value that a third of all rows share, -0.0, infinite values, nulls and no values at all."""
    if large:
        monkeypatch.setattr(scale, "ONE_TASK_VALUES", 0)
    frame, df = skewed
    number = F.regexp_extract("id", "(\\d+)$", 1).cast("int")
    df = df.withColumns({
        "few": F.when(number % 3 == 0, F.lit(-0.0)).when(number % 5 == 0, F.lit(0.0)).when(number % 7 == 0, F.lit(float("inf"))).otherwise((number % 11).cast("double")),
        "gap": F.when(number % 4 > 0, F.col("value")), "empty": F.lit(None).cast("double"),
    })
    ranked = ranking.global_ranks(df, ["id"], RANKS, buckets=16).toPandas().sort_values("id").reset_index(drop=True)
    assert len(ranked) == len(frame)
    values = ranked.assign(few=ranked["few"] + 0.0)
    expected = {
        "most": values["value"].rank(ascending=False) // 1, "least": values["value"].rank(method="min"), "tied": values["few"].rank(ascending=False, method="min"),
        "share": values["few"].rank(pct=True), "gaps": values["gap"].rank(ascending=False) // 1,
    }
    for name, column in expected.items():
        assert np.allclose(ranked[name].to_numpy(float), column.to_numpy(float), equal_nan=True), name
    assert ranked["none"].isna().all()


def test_ranks_take_one_shuffle_by_range_and_one_by_key(skewed, monkeypatch):
    monkeypatch.setattr(scale, "ONE_TASK_VALUES", 0)
    _, df = skewed
    placed = scale.ordered_rows(df, ["id"], [F.col("value"), -F.col("value")], buckets=16)
    text = placed._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "hashpartitioning(series" in text and "hashpartitioning(value" not in text


def test_percentile_ranks(skewed, forced):
    frame, df = skewed
    df = df.withColumn("digit", F.substring("id", 6, 1).cast("int"))
    ranked = ranking.percentile_ranks(df, ["id"], ["value", "digit"]).toPandas().sort_values("id")
    digit = frame["id"].str[-1].astype(int)
    assert np.allclose(ranked["value_pct"], frame["value"].rank(pct=True))
    assert np.allclose(ranked["digit_pct"], digit.rank(pct=True))


@pytest.mark.parametrize("values, margin, size", [(10**6, 0.002, 4000), (300, 0.01, 200), (50, 0.0, 8), (3, 0.3, 8)])
def test_exact_quantiles(skewed, monkeypatch, values, margin, size):
    """With good sketches, sketches of sketches, and sketches so bad that places fall outside of their brackets."""
    for name, value in (("BRACKET_VALUES", values), ("SKETCH_MARGIN", margin), ("SKETCH_SIZE", size)):
        monkeypatch.setattr(quantiles, name, value)
    frame, df = skewed
    number = F.regexp_extract("id", "(\\d+)$", 1).cast("int")
    df = df.withColumns({
        "g": F.when(number % 10 > 0, F.col("key") == "hot"), "whole": number % 4, "gap": F.when(number % 3 > 0, F.col("value")), "none": F.lit(None).cast("double"),
    })
    local = df.toPandas()
    probabilities = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    columns = ["value", "whole", "gap", "none"]
    rows = quantiles.column_quantiles(df, columns, probabilities, group="g").collect()
    assert sorted(str((r["g"], r["column"])) for r in rows) == sorted(str((g, c)) for g in (True, False, None) for c in columns[:3])
    for row in rows:
        mask = local["g"].isna() if row["g"] is None else local["g"] == row["g"]
        assert np.allclose([row[name] for name in probabilities], local.loc[mask, row["column"]].astype(float).quantile(list(probabilities.values()))), row
    whole = {r["column"]: r for r in quantiles.column_quantiles(df, columns, probabilities).collect()}
    assert set(whole) == {"value", "whole", "gap"}
    assert np.allclose([whole["gap"][name] for name in probabilities], local["gap"].quantile(list(probabilities.values())))
    assert quantiles.column_quantiles(df.limit(0), columns, probabilities, group="g").count() == 0


def test_quantiles_of_nan_and_infinite_values(spark):
    values = [float("nan"), float("inf"), 1.0, 2.0, None, float("-inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = quantiles.column_quantiles(df, ["v"], {"low": 0.0, "second": 0.2, "fourth": 0.6, "top": 1.0}).first()
    assert (row["low"], row["second"], row["fourth"]) == (float("-inf"), 1.0, float("inf")) and np.isnan(row["top"])


def test_only_values_in_brackets_are_shuffled(spark):
    df = spark.range(200_000).select((F.xxhash64("id") / F.lit(1e9)).alias("v"), (F.col("id") * 1.5).alias("w"))
    local = df.toPandas()
    kept = []
    original = quantiles.cut
    try:
        quantiles.cut = lambda frame: kept.append(original(frame)) or kept[-1]
        rows = {r["column"]: r for r in quantiles.column_quantiles(df, ["v", "w"], {"p25": 0.25, "p50": 0.5}).collect()}
    finally:
        quantiles.cut = original
    for column in ("v", "w"):
        assert np.allclose([rows[column]["p25"], rows[column]["p50"]], local[column].quantile([0.25, 0.5]))
    assert len(kept) == 1 and kept[0].count() < 0.03 * 400_000


def test_keep_first_prunes_before_the_shuffle(skewed):
    _, df = skewed
    kept = ranking.keep_first(df, ["key"], [F.desc("value"), "id"])
    assert "WindowGroupLimit" in kept._jdf.queryExecution().toString()
    assert kept.count() == df.select("key").distinct().count()
