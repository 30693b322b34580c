"""Isolation forest (Liu, Ting and Zhou, ICDM 2008), grown level by level with DataFrame operations.

Samples and splits come from MD5 hashes of the seed, the tree and the id or node, which any SQL engine computes alike: the forest is
the same on every partitioning, and can be grown again elsewhere. All rows are scored in Arrow batches against the broadcast forest.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.operators.ranking import first_per_key
from claimscope.session import cut

# Tasks get the small numpy helpers below with their code, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EULER = 0.5772156649
# A tree draws from about this many times its sample, thinned from all rows by the same hash that orders the draw.
THINNING = 2.0
# One hash has the draws of this many trees, of this many hexadecimal digits each.
DRAWS_PER_HASH, DRAW_DIGITS = 4, 8
# Hexadecimal digits of a fraction: 52 bits, which a double holds exactly.
FRACTION_DIGITS = 13
# Features are compared to this many decimals: means and deviations over a cluster have no fixed order of addition.
DIGITS = 9
FIT_TASKS = 16


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Expected path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype="float64")
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def tree_depth(psi: int) -> int:
    return math.ceil(math.log2(max(psi, 2)))


def prepared(z: DataFrame, id_col: str, features: Sequence[str]) -> DataFrame:
    """The id and the features as they are compared: rounded, nulls as 0."""
    return z.select(id_col, *[F.round(F.coalesce(F.col(f), F.lit(0.0)), DIGITS).alias(f) for f in features])


def draw_samples(filled: DataFrame, rows: int, trees: int, psi: int, seed: int, thinning: float = THINNING) -> DataFrame:
    """Per tree, the ``psi`` rows (all, if fewer) with the smallest draw, ties by id: a draw from all rows.

    A draw is a part of the MD5 of seed, id and a number for four trees. Each row is copied only to the trees for which its draw is small
    enough to have a chance, so about ``thinning`` x ``psi`` x ``trees`` rows are shuffled, however many there are. Should a tree
    get too few, the cut-off is doubled; it never changes the draw.
    """
    space = 16**DRAW_DIGITS
    hashes = filled.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit((trees - 1) // DRAWS_PER_HASH)))).withColumn(
        "_hash", F.md5(F.concat_ws("|", F.lit(str(seed)), "_id", F.col("_group").cast("string")))
    )
    while True:
        limit = space if not rows else min(space, int(space * thinning * psi / rows) + 1)

        def chance(slot: int) -> Column:
            draw = F.substr("_hash", F.lit(1 + DRAW_DIGITS * slot), F.lit(DRAW_DIGITS))
            tree = F.col("_group") * DRAWS_PER_HASH + slot
            small = F.lit(True) if limit == space else draw < F.lit(f"{limit:0{DRAW_DIGITS}x}")
            return F.when(small & (tree < trees), F.struct(tree.alias("tree"), draw.alias("draw")))

        chosen = F.array_compact(F.array(*[chance(slot) for slot in range(DRAWS_PER_HASH)]))
        draws = hashes.withColumn("_draw", F.explode(chosen)).select(*filled.columns, "_draw.tree", "_draw.draw").repartition(FIT_TASKS, "tree")
        sample = cut(first_per_key(draws, ["tree"], ["draw", "_id"], psi))
        sizes = [row["count"] for row in sample.groupBy("tree").count().collect()]
        if limit == space or len(sizes) == trees and min(sizes) >= min(psi, rows):
            return sample
        thinning *= 2


def _fraction(start: int) -> str:
    """SQL: a number from 0 up to 1 from hexadecimal digits of ``_hash``."""
    return f"CAST(CAST(CONV(SUBSTR(_hash, {start}, {FRACTION_DIGITS}), 16, 10) AS BIGINT) AS DOUBLE) / {16**FRACTION_DIGITS}D"


def grow_forest(sample: DataFrame, features: Sequence[str], seed: int, max_depth: int) -> DataFrame:
    """(tree, node, feature, split, size) of the nodes of all trees, from the sampled rows (tree, features).

    Node 1 is the root, 2 i and 2 i + 1 are below node i; a leaf has no feature. A node's hash picks one of the features that vary in it, and a place
    between its smallest and largest value: rows up to there go to 2 i. Each level is one window over (tree, node); rows stay with
    the tasks of their tree, so all levels take one shuffle of the sample, whose size doesn't depend on the data's.
    """
    own = "OVER (PARTITION BY tree, node)"
    names = [f"`{f}`" for f in features]
    # The expressions of a level are SQL text: as columns they would take longer to build than to run.
    varying = ", ".join(
        f"CASE WHEN _high{i} > _low{i} THEN STRUCT({i} AS feature, _low{i} AS low, _high{i} AS high, {name} AS value) END" for i, name in enumerate(names)
    )
    nodes_type = "ARRAY<STRUCT<node: BIGINT, feature: INT, split: DOUBLE, size: BIGINT>>"
    # Every level has the same columns, so that Spark compiles its code once.
    state = sample.select("tree", *features).repartition(FIT_TASKS, "tree").selectExpr("tree", *names, "1L AS node", f"CAST(ARRAY() AS {nodes_type}) AS _nodes")
    for _ in range(max_depth):
        ends = [f"{way}({name}) {own} AS {end}{i}" for i, name in enumerate(names) for way, end in (("MIN", "_low"), ("MAX", "_high"))]
        state = state.selectExpr("*", f"COUNT(1) {own} AS _size", *ends)
        state = state.selectExpr(
            "tree", *names, "node", "_nodes", "_size", f"ARRAY_COMPACT(ARRAY({varying})) AS _varying", f"MD5(CONCAT_WS('|', '{seed}', tree, node)) AS _hash"
        )
        state = state.selectExpr("*", f"GET(_varying, CAST(FLOOR({_fraction(1)} * SIZE(_varying)) AS INT)) AS _picked")
        state = state.selectExpr("*", f"_picked.low + {_fraction(1 + FRACTION_DIGITS)} * (_picked.high - _picked.low) AS _between")
        state = state.selectExpr("*", "CASE WHEN _between < _picked.high THEN _between ELSE _picked.low END AS _split")
        found = "ARRAY_APPEND(_nodes, STRUCT(node, _picked.feature AS feature, _split AS split, _size AS size)) AS _nodes"
        below = "COALESCE(2 * node + CAST(_picked.value > _split AS BIGINT), node) AS node"
        state = state.selectExpr("tree", *names, below, found)
    state = state.selectExpr("*", f"COUNT(1) {own} AS _size")
    last = "STRUCT(node, CAST(NULL AS INT) AS feature, CAST(NULL AS DOUBLE) AS split, _size AS size)"
    nodes = state.selectExpr("tree", f"INLINE(ARRAY_APPEND(_nodes, {last}))")
    # A leaf above the last level was found once per level below it.
    return nodes.groupBy("tree", "node").agg(*[F.max(c).alias(c) for c in ("feature", "split", "size")])


def fit_forest(
    z: DataFrame, id_col: str, features: Sequence[str], rows: int, trees: int = 200, psi: int = 256, seed: int = 42,
) -> DataFrame:
    """Nodes of all trees, as ``grow_forest`` has them. ``rows`` is the number of rows of ``z``."""
    filled = prepared(z, id_col, features).withColumn("_id", F.col(id_col).cast("string")).drop(id_col)
    return grow_forest(draw_samples(filled, rows, trees, psi, seed), features, seed, tree_depth(psi))


def score_forest(
    z: DataFrame, id_col: str, features: Sequence[str], rows: int, forest: DataFrame, psi: int = 256,
) -> DataFrame:
    """(id, if_anomaly_score): 2^(-mean path / c(sample size)) - 0.5; higher is more anomalous.

    The forest has at most trees x (2 psi - 1) nodes, whatever the size of the data; it is broadcast.
    """
    features = list(features)
    nodes = forest.toPandas()
    depth = tree_depth(psi)
    names, at = np.unique(nodes["tree"].to_numpy(np.int64), return_inverse=True)
    place = (at, nodes["node"].to_numpy(np.int64))
    feature = np.full((len(names), 2 << depth), -1)
    split, path = np.zeros(feature.shape), np.zeros(feature.shape)
    feature[place] = nodes["feature"].fillna(-1).to_numpy(np.int64)
    split[place] = nodes["split"].fillna(0.0).to_numpy(float)
    path[place] = np.floor(np.log2(place[1])) + average_path(nodes["size"].to_numpy(float))
    shared = z.sparkSession.sparkContext.broadcast((feature, split, path))
    scale = float(average_path(min(psi, rows))) or 1.0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        feature, split, path = shared.value
        for batch in batches:
            values = batch[features].to_numpy("float64")
            total = np.zeros(len(values))
            every = np.arange(len(values))
            for tree in range(len(feature)):
                node = np.ones(len(values), dtype="int64")
                for _ in range(depth):
                    asked = feature[tree, node]
                    below = 2 * node + (values[every, np.maximum(asked, 0)] > split[tree, node])
                    node = np.where(asked >= 0, below, node)
                total += path[tree, node]
            mean = total / max(len(feature), 1)
            yield pd.DataFrame({id_col: batch[id_col], "if_anomaly_score": np.exp2(-mean / scale) - 0.5})

    id_type = dict(z.dtypes)[id_col]
    return prepared(z, id_col, features).mapInPandas(score, f"{id_col} {id_type}, if_anomaly_score double")


def isolation_forest(
    z: DataFrame, id_col: str, features: Sequence[str], trees: int = 200, psi: int = 256, seed: int = 42,
) -> DataFrame:
    rows = z.count()
    return score_forest(z, id_col, features, rows, fit_forest(z, id_col, features, rows, trees, psi, seed), psi)
