"""Exact top-k by inner product: a KD-tree per shard, searched best-first under a bound that queries carry along."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.llm.common import written

SHARD_ROWS = 8192
LEAF_ROWS = 64
NONE = np.iinfo(np.int64).min  # the bound of a query that has fewer than k results so far


@dataclass
class Tree:
    """Vectors in the order of the leaves. Node i of level l holds rows n i / 2^l up to n (i + 1) / 2^l; boxes are by level."""

    ids: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def levels(self) -> int:
        return (len(self.low) + 1).bit_length() - 1


def build(ids: np.ndarray, vectors: np.ndarray) -> Tree:
    """Median splits along the widest side of each node's box, down to leaves of at most ``LEAF_ROWS`` rows."""
    n, order = len(ids), np.arange(len(ids))
    depth = max(0, int(np.ceil(np.log2(max(1, n / LEAF_ROWS)))))
    low, high = [], []
    for level in range(depth + 1):
        for i in range(1 << level):
            a, b = n * i >> level, n * (i + 1) >> level
            rows = vectors[order[a:b]]
            low.append(rows.min(axis=0))
            high.append(rows.max(axis=0))
            if level < depth:
                side = int(np.argmax(high[-1].astype(float) - low[-1].astype(float)))
                middle = (n * (2 * i + 1) >> (level + 1)) - a
                order[a:b] = order[a:b][np.argpartition(rows[:, side], min(middle, len(rows) - 1))]
    return Tree(ids[order], vectors[order], np.array(low), np.array(high))


def _product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows as whole numbers; in doubles where every sum is exact in them."""
    size = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(1, left.shape[1])
    if size < 2.0**53:
        return (left.astype(float) @ right.T.astype(float)).astype(np.int64)
    return left @ right.T


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each query its up to k best (score, id) in the tree, of scores not below its bound, ties to the smaller id.

    A box bounds the product with a query from above by its farther corner. Nodes are opened from the highest bound down, until
    none is left that reaches the kth score.
    """
    above = _product(np.maximum(queries, 0), tree.high) + _product(np.minimum(queries, 0), tree.low)
    last, n, found = tree.levels - 1, len(tree.ids), []
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(tree.vectors).max(initial=0)) * max(1, queries.shape[1]) < 2.0**53
    vectors = tree.vectors.astype(float) if exact else tree.vectors
    for q, own in enumerate(query_ids.tolist()):
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        kth, reach = int(bounds[q]), above[q]
        query = queries[q].astype(float) if exact else queries[q]
        waiting = [(-int(reach[0]), 0, 0)]
        while waiting:
            bound, level, i = heapq.heappop(waiting)
            if -bound < kth:
                break
            if level < last:
                for child in (2 * i, 2 * i + 1):
                    upper = int(reach[(2 << level) - 1 + child])
                    if upper >= kth:
                        heapq.heappush(waiting, (-upper, level + 1, child))
                continue
            a, b = n * i >> level, n * (i + 1) >> level
            scores = vectors[a:b] @ query
            for j in np.flatnonzero(scores >= kth).tolist():
                name = int(tree.ids[a + j])
                if name == own:
                    continue
                entry = (int(scores[j]), -name)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                kth = max(kth, best[0][0])
        found.append([(score, -name) for score, name in sorted(best, reverse=True)])
    return found


_INDEX = (
    "width int, shard int, ids binary, vectors binary, low binary, high binary, query_ids binary, queries binary, bounds binary, "
    "near array<struct<q:int,vec_id:bigint,score:bigint>>"
)


def _build_shard(every: int, k: int):
    def shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        width = int(key[0])
        ids = rows["vec_id"].to_numpy(np.int64)
        vectors = np.array(rows["whole"].tolist(), np.int64).reshape(len(rows), width)
        tree = build(ids, vectors)
        asks = np.flatnonzero(ids % every == 0)
        asked = np.unique(np.column_stack([ids[asks], vectors[asks]]), axis=0)  # a repeated row asks once
        names, queries = asked[:, 0], asked[:, 1:]
        found = search(tree, names, queries, np.full(len(names), NONE), k)
        bounds = np.array([x[-1][0] if len(x) == k else NONE for x in found], np.int64)
        near = [{"q": q, "vec_id": name, "score": score} for q, entries in enumerate(found) for score, name in entries]
        return pd.DataFrame({
            "width": [width], "shard": [int(key[1])], "ids": [tree.ids.tobytes()], "vectors": [tree.vectors.tobytes()], "low": [tree.low.tobytes()],
            "high": [tree.high.tobytes()], "query_ids": [names.tobytes()], "queries": [queries.tobytes()], "bounds": [bounds.tobytes()], "near": [near],
        })

    return shard


def _search_shards(k: int):
    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                whole = lambda name: np.frombuffer(getattr(row, name), np.int64)  # noqa: B023, E731
                shaped = lambda name: whole(name).reshape(-1, row.width)  # noqa: B023, E731
                tree = Tree(whole("ids"), shaped("vectors"), shaped("low"), shaped("high"))
                found = search(tree, whole("query_ids"), shaped("queries"), whole("bounds"), k)
                lines = [(row.width, row.home, q, name, score) for q, entries in enumerate(found) for score, name in entries]
                yield pd.DataFrame(lines, columns=["width", "home", "q", "vec_id", "score"]).astype("int64")

    return visit


def whole_components(vector: Column) -> Column:
    """floor(256 x) of each component as a whole number."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("bigint"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding) whose id is divisible by ``every``, its k
    best other rows by the inner product of whole components, over all rows; ties to the smaller vec_id.

    Rows are dealt to shards of about ``shard_rows`` by a hash. A shard first answers its own queries, which gives each a kth score;
    then its queries visit the other shards as one block, and only better or equal scores come back. Vectors that are null or empty, or
    hold null or non-finite components, and rows with a null vec_id take no part; vectors are compared with those of their own
    length. Repeated rows are all candidates, but none with the query's own id; a repeated query asks
    once (with different vectors, once for each). No rows give no rows; other columns are not read.
    """
    embedding = F.col("embedding")
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & (F.size(embedding) > 0)).where(fine).select(
        F.col("vec_id").cast("bigint"), whole_components(embedding).alias("whole")
    ).withColumn("width", F.size("whole"))
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "whole"), F.lit(shards)).cast("int"))
    index = written(dealt.groupBy("width", "shard").applyInPandas(_build_shard(every, k), _INDEX))
    own = index.select("width", F.col("shard").alias("home"), "query_ids", F.explode("near").alias("x"))
    # Ids of queries by (width, home, q); a few bytes per query.
    blocks = index.where(F.octet_length("query_ids") > 0).select("width", F.col("shard").alias("home"), "query_ids", "queries", "bounds")
    trees = index.select("width", "shard", "ids", "vectors", "low", "high")
    visits = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard != home").join(trees, ["width", "shard"])
    away = visits.mapInPandas(_search_shards(k), "width bigint, home bigint, q bigint, vec_id bigint, score bigint")
    here = own.select(*[F.col(c).cast("bigint") for c in ("width", "home")], F.col("x.q").cast("bigint").alias("q"), "x.vec_id", "x.score")
    order = Window.partitionBy("width", "home", "q").orderBy(F.desc("score"), "vec_id")
    best = here.union(away).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # Eight bytes each, little-endian.
    names = blocks.select(F.col("width").cast("bigint"), F.col("home").cast("bigint"), F.posexplode(_longs("query_ids")).alias("q", "query_id"))
    return best.join(names.withColumn("q", F.col("q").cast("bigint")), ["width", "home", "q"]).select("query_id", "rank", "vec_id", "score")


def _longs(column: str) -> Column:
    """The whole numbers in a binary column."""

    @F.pandas_udf("array<bigint>")
    def unpack(values: pd.Series) -> pd.Series:
        return values.map(lambda body: np.frombuffer(body, np.int64))

    return unpack(F.col(column))
