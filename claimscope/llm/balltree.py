"""Exact ranked lexical search: ball trees over sparse document vectors, searched best-first under inner-product bounds."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimscope.llm.common import written

SHARD_ROWS, SHARD_ENTRIES = 8192, 2_000_000
LEAF_ROWS = 64
# Items are asked in blocks of at most about this many, and this many bytes of text.
BLOCK_ITEMS, BLOCK_BYTES = 4096, 16 << 20
# Bytes of terms stay, A-Z are lowered, all others part terms; bytes from 128 on are those of other characters.
_BYTES = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if byte >= 128 or 48 <= byte <= 57 or 97 <= byte <= 122 else 32 for byte in range(256)
)
_VECTOR = "doc_id bigint, n bigint, terms binary, counts binary"


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in order: runs of ASCII letters, digits and characters outside of ASCII."""
    return (text or "").encode().translate(_BYTES).split()


@dataclass
class Rows:
    """Sparse rows: row i has the terms and whole values from ``at[i]`` to ``at[i + 1]``, one entry at least."""

    at: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def taken(self, order: np.ndarray) -> Rows:
        sizes = np.diff(self.at)[order]
        at = np.concatenate([[0], np.cumsum(sizes)])
        entries = np.repeat(self.at[order] - at[:-1], sizes) + np.arange(at[-1])
        return Rows(at, self.terms[entries], self.values[entries])

    def products(self, dense: np.ndarray, a: int, b: int, roots: np.ndarray | None = None) -> np.ndarray:
        """Inner products of rows a to b with a dense vector; of whole numbers if both are, else with values times ``roots``."""
        own = slice(self.at[a], self.at[b])
        weighed = self.values[own] * dense[self.terms[own]]
        if roots is not None:
            weighed = weighed * roots[self.terms[own]]
        return np.add.reduceat(weighed, self.at[a:b] - self.at[a])


@dataclass
class Tree:
    """Rows in the order of the leaves; node i of level l holds rows n i / 2^l up to n (i + 1) / 2^l. Nodes are stored level by level."""

    names: np.ndarray
    rows: Rows
    levels: int
    centre_at: np.ndarray
    centre_terms: np.ndarray
    centre_values: np.ndarray
    radius: np.ndarray

    def bounds(self, query: np.ndarray, slack: float) -> np.ndarray:
        """For each node, a number that no row's product with ``query`` exceeds: centre's product + radius x length, rounded up.

        All terms of the sums are positive, so rounding moves them by a share of at most ``slack``.
        """
        near = np.add.reduceat(self.centre_values * query[self.centre_terms], self.centre_at)
        return (near + self.radius * math.sqrt(float(query @ query))) * (1 + slack) + 1


def build(names: np.ndarray, rows: Rows, roots: np.ndarray) -> Tree:
    """Balls split in halves between two far rows, down to leaves of at most ``LEAF_ROWS``.

    Distances are taken with each term's values times its root (of the term's weight), which leaves products with queries over the root the same.
    """
    n, size = len(names), len(roots)
    depth = max(0, math.ceil(math.log2(max(1, n / LEAF_ROWS))))
    starts, terms, values, radius = [], [], [], []
    filled = 0
    lengths = np.add.reduceat((rows.values * roots[rows.terms]) ** 2, rows.at[:-1])
    slack = 4 * (int(np.diff(rows.at).max()) + n + 8) * 2.0**-52
    for level in range(depth + 1):
        order = np.arange(n)
        for i in range(1 << level):
            a, b = n * i >> level, n * (i + 1) >> level
            own = slice(rows.at[a], rows.at[b])
            centre = np.bincount(rows.terms[own], rows.values[own] * roots[rows.terms[own]], minlength=size) / (b - a)
            inner = float(centre @ centre)
            squares = lengths[a:b] - 2 * rows.products(centre, a, b, roots) + inner
            # What cancels in the difference can be off by this much.
            radius.append(math.sqrt(max(0.0, float(squares.max())) + slack * (float(lengths[a:b].max()) + inner)))
            used = np.flatnonzero(centre)
            if not len(used):
                used = np.zeros(1, np.int64)
            starts.append(filled)
            terms.append(used)
            values.append(centre[used])
            filled += len(used)
            if level < depth:
                first = a + int(squares.argmax())
                to_first = rows.products(_dense(rows, first, roots), a, b, roots)
                second = a + int((lengths[a:b] - 2 * to_first).argmax())
                side = rows.products(_dense(rows, second, roots), a, b, roots) - to_first
                middle = (n * (2 * i + 1) >> (level + 1)) - a
                order[a:b] = a + np.argpartition(side, min(middle, b - a - 1))
        if level < depth:
            rows, names, lengths = rows.taken(order), names[order], lengths[order]
    return Tree(names, rows, depth + 1, np.array(starts), np.concatenate(terms), np.concatenate(values), np.array(radius))


def _dense(rows: Rows, i: int, roots: np.ndarray) -> np.ndarray:
    out = np.zeros(len(roots))
    own = slice(rows.at[i], rows.at[i + 1])
    out[rows.terms[own]] = rows.values[own] * roots[rows.terms[own]]
    return out


@dataclass
class Best:
    """The k best (score, name) of an item so far, ties to the smaller name."""

    k: int
    scores: np.ndarray
    names: np.ndarray

    @property
    def kth(self) -> int:
        """What a row must reach: the kth score, or one where there are fewer."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, names: np.ndarray) -> None:
        good = scores >= self.kth
        if good.any():
            scores, names = np.concatenate([self.scores, scores[good]]), np.concatenate([self.names, names[good]])
            order = np.lexsort((names, -scores))[:self.k]
            self.scores, self.names = scores[order], names[order]


def search(tree: Tree, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Improve ``best`` by the rows of the tree for a query of ``counts`` of ``terms``; returns the number of leaves scored.

    Nodes are opened from the highest bound down, until none is left whose bound reaches the kth score; rows of a leaf are
    scored in whole numbers.
    """
    query, asked = np.zeros(len(weights)), np.zeros(len(weights), np.int64)
    query[terms] = counts * np.sqrt(weights[terms])
    asked[terms] = counts * weights[terms]
    bounds = tree.bounds(query, 4 * (len(weights) + 8) * 2.0**-52)
    last, n, opened = tree.levels - 1, len(tree.names), 0
    waiting = [(-float(bounds[0]), 0, 0)]
    while waiting:
        bound, level, i = heapq.heappop(waiting)
        if -bound < best.kth:
            break
        if level < last:
            for child in (2 * i, 2 * i + 1):
                upper = float(bounds[(2 << level) - 1 + child])
                if upper >= best.kth:
                    heapq.heappush(waiting, (-upper, level + 1, child))
            continue
        a, b = n * i >> level, n * (i + 1) >> level
        best.add(tree.rows.products(asked, a, b), tree.names[a:b])
        opened += 1
    return opened


def _vectors(index: dict[bytes, int]):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = []
            for text in batch["text"]:
                words = terms_of(text)
                found = Counter(map(index.get, words))
                found.pop(None, None)
                lines.append((len(words), np.fromiter(found, np.int32, len(found)).tobytes(), np.fromiter(found.values(), np.int64, len(found)).tobytes()))
            out = pd.DataFrame(lines, columns=["n", "terms", "counts"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out[out["n"] > 0]

    return count


def _holders(size: int):
    """Documents per term, added up within a task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch["terms"]), np.int32), minlength=size)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"term": used, "df": total[used]})

    return count


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a task in portions of at most ``SHARD_ROWS`` rows and, but for single rows, ``SHARD_ENTRIES`` terms."""
    waiting, rows, entries = [], 0, 0
    for batch in batches:
        sizes = batch["terms"].map(len).to_numpy() // 4
        start = 0
        for i, size in enumerate(sizes.tolist()):
            if rows and (rows == SHARD_ROWS or entries + size > SHARD_ENTRIES):
                yield pd.concat([*waiting, batch.iloc[start:i]])
                waiting, rows, entries, start = [], 0, 0, i
            rows, entries = rows + 1, entries + size
        waiting.append(batch.iloc[start:])
    if rows:
        yield pd.concat(waiting)


def shard_rows(shard: pd.DataFrame, weights: np.ndarray, documents: int, total: int) -> tuple[np.ndarray, Rows]:
    """Names and sparse vectors of the rows that hold any term with a weight."""
    terms = np.frombuffer(b"".join(shard["terms"]), np.int32)
    counts = np.frombuffer(b"".join(shard["counts"]), np.int64)
    sizes = shard["terms"].map(len).to_numpy() // 4
    # Python's whole numbers: the product of three counts may not fit a long.
    size = np.array([25 + 75 * n * documents // total for n in shard["n"].tolist()], np.int64)
    values = 1_000_000_000 * counts // (1000 * counts + 8 * np.repeat(size, sizes))
    owner = np.repeat(np.arange(len(shard)), sizes)
    used = (weights[terms] > 0) & (values > 0)
    terms, values, owner = terms[used], values[used], owner[used]
    kept, sizes = np.unique(owner, return_counts=True)
    return shard["doc_id"].to_numpy(np.int64)[kept], Rows(np.concatenate([[0], np.cumsum(sizes)]), terms, values)


def _search_shards(queries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, documents: int, total: int, k: int):
    roots = np.sqrt(weights)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [Best(k, np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
        for shard in _shards(batches):
            names, rows = shard_rows(shard, weights, documents, total)
            if not len(names):
                continue
            tree = build(names, rows, roots)
            for (terms, counts), found in zip(queries, best, strict=True):
                if len(terms):
                    search(tree, terms, counts, weights, found)
        yield pd.DataFrame({
            "item": np.repeat(np.arange(len(best)), [len(b.scores) for b in best]), "doc_id": np.concatenate([b.names for b in best]),
            "score": np.concatenate([b.scores for b in best]),
        })

    return visit


def _rank_block(docs: DataFrame, items: list[tuple], types: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    counted = [Counter(terms_of(text)) for _, text in items]
    index = {term: i for i, term in enumerate(sorted(set().union(*counted)))}
    vectors = written(docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(_vectors(index), _VECTOR))
    documents, total = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    holders = vectors.select("terms").mapInPandas(_holders(len(index)), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    weights = np.zeros(len(index), np.int64)
    for row in holders.collect():  # one row per term of the block's items
        weights[row["term"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * row["df"] + 1)))
    queries = []
    for counts in counted:
        named = [(index[term], n) for term, n in counts.items() if weights[index[term]] > 0]
        queries.append((np.array([t for t, _ in named], np.int64), np.array([n for _, n in named], np.int64)))
    # Rows without an id are named by the smallest number, which comes first.
    named = vectors.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**63))))
    found = named.mapInPandas(_search_shards(queries, weights, documents, total, k), "item int, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(items)], f"item int, item_id {types}")
    return ranked.join(F.broadcast(names), "item").select(
        "item_id", "rank", F.when(F.col("doc_id") > -(2**63), F.col("doc_id")).alias("doc_id"), "score"
    )


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of ``docs`` (doc_id, text) for each item of ``items`` (item_id, text).

    Terms, weights and scores are those of op12's contract, over whole texts. Documents become sparse vectors over the terms of the items: the others add
    nothing to a product. Each task cuts its documents into shards, builds a ball tree for each, and carries every item's kth score from shard
    to shard; at most ``k`` rows an item and task are ranked. Items are asked in blocks of ``block_items`` rows and about ``block_bytes`` of text, each with a
    pass over the documents, so what is sent to tasks doesn't grow with either table.

    Null and empty texts have no terms: such a document isn't counted, such an item has no rows; nor has an item without
    any document above 0. Equal scores go by ascending doc_id, null first. A repeated document is listed as often as it occurs; an
    item repeated with its text is asked once, with another text again. An empty table gives no rows; other columns are not read.
    """
    asked = items.select("item_id", "text").distinct().withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)))
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-size // block_bytes))
    types = dict(items.dtypes)["item_id"]
    found = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select("item_id", "text").collect()
        if own:
            ranked = _rank_block(docs, [tuple(row) for row in sorted(own, key=repr)], types, k)
            found = ranked if found is None else found.union(ranked)
    if found is None:
        found = docs.sparkSession.createDataFrame([], f"item_id {types}, rank int, doc_id bigint, score bigint")
    kind = dict(docs.dtypes)["doc_id"]
    return found if kind == "bigint" else found.withColumn("doc_id", F.col("doc_id").cast(kind))
