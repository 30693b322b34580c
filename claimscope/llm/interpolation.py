"""Language-model scores by deleted interpolation of word bigrams, word counts and a uniform share.

P(w | h) = l2(b) c(h, w) / c(h) + l1(b) c(w) / N + l0(b) / (V + 1), where b is the bucket of c(h), a power of two. The weights are
learned by expectation-maximisation on held-out counts: each training event is judged by the counts that are left
when it is taken out of them itself.

Texts are read once, in blocks of some megabytes. A block asks for the corpus counts of its distinct words and bigrams, which
are dealt by ranges of their hashes, so a frequent word is one request per block and not one per occurrence; no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import fold, written

BLOCK_BYTES = 2 << 20
ROUNDS = 30  # of expectation-maximisation, over a histogram of bounded size
STEP = 2.0  # cells of the histogram per doubling of a probability
BUCKETS = 40
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(32)
START, END = np.uint64(0x51A7), np.uint64(0xE17D)

_BLOCK = "block bigint, tokens binary, vocab binary, ids array<string>, held array<boolean>, lengths array<int>"


def _squeezed(body: bytes) -> bytes:
    return pa.compress(body, codec="zstd", asbytes=True)


def _expanded(body: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(body, decompressed_size=size, codec="zstd", asbytes=True), np.uint8)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of texts as numbers of their own word list; the list holds a 64-bit hash of each word."""
    first, count = TaskContext.get().partitionId() << 24, 0
    numbers: dict[bytes, int] = {}
    tokens: list[np.ndarray] = []
    rows: list[tuple] = []
    size = 0

    def block() -> pd.DataFrame:
        vocab = np.fromiter((xxhash.xxh64_intdigest(word) for word in numbers), np.uint64, len(numbers))
        body = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
        return pd.DataFrame({
            "block": [first + count], "tokens": [_squeezed(body.view(np.uint8).reshape(-1, 4).T.tobytes())], "vocab": [vocab.tobytes()],
            "ids": [[row[0] for row in rows]], "held": [[row[1] for row in rows]], "lengths": [[row[2] for row in rows]],
        })

    for batch in batches:
        for doc_id, text, held in zip(batch["doc_id"], batch["text"], batch["held"], strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            tokens.append(np.array([numbers.setdefault(word, len(numbers)) for word in words], np.int32))
            rows.append((doc_id, bool(held), len(words)))
            size += len(text or "") + 8
            if size >= BLOCK_BYTES:
                yield block()
                numbers, tokens, rows, size, count = {}, [], [], 0, count + 1
    if rows:
        yield block()


def _events(tokens: bytes, vocab: bytes, held: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: word numbers (-1 for the end), distinct bigram keys, the bigram of each event, and which events train."""
    planes, hashes = _expanded(tokens, 4 * int(lengths.sum())).reshape(4, -1), np.frombuffer(vocab, np.uint64)
    body = np.ascontiguousarray(planes.T).view(np.int32).ravel()
    ends = np.cumsum(lengths + 1) - 1
    words = np.full(len(body) + len(lengths), -1, np.int32)
    inside = np.ones(len(words), bool)
    inside[ends] = False
    words[inside] = body
    now = np.where(inside, hashes[np.where(inside, words, 0)], END) if len(hashes) else np.full(len(words), END)
    before = np.concatenate([[START], now[:-1]]).astype(np.uint64)
    before[ends[:-1] + 1] = START
    key = before * _A + now * _B
    key = (key ^ (key >> _C)) * _A
    keys, event = np.unique(key ^ (key >> _C), return_inverse=True)
    return words, keys, event, np.repeat(~held, lengths + 1)


def _dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, and where each non-empty part starts in that order; a part is a range of keys, which lie closer together than all."""
    order = np.argsort(keys, kind="stable")
    part = ((keys[order] >> _C) * np.uint64(parts) >> _C).astype(np.int64)
    present, starts = np.unique(part, return_index=True)
    return order, present, starts


def _planes(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte: the leading bytes are alike, and compress."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _keys(body: bytes) -> np.ndarray:
    planes = np.frombuffer(body, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _requests(parts: int):
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                words, keys, event, train = _events(row.tokens, row.vocab, np.asarray(row.held, bool), np.asarray(row.lengths, np.int64))
                vocab = np.frombuffer(row.vocab, np.uint64)
                own = np.bincount(words[train & (words >= 0)], minlength=len(vocab))
                for kind, asked, counts in ((1, vocab, own), (2, keys, np.bincount(event, weights=train, minlength=len(keys)))):
                    order, present, starts = _dealt(asked, parts)
                    packed = [_packed(x) for x in np.split(counts[order].astype(np.int64), starts[1:])][: len(present)]
                    yield pd.DataFrame({
                        "part": present, "kind": kind, "block": row.block,
                        "keys": [_planes(x) for x in np.split(asked[order], starts[1:])][: len(present)],
                        "small": [x[0] for x in packed], "large": [x[1] for x in packed],
                    })

    return ask


def _packed(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as bytes, compressed; those from 255 on follow apart."""
    return _squeezed(np.minimum(counts, 255).astype(np.uint8).tobytes()), counts[counts >= 255].astype(np.int64).tobytes()


def _unpacked(small: bytes, large: bytes, size: int) -> np.ndarray:
    counts = _expanded(small, size).astype(np.int64)
    counts[counts == 255] = np.frombuffer(large, np.int64)
    return counts


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """Corpus counts for all requests of one part and kind."""
    keys = np.concatenate([_keys(body) for body in rows["keys"]])
    sizes = [len(body) // 8 for body in rows["keys"]]
    counts = np.concatenate([_unpacked(*reply) for reply in zip(rows["small"], rows["large"], sizes, strict=True)])
    distinct, place = np.unique(keys, return_inverse=True)
    total = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)
    cuts = np.cumsum(sizes)[:-1]
    replies = [_packed(x) for x in np.split(total[place], cuts)]
    known = np.zeros(len(rows), np.int64)
    known[0] = np.count_nonzero(total) if rows["kind"].iloc[0] == 1 else 0
    return pd.DataFrame({
        "block": rows["block"].to_numpy(), "kind": rows["kind"].to_numpy(), "part": rows["part"].to_numpy(),
        "small": [x[0] for x in replies], "large": [x[1] for x in replies], "known": known,
    })


def _counted(parts: int, train_docs: int):
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["kind"] == 0].iloc[0]
        lengths = np.asarray(own["lengths"], np.int64)
        words, keys, event, _ = _events(own["small"], own["large"], np.asarray(own["held"], bool), lengths)
        found = []
        for kind, asked in ((1, np.frombuffer(own["large"], np.uint64)), (2, keys)):
            order, _, starts = _dealt(asked, parts)
            sizes = np.diff(starts, append=len(asked)).tolist()
            replies = rows[rows["kind"] == kind].sort_values("part")
            counts = np.zeros(len(asked), np.int64)
            if len(asked):
                counts[order] = np.concatenate([_unpacked(*reply) for reply in zip(replies["small"], replies["large"], sizes, strict=True)])
            found.append(counts)
        word_counts = np.append(found[0], train_docs)[words]  # -1, the end, reads the last entry
        ends = np.cumsum(lengths + 1)[:-1]
        return pd.DataFrame({
            "doc_id": list(own["ids"]), "held_out": np.asarray(own["held"], bool),
            "words": np.split(word_counts, ends), "pairs": np.split(found[1][event], ends),
        })

    return merge


def counted(docs: DataFrame, folds: int = 10) -> DataFrame:
    """(doc_id, held_out, words, pairs): the training counts of each token of each text, and of its bigram; and totals.

    Returns the written table and (N, V, number of training texts).
    """
    rows = docs.select(F.col("doc_id").cast("string"), "text", (fold(F.col("doc_id"), folds) == 0).alias("held"))
    blocks = written(rows.mapInPandas(_blocks, _BLOCK))
    sums = blocks.select("block", F.explode(F.arrays_zip("held", "lengths")).alias("x")).agg(
        F.count_distinct("block").alias("blocks"), F.count_if(~F.col("x.held")).alias("docs"),
        F.sum(F.when(~F.col("x.held"), F.col("x.lengths") + 1).otherwise(0)).alias("tokens"),
    ).first()
    train_docs, tokens = sums["docs"], sums["tokens"] or 0
    parts = max(32, sums["blocks"])
    replies = written(
        blocks.mapInPandas(_requests(parts), "part int, kind int, block bigint, keys binary, small binary, large binary")
        .groupBy("part", "kind").applyInPandas(_answer, "block bigint, kind int, part int, small binary, large binary, known bigint")
    )
    vocabulary = (replies.agg(F.sum("known")).first()[0] or 0) + (train_docs > 0)
    own = blocks.select(
        "block", F.lit(0).alias("kind"), F.lit(0).alias("part"), F.col("tokens").alias("small"), F.col("vocab").alias("large"), "ids", "held", "lengths"
    )
    answers = replies.select("block", "kind", "part", "small", "large", *[F.lit(None).cast(dict(own.dtypes)[c]).alias(c) for c in ("ids", "held", "lengths")])
    events = own.union(answers).groupBy("block").applyInPandas(
        _counted(parts, train_docs), "doc_id string, held_out boolean, words array<bigint>, pairs array<bigint>"
    )
    return written(events), (tokens, vocabulary, train_docs)


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the whole part of the logarithm to base two."""
    return np.where(context > 0, np.minimum(np.floor(np.log2(np.maximum(context, 1))).astype(int) + 1, BUCKETS - 1), 0)


def _context(words: np.ndarray, train_docs: int) -> np.ndarray:
    return np.concatenate([[train_docs], words[:-1]])


def _share(part: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=np.broadcast_to(np.asarray(whole) > 0, part.shape), casting="unsafe")


def learn_weights(events: DataFrame, totals: tuple[int, int, int]) -> np.ndarray:
    """Weights (bucket; bigram, word, uniform) by expectation-maximisation on all training events.

    Each event is taken out of its own counts. Events gather in cells (bucket, bigram share, word share), half a doubling wide,
    so the driver gets a table of bounded size from any corpus.
    """
    tokens, vocabulary, train_docs = totals

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, int] = {}
        for batch in batches:
            if not len(batch):
                continue
            words = np.concatenate([np.asarray(x, np.int64) for x in batch["words"]])
            pairs = np.concatenate([np.asarray(x, np.int64) for x in batch["pairs"]])
            context = np.concatenate([_context(np.asarray(x, np.int64), train_docs) for x in batch["words"]]) - 1
            grid = [_bucket(context)]
            for share in (_share(pairs - 1, context), _share(words - 1, tokens - 1)):
                scaled = np.log2(np.maximum(share * (vocabulary + 1), 2.0**-40)) * STEP
                grid.append(np.where(share > 0, np.clip(np.round(scaled) + 200, 1, 399), 0).astype(int))
            key, n = np.unique((grid[0] * 400 + grid[1]) * 400 + grid[2], return_counts=True)
            for k, v in zip(key.tolist(), n.tolist(), strict=True):
                sums[k] = sums.get(k, 0) + v
        yield pd.DataFrame({"cell": list(sums), "n": list(sums.values())}, dtype="int64")

    found = events.where("not held_out").select("words", "pairs").mapInPandas(cells, "cell bigint, n bigint")
    table = found.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    cell, n = table["cell"].to_numpy(np.int64), table["n"].to_numpy(float)
    shares = [np.where(x > 0, 2.0 ** ((x - 200) / STEP), 0.0) for x in (cell // 400 % 400, cell % 400)]
    given = np.stack([*shares, np.ones(len(cell))], axis=1)
    for bucket in np.unique(cell // 160_000):
        rows, own = given[cell // 160_000 == bucket], n[cell // 160_000 == bucket]
        mix = np.array([0.0 if bucket == 0 else 0.5, 0.4, 0.1])
        for _ in range(ROUNDS):
            mix = mix / mix.sum()
            odds = rows * mix
            gain = (odds / odds.sum(axis=1, keepdims=True) * own[:, None]).sum(axis=0)
            mix = gain + np.array([float(bucket > 0), 1.0, 1.0])  # one more event each: no part is ruled out
        weights[bucket] = mix / mix.sum()
    for bucket in range(2, BUCKETS):  # a bucket without events of its own takes the weights of the one below
        if not (cell // 160_000 == bucket).any():
            weights[bucket] = weights[bucket - 1]
    return weights


def score(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Scores for every row of ``docs`` (doc_id, text), whole texts, as the contract of op3 names the columns.

    Learns from the rows whose crc32 of doc_id as text is not 0 modulo ``folds``; a null doc_id counts as empty text. A null
    or empty text is its end alone. Repeated rows count as often as they occur. Without training rows every token is
    unknown and has probability one. No rows give no rows; other columns are not read. Two words with the same 64-bit hash would
    count as one (about one pair at a billion different words).
    """
    events, totals = counted(docs, folds)
    tokens, vocabulary, train_docs = totals
    weights = learn_weights(events, totals)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for words, pairs in zip(batch["words"], batch["pairs"], strict=True):
                words, pairs = np.asarray(words, np.int64), np.asarray(pairs, np.int64)
                context = _context(words, train_docs)
                mix = weights[_bucket(context)]
                chance = mix[:, 0] * _share(pairs, context) + mix[:, 1] * _share(words, tokens) + mix[:, 2] / (vocabulary + 1)
                base = np.log10((words + 0.1) / (tokens + 0.1 * (vocabulary + 1)))
                rows.append((len(words), int((words > 0).sum()), float(base.sum()), float(np.log10(chance).sum())))
            out = pd.DataFrame(rows, columns=["n_tokens", "n_known", "base_score", "score"])
            yield out.assign(doc_id=batch["doc_id"].to_numpy(), held_out=batch["held_out"].to_numpy(), train_tokens=tokens)

    scored = events.mapInPandas(
        judge, "doc_id string, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )
    return scored.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]))
