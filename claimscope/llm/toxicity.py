"""Toxicity by a convolutional text classifier: hashed word embeddings, several filter widths, max pooling, trained in numpy
by tasks that each learn from a part of all labelled texts, and whose models are averaged."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import fold, written
from claimscope.operators.scale import lookup_join
from claimscope.session import cut_by

# Frequent function words, for telling the language of a text from its words.
FUNCTION_WORDS = {
    "en": "the of and to is that it with for this are was",
    "de": "der die und den das nicht ist ein mit von sich zu",
    "fr": "le les des et du un est dans pour que pas sur",
    "es": "el los y que las del se por con una para no",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
_LANGUAGE_OF = {word.encode(): [k for k, words in enumerate(FUNCTION_WORDS.values()) if word in words.split()] for word in " ".join(FUNCTION_WORDS.values()).split()}
# Letters and digits stay, other ASCII becomes space; bytes of longer characters stay.
_KEEP = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
WIDTHS = (1, 2, 3)
STRIDE = 1 << 16  # words that are scored at once
LINES = 1 << 12  # words whose table rows are added up at once
SHARD_CHARS = 1 << 25  # a task learns from about this much text between two averages
SLOTS = 1 << 10  # rows of the embedding that are averaged together
FEW = 10
LOGIT_BINS = 100  # calibration counts scores by logits of two decimals


@dataclass
class Settings:
    """Shape of the model, and how it is trained. No number of texts or length of a text bounds what is learnt from."""

    calibration_share: float = 0.2  # of the labelled training texts: these choose the thresholds, all others fit the model
    buckets: int = 1 << 16
    size: int = 10
    filters: int = 10
    epochs: int = 5
    least_steps: int = 400  # few texts get more epochs, up to so many minibatches
    batch: int = 32
    rate: float = 0.05
    spread: float = 0.01  # of the first embeddings
    seed: int = 7


@dataclass
class Model:
    settings: Settings
    embedding: np.ndarray
    kernels: list[np.ndarray]  # per width: (width, size, filters)
    weights: np.ndarray
    bias: float
    shift: dict[str, float] = field(default_factory=dict)  # per language: the calibrated threshold, as a logit


@dataclass
class State:
    """A model in training: its numbers, Adagrad's sums of squares, and how many minibatches touched each row of the embedding."""

    values: list[np.ndarray]  # the embedding, a kernel per width, weights, bias
    sums: list[np.ndarray]
    touched: np.ndarray


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_KEEP).split()


def language(words: list[bytes]) -> str:
    """The language with most function words in the text; without any, or at a tie, "other"."""
    found = [0] * len(FUNCTION_WORDS)
    for word in words:
        for k in _LANGUAGE_OF.get(word, ()):
            found[k] += 1
    best = max(found)
    return LANGUAGES[found.index(best)] if best and found.count(best) == 1 else "other"


def word_rows(word: bytes, buckets: int) -> tuple[int, int, int]:
    """Rows of the embedding that a word adds up: the word's own, and those of its first four and six bytes."""
    return (
        xxhash.xxh64_intdigest(word, 1) % buckets, xxhash.xxh64_intdigest(word[:4], 2) % buckets, xxhash.xxh64_intdigest(word[:6], 3) % buckets,
    )


class Indexer:
    """Numbers of words in order of appearance, with their embedding rows."""

    def __init__(self, buckets: int) -> None:
        self.numbers: dict[bytes, int] = {}
        self.buckets = buckets

    def __call__(self, words: list[bytes]) -> np.ndarray:
        numbers = self.numbers
        return np.array([numbers.setdefault(word, len(numbers)) for word in words], np.int32)

    def rows(self) -> np.ndarray:
        return np.array([word_rows(word, self.buckets) for word in self.numbers], np.int32).reshape(-1, 3)


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def encode(texts: Iterable[str | None], settings: Settings) -> tuple[list[np.ndarray], list[str]]:
    """Per text, the three embedding rows of each of its words, and its language. Words are let go text by text."""
    indexer = Indexer(settings.buckets)
    numbers, spoken = [], []
    for text in texts:
        words = words_of(text)
        numbers.append(indexer(words))
        spoken.append(language(words))
    rows = indexer.rows()
    return [rows[own] for own in numbers], spoken


def _padded(rows: np.ndarray, settings: Settings) -> np.ndarray:
    """With three rows of padding, so that no window spans two texts; the embedding's last row stays zero."""
    return np.concatenate([rows.reshape(-1, 3).astype(np.int32), np.full((3, 3), settings.buckets, np.int32)])


def first_state(settings: Settings) -> State:
    s, rng = settings, np.random.default_rng(settings.seed)
    embedding = rng.normal(0, s.spread, (s.buckets + 1, s.size)).astype(np.float32)
    embedding[-1] = 0
    kernels = [rng.normal(0, 0.5 / np.sqrt(w), (w, s.size, s.filters)).astype(np.float32) for w in WIDTHS]
    values = [embedding, *kernels, rng.normal(0, 0.3, len(WIDTHS) * s.filters), np.zeros(1)]
    return State(values, [np.full(x.shape, 1e-6, x.dtype) for x in values], np.zeros(s.buckets + 1))


def pooled(state: State, texts: Sequence[np.ndarray], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(texts, filters of all widths): the largest value of each filter over the whole text, and the word of the text where it lies.

    At most about ``STRIDE`` words have their vectors at once; longer texts are taken in pieces that overlap.
    """
    filters = settings.filters
    best = np.full((len(texts), len(WIDTHS) * filters), -np.inf, np.float32)
    where = np.zeros(best.shape, np.int64)
    pieces: list[tuple[int, int, np.ndarray]] = []
    held = 0

    def flush() -> None:
        flat = np.concatenate([piece for _, _, piece in pieces])
        vectors = state.values[0][flat].sum(axis=1)
        outs = []
        for kernel in state.values[1 : 1 + len(WIDTHS)]:
            n = len(flat) - len(kernel) + 1
            outs.append(sum(vectors[j : j + n] @ kernel[j] for j in range(len(kernel))))
        start = 0
        for text, offset, piece in pieces:
            end = start + max(1, len(piece) - 3)
            for w, out in enumerate(outs):
                own = slice(w * filters, (w + 1) * filters)
                at = out[start:end].argmax(axis=0)
                found = np.take_along_axis(out[start:end], at[None], axis=0)[0]
                larger = found > best[text, own]
                best[text, own] = np.where(larger, found, best[text, own])
                where[text, own] = np.where(larger, at + offset, where[text, own])
            start += len(piece)

    for text, rows in enumerate(texts):
        for cut in range(0, max(1, len(rows) - 3), STRIDE):
            piece = rows[cut : cut + STRIDE + 3]
            if pieces and held + len(piece) > STRIDE:
                flush()
                pieces, held = [], 0
            pieces.append((text, cut, piece))
            held += len(piece)
    if pieces:
        flush()
    return best, where


def chances(state: State, texts: Sequence[np.ndarray], settings: Settings) -> np.ndarray:
    """The uncalibrated logits of padded texts."""
    weights, bias = state.values[-2:]
    parts = [np.maximum(pooled(state, texts[c : c + 64], settings)[0], 0) @ weights + bias for c in range(0, len(texts), 64)]
    return np.concatenate(parts) if parts else np.zeros(0)


def learn(state: State, texts: Sequence[np.ndarray], labels: np.ndarray, importance: np.ndarray, settings: Settings, passes: int, seed: int) -> None:
    """Passes of minibatch Adagrad over padded texts, on weighted logistic loss; ``state`` is changed."""
    s, rng = settings, np.random.default_rng(seed)
    embedding, kernels, (weights, bias) = state.values[0], state.values[1 : 1 + len(WIDTHS)], state.values[-2:]
    for _ in range(passes):
        order = rng.permutation(len(texts))
        for cut in range(0, len(order), s.batch):
            batch = order[cut : cut + s.batch]
            own = [texts[d] for d in batch]
            values, where = pooled(state, own, s)
            flat = np.concatenate(own)
            starts = np.cumsum([0, *[len(rows) for rows in own[:-1]]])
            hidden = np.maximum(values, 0)
            error = (_sigmoid(hidden @ weights + bias) - labels[batch]) * importance[batch] / len(batch)
            back = (error[:, None] * weights) * (values > 0)
            touched, pulls, moved = [], [], []
            for w, kernel in enumerate(kernels):
                part = back[:, w * s.filters : (w + 1) * s.filters].astype(np.float32)
                at = starts[:, None] + where[:, w * s.filters : (w + 1) * s.filters]
                change = np.empty_like(kernel)
                for j in range(len(kernel)):
                    change[j] = np.einsum("dfs,df->sf", embedding[flat[at + j]].sum(axis=2), part)
                    touched.append((at + j).ravel())
                    pulls.append((part[:, :, None] * kernel[j].T[None]).reshape(-1, s.size))
                moved.append(change)
            pull = np.repeat(np.concatenate(pulls), 3, axis=0)
            spots = flat[np.concatenate(touched)].ravel()
            real = spots < s.buckets
            unique, place = np.unique(spots[real], return_inverse=True)
            gathered = np.zeros((len(unique), s.size), np.float32)
            np.add.at(gathered, place, pull[real])
            state.touched[unique] += 1
            state.sums[0][unique] += gathered**2
            embedding[unique] -= s.rate * gathered / np.sqrt(state.sums[0][unique])
            for w, change in enumerate(moved):
                state.sums[1 + w] += change**2
                kernels[w] -= s.rate * 0.3 * change / np.sqrt(state.sums[1 + w])
            for x, total, change in ((weights, state.sums[-2], hidden.T @ error + 1e-4 * weights), (bias, state.sums[-1], error.sum(keepdims=True))):
                total += change**2
                x -= s.rate * change / np.sqrt(total)


def calibrated(state: State, settings: Settings, chance: np.ndarray, labels: np.ndarray, importance: np.ndarray, spoken: np.ndarray) -> Model:
    """The model with one threshold per language; a language with fewer than ten toxic texts gets that of all.

    Few held texts say little about the best cut, so a threshold is drawn towards one half as ``FEW`` toxic texts would draw it.
    """
    model = Model(settings, state.values[0], state.values[1 : 1 + len(WIDTHS)], state.values[-2], float(state.values[-1][0]))
    for name in LANGUAGES:
        own = spoken == name
        if importance[own & (labels > 0)].sum() < 10:
            own = np.ones(len(chance), bool)
        toxic = importance[own & (labels > 0)].sum()
        model.shift[name] = _logit(threshold(chance[own], labels[own], importance[own])) * float(toxic / (toxic + FEW))
    return model


def passes_for(n: int, settings: Settings) -> int:
    return max(settings.epochs, -(-settings.least_steps * settings.batch // max(1, n)))


def train(texts: list[str], labels: np.ndarray, importance: np.ndarray, settings: Settings | None = None) -> Model:
    """Fit on texts at hand; a share of them is held back for the thresholds. ``fit`` does the same in tasks."""
    s = settings or Settings()
    found, spoken = encode(texts, s)
    docs = [_padded(rows, s) for rows in found]
    order = np.random.default_rng(s.seed).permutation(len(docs))
    held, rest = np.split(order, [int(len(docs) * s.calibration_share)])
    state = first_state(s)
    learn(state, [docs[d] for d in rest], labels[rest], importance[rest], s, passes_for(len(rest), s), s.seed)
    chance = _sigmoid(chances(state, [docs[d] for d in held], s))
    return calibrated(state, s, chance, labels[held], importance[held], np.array(spoken)[held])


def threshold(chance: np.ndarray, labels: np.ndarray, importance: np.ndarray) -> float:
    """The cut with the best F1 on weighted rows, in the middle of its gap; one half where a class is absent."""
    if not len(chance) or not labels.any() or labels.all():
        return 0.5
    order = np.argsort(-chance, kind="stable")
    p, y, w = chance[order], labels[order], importance[order]
    hits, taken = np.cumsum(w * y), np.cumsum(w)
    f1 = 2 * hits / (taken + (w * y).sum())
    f1[:-1][p[:-1] == p[1:]] = -1  # equal scores are cut together
    best = int(np.flatnonzero(f1 == f1.max())[0])
    below = p[best + 1] if best + 1 < len(p) else 0.0
    return float((p[best] + below) / 2)


def scorer(model: Model):
    """A function from a series of whole texts to calibrated scores. Each filter is a sum of table look-ups per word."""
    s = model.settings
    tables = np.concatenate([model.embedding @ kernel[j] for kernel in model.kernels for j in range(len(kernel))], axis=1)

    def pool(lines: np.ndarray, words: np.ndarray) -> np.ndarray:
        best = np.full(len(WIDTHS) * s.filters, -np.inf)
        padded = np.concatenate([words, np.full(max(2, 3 - len(words)), len(lines) - 1, np.int32)])
        for cut in range(0, max(1, len(words)), STRIDE):
            part = lines[padded[cut : cut + STRIDE + 2]]
            n, column = len(part) - 2, 0
            for w, width in enumerate(WIDTHS):
                out = 0
                for j in range(width):
                    out = out + part[j : j + n, column : column + s.filters]
                    column += s.filters
                own = slice(w * s.filters, (w + 1) * s.filters)
                best[own] = np.maximum(best[own], out.max(axis=0))
        return best

    def score(texts: pd.Series) -> pd.Series:
        scores = np.empty(len(texts))
        indexer, held, size = Indexer(s.buckets), [], 0

        def flush() -> None:
            rows = indexer.rows()
            lines = np.zeros((len(rows) + 1, tables.shape[1]), tables.dtype)
            for cut in range(0, len(rows), LINES):
                for own in rows[cut : cut + LINES].T:
                    lines[cut : cut + len(own)] += tables[own]
            for at, words, spoken in held:
                logit = float(np.maximum(pool(lines, words), 0) @ model.weights + model.bias)
                scores[at] = _sigmoid(np.array(logit - model.shift[spoken]))

        for at, text in enumerate(texts):
            words = words_of(text)
            held.append((at, indexer(words), language(words)))
            size += len(words)
            if size > 1 << 19:
                flush()
                indexer, held, size = Indexer(s.buckets), [], 0
        flush()
        return pd.Series(scores)

    return score


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings, folds: int) -> DataFrame:
    """Every labelled training text, whole, as (key, toxic, held, chars, spoken, rows); ``rows`` are the words' embedding rows as bytes.

    A document with several labels counts as toxic if one of them is. Held texts choose the thresholds, the others fit the model.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.where(fold(F.col("doc_id"), folds) != 0)

    @F.pandas_udf("rows binary, spoken string")
    def encoded(texts: pd.Series) -> pd.DataFrame:
        rows, spoken = encode(texts, settings)
        return pd.DataFrame({"rows": [own.astype(_kind(settings)).tobytes() for own in rows], "spoken": spoken})

    met = lookup_join(docs.select("doc_id", "text").where(F.col("text").isNotNull()), known, "doc_id", spread_by=["text"])
    share = F.lit(int(1000 * settings.calibration_share))
    return met.select(
        F.concat_ws("|", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")).alias("key"), "toxic",
        (F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(1000)) < share).alias("held"), F.length("text").cast("bigint").alias("chars"), encoded("text").alias("code"),
    ).select("key", "toxic", "held", "chars", "code.spoken", "code.rows")


def _kind(settings: Settings) -> type:
    return np.uint16 if settings.buckets <= 1 << 16 else np.int32


class _Texts(Sequence):
    """Padded texts from their stored rows, each worked out when it is asked for: all at once take twice the rows' memory."""

    def __init__(self, rows: pd.Series, settings: Settings) -> None:
        self.bodies, self.settings = rows.to_list(), settings

    def __len__(self) -> int:
        return len(self.bodies)

    def __getitem__(self, at: int | slice) -> np.ndarray | list[np.ndarray]:
        if isinstance(at, slice):
            return [self[i] for i in range(*at.indices(len(self)))]
        return _padded(np.frombuffer(self.bodies[at], _kind(self.settings)), self.settings)


def _averaged(state: State, shards: DataFrame, settings: Settings, passes: int, seed: int) -> State:
    """``state`` after each shard has learnt from it by itself: a row of the embedding moves by the mean over the minibatches that touched it, all else by the mean over texts.

    The driver gets one state, whatever the number of shards; a group has ``SLOTS`` rows of each.
    """
    s = settings
    shared = shards.sparkSession.sparkContext.broadcast(state)
    dense = [(x.shape, x.size) for x in state.values[1:]]

    def study(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        before = shared.value
        own = State([x.copy() for x in before.values], [x.copy() for x in before.sums], np.zeros(len(before.touched)))
        rows = rows.sort_values("key")
        learn(own, _Texts(rows["rows"], s), rows["toxic"].to_numpy(float), np.ones(len(rows)), s, passes, seed + key[0])
        moved = np.concatenate([own.values[0] - before.values[0], own.sums[0] - before.sums[0]], axis=1, dtype=np.float32)
        moved *= own.touched[:, None].astype(np.float32)
        found = [
            (at // SLOTS, own.touched[at : at + SLOTS].tobytes(), moved[at : at + SLOTS].astype(float).tobytes())
            for at in range(0, len(moved), SLOTS) if own.touched[at : at + SLOTS].any()
        ]
        rest = np.concatenate([x.ravel() - y.ravel() for x, y in zip(own.values[1:] + own.sums[1:], before.values[1:] + before.sums[1:], strict=True)], dtype=float)
        found.append((-1, np.full(1, float(len(rows))).tobytes(), (rest * len(rows)).tobytes()))
        return pd.DataFrame(found, columns=["block", "weight", "moved"])

    def added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        totals = [sum(np.frombuffer(body) for body in rows[name]) for name in ("weight", "moved")]
        return pd.DataFrame([(key[0], *[total.tobytes() for total in totals])], columns=["block", "weight", "moved"])

    kind = "block int, weight binary, moved binary"
    learnt = shards.groupBy("shard").applyInPandas(study, kind).groupBy("block").applyInPandas(added, kind)
    after = State([x.copy() for x in state.values], [x.copy() for x in state.sums], state.touched)
    for row in learnt.collect():
        weight = np.frombuffer(row["weight"])
        change = np.frombuffer(row["moved"]).reshape(len(weight), -1) / np.maximum(weight, 1)[:, None]
        if row["block"] >= 0:
            at = slice(row["block"] * SLOTS, row["block"] * SLOTS + len(weight))
            after.values[0][at] += change[:, : s.size].astype(np.float32)
            after.sums[0][at] += change[:, s.size :].astype(np.float32)
            continue
        parts = np.split(change[0], np.cumsum([size for _, size in dense * 2])[:-1])
        for x, part in zip(after.values[1:] + after.sums[1:], parts, strict=True):
            x += part.reshape(x.shape).astype(x.dtype)
    shared.unpersist()
    return after


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, folds: int = 5) -> Model | None:
    """The model, learnt from all labelled training texts; None where there is none.

    The texts are dealt to shards of about ``SHARD_CHARS`` and stored as the numbers of their words. In each round every shard learns from the
    round's model in a task of its own, and the changes are averaged; few texts are one shard, with all epochs in one round. Logits
    of the held texts are counted by language and label, and the counts choose the thresholds.
    """
    s = settings or Settings()
    rows = written(training_rows(docs, labels, s, folds))
    sizes = {row["held"]: row for row in rows.groupBy("held").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).collect()}
    if not sizes:
        return None
    own = sizes.get(False, sizes.get(True))  # should all texts be held, they are learnt from as well
    shards = max(1, -(-own["chars"] // SHARD_CHARS))
    dealt = rows.where(F.col("held") == own["held"]).select("key", "toxic", "rows", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"))
    stored = cut_by(dealt, "shard", shards) if shards > 1 else dealt
    passes = passes_for(own["n"], s)
    rounds = 1 if shards == 1 else s.epochs
    state = first_state(s)
    for turn in range(rounds):
        state = _averaged(state, stored, s, -(-passes // rounds), s.seed + 1_000_003 * turn)
    shared = docs.sparkSession.sparkContext.broadcast(state)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            logits = np.clip(chances(shared.value, _Texts(batch["rows"], s), s), -40, 40)
            yield batch[["spoken", "toxic"]].assign(bin=np.round(LOGIT_BINS * logits).astype(int))

    counted = rows.where("held").mapInPandas(judge, "spoken string, toxic int, bin int").groupBy("spoken", "toxic", "bin").agg(F.count(F.lit(1)).alias("n"))
    held = counted.toPandas()  # at most 8001 rows per language and label
    chance = _sigmoid(held["bin"].to_numpy(float) / LOGIT_BINS)
    return calibrated(state, s, chance, held["toxic"].to_numpy(float), held["n"].to_numpy(float), held["spoken"].to_numpy(object))


def with_score(docs: DataFrame, model: Model | None, name: str) -> DataFrame:
    """Add the score of each whole text (null: empty). A null model scores 0."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x size numbers, whatever the corpus
    kept: dict[str, object] = {}

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        if "score" not in kept:
            kept["score"] = scorer(shared.value)
        return kept["score"](texts)

    return docs.withColumn(name, of(F.coalesce(F.col("text"), F.lit(""))))


def classify(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Learns from all labelled rows whose crc32 of doc_id as text is not 0 modulo ``folds``, whatever their number and length. Null and
    empty texts get the score of a text without words; repeated rows stay, each with the same score; a null doc_id is
    scored and never learnt from; without labelled training texts every score is 0; no rows give no rows; other columns are
    not read, and neither lang nor source plays any part: the language of a text is told from its words.
    """
    model = fit(docs, labels, settings, folds)
    scored = with_score(docs.select("doc_id", "text"), model, "score")
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, folds: int = 5) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't call toxic, with the columns of ``docs``; cases as in ``classify``."""
    model = fit(docs, labels, settings, folds)
    rows = docs.select(F.struct("*").alias("_row"), "text")
    return with_score(rows, model, "_score").where(F.col("_score") < 0.5).select("_row.*")
