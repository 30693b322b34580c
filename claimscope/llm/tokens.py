"""Token counts of a byte-level BPE vocabulary: pre-tokens as ragged arrays, merged in rounds of lowest rank."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern by which byte-level pre-tokenizers split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts of ASCII characters alone, where Python's plain classes are quicker.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
# Texts are split piece by piece, and pre-tokens merged, in portions of about these sizes.
CHUNK_CHARS = 1 << 20
PORTION_CHARS = 1 << 22
# Pre-tokens of more symbols keep their pairs listed by rank, so that a round touches only what it changes.
LONG_SYMBOLS = 1024
NONE = np.iinfo(np.int32).max
# A space between two word characters always begins a pre-token.
_SAFE_CUT = re.compile(r"(?<=\w) (?=\w)")


@dataclass
class Vocabulary:
    """What counting needs of a tokenizer file: its merges as arrays, and where its code splits texts."""

    byte_ids: np.ndarray  # the symbol of each byte
    keys: np.ndarray  # left * size + right of each merge, ascending
    ranks: np.ndarray  # the rank of each key
    made: np.ndarray  # the symbol that the merge of each rank makes
    size: int
    special: list[str]
    exceptions: list[tuple[int, int, str]]  # ranges of characters that Python's tables class otherwise, with their class here

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ``NONE`` for a pair without merge."""
        if not len(self.keys):
            return np.full(len(left), NONE, np.int32)
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE).astype(np.int32)


def byte_letters() -> list[str]:
    """The character that stands for each byte in vocabulary files: itself if it can be printed, else one from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(byte) if byte in plain else chr(next(others)) for byte in range(256)]


def _exceptions(pre_tokenizer) -> list[tuple[int, int, str]]:
    """Ranges of characters whose class (L, N, S for space, O for others) differs between Python's tables and the library's.

    Tables of characters are of different years. The library is asked for each character that one of Python's tables has in a class.
    """
    whole = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    ours = np.full(len(whole), "O")
    for kind, pattern in (("L", r"\p{L}+"), ("N", r"\p{N}+"), ("S", r"\s+")):
        for hit in regex.finditer(pattern, whole):
            ours[hit.start():hit.end()] = kind
    named = np.fromiter((unicodedata.category(c)[0] in "LNZ" for c in whole), bool, len(whole))
    asked = np.flatnonzero((ours != "O") | named)
    theirs = np.full(len(asked), "S")
    for kind, first in (("L", "a"), ("N", "1"), ("O", "!")):
        # Characters of a kind go into the pre-token that a character of that kind begins.
        left = np.flatnonzero(theirs == "S")
        text = " ".join(first + whole[i] for i in asked[left])
        begins = np.zeros(len(text) + 1, bool)
        begins[[span[0] for _, span in pre_tokenizer.pre_tokenize_str(text)]] = True
        theirs[left[~begins[1:len(text) + 1:3]]] = kind
    ranges: list[tuple[int, int, str]] = []
    for i in np.flatnonzero(theirs != ours[asked]).tolist():
        c, kind = ord(whole[asked[i]]), str(theirs[i])
        if ranges and ranges[-1][1] == c - 1 and ranges[-1][2] == kind:
            ranges[-1] = (ranges[-1][0], c, kind)
        else:
            ranges.append((c, c, kind))
    return ranges


def load(path: str) -> Vocabulary:
    """Read a tokenizer file of the byte-level BPE kind; one with settings that counting doesn't know is an error."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [name for name in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(name)]
    odd += [name for name in ("normalizer", "truncation", "padding") if spec.get(name)]
    added = spec.get("added_tokens", [])
    odd += [name for token in added for name in ("single_word", "lstrip", "rstrip", "normalized") if token.get(name)]
    if model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or odd:
        raise ValueError(f"{path} isn't a plain byte-level BPE file: {odd or [model.get('type'), split]}")
    vocab = dict(model["vocab"])
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    size = max(vocab.values()) + 1
    left, right = (np.array([vocab[pair[side]] for pair in pairs], np.int64) for side in (0, 1))
    keys = left * size + right
    order = np.argsort(keys)
    return Vocabulary(
        np.array([vocab[c] for c in byte_letters()], np.int32), keys[order], order.astype(np.int32),
        np.array([vocab[a + b] for a, b in pairs], np.int32), size, [token["content"] for token in added],
        _exceptions(Tokenizer.from_file(path).pre_tokenizer),
    )


def _alternate(places: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Of places in order, every other one of each run in which each place's pair overlaps the one before: from the left."""
    at = np.arange(len(places))
    first = np.maximum.accumulate(np.where(follows, 0, at))
    return places[(at - first) % 2 == 0]


def _merge_long(symbols: np.ndarray, vocabulary: Vocabulary) -> int:
    """Symbols left of one long pre-token. Each round applies its lowest-rank pair at all places, found in a list by rank."""
    n = len(symbols)
    symbols, after, before = symbols.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
    rank = np.append(vocabulary.rank_of(symbols[:-1], symbols[1:]), np.int32(NONE))
    waiting: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def wait(places: np.ndarray) -> None:
        order = places[np.argsort(rank[places], kind="stable")]
        values, starts = np.unique(rank[order], return_index=True)
        for value, group in zip(values.tolist(), np.split(order, starts[1:]), strict=True):
            if value == NONE:
                continue
            if value not in waiting:
                waiting[value] = []
                heapq.heappush(heap, value)
            waiting[value].append(group)

    wait(np.arange(n))
    while heap:
        low = heapq.heappop(heap)
        places = np.unique(np.concatenate(waiting.pop(low)))
        places = places[rank[places] == low]
        if not len(places):
            continue
        p = _alternate(places, np.concatenate([[False], after[places[:-1]] == places[1:]]))
        q = after[p]
        symbols[p], rank[q] = vocabulary.made[low], NONE
        after[p] = after[q]
        inner = after[p] < len(symbols)
        before[after[p[inner]]] = p[inner]
        n -= len(p)
        touched = np.unique(np.concatenate([p, before[p][before[p] >= 0]]))
        right = after[touched]
        paired = right < len(symbols)
        rank[touched] = NONE
        rank[touched[paired]] = vocabulary.rank_of(symbols[touched[paired]], symbols[right[paired]])
        wait(touched)
    return n


def merged_lengths(pieces: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
    """Number of symbols of each piece after all merges.

    All pieces lie behind each other in one array. A round finds the lowest rank among each piece's pairs and applies it at all of
    the piece's places at once, from the left where places overlap; pieces without a pair that merges leave the array.
    """
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    symbols = vocabulary.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    result = lengths.copy()
    ends = np.cumsum(lengths)
    for i in np.flatnonzero(lengths > LONG_SYMBOLS).tolist():
        result[i] = _merge_long(symbols[ends[i] - lengths[i]:ends[i]], vocabulary)
    names = np.flatnonzero((lengths > 1) & (lengths <= LONG_SYMBOLS))
    symbols = symbols[np.repeat((lengths > 1) & (lengths <= LONG_SYMBOLS), lengths)]
    sizes = lengths[names]
    owner = np.repeat(np.arange(len(names)), sizes)
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    rank = np.full(len(symbols), NONE, np.int32)
    inside = np.flatnonzero(~last)
    rank[inside] = vocabulary.rank_of(symbols[inside], symbols[inside + 1])
    while len(symbols):
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        low = np.minimum.reduceat(rank, starts)
        going = low < NONE
        if not going.all():
            result[names[~going]] = sizes[~going]
            kept = np.repeat(going, sizes)
            symbols, rank, names, sizes, low = symbols[kept], rank[kept], names[going], sizes[going], low[going]
            if not len(symbols):
                break
        owner = np.repeat(np.arange(len(names)), sizes)
        places = np.flatnonzero(rank == low[owner])
        p = _alternate(places, np.concatenate([[False], np.diff(places) == 1]))
        symbols[p] = vocabulary.made[rank[p]]
        stays = np.ones(len(symbols), bool)
        stays[p + 1] = False
        sizes = sizes - np.bincount(owner[p], minlength=len(names))
        moved = np.cumsum(stays) - 1
        symbols, rank, owner, p = symbols[stays], rank[stays], owner[stays], moved[p]
        changed = np.zeros(len(symbols), bool)
        changed[p] = changed[p[p > 0] - 1] = True
        touched = np.flatnonzero(changed)
        paired = np.zeros(len(touched), bool)
        within = touched + 1 < len(symbols)
        paired[within] = owner[touched[within]] == owner[touched[within] + 1]
        rank[touched] = NONE
        rank[touched[paired]] = vocabulary.rank_of(symbols[touched[paired]], symbols[touched[paired] + 1])
    return result


class _Numbers(dict):
    """Numbers words in order of first sight, and adds up their lengths."""

    chars = 0

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.chars += len(word)
        return number


class TokenCounter:
    """Counts tokens of texts. Holds the distinct pre-tokens of a portion of texts at a time."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.ascii, self.plain = re.compile(ASCII_PATTERN), regex.compile(PATTERN)
        kinds = {kind: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b, k in vocabulary.exceptions if k == kind) for kind in "LNSO"}
        every = "".join(kinds.values())
        self.odd = None
        if every:
            # Characters below the first exception are passed over at the first comparison.
            self.odd = re.compile(f"(?=[\\U{vocabulary.exceptions[0][0]:08x}-\\U0010ffff])[{every}]")
            own = {k: f"[{base}--[{every}]]" if not kinds[k] else f"[[{base}--[{every}]]||[{kinds[k]}]]" for k, base in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s"))}
            spaces, others = own["S"], "".join(f"(?!{own[k]})" for k in "SLN")
            self.exact = regex.compile(
                f"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{own['L']}+| ?{own['N']}+| ?(?:{others}(?s:.))+|{spaces}+(?!(?!{spaces})(?s:.))|{spaces}+"
            )
        self.special = re.compile("|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None

    def _chunks(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > CHUNK_CHARS:
            cut = _SAFE_CUT.search(text, start + CHUNK_CHARS)
            if not cut:
                break
            yield text[start:cut.start()]
            start = cut.start()
        yield text[start:] if start else text

    def count(self, texts: Iterable[str | None]) -> np.ndarray:
        totals: list[int] = []
        words, places, owners = _Numbers(), [], []

        def settle() -> None:
            lengths = merged_lengths([word.encode() for word in words], self.vocabulary)
            for owner, found in zip(owners, places, strict=True):
                totals[owner] += int(lengths[found].sum())
            words.clear()
            words.chars = 0
            places.clear()
            owners.clear()

        for number, text in enumerate(texts):
            totals.append(0)
            if not text:
                continue
            parts = [text]
            if self.special:
                parts = self.special.split(text)
                totals[-1] = len(parts) - 1
            for part in parts:
                pattern = self.ascii if part.isascii() else self.exact if self.odd and self.odd.search(part) else self.plain
                for chunk in self._chunks(part):
                    found = pattern.findall(chunk)
                    places.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                    owners.append(number)
                    if words.chars > PORTION_CHARS:
                        settle()
        settle()
        return np.array(totals, np.int64)


def token_count(text: Column, vocabulary: Vocabulary) -> Column:
    """Tokens of each text under ``vocabulary``, as a bigint column."""

    @F.pandas_udf("bigint")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = TokenCounter(vocabulary)
        for texts in batches:
            yield pd.Series(counter.count(texts))

    return counted(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text), whole texts.

    ``path`` names a tokenizer file of the byte-level BPE kind on the driver; its merges (some megabytes, whatever the input) go to the tasks.
    Counts are those of the tokenizers library without added begin or end: a special token's string inside a text is that one token. A null or empty text has no bytes and no tokens. A very long
    text is split at safe places and counted in portions; only its longest run without such a place is held at once. Repeated rows and
    null ids stay as they are; no rows give no rows; other columns are not read.
    """
    vocabulary = load(path)
    counted = docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), token_count(F.col("text"), vocabulary).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
