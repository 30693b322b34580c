"""Whitening, ranked search and token counts against brute-force versions, and their edge cases."""

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimscope.llm import balltree, tokens, whitening

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id bigint, embedding array<double>, block int, n string, whole double"
DOCS = "doc_id bigint, text string, n int, terms string, score double, rank int"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def by_component(frame):
    rows = sorted(frame.collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"], r["component"]))
    k = max(r["component"] for r in rows)
    return rows, np.array([np.nan if r["whitened"] is None else r["whitened"] for r in rows]).reshape(-1, k)


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_whitening_is_that_of_numpy(spark, block_rows):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    local = sorted(table.select("vec_id", "embedding").collect())
    x = np.floor(1024 * np.array([r["embedding"] for r in local], float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    covariance = centred.T @ centred / n
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1][:8], directions[:, ::-1][:, :8]
    expected = centred @ directions / np.sqrt(values)
    rows, found = by_component(whitening.whiten(table, block_rows=block_rows))
    assert len(rows) == 8 * n and {r["n"] for r in rows} == {n}
    assert np.abs(found * np.sign((found * expected).sum(axis=0)) - expected).max() < 1e-9
    assert [r["deviation"] for r in rows[::8]] == [sum(int(v) ** 2 for v in row) for row in (n * x - sums)]
    assert np.allclose([r["explained"] for r in rows[:8]], values / np.trace(covariance), rtol=1e-9)
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


def test_whitening_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (None, [0.5, 2.0, 1.0]), (4, None), (5, []), (6, [1.0, None, 2.0]), (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]),
        (9, [1.0]), (10, [1e30, 0.0, 0.0]), (11, [3.0, 1.0, 1.0]), (12, [4.0, -9.0, 2.0]), (13, [7.0, 1.0, -3.0]),
    ]
    frame = spark.createDataFrame([(*r, 1, "x", 1.0) for r in rows], VECTORS)
    found = whitening.whiten(frame, block_rows=2).collect()
    assert Counter(r["vec_id"] for r in found) == {1: 6, None: 3, 9: 1, 11: 3, 12: 3, 13: 3}
    alone = next(r for r in found if r["vec_id"] == 9)  # the only vector of its length: no variance
    assert (alone["n"], alone["deviation"], alone["whitened"], alone["explained"], alone["identity_error"]) == (1, 0, None, None, None)
    assert all(r["n"] == 6 and r["identity_error"] < 1e-9 for r in found if r["vec_id"] != 9)
    # Three rows span two directions.
    flat = whitening.whiten(spark.createDataFrame([(*r, 1, "x", 1.0) for r in [rows[0], rows[10], rows[11]]], VECTORS)).collect()
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: False, 3: True}
    # Numbers whose squares pass a long: no deviation, but coordinates.
    wide = whitening.whiten(spark.createDataFrame([(1, [2.0**51, 0.0], 1, "x", 1.0), (2, [-(2.0**51), 1.0], 1, "x", 1.0)], VECTORS)).collect()
    assert all(r["deviation"] is None for r in wide) and all(abs(abs(r["whitened"]) - 1) < 1e-9 for r in wide if r["component"] == 1)
    assert whitening.whiten(frame.limit(0)).count() == 0
    assert whitening.whiten(frame.select(F.col("vec_id").cast("int").alias("vec_id"), "embedding")).dtypes[0] == ("vec_id", "int")


def test_exact_deviations_beyond_doubles():
    rng = np.random.default_rng(3)
    whole = rng.integers(-(2**50), 2**50, (20, 3))
    sums = whole.astype(object).sum(axis=0)
    away = whitening._away(whole, 20, sums)
    assert [[int(x) for x in row] for row in away] == [[20 * int(x) - int(s) for x, s in zip(row, sums)] for row in whole]
    squares = [sum((20 * int(x) - int(s)) ** 2 for x, s in zip(row, sums)) for row in whole]
    assert whitening._deviations(away) == [x if x < 2**63 else None for x in squares]


def brute_ranks(docs, items, k=10):
    docs = [(name, Counter(balltree.terms_of(text))) for name, text in docs]
    docs = [(name, terms, sum(terms.values())) for name, terms in docs if terms]
    total, holders = sum(n for *_, n in docs), Counter(t for _, terms, _ in docs for t in terms)
    found = []
    for item, text in {*items}:
        scored = []
        for name, terms, n in docs:
            m = 25 + 75 * n * len(docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * holders[t] + 1))) * (1_000_000_000 * terms[t] // (1000 * terms[t] + 8 * m))
                for t in balltree.terms_of(text) if t in terms
            )
            if score > 0:
                scored.append((-score, name is not None, name or 0, name))
        found += [(item, rank, name, -score) for rank, (score, _, _, name) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found, key=repr)


def test_ranks_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(balltree, "SHARD_ROWS", 100)
    docs, items = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "benchmark"))
    expected = brute_ranks([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert sorted(map(tuple, balltree.rank_documents(docs, items).collect()), key=repr) == expected
    # In several blocks of items; each block has its own passes over the documents.
    assert sorted(map(tuple, balltree.rank_documents(docs, items, block_items=15).collect()), key=repr) == expected


def test_terms_of_a_text():
    assert balltree.terms_of("Ärger, it's 3,5\x7f\x00ÀB c\n_d-E`f{G} ") == [t.encode() for t in ["Ärger", "it", "s", "3", "5", "Àb c", "d", "e", "f", "g", " "]]
    assert balltree.terms_of(None) == balltree.terms_of(" \t.!") == []


def test_rank_edges(spark):
    docs = [
        (1, "Alpha beta gamma"), (1, "Alpha beta gamma"), (2, "alpha BETA gamma"), (None, "alpha beta gamma"), (3, None), (4, ""), (5, "..."), (6, "delta " * 200_000),
        (7, "beta beta"), *[(100 + i, "filler words only") for i in range(30)],
    ]
    items = [(1, "alpha, gamma!"), (1, "alpha, gamma!"), (2, None), (3, "nothing known"), (4, "delta"), (None, "beta"), (5, "beta beta alpha")]
    frame = spark.createDataFrame([(*r, 1, "x", 1.0, 2) for r in docs], DOCS)
    asked = spark.createDataFrame([(*r, 1, "x", 1.0, 2) for r in items], DOCS.replace("doc_id", "item_id"))
    found = sorted(map(tuple, balltree.rank_documents(frame, asked, k=4).collect()), key=repr)
    assert found == brute_ranks(docs, items, k=4)
    assert [r[2] for r in found if r[0] == 1] == [None, 1, 1, 2]
    assert balltree.rank_documents(frame.limit(0), asked).count() == balltree.rank_documents(frame, asked.limit(0)).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    weights = rng.integers(1, 5000, 40)
    # Groups of rows near each other, and one group of equal rows.
    lines = [rng.permutation(40)[:6] for _ in range(20)]
    terms = np.concatenate([np.sort(lines[i % 20]) for i in range(2000)]).astype(np.int32)
    values = np.concatenate([rng.integers(900_000, 1_000_000, 6) if i % 20 else np.full(6, 950_000) for i in range(2000)])
    rows = balltree.Rows(np.arange(2001) * 6, terms, values)
    names, roots = np.arange(2000), np.sqrt(weights)
    tree = balltree.build(names, rows, roots)
    assert sorted(tree.names.tolist()) == names.tolist()
    opened = 0
    for line in lines:
        asked = np.zeros(40, np.int64)
        asked[line] = weights[line]
        scores = rows.products(asked, 0, 2000)
        query = np.zeros(40)
        query[line] = roots[line]
        bounds = tree.bounds(query, 1e-12)
        in_tree = tree.rows.products(asked, 0, 2000)
        for level in range(tree.levels):
            for i in range(1 << level):
                assert in_tree[2000 * i >> level:2000 * (i + 1) >> level].max() <= bounds[(1 << level) - 1 + i]
        best = balltree.Best(5, np.zeros(0, np.int64), np.zeros(0, np.int64))
        opened += balltree.search(tree, np.sort(line), np.ones(6, np.int64), weights, best)
        order = np.lexsort((names, -scores))[:5]
        assert best.names.tolist() == names[order].tolist() and best.scores.tolist() == scores[order].tolist()
    assert opened < 0.5 * 20 * (1 << (tree.levels - 1))


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.load(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def library_counts(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts_are_those_of_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r["doc_id"]: r for r in tokens.count_tokens(docs, VOCABULARY).collect()}
    local = docs.select("doc_id", "text").collect()
    assert len(found) == len(local)
    for row, n in zip(local, library_counts(library, [r["text"] for r in local])):
        got = found[row["doc_id"]]
        assert (got["n_tokens"], got["n_bytes"], got["over_limit"]) == (n, len((row["text"] or "").encode()), n > 512)


@pytest.mark.parametrize("small", [False, True])
def test_hostile_texts(vocabulary, library, monkeypatch, small):
    if small:  # portions, chunks and long pre-tokens at small sizes
        for name, value in (("CHUNK_CHARS", 40), ("PORTION_CHARS", 500), ("LONG_SYMBOLS", 6)):
            monkeypatch.setattr(tokens, name, value)
    rng = random.Random(11)
    texts = ["", None, "a", "aaaa" * 700, "<|endoftext|>x<|endoftext|><|endoftext|> y <|endof", "don't we'll 'S '", " \n\n  x \t", "x\x1c\x1d\x85  y", "ACGT" * 3]
    alphabets = ["ab ", "abcdefghij  '\n", "éèñ 中文字 a1٣", "՘࢏\U00010940\U00018d80 a1!  ", [chr(x) for x in range(32, 3000)]]
    texts += ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice([3, 30, 300]))) for _ in range(600)]
    texts.append("".join(rng.choice("ACGT") for _ in range(20_000)))
    assert tokens.TokenCounter(vocabulary).count(texts).tolist() == library_counts(library, texts)


def test_every_character(vocabulary, library):
    texts = [
        "".join(f"a{chr(c)}b 1{chr(c)}1 {chr(c)}{chr(c)}  {chr(c)}!" for c in range(start, start + 2048) if not 0xD800 <= c < 0xE000)
        for start in range(0, 0x110000, 2048)
    ]
    assert tokens.TokenCounter(vocabulary).count(texts).tolist() == library_counts(library, texts)


def test_token_edges(spark, tmp_path, library):
    rows = [(1, "some words"), (1, "some words"), (None, "x"), (2, None), (3, ""), (4, "long text " * 100_000), (5, "z" * 300_000)]
    frame = spark.createDataFrame([(*r, 1, "x", 1.0, 2) for r in rows], DOCS)
    found = sorted((r["doc_id"] or 0, r["n_tokens"], r["n_bytes"]) for r in tokens.count_tokens(frame, VOCABULARY, limit=2).collect())
    expected = library_counts(library, [t for _, t in rows])
    assert found == sorted((i or 0, n, len(t or "")) for (i, t), n in zip(rows, expected))
    assert tokens.count_tokens(frame.limit(0), VOCABULARY).count() == 0
    other = tmp_path / "other.json"
    other.write_text('{"model": {"type": "WordPiece"}}')
    with pytest.raises(ValueError, match="byte-level"):
        tokens.load(str(other))
