"""Operators on documents against brute-force versions, and their edge cases."""

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from claimscope.llm import decontaminate, interpolation, mixing, simhash, toxicity
from claimscope.llm.common import written
from claimscope.llm.components import components
from claimscope.operators import scale

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, score double, _row string"
EDGES = [
    (5, "the same few words here", "en", "a", 1, "x", 1.0, "r"), (5, "the same few words here", "en", "a", 1, "x", 1.0, "r"),
    (7, "The Same few\twords\nhere", "en", "a", 1, None, None, None), (3, None, None, None, None, None, None, None), (4, "", "en", "a", 1, None, None, None),
    (None, "no id", "en", None, 1, None, None, None), (9, "word " * 50_000, "en", "b", 1, None, None, None), (None, None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_components_are_those_of_union_find(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2300)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    found = dict(components(spark.createDataFrame([*links, (None, 1), (5, None)], "a bigint, b bigint")).collect())
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: find(x) for x in linked}


def brute_prints(texts):
    def one(text):
        words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    return [one(text) for text in texts]


def test_simhash_against_brute_force(spark):
    docs = table(spark, "documents").select("doc_id", "text").collect()
    prints = brute_prints([d["text"] for d in docs])
    ids = [d["doc_id"] for d in docs]
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, a in zip(ids, prints):
            for j, b in zip(ids, prints):
                if (a ^ b).bit_count() <= 3 and label[j] > label[i]:
                    label[j], changed = label[i], True
    rows = simhash.near_duplicates(table(spark, "documents")).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {(i, f"{p:016x}", label[i]) for i, p in zip(ids, prints)}


@pytest.mark.parametrize("lanes, radius", [(1, 3), (4, 51)])
def test_tiles_lose_no_link(lanes, radius):
    rng = np.random.default_rng(lanes)
    base = rng.integers(0, 2**63, (60, lanes)).astype(np.uint64)
    flips = [(base[i % 60].copy(), rng.choice(64 * lanes, int(rng.integers(0, radius + 3)), replace=False)) for i in range(1500)]
    for row, bits in flips:
        for bit in bits:
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    prints = np.unique(np.array([row for row, _ in flips]), axis=0)
    prints = prints[np.lexsort(simhash._part_counts(prints).T[::-1])]
    left, right = prints[::2], prints[1::2]
    both = np.concatenate([left, right])
    near = np.bitwise_count(both[:, None] ^ both[None]).sum(axis=2) <= radius
    want = np.triu(near, 1)
    for i, j in ((simhash._compare(left, None, radius)), (simhash._compare(right, None, radius))):
        assert len(i) < len(left) + 1
    links = []
    for a, b, shift in ((left, None, 0), (right, None, len(left)), (left, right, 0)):
        i, j = simhash._compare(a, b, radius)
        links += list(zip(i + shift, j + shift))
    label = simhash._forest(len(both), *map(np.array, zip(*links)))
    true = simhash._forest(len(both), *np.nonzero(want))
    assert dict(zip(*label)) == dict(zip(*true))


def test_simhash_edges(spark, edges, empty):
    rows = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(edges).collect()}
    zero = "0" * 16
    assert simhash.near_duplicates(edges).count() == len(EDGES) and rows[3, zero] == rows[4, zero] == rows[None, zero] == 3
    assert {c for (d, _), c in rows.items() if d in (5, 7)} == {5}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(edges)
    assert kept.columns == edges.columns and simhash.drop_near_duplicates(empty).count() == 0
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, 3), (False, 5), (False, 9), (True, None)]


def test_one_of_each_group_of_near_copies_stays(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    rows, number = [], 0
    for group in range(12):
        base = list(rng.choice(words, 200))
        for copy in range(5):
            text = list(base)
            for place in rng.choice(200, copy, replace=False):
                text[place] = "new"
            rows.append((number, " ".join(text)))
            number += 1
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 60, 5))


def jaccard_groups(texts, shingle=5, similarity=0.8):
    sets = []
    for text in texts:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    low = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if low[i] != low[j] and (a == b or a and b and len(a & b) / len(a | b) >= similarity):
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    return low


def test_near_duplicates_are_those_of_shingle_sets(spark):
    rng = np.random.default_rng(6)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    line, texts = fresh(12), []
    for tail in range(4):  # one line very often, and two different ends
        texts.append(" ".join(line * 60 + fresh(40)))
    base = fresh(6)
    texts += [" ".join(base), " ".join(base[:5]), " ".join(["x", *base[1:]]), "same " * 300, "same " * 7, "other " * 9]
    for size in (5, 8, 60, 200):  # runs that share 0.6 to 0.95 of their shingles
        for share in (0.6, 0.7, 0.75, 0.79, 0.8, 0.85, 0.95):
            own = fresh(size + 4)
            texts += [" ".join(own), " ".join(own + fresh(round(size / share) - size))]
    for _ in range(20):  # exactly 0.8, of four and of five shingles
        own = fresh(8)
        texts += [" ".join(own), " ".join(own + fresh(1))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == sorted(set(jaccard_groups(texts)))


def test_texts_that_are_near_but_not_linked_give_no_square_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base, texts = [f"w{x}" for x in rng.integers(0, 10**9, 200)], []
    for n in [4] * 36 + [1] * 4:  # similarities of about 0.68; the last four are near copies of the first
        text = list(base) if n > 1 else texts[0].split()
        for place in rng.choice(200, n, replace=False):
            text[place] = f"new{len(texts)}"
        texts.append(" ".join(text))
    counts, links = [], simhash.fingerprint_links

    def counted(*args):
        found = links(*args)
        counts.append(found.count())
        return found

    monkeypatch.setattr(simhash, "fingerprint_links", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for nodes in (1024, 8):  # in one part, and in several
        monkeypatch.setattr(simhash, "CLUMP_NODES", nodes, raising=False)
        kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect())
        assert kept == sorted(set(jaccard_groups(texts)))
    assert len(kept) > 20 and all(0 < n < len(texts) for n in counts)


def test_only_texts_with_copies_are_joined(spark, monkeypatch):
    rng = np.random.default_rng(12)
    fresh = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10**9, 40))
    texts = [fresh() for _ in range(300)]
    texts += [texts[0] + " end", texts[1], None, ""]
    rows = [*enumerate(texts), (None, fresh()), (None, texts[2]), (5, texts[5]), (5, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    joined, split = [], scale.split_listed

    def counted(*args):
        likely, others = split(*args)
        joined.append(likely.count())
        return likely, others

    monkeypatch.setattr(scale, "split_listed", counted)
    kept = Counter(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == Counter([*range(300), 302, None])  # 302 and 303 are empty; doc 5 is there once
    assert len(joined) == 1 and joined[0] < 60


def test_a_star_of_many_near_copies_is_verified_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(13)
    base, texts = [f"w{x}" for x in rng.integers(0, 10**9, 300)], []
    for n in range(60):  # the later ones are too far from the first
        text = list(base)
        for place in rng.choice(300, n // 4, replace=False):
            text[place] = f"new{len(texts)}"
        texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(simhash, "CLUMP_NODES", 8)
    kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == sorted(set(jaccard_groups(texts))) and 1 < len(kept) < 50


def test_blocks_of_sets_grow_so_that_their_copies_do_not(spark, monkeypatch):
    copies = [-(-n // simhash.block_side(n, sets=True)) for n in (1, 16_385, 590_000, 2_000_000, 4_000_000)]
    assert copies == [1, 2, 8, 8, 16] and simhash.block_side(590_000, sets=False) == simhash.SIDE
    monkeypatch.setattr(simhash, "SIDE", 4)
    monkeypatch.setattr(simhash, "COPIES", 3)
    rng = np.random.default_rng(14)
    fresh, texts = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)], []
    for share in (0.6, 0.75, 0.79, 0.8, 0.85, 0.95) * 6:
        own = fresh(64)
        texts += [" ".join(own), " ".join(own + fresh(round(60 / share) - 60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == sorted(set(jaccard_groups(texts)))


def test_near_duplicates_of_the_test_table(spark):
    docs = table(spark, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(table(spark, "documents")).collect())
    assert kept == [docs[i]["doc_id"] for i in sorted(set(jaccard_groups([d["text"] for d in docs])))]


def test_scores_against_brute_force(spark):
    docs = table(spark, "documents").select("doc_id", "text").collect()
    words, ones, pairs, total, train = {}, Counter(), Counter(), 0, 0
    for d in docs:
        own = words[d["doc_id"]] = [*(d["text"] or "").encode().lower().split(), None]
        if zlib.crc32(str(d["doc_id"]).encode()) % 10:
            ones.update(own)
            pairs.update(zip(["start", *own], own))
            total, train = total + len(own), train + 1
    events, totals = interpolation.counted(table(spark, "documents"))
    assert totals == (total, len(ones), train)
    weights = interpolation.learn_weights(events, totals)
    assert np.allclose(weights.sum(axis=1), 1) and weights[0, 0] == 0 and (weights[:, 2] > 0).all()
    gained = Counter()
    for r in interpolation.score(table(spark, "documents")).collect():
        own, score = words[r["doc_id"]], 0.0
        base = sum(math.log10((ones[w] + 0.1) / (total + 0.1 * (len(ones) + 1))) for w in own)
        for before, w in zip(["start", *own], own):
            seen = train if before == "start" else ones[before]
            mix = weights[0 if seen == 0 else int(math.log2(seen)) + 1]
            score += math.log10((mix[0] * pairs[before, w] / seen if seen else 0) + mix[1] * ones[w] / total + mix[2] / (len(ones) + 1))
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(ones[w] > 0 for w in own), total)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        gained[r["held_out"]] += r["score"] - r["base_score"]
    assert gained[True] > 0 and gained[False] > 0


def test_written_leaves_no_shuffle_behind(spark):
    count = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    docs = spark.range(1000).repartition(7, "id")
    before = count()
    found = written(docs)
    for _ in range(50):  # files go in the background
        if count() <= before:
            break
        time.sleep(0.1)
    assert count() <= before and found.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_requests_of_counts_are_short():
    rng = np.random.default_rng(15)
    keys, parts = np.unique(rng.integers(0, 2**64, 200_000, np.uint64)), 200
    order, present, starts = interpolation._dealt(rng.permutation(keys), parts)
    assert present.tolist() == list(range(parts)) and len(order) == len(keys)
    ranges = np.split(keys, starts[1:])
    planes = [np.frombuffer(interpolation._planes(x), np.uint8).reshape(8, -1) for x in ranges]
    assert all((interpolation._keys(p.tobytes()) == x).all() for p, x in zip(planes, ranges))
    joined = np.concatenate([p[:, 1:] for p in planes], axis=1)
    assert (joined[6] == 0).mean() > 0.9 and not joined[7].any()  # most take six bytes, but for the first of a part
    counts = rng.choice([0, 1, 2, 255, 70_000], 1000, p=[0.1, 0.85, 0.04, 0.005, 0.005])
    small, large = interpolation._packed(counts)
    assert len(small) < 300 and (interpolation._unpacked(small, large, 1000) == counts).all()
    assert not len(interpolation._unpacked(*interpolation._packed(counts[:0]), 0))


def test_score_edges(spark, edges, empty):
    rows = interpolation.score(edges).collect()
    assert len(rows) == len(EDGES) and all(math.isfinite(r["score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4)} == {1} and {r["n_tokens"] for r in rows if r["doc_id"] == 9} == {50_001}
    assert interpolation.score(empty).count() == 0
    only_held = edges.where("doc_id IS NULL")
    assert {(r["held_out"], r["n_known"], r["train_tokens"], r["score"], r["base_score"]) for r in interpolation.score(only_held).collect()} == {(True, 0, 0, 0.0, 0.0)}


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.01"), table(spark, "labels", "/root/testdata/sf0.01")
    scored = toxicity.classify(docs, labels)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"] and scored.count() == docs.count()
    held = [r for r in scored.join(labels, "doc_id").where("held_out").collect()]
    # The table is small (50 toxic texts in four languages); at sf0.1, 98 of 100 held-out rows are right.
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.85
    clean = docs.select("doc_id", F.lit("xx").alias("lang"), "text", F.lit("q").alias("source"))
    again = {r["doc_id"]: r["score"] for r in toxicity.classify(clean, labels).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"], abs=1e-6) for r in scored.collect())


def test_toxicity_edges(spark, edges, empty):
    labels = spark.createDataFrame([(5, 1, 1), (7, 0, 0), (7, 1, None), (None, 1, 1), (9, 1, 0), (4, 1, 0), (77, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = toxicity.classify(edges, labels).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert {r["score"] for r in toxicity.classify(edges, labels.limit(0)).collect()} == {0.0}
    assert toxicity.classify(empty, labels).count() == 0
    assert toxicity.drop_toxic(edges, labels.limit(0)).collect() == edges.collect()


def test_convolution_is_that_of_the_plain_definition():
    rng = np.random.default_rng(0)
    settings = toxicity.Settings(buckets=64, epochs=1, batch=4)
    texts = [" ".join(rng.choice(["a", "bad", "good", "word", "x"], int(n))) for n in rng.integers(0, 9, 40)]
    labels = np.array(["bad" in t for t in texts], float)
    model = toxicity.train(texts, labels, np.ones(40), settings)
    for text, score in zip(texts, toxicity.scorer(model)(__import__("pandas").Series(texts))):
        words = toxicity.words_of(text)
        rows = [model.embedding[list(toxicity.word_rows(w, 64))].sum(axis=0) for w in words] + [np.zeros(settings.size)] * max(2, 3 - len(words))
        features = []
        for kernel in model.kernels:
            outs = [sum(rows[i + j] @ kernel[j] for j in range(len(kernel))) for i in range(max(1, len(words)))]
            features.append(np.max(outs, axis=0))
        logit = np.maximum(np.concatenate(features), 0) @ model.weights + model.bias - model.shift[toxicity.language(words)]
        assert score == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-5)


def test_threshold_and_language():
    assert toxicity.threshold(np.array([0.9, 0.8, 0.3, 0.2]), np.array([1.0, 1, 0, 0]), np.ones(4)) == pytest.approx(0.55)
    assert toxicity.threshold(np.array([0.4]), np.array([1.0]), np.ones(1)) == 0.5
    assert [toxicity.language(t.encode().split()) for t in ("the cat of", "der und die", "le chat et", "el los y", "", "zzz")] == ["en", "de", "fr", "es", "other", "other"]


ITEM = "What is the total cost when John Smith buys 3 apples for 5 dollars and then 3 pears for 7 dollars in one shop?"


def test_templates_find_the_item_with_other_values(spark):
    docs = spark.createDataFrame([
        (1, "Well. " + ITEM.replace("John Smith", "Mary Jones").replace("3", "12").replace("5 dollars", "9 euros").replace("7 dollars", "4 euros") + " Yes."),
        (2, ITEM.lower().replace("john smith", "John Smith")), (3, ITEM.replace("3 pears", "8 pears")), (4, "Tiny words, here!"), (5, "some tiny words here"), (6, None),
        (None, ITEM), (8, ""), (9, ITEM.split(" buys")[0]), (2, ITEM.lower().replace("john smith", "John Smith")),
    ], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, ITEM), (2, "tiny words here"), (None, ""), (4, None), (1, ITEM)], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): r["n_changed"] for r in decontaminate.leaks(docs, items).collect()}
    assert found == {(1, 1): 8, (2, 1): 0, (4, 2): 0, (None, 1): 0}
    wide = docs.withColumn("hashes", F.lit(1)).withColumn("words", F.lit("w"))
    kept = decontaminate.drop_leaks(wide, items)
    assert kept.columns == wide.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 6, 8, 9]
    assert decontaminate.leaks(docs.limit(0), items).count() == 0 == decontaminate.leaks(docs, items.limit(0)).count()


def test_items_of_names_and_short_items_are_found(spark):
    names = "Guests were Anna Beck, Otto Frey, Paul Weber, Rosa Kern, Emil Vogt, Lena Roth, Karl Busch and Ida Lang."
    short, capital = "what is the capital of France", "They met Anna and Otto and Paul Weber on the way to an old mill by the river."
    items = spark.createDataFrame([(1, names), (2, short), (3, capital), (4, "Anna Beck"), (5, "He had sixteen of them")], "item_id bigint, text string")
    docs = spark.createDataFrame([
        (1, names), (2, "so " + names + " And more."), (3, names.replace("Anna", "Olga")), (4, "Tell me What is the capital of France, if you know."),
        (5, "what is the capital of Spain then"), (6, "After work they met Bob and Jim and Tom Ford for lunch."), (7, "anna beck"), (8, "I saw Anna Beck there."),
        (9, "the river they met Anna and Otto"), (10, "He had sixty of them"), (11, "x " + capital.replace("Otto", "Hugo")),
    ], "doc_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["item_windows"], r["n_changed"]) for r in decontaminate.leaks(docs, items).collect()}
    assert {k for k in found if k[1] == 1} == {(1, 1), (2, 1), (3, 1)} and found[1, 1] == (12, 12, 0)
    assert {k for k in found if k[1] != 1} == {(4, 2), (10, 5), (11, 3)}
    assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(docs, items).collect()) == [5, 6, 7, 8, 9]


def brute_template(text):
    text = re.sub(r"(?<=[^.!?:\s][ \t])[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+", "QNAME", text or "").lower()
    numbers = "|".join(sorted(decontaminate.NUMBER_WORDS.split(), key=len, reverse=True))
    text = re.sub(rf"(?<![^\W\d_])(?:\d+(?:[.,:/]\d+)*|(?:{numbers})(?![^\W\d_]))", "QNUMBER", text)
    return [w for w in (re.sub(r"[\W_]", "", w) for w in text.split()) if w]


def test_leaks_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    items = {r["item_id"]: brute_template(r["text"]) for r in table(spark, "benchmark", sf).collect()}
    places = {}
    for item, words in items.items():
        for k in range(len(words) - 7):
            places.setdefault(tuple(words[k : k + 8]), []).append((item, k))
    want = set()
    for r in table(spark, "documents", sf).collect():
        words, lines = brute_template(r["text"]), Counter()
        for at in range(len(words) - 7):
            for item, k in places.get(tuple(words[at : at + 8]), ()):
                lines[item, at - k] += 1
        want |= {(r["doc_id"], item) for (item, _), n in lines.items() if n >= min(6, len(items[item]) - 7)}
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table(spark, "documents", sf), table(spark, "benchmark", sf)).collect()}
    assert found == want and found


def test_period_keeps_every_source_within_a_block_of_its_share():
    rng = np.random.default_rng(2)
    for _ in range(30):
        weights = {f"s{i}": int(w) for i, w in enumerate(rng.integers(1, 40, int(rng.integers(1, 8))))}
        order, period, done = mixing.period_order(weights), sum(weights.values()), Counter()
        assert Counter(order) == weights
        for slot, name in enumerate(order):
            i = done[name]
            assert i * period // weights[name] <= slot < -(-(i + 1) * period // weights[name])
            done[name] += 1
            assert all(abs(done[s] - (slot + 1) * w / period) < 1 for s, w in weights.items())


@pytest.mark.parametrize("weights", [None, {None: 1, "a": 3, "b": 2, "c": 1}])
def test_mix_against_slot_by_slot(spark, weights):
    rng = np.random.default_rng(5)
    rows = [(i, str(rng.choice(["a", "a", "a", "b", "c"])) if i % 50 else None, f"t{i}", i) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, mix_slot bigint")
    mixed = mixing.mix(docs, weights, block_rows=8)
    assert mixed.columns[:3] == ["doc_id", "source", "text"]
    found = mixed.collect()
    assert sorted(r["doc_id"] for r in found) == list(range(2000))
    counts = Counter(r[1] for r in rows)
    shares = weights or {s: mixing.temperature_weights({str(k): v for k, v in counts.items()})[str(s)] for s in counts}
    key = lambda s: "" if s is None else "=" + s
    left = {s: -(-n // 8) for s, n in counts.items()}
    place, done, slot = {}, Counter(), 0
    while any(done[s] < left[s] for s in left):
        active, got, start = [s for s in left if done[s] < left[s]], Counter(), slot
        period = sum(shares[s] for s in active)
        while all(done[s] < left[s] for s in active):
            ready = [(-(-(got[s] + 1) * period // shares[s]), key(s), s) for s in active if got[s] * period // shares[s] <= slot - start]
            chosen = min(ready, key=lambda x: x[:2])[2]
            place[chosen, done[chosen]] = slot
            done[chosen], got[chosen], slot = done[chosen] + 1, got[chosen] + 1, slot + 1
    assert all(r["mix_slot"] == place[r["source"], r["mix_block"]] and r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in found)
    assert len({(r["mix_slot"], r["mix_row"]) for r in found}) == 2000


def test_mix_edges(spark, edges, empty):
    mixed = mixing.mix(edges)
    assert mixed.count() == len(EDGES) and mixed.columns[: len(edges.columns)] == edges.columns and mixing.mix(empty).count() == 0
    with pytest.raises(ValueError, match="no weight"):
        mixing.mix(edges, {"a": 1})


def test_toxicity_learns_from_every_labelled_text(spark, monkeypatch):
    """No number of texts, nor the length of one, keeps a labelled text from being learnt from; several shards learn the same."""
    filler = "plain words of no weight " * 2500  # over 60,000 characters
    texts = [(i, (filler if i % 7 == 0 else "") + ("vile grubby stuff" if i % 3 == 0 else "fine clean stuff")) for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id bigint, toxic int")
    settings = toxicity.Settings(buckets=1 << 10)
    rows = toxicity.training_rows(docs, labels, settings, 5)
    assert {r["key"].split("|")[0] for r in rows.collect()} == {r["doc_id"] for r in labels.where("crc32(cast(doc_id as string)) % 5 != 0").select(F.col("doc_id").cast("string")).collect()}
    assert {len(r["rows"]) // 6 for r in rows.collect()} == {3, 12503}
    for chars in (toxicity.SHARD_CHARS, 1 << 20):
        monkeypatch.setattr(toxicity, "SHARD_CHARS", chars)
        found = toxicity.classify(docs, labels, settings).join(labels, "doc_id").where("held_out").collect()
        assert all(r["predicted"] == r["toxic"] for r in found)


def test_pooling_of_a_text_in_pieces_is_that_of_the_whole(monkeypatch):
    settings = toxicity.Settings(buckets=64)
    state = toxicity.first_state(settings)
    rng = np.random.default_rng(1)
    texts = [toxicity._padded(rng.integers(0, 64, (n, 3)), settings) for n in (0, 1, 2, 5, 40, 7)]
    whole = toxicity.pooled(state, texts, settings)
    monkeypatch.setattr(toxicity, "STRIDE", 4)
    for a, b in zip(whole, toxicity.pooled(state, texts, settings)):
        np.testing.assert_allclose(a, b, atol=1e-6)
