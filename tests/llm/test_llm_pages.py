"""Operators on pages, vectors and conversations against brute-force versions, and their edge cases."""

import base64
import hashlib
import html as references
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimscope.llm import html, kdtree, toolcalls, urls, warc
from claimscope.session import scratch_path

SF = "/root/testdata/sf0.001"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(page):
    return [(line.text, line.noise, line.article) for line in html.page_lines(page)]


def test_articles_of_the_test_pages(spark):
    pages = table(spark, "pages", "/root/testdata/sf0.01")
    texts = {r["page_id"]: r for r in html.extract(pages).collect()}
    for page in pages.collect():
        body = re.search("<article>(.*?)</article>", page["html"], re.DOTALL)[1].replace("<br>", " ")
        parts = re.split("</?h1>|</?p>", re.sub("</?b>", "", body))
        want = "\n\n".join(x for x in (" ".join(references.unescape(p).split()) for p in parts) if x)
        assert texts[page["page_id"]]["text"] == want and texts[page["page_id"]]["n_chars"] == len(want)


def test_page_lines():
    page = """<html><header class="site"><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><div class=menu><a>Home</a></div>
    <article><header><h1>T</h1></header><p>One &lt; two<p>a<b>b</b>c<br>d<ul><li>x<li>y</ul><div class="ad-box">Buy</div><footer>me</footer></article>
    <div class="comments"><p>nice</p></div><form><input> Go</form><table><tr><td>p<td>q</table><script>if(a<b){"</div>"}</script>tail<!-- c > d --><p hidden>h</p>"""
    assert lines(page) == [
        ("Site", True, False), ("We use cookies", True, False), ("Home", True, False), ("T", False, True), ("One < two", False, True), ("abc d", False, True),
        ("x", False, True), ("y", False, True), ("Buy", True, True), ("me", True, True), ("nice", True, False), ("Go", True, False), ("p", False, False),
        ("q", False, False), ("tail", False, False), ("h", True, False),
    ]
    assert lines("<body class='has-sidebar'><div class='no-ads page'>x</div><article class='comment'>y</article></body>") == [("x", False, False), ("y", True, False)]
    assert lines(None) == lines("") == lines("<p></p>") == lines("<script>x") == [] and lines("a < b & c &amp d") == [("a < b & c & d", False, False)]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found, rest = html.shared_lines(a, b), iter(b)
        assert len(found) == best[-1][-1] and all(any(a[i] == y for y in rest) for i in found)


def test_shared_lines_go_where_no_article_is_marked(spark):
    page = lambda own: f"<div>Our shop</div><div>{own}</div><div>All rights reserved</div>"
    rows = [(1, "http://h/a/1", page("first")), (2, "http://h/a/2", page("second")), (3, "http://h/a/3", page("second")), (4, "http://other/a", page("alone")),
            (5, None, None), (None, "http://h/b", ""), (1, "http://h/a/1", page("first"))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("q")).withColumn("host", F.lit("q"))
    found = sorted((r["page_id"] or 0, r["text"], r["n_shared"]) for r in html.extract(pages).collect())
    alone = "Our shop\n\nalone\n\nAll rights reserved"
    assert found == [(0, "", 0), (1, "first", 2), (1, "first", 2), (2, "second", 2), (3, "second", 2), (4, alone, 0), (5, "", 0)]
    assert html.extract(pages.limit(0)).count() == 0


def test_stories_outside_of_articles_stay(spark):
    teasers = "<article>Teaser one</article><article>Teaser two</article>"
    page = lambda own: f"<div>Our shop</div><div>{own}</div>{teasers}<footer>{own}</footer>"
    story = lambda n: f"A story of some length, number {n}, in a plain element."
    deck = "<div>Our shop</div><div>Deck</div><article>A long article, much longer than its deck</article>"
    rows = [(1, "http://h/a/1", page(story(1))), (2, "http://h/a/2", page(story(2))), (3, "http://g/1", deck), (4, "http://g/2", deck.replace("Deck", "Other"))]
    found = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    long = "A long article, much longer than its deck"
    assert found == {1: story(1), 2: story(2), 3: f"Deck\n\n{long}", 4: f"Other\n\n{long}"}


def test_noise_is_told_by_whole_names():
    page = """<article class="post category-notice tag-search share-enabled">a</article><div class="category-notice">b</div><div class="tag-search">c</div>
    <div class="site-footer">d</div><div class="sidebar-2">e</div><article class="promo">f</article>"""
    assert lines(page) == [("a", False, True), ("b", False, False), ("c", False, False), ("d", True, False), ("e", True, False), ("f", True, False)]


def test_neighbours_across_ranges(spark):
    rows = [(f"h{i % 3}", f"/p{i:03d}", i) for i in range(200)]
    nodes = spark.createDataFrame(rows, "host string, path string, content int")
    order = sorted(rows)
    found = {tuple(r[:3]): (r["previous"], r["following"]) for r in html.neighbours(nodes).collect()}
    for k, row in enumerate(order):
        before, after = found[row]
        assert (before and tuple(before)) == (order[k - 1] if k else None) and (after and tuple(after)) == (order[k + 1] if k < 199 else None)


def archive_rows():
    m = warc.MAGIC
    return [
        (1, "u", "a" + m + "b"), (2, None, m + "WARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"), (3, "x y\n", None), (None, "z", "q"), (4, "u", m),
        (5, "u", m + "Content-Length: 3\r\n\r\nabc"), (6, "u", "é" * 300), (7, "u", "é" * 300), (8, "u", m * 3 + "Content-Length: 5\r\n\r\nhello\r\n\r\n" + m), (9, "u", ""),
        *[(100 + i, "u", f"page {i} " * 40) for i in range(120)],
    ]


@pytest.mark.parametrize("compression, part", [("none", "2000"), ("gzip", "2000"), ("none", "1000000")])
def test_archive_round_trip(spark, compression, part):
    rows = archive_rows()
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", part)
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        path = scratch_path(spark, "warc-test")
        warc.write_archive(pages.coalesce(2), path, compression)
        found = {r["page_id"]: r for r in warc.read_archive(spark, path).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(found) == len(rows)
    for page_id, _, text in rows:
        body = (text or "").encode()
        r = found[page_id]
        assert (r["payload_bytes"], r["payload_digest"], r["verified"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), True)
        refers = {6: 7, 3: 9}.get(page_id)
        assert (r["record_type"], r["refers_to"]) == ("revisit" if refers else "response", refers)


def test_archive_of_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_chain_reaches_only_what_the_start_points_at(spark):
    rows = [("f", 0, 0, 10), ("f", 0, 4, 20), ("f", 0, 10, 20), ("f", 5, 20, 35), ("f", 5, 27, 35), ("f", 5, 35, 50), ("f", 9, 41, 99), ("g", 0, 3, 7), ("g", 0, 7, 9)]
    frame = spark.createDataFrame(rows, "file string, part bigint, at bigint, next bigint")  # files by any key
    assert {tuple(r) for r in warc._reached(frame).collect()} == {("f", 0), ("f", 10), ("f", 20), ("f", 35)}


def test_fixed_rules(spark):
    cases = {
        "http://a.net/x": ("net/", "block"), "https://Example.NET/en/1?q": ("example.net/en/", "allow"), "http://example.net/de/": ("net/", "block"),
        "http://www.example.com/de/1": ("example.com/de/", "block"), "http://notexample.com/de/": (None, "allow"), "http://x.org/fr/#a": ("org/fr/", "allow"),
        "http://a.net": (None, "allow"), "mailto:x": (None, "allow"), None: (None, "allow"), "": (None, "allow"), "http://a.net?x=/": (None, "allow"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id bigint, url string").withColumn("rule", F.lit("q"))
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    found = {r["page_id"]: r for r in urls.judge(pages, labels).collect()}
    assert {u: (found[i]["rule"], found[i]["verdict"]) for i, u in enumerate(cases)} == cases
    assert [(found[i]["host"], found[i]["path"]) for i in (1, 6, 7, 10)] == [("example.net", "/en/1"), ("a.net", ""), ("", ""), ("a.net", "")]
    assert urls.judge(pages.limit(0), labels).count() == 0


def test_mined_rules_block_what_labels_call_bad(spark):
    rows = [(i, f"https://{'casino' if i % 4 == 0 else 'shop'}{i % 3}.example.io/{'win' if i % 4 == 0 else 'en'}/{i}?ref={i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 400)] + [(None, 0, 0), (8, None, 0)], "doc_id bigint, quality int, toxic int")
    found = urls.judge(pages, labels).collect()
    assert all((r["verdict"] == "block") == (r["page_id"] % 4 == 0) for r in found)
    mined = urls.mine_rules(pages.withColumn("bad", F.col("page_id") % 4 == 0)).collect()
    assert mined and {r["size"] for r in mined} == {1} and all(r["confidence"] >= 0.6 for r in mined)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)], 0) for i in range(700)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(300)] + [(50, rows[50][1], 0), (None, rows[0][1], 0), (2000, None, 0), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0),
                                                               (2050, [float("nan")] * 6, 0), (2100, [], 0), (2101, [1.0, 2.0], 0), (2150, [3.0, 1.0], 0)]
    found = {tuple(r) for r in kdtree.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int"), shard_rows=150).collect()}
    good = [(i, np.floor(np.array(v, float) * 256).astype(int)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))[:5]
            want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    assert found == want
    assert kdtree.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_search_is_exact_beyond_doubles():
    rng = np.random.default_rng(9)
    vectors = rng.integers(-(2**29), 2**29, (500, 4))
    tree = kdtree.build(np.arange(500), vectors)
    for q, found in zip(range(0, 500, 50), kdtree.search(tree, np.arange(0, 500, 50), vectors[::50], np.full(10, kdtree.NONE), 5)):
        scores = [(-sum(int(a) * int(b) for a, b in zip(vectors[q], v)), i) for i, v in enumerate(vectors) if i != q]
        assert found == [(-s, i) for s, i in sorted(scores)[:5]]


SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}}


def test_tool_calls(spark):
    say = lambda *calls: json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments"), c)) for c in calls]})
    rows = [
        (1, 0, "user", 'hi "x"\n é'), (1, 1, "assistant", say(("c1", "add", {"b": 2.5, "a": 1}), ("c2", "add", json.dumps({"a": "$ref:c1", "b": 1})))),
        (1, 2, "tool", json.dumps({"tool_call_id": "c1", "content": "3.5"})), (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": "?"})),
        (1, 4, "assistant", say(("x", "add", {"a": 1, "b": 1, "note": "$ref:y"}), ("y", "add", {"a": 1, "b": 1, "note": "$ref:x", "q": {"z": 1, "a": [1, 2]}}))),
        (1, 5, "assistant", say(("d", "nope", "not json"), ("e", "add", {"a": 1, "b": 2}), ("e", "add", {"a": 1, "b": 2}), ("f", "add", {"b": None, "a": 1, "note": "$ref:gone"}))),
        (None, 0, "user", None), (None, 1, "assistant", ""), (2, None, "user", "q"), (2, 0, "system", "s"), (2, 1, None, "s"),
    ]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("call_id", F.lit("q"))
    found = {(r["conv_id"], r["call_id"], r["index"]): r for r in toolcalls.link_conversations(frame, SCHEMAS).collect()}
    status = {k[1:]: (r["status"], r["level"], r["errors"]) for k, r in found.items() if k[0] == 1}
    assert status == {
        ("turn-0", 0): ("no_result", 0, []), ("c1", 0): ("ok", 0, []), ("c2", 1): ("invalid_arguments", 1, ["type:a"]), ("zz", 0): ("orphan_result", None, []),
        ("x", 0): ("cyclic", None, []), ("y", 1): ("cyclic", None, ["unexpected:q"]), ("d", 0): ("invalid_arguments", 0, ["not_an_object"]),
        ("e", 1): ("duplicate_id", 0, []), ("e", 2): ("duplicate_id", 0, []), ("f", 3): ("dangling_reference", 0, ["missing:b"]),
    }
    assert found[None, "turn-0", 0]["status"] == "ok" and len(found) == 11
    for r in found.values():
        value = json.loads(r["json"])
        assert r["json"] == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(found[1, "c1", 0]["json"])["result"] == "3.5" and json.loads(found[1, "turn-0", 0]["json"])["arguments"]["prompt"] == 'hi "x"\n é'
    assert toolcalls.link_conversations(frame.limit(0)).count() == 0


def test_every_result_is_kept(spark):
    result = lambda name, text: json.dumps({"tool_call_id": name, "content": text})
    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", "first"), (1, 1, "assistant", "second"), (1, 1, "assistant", "second"),
        (1, 5, "tool", result("zz", "a")), (1, 6, "tool", result("zz", "b")), (1, 7, "tool", "no json"), (1, 7, "tool", "nor this"),
        *[(None, 3, "assistant", f"answer {i}") for i in range(40)],
    ]
    found = toolcalls.link_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    told = sorted((r["conv_id"] or 0, r["turn"], r["call_id"] or "", r["status"], json.loads(r["json"])["result"]) for r in found)
    assert told == sorted([
        (1, 0, "turn-0", "ok", "first"), (1, 1, "turn-0", "extra_result", "second"), (1, 1, "turn-0", "extra_result", "second"),
        (1, 5, "zz", "orphan_result", "a"), (1, 6, "zz", "orphan_result", "b"), (1, 7, "", "orphan_result", "no json"), (1, 7, "", "orphan_result", "nor this"),
        *[(0, 3, "turn-2", "orphan_result", f"answer {i}") for i in range(40)],
    ])
    assert {r["n_results"] for r in found if r["conv_id"] is None} == {40}


def test_levels_follow_the_longest_chain(spark):
    calls = [(1, f"k{i}", json.dumps({"v": f"$ref:k{i - 1} $ref:k{i // 2}"} if i else {})) for i in range(6)]
    frame = spark.createDataFrame(calls, "conv_id bigint, call_id string, arguments string")
    assert {r["call_id"]: r["level"] for r in toolcalls.levels(frame).collect()} == {f"k{i}": i for i in range(6)}
