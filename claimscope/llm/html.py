"""Main text of web pages by nearest-URL page differencing.

Pages of a host are paired with the neighbour in the order of their paths; the lines (blocks of text) of both are aligned by longest
common subsequence, and lines that both have are deleted. What stands in a marked article that is the larger part of its page is kept
even if shared, since articles repeat passages; what stands in an element marked as menu, footer, advert and the like goes even if unique.
"""

from __future__ import annotations

import html as references
import os.path
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimscope.llm.common import written
from claimscope.llm.urls import url_host, url_path

# Element names and the words of class, id and role that mark what is not the article.
RAW = set("script style title textarea iframe noscript noembed noframes template svg math object select".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = set("nav footer aside form menu button dialog search head".split())
NOISE_WORDS = set(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead footer colophon sidebar aside widget widgets ad ads adv advert adverts "
    "advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal "
    "overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations comment comments "
    "disqus respond reply replies toolbar pagination pager skip complementary contentinfo dialog".split()
)
# Words that a name of several may have besides those: cookie-notice and ad-box are noise, category-notice and tag-search aren't.
LAYOUT_WORDS = set(
    "area bar block bottom box button buttons col column container content fixed footer form global group header inner item items left link links list "
    "main outer page primary right row secondary section site sticky top wrap wrapper".split()
)
HEADER_WORDS = {"header", "topbar"}
ARTICLE_WORDS = {"article", "post", "entry", "story"}
# An open element of these is closed by the next one, up to the element that holds both.
CLOSES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.DOTALL
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


@dataclass
class Line:
    text: str
    noise: bool  # in an element that is marked as not the article
    article: bool  # in a marked article


def _attributes(text: str) -> dict[str, str]:
    return {name.lower(): references.unescape(value.strip("\"'")).lower() for name, value in _ATTRIBUTE.findall(text)}


def _is_noise(name: str) -> bool:
    """Whether a class, id or role is a word of noise, or made of such words, words of layout and numbers."""
    parts = [part for part in re.split("[^a-z0-9]+", name) if part and not part[0].isdigit()]
    return any(part in NOISE_WORDS for part in parts) and all(part in NOISE_WORDS or part in LAYOUT_WORDS for part in parts)


def _marks(tag: str, attributes: dict[str, str], in_article: bool) -> tuple[bool, bool]:
    """Whether an element starts noise, and whether it starts an article."""
    names = " ".join(attributes.get(k, "") for k in ("class", "id", "role")).split()
    words = {word for name in names if not name.startswith(("has-", "no-", "with-", "without-")) for word in re.split("[^a-z0-9]+", name)}
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")
    article = tag in ("article", "main") or attributes.get("role") in ("main", "article") or attributes.get("itemprop") == "articlebody"
    head = (tag == "header" or bool(words & HEADER_WORDS)) and not in_article and not words & ARTICLE_WORDS
    named = any(name in NOISE_WORDS if article else _is_noise(name) for name in names) and tag not in ("html", "body", "main")
    noise = hidden or tag in NOISE_TAGS or head or named
    return noise, article and not noise


def page_lines(page: str | None) -> list[Line]:
    """Blocks of text in page order: references decoded, white space to one space, trimmed; scripts, styles and comments left out."""
    page = page or ""
    lines: list[Line] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, noise, article
    parts: list[str] = []

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            lines.append(Line(text, bool(stack) and stack[-1][1], bool(stack) and stack[-1][2]))

    def close(depth: int) -> None:
        if any(tag in BLOCKS for tag, _, _ in stack[depth:]) or stack[depth:] and stack[depth][1:] != (stack[depth - 1][1:] if depth else (False, False)):
            flush()
        del stack[depth:]

    at = 0
    while found := _TAG.search(page, at):
        parts.append(references.unescape(page[at : found.start()]))
        at = found.end()
        slash, tag, rest = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if tag is None:
            continue
        tag = tag.lower()
        if slash:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
            else:
                if tag in BLOCKS:
                    flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            if not rest.rstrip().endswith("/"):
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    close(depth)
                    break
                if stack[depth][0] in BLOCKS:
                    break
            if tag in CLOSES:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in CLOSES[tag]:
                        break
                    if stack[depth][0] == tag or {tag, stack[depth][0]} <= {"dt", "dd"} or {tag, stack[depth][0]} <= {"td", "th"}:
                        close(depth)
                        break
            flush()
        if tag in VOID:
            continue
        noise, article = stack[-1][1:] if stack else (False, False)
        own_noise, own_article = _marks(tag, _attributes(rest), article) if rest.strip() or tag in BLOCKS else (False, False)
        if own_noise and not noise:
            flush()
        stack.append((tag, noise or own_noise, article or own_article))
    parts.append(references.unescape(page[at:]))
    flush()
    return lines


def line_hashes(lines: list[Line]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(line.text.encode("utf-8", "surrogatepass")) for line in lines], np.uint64).view(np.int64)


def shared_lines(own: list[int], other: list[int]) -> list[int]:
    """Places in ``own`` of a longest common subsequence with ``other``, by bit-parallel rows that are traced back."""
    full = (1 << len(own)) - 1
    places: dict[int, int] = {}
    for i, value in enumerate(own):
        places[value] = places.get(value, 0) | 1 << i
    rows = [full]
    for value in other:
        row = rows[-1]
        met = row & places.get(value, 0)
        rows.append(((row + met) | (row - met)) & full)
    found, i, j = [], len(own), len(other)
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1
        elif not rows[j - 1] >> (i - 1) & 1:
            j -= 1
        else:
            found.append(i - 1)
            i, j = i - 1, j - 1
    return found[::-1]


def main_text(lines: list[Line], shared: set[int]) -> str:
    """Lines that are neither noise nor shared; where marked articles hold at least as much text as is unshared around them, all of theirs.

    So unshared lines around an article stay, and teasers that pages share go though they are marked as articles.
    """
    inside = sum(len(line.text) for line in lines if line.article and not line.noise)
    around = sum(len(line.text) for i, line in enumerate(lines) if not line.article and not line.noise and i not in shared)
    kept = [line.text for i, line in enumerate(lines) if not line.noise and (i not in shared or line.article and inside >= around)]
    return "\n\n".join(kept)


def neighbours(nodes: DataFrame) -> DataFrame:
    """``nodes`` (host, path, content) with ``previous`` and ``following``, the neighbours in the order of these three, in any host.

    Rows are dealt to ranges; the first and last row of each range (two rows per range) are looked up by the ranges beside it.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(nodes.repartitionByRange(parts, "host", "path", "content").withColumn("part", F.spark_partition_id()))
    key = F.struct("host", "path", "content")
    ends = dealt.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    by_part = Window.orderBy("part")
    ends = ends.select("part", F.lag("high").over(by_part).alias("before"), F.lead("low").over(by_part).alias("after"))
    order = Window.partitionBy("part").orderBy("host", "path", "content")
    inside = dealt.withColumns({"p": F.lag(key).over(order), "f": F.lead(key).over(order)})
    return inside.join(F.broadcast(ends), "part").select(
        *nodes.columns, F.coalesce("p", "before").alias("previous"), F.coalesce("f", "after").alias("following")
    )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, n_shared) for every row of ``pages`` (page_id, url, html).

    Pages of a host with the same lines count as one for pairing, so a copy is no neighbour; the neighbour is the page before or after
    with the longer common beginning of the path (at a tie, the one before). A page alone in its host shares nothing. A null html
    has the text of an empty one; a null url, or one without ://, is of the empty host; repeated rows stay, each with the
    same text; a null page_id is kept; no rows give no rows; other columns are not read.
    """
    keyed = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")
    ).withColumn("key", F.xxhash64("html"))

    @F.pandas_udf("array<bigint>")
    def hashes_of(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda body: line_hashes(page_lines(body)))

    @F.pandas_udf("string")
    def nearer(paths: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        def choose(path: str, a: str | None, b: str | None) -> str:
            if a is None or b is None:
                return "none" if a is None and b is None else "before" if b is None else "after"
            return "after" if len(os.path.commonprefix([path, b])) > len(os.path.commonprefix([path, a])) else "before"

        return pd.Series([choose(*row) for row in zip(paths, before, after, strict=True)])

    @F.pandas_udf("array<int>")
    def aligned(own: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([[] if b is None else shared_lines(a.tolist(), b.tolist()) for a, b in zip(own, other, strict=True)])

    @F.pandas_udf("binary")
    def packed(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda body: zlib.compress(body.encode("utf-8", "surrogatepass"), 1))

    @F.pandas_udf("struct<text:string,n_lines:int>")
    def text_of(bodies: pd.Series, shared: pd.Series) -> pd.DataFrame:
        found = []
        for body, places in zip(bodies, shared, strict=True):
            lines = page_lines(zlib.decompress(body).decode("utf-8", "surrogatepass"))
            found.append((main_text(lines, set() if places is None else set(places.tolist())), len(lines)))
        return pd.DataFrame(found, columns=["text", "n_lines"])

    lined = written(keyed.select("host", "path", "key", hashes_of("html").alias("lines")).withColumn("content", F.xxhash64("lines")))
    nodes = lined.groupBy("host", "content").agg(F.min("path").alias("path"))
    near = neighbours(nodes)
    there = lambda name: F.when(F.col(f"{name}.host") == F.col("host"), F.col(name))
    near = near.withColumns({"previous": there("previous"), "following": there("following")})
    near = near.withColumn("side", nearer("path", "previous.path", "following.path"))
    other = F.when(F.col("side") == "before", F.col("previous.content")).when(F.col("side") == "after", F.col("following.content"))
    bodies = lined.dropDuplicates(["host", "content"]).select("host", "content", "lines")
    pairs = near.select("host", "content", other.alias("other")).join(bodies, ["host", "content"])
    pairs = pairs.join(bodies.select("host", F.col("content").alias("other"), F.col("lines").alias("beside")), ["host", "other"], "left")
    shared = pairs.select("host", "content", aligned("lines", "beside").alias("shared"))
    places = lined.select("host", "path", "key", "content").distinct().join(shared, ["host", "content"]).drop("content")
    # Pages are packed before they are shuffled; this is the only step that moves them.
    moved = keyed.select("page_id", "url", "host", "path", "key", packed("html").alias("html"))
    met = moved.join(written(places), ["host", "path", "key"], "left")
    return met.withColumn("found", text_of("html", "shared")).select(
        "page_id", "url", F.col("found.text").alias("text"), F.char_length("found.text").cast("bigint").alias("n_chars"),
        F.col("found.n_lines").alias("n_lines"), F.coalesce(F.size("shared"), F.lit(0)).alias("n_shared"),
    )
