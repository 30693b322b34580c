"""URL filters: fixed rules by host and path, and association rules that FP-growth mines from labelled URLs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import ascii_lower, fold, written

# Host, beginning of the path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
BAD = "label=bad"


@dataclass
class Mining:
    """What a rule needs in order to block: its share and number of the labelled URLs, and the share of bad ones among those it fits."""

    support: float = 0.005
    least_urls: int = 10
    confidence: float = 0.6


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    """Between the first :// and the next /, ?, # or end, with A-Z lowered; empty for a null url and one without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """From behind the host up to ?, # or end; empty for a null url and one without ://."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits the host or a parent of it, and the beginning of the path; else null.

    Length is that of host and path together; of two as long, the one that comes first as text.
    """
    ordered = sorted(rules, key=lambda rule: (-len(rule[0] + rule[1]), rule[0] + rule[1]))
    found = None
    for name, start, verdict in ordered:
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: its scheme, host and parent domains, words before the domain, parts of the path, names in the query.

    Tokens that always come together would only multiply the combinations: top-level domains and words of the last two
    labels are in the domains already.
    """
    host, path = url_host(url), url_path(url)
    labels = F.split(host, r"\.")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1))
    parents = F.transform(starts, lambda i: F.concat(F.lit("domain="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    front = F.array_join(F.slice(labels, 1, F.greatest(F.lit(0), F.size(labels) - 2)), ".")
    words = F.transform(F.filter(F.split(front, r"[.\-_]"), lambda x: x != ""), lambda x: F.concat(F.lit("host="), x))
    parts = F.transform(F.filter(F.split(ascii_lower(path), r"[/\-_.]"), lambda x: (x != "") & ~x.rlike("^[0-9]+$")), lambda x: F.concat(F.lit("path="), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.regexp_extract(x, "^([^=]*)", 1)))
    scheme = F.array(F.concat(F.lit("scheme="), ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([^:/?#]*)://", 1))))
    return F.array_distinct(F.concat(scheme, F.when(host != "", F.concat(parents, words)).otherwise(F.array().cast("array<string>")), parts, names))


def mine_rules(labelled: DataFrame, mining: Mining | None = None) -> DataFrame:
    """(rule_id, token, size, confidence, support): token combinations that mark bad URLs, one row per token.

    ``labelled`` has (url, bad). Spark's FP-growth finds the combinations over all labelled rows; a rule is dropped when a part
    of it is a rule of at least its confidence already (then it adds nothing).
    """
    m = mining or Mining()
    baskets = labelled.where(F.col("bad").isNotNull()).select(F.when(F.col("bad"), F.array_append(tokens(F.col("url")), BAD)).otherwise(tokens(F.col("url"))).alias("items"))
    baskets = written(baskets)
    n = baskets.count()
    if not n:
        return labelled.sparkSession.createDataFrame([], "rule_id bigint, token string, size int, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(m.support, m.least_urls / n)), minConfidence=m.confidence).fit(baskets)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD))
    rules = written(found.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support").withColumn("rule_id", F.xxhash64("tokens")))
    return _general(rules).select("rule_id", F.explode("tokens").alias("token"), F.size("tokens").alias("size"), "confidence", "support")


def _general(rules: DataFrame) -> DataFrame:
    """Rules without those that a more general rule makes needless, found by the tokens that two rules share."""
    each = rules.select("rule_id", F.explode("tokens").alias("token"), F.size("tokens").alias("size"), "confidence")
    pairs = each.alias("l").join(each.alias("s"), (F.col("l.token") == F.col("s.token")) & (F.col("s.size") < F.col("l.size")) & (F.col("s.confidence") >= F.col("l.confidence")))
    covered = pairs.groupBy(F.col("l.rule_id").alias("rule_id"), F.col("s.rule_id").alias("other"), F.col("s.size").alias("size")).agg(
        F.count(F.lit(1)).alias("n")
    ).where("n = size")
    return rules.join(covered.select("rule_id").distinct(), "rule_id", "left_anti")


def matches(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence, rule_size): the surest mined rule per distinct URL that fits, by an inverted index from tokens to rules."""
    urls = pages.select("url").where(F.col("url").isNotNull()).distinct()
    postings = urls.select("url", F.explode_outer(tokens(F.col("url"))).alias("token"))
    hits = postings.join(rules, "token").groupBy("url", "rule_id", "size", "confidence").agg(F.count(F.lit(1)).alias("n"))
    return hits.where("n = size").groupBy("url").agg(F.max(F.struct("confidence", F.col("size").alias("rule_size"))).alias("best")).select("url", "best.*")


def judge(pages: DataFrame, labels: DataFrame, mining: Mining | None = None, folds: int = 5) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_confidence) for every row of ``pages`` (page_id, url).

    A fixed rule that fits decides; else a mined rule that fits blocks, and all other URLs are allowed. Rules are mined from pages
    whose page_id has a label (doc_id; bad is a quality of 0) outside the fold of crc32 of the id that is 0. Several labels of an id count as
    bad if one is. A null url has no tokens and is allowed; a null page_id is judged; repeated rows stay; tables without
    rows give no rules or no rows; other columns are not read.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(
        (F.min("quality") < 1).alias("bad")
    )
    rows = pages.select("page_id", "url")
    labelled = rows.where(F.col("url").isNotNull() & (fold(F.col("page_id"), folds) != 0)).join(known, "page_id").select("url", "bad")
    found = written(matches(rows, mine_rules(labelled, mining)))
    parsed = rows.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    fixed = fixed_rule(F.col("host"), F.col("path"))
    met = parsed.withColumn("fixed", fixed).join(found, "url", "left")
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return met.select(
        "page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce(F.col("fixed.verdict"), mined).alias("verdict"),
        F.col("confidence").alias("mined_confidence"),
    )
