"""Standardization, scores and reports of the general model and of the cohort."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from claimscope.catalog import stages
from claimscope.catalog.aggregates import CODES, FEATURES, HH_CATEGORIES, HH_CLAIMS, SCORED, STATS, profile_sql, shown
from claimscope.catalog.registry import query, r
from claimscope.functions.constants import (
    COHORT_SCORED, COHORT_WEIGHTS, FILL_FEATURES, LOG_FEATURES, MODEL_FEATURES,
)
from claimscope.operators import claims as C
from claimscope.operators import peers, profile, ranking
from claimscope.operators.iforest import DRAW_DIGITS, DRAWS_PER_HASH, EULER, FRACTION_DIGITS, isolation_forest
from claimscope.operators.risk import dollar_weight
from claimscope.operators.standardize import extreme_count, preprocess
from claimscope.plans import cohort as HH
from claimscope.plans import providers as P
from claimscope.session import cut

GATE = stages.GATE


def prepared(name: str) -> str:
    text = f"CAST({name} AS DOUBLE)"
    if name in FILL_FEATURES:
        text = f"COALESCE({text}, {FILL_FEATURES[name]})"
    return f"LN(1 + {text})" if name in LOG_FEATURES else text


def z_sql(source: str, features: list[str], value) -> str:
    """CTEs ``matrix``, ``moments`` and ``z``: standardized features of a relation."""
    return (
        "matrix AS (SELECT billing_npi, " + ", ".join(f"{value(c)} {c}" for c in features) + f" FROM {source}), "
        "moments AS (SELECT " + ", ".join(f"AVG({c}) m_{c}, STDDEV_POP({c}) s_{c}" for c in features) + " FROM matrix), "
        "z AS (SELECT billing_npi, " + ", ".join(
            f"CASE WHEN s_{c} > 1e-9 * GREATEST(ABS(m_{c}), 1) THEN ({c} - m_{c}) / s_{c} ELSE 0 END {c}" for c in features
        ) + " FROM matrix, moments)"
    )


def forest_sql(trees: int = 200, psi: int = 256, seed: int = 42) -> str:
    """CTEs from ``z`` to ``forest`` (billing_npi, if_anomaly_score): the isolation forest of the same hashes, grown and walked by recursion."""
    depth = math.ceil(math.log2(psi))
    n = len(MODEL_FEATURES)
    values = ", ".join(f"ROUND(COALESCE({c}, 0), 9)" for c in MODEL_FEATURES)

    def fraction(start: int) -> str:
        return f"(('0x' || SUBSTR(h, {start}, {FRACTION_DIGITS}))::BIGINT / {16**FRACTION_DIGITS}e0)"

    def average(size: str) -> str:
        return f"CASE WHEN {size} > 2 THEN 2 * (LN({size} - 1e0) + {EULER}) - 2 * ({size} - 1e0) / {size} WHEN {size} = 2 THEN 1e0 ELSE 0e0 END"

    def split(source: str) -> str:
        """The rows of nodes with the feature and value that part them, and the number of rows in their node."""
        lows, highs = (", ".join(f"{way}(xs[{i}]) OVER w" for i in range(1, n + 1)) for way in ("MIN", "MAX"))
        return f"""SELECT tree, id, xs, node, depth, size, feature, CASE WHEN between_them < high THEN between_them ELSE low END split FROM (
 SELECT *, low + {fraction(1 + FRACTION_DIGITS)} * (high - low) between_them FROM (SELECT *, lows[feature] low, highs[feature] high FROM (
 SELECT *, CASE WHEN depth < {depth} THEN usable[1 + CAST(FLOOR({fraction(1)} * LEN(usable)) AS BIGINT)] END feature FROM (
 SELECT *, LIST_FILTER(RANGE(1, {n + 1}), LAMBDA i: highs[i] > lows[i]) usable, MD5('{seed}|' || tree || '|' || node) h FROM (
 SELECT *, [{lows}] lows, [{highs}] highs, COUNT(*) OVER w size FROM ({source}) WINDOW w AS (PARTITION BY tree, node)))))) """

    drawn = f"""SELECT t.tree, id, xs, ROW_NUMBER() OVER (PARTITION BY t.tree ORDER BY SUBSTR(MD5('{seed}|' || id || '|' || (t.tree // {DRAWS_PER_HASH})),
 1 + {DRAW_DIGITS} * (t.tree % {DRAWS_PER_HASH}), {DRAW_DIGITS}), id) place FROM prepared, RANGE({trees}) t(tree)"""
    return f"""prepared AS MATERIALIZED (SELECT billing_npi id, [{values}] xs FROM z),
drawn AS MATERIALIZED (SELECT tree, id, xs FROM ({drawn}) WHERE place <= {psi}),
grown AS ({split('SELECT tree, id, xs, 1::BIGINT node, 0::BIGINT depth FROM drawn')}
 UNION ALL {split('SELECT tree, id, xs, 2 * node + (xs[feature] > split)::BIGINT node, depth + 1 depth FROM grown WHERE feature IS NOT NULL')}),
nodes AS MATERIALIZED (SELECT DISTINCT tree, node, depth, size, feature, split FROM grown),
walked AS (SELECT t.tree, id, xs, 1::BIGINT node FROM prepared, RANGE({trees}) t(tree)
 UNION ALL SELECT w.tree, w.id, w.xs, 2 * w.node + (w.xs[n.feature] > n.split)::BIGINT FROM walked w JOIN nodes n ON w.tree = n.tree AND w.node = n.node WHERE n.feature IS NOT NULL),
forest AS MATERIALIZED (SELECT w.id billing_npi, POW(2, -AVG(n.depth + {average('n.size')}) / (SELECT {average(f'LEAST({psi}, COUNT(*))')} FROM prepared)) - 0.5 if_anomaly_score
 FROM walked w JOIN nodes n ON w.tree = n.tree AND w.node = n.node WHERE n.feature IS NULL GROUP BY w.id)"""


def average_place(column: str, digits: int) -> str:
    """SQL: the descending rank of a rounded column, with the whole part of the average place for ties."""
    value = f"ROUND({column}, {digits})"
    return f"CAST(FLOOR(RANK() OVER (ORDER BY {value} DESC) + (COUNT(*) OVER (PARTITION BY {value}) - 1) / 2.0) AS BIGINT)"


def scored_list(columns: list[str]) -> str:
    """SQL select list of score columns, rounded as ``tidy`` does."""
    plain = {"zscore_count", "if_rank", "zscore_rank", "dollar_rank"}
    cents = {"dollar_weighted_score": f"{r('ROUND(dollar_weighted_score, 2)')} dollar_weighted_score"}
    return ", ".join(c if c in plain else cents.get(c, shown([c])) for c in columns)


Z = z_sql("features", MODEL_FEATURES, prepared)
FOREST = forest_sql()
BASELINE = f"""{FEATURES}, {Z}, counted AS (SELECT billing_npi, {' + '.join(f'(ROUND(ABS({c}), 9) > 3)::INT' for c in MODEL_FEATURES)} zscore_count FROM z),
ranked AS (SELECT f.*, c.zscore_count, RANK() OVER (ORDER BY c.zscore_count DESC) zscore_rank,
 CAST(FLOOR(RANK() OVER (ORDER BY ROUND(total_paid, 9) DESC) + (COUNT(*) OVER (PARTITION BY ROUND(total_paid, 9)) - 1) / 2.0) AS BIGINT) paid_rank,
 CAST(FLOOR(RANK() OVER (ORDER BY ROUND(max_peer_zscore, 9) DESC) + (COUNT(*) OVER (PARTITION BY ROUND(max_peer_zscore, 9)) - 1) / 2.0) AS BIGINT) peer_rank
 FROM features f JOIN counted c USING (billing_npi))"""


@query("m1_preprocess", f"WITH {FEATURES}, {Z} SELECT billing_npi, " + ", ".join(f"{r(c)} {c}" for c in MODEL_FEATURES) + " FROM z")
def _(t):
    return preprocess(stages.features(t))


@query("m2_peer_zscore", f"WITH {CODES}, {STATS}, {SCORED} SELECT billing_npi, hcpcs_code, {r('code_paid')} code_paid, {r('ppc')} ppc, {r('avg_ppc')} avg_ppc, {r('peer_zscore')} peer_zscore FROM scored")
def _(t):
    z = peers.peer_zscore(stages.codes(t), min_count=GATE, ddof=0)
    return z.select("billing_npi", "hcpcs_code", "code_paid", "ppc", "avg_ppc", "peer_zscore")


@query("m3_extreme_count", f"WITH {BASELINE} SELECT billing_npi, zscore_count FROM ranked")
def _(t):
    return extreme_count(preprocess(stages.features(t)), MODEL_FEATURES, 3, "zscore_count").select("billing_npi", "zscore_count")


@query("m3_baseline_rank", f"WITH {BASELINE} SELECT billing_npi, zscore_count, zscore_rank FROM ranked")
def _(t):
    return P.zscore_baseline(stages.features(t))


@query("m4_isolation_forest", f"WITH RECURSIVE {FEATURES}, {Z}, {FOREST} SELECT billing_npi, {r('if_anomaly_score')} if_anomaly_score FROM forest")
def _(t):
    return isolation_forest(preprocess(stages.features(t)), "billing_npi", MODEL_FEATURES)


@query("m5_dollar_weight", f"""WITH {FEATURES}, given AS (SELECT billing_npi, total_paid, max_peer_zscore if_anomaly_score,
  max_peer_zscore * total_paid dollar_weighted_score FROM features)
 SELECT billing_npi, {r('dollar_weighted_score', 3)} dollar_weighted_score, CAST(FLOOR(RANK() OVER (ORDER BY ROUND(dollar_weighted_score, 2) DESC)
  + (COUNT(*) OVER (PARTITION BY ROUND(dollar_weighted_score, 2)) - 1) / 2.0) AS BIGINT) dollar_rank FROM given""", digits=3)
def _(t):
    # The score under test is given: SQL has no forest.
    scored = stages.features(t).select("billing_npi", "total_paid", F.col("max_peer_zscore").alias("if_anomaly_score"))
    return dollar_weight(scored).select("billing_npi", "dollar_weighted_score", "dollar_rank")


@query("w5_top_features", f"""WITH {FEATURES}, {Z}, long AS (""" + " UNION ALL ".join(
    f"SELECT billing_npi, '{c}' feature, ROUND(ABS({c}), 9) abs_z FROM z" for c in MODEL_FEATURES
) + f""") SELECT billing_npi, CAST(place AS INTEGER) place, feature, {r('abs_z')} abs_z FROM (SELECT *,
 ROW_NUMBER() OVER (PARTITION BY billing_npi ORDER BY abs_z DESC, feature) place FROM long) WHERE place <= 3""")
def _(t):
    return ranking.top_features(preprocess(stages.features(t)), "billing_npi", MODEL_FEATURES, 3)


# --- layer 1 reports -----------------------------------------------------------------------------------------------

FEATURE_LIST = ["billing_npi", *MODEL_FEATURES, "num_rows", "primary_taxonomy"]


@query("r2_provider_features", f"WITH {FEATURES} SELECT {shown(P.FEATURE_COLUMNS)} FROM features")
def _(t):
    return P.provider_features(t.claims, t.providers, t.deactivated, stages.AS_OF, GATE)


@query("r2_provider_features_state", f"""WITH all_claims AS (SELECT c.* FROM claims c JOIN providers p ON c.billing_npi = p.npi WHERE p.state = 'NATION_3')
 SELECT billing_npi, {r('SUM(total_paid)')} total_paid, COUNT(*) num_rows, COUNT(DISTINCT hcpcs_code) num_hcpcs_codes FROM all_claims GROUP BY billing_npi""")
def _(t):
    scoped = P.provider_features(t.claims, C.scope_state(t.providers, "NATION_3"), t.deactivated, stages.AS_OF)
    return scoped.select("billing_npi", "total_paid", "num_rows", "num_hcpcs_codes")


# Scores are ranked as rounded to nine decimals; ties share the whole part of their average place.
SCORES = f"""{BASELINE}, {FOREST}, weighted AS (SELECT k.*, o.if_anomaly_score, o.if_anomaly_score * k.total_paid dollar_weighted_score FROM ranked k JOIN forest o USING (billing_npi)),
scores AS (SELECT *, {average_place('if_anomaly_score', 9)} if_rank, {average_place('dollar_weighted_score', 2)} dollar_rank FROM weighted)"""
SCORE_COLUMNS = [*P.FEATURE_COLUMNS, "zscore_count", "if_anomaly_score", "if_rank", "zscore_rank", "dollar_weighted_score", "dollar_rank"]


@query("r3_score_providers", f"WITH RECURSIVE {SCORES} SELECT {scored_list(SCORE_COLUMNS)} FROM scores")
def _(t):
    # To the cent, as the amounts are ranked.
    return P.score_providers(stages.features(t)).withColumn("dollar_weighted_score", F.round("dollar_weighted_score", 2)).select(*SCORE_COLUMNS)


TOP_COLUMNS = ["billing_npi", "if_rank", "zscore_rank", "dollar_rank", "if_anomaly_score", "zscore_count", "total_paid", "total_claims", "paid_per_claim",
               "max_peer_zscore", "num_hcpcs_codes", "num_taxonomy_codes", "pct_round_dollar", "monthly_paid_cv", "is_deactivated", "entity_type"]


@query("r4_top_anomalies_forest", f"WITH RECURSIVE {SCORES} SELECT {scored_list(TOP_COLUMNS)} FROM scores ORDER BY scores.if_rank, scores.billing_npi LIMIT 50")
def _(t):
    return P.top_anomalies(stages.scores(t), "if_rank", 50)


@query("r4_top_anomalies_dollars", f"WITH RECURSIVE {SCORES} SELECT {scored_list(TOP_COLUMNS)} FROM scores ORDER BY scores.dollar_rank, scores.billing_npi LIMIT 20")
def _(t):
    return P.top_anomalies(stages.scores(t), "dollar_rank", 20)


# What SQL can say about tables of forest scores, which it can't compute itself.

@query("m4_forest_properties", f"WITH {FEATURES} SELECT COUNT(*) scored, COUNT(*) distinct_ids, 0 out_of_range, 1 varies FROM features")
def _(t):
    score = F.col("if_anomaly_score")
    return stages.scores(t).agg(
        F.count(score).alias("scored"), F.count_distinct("billing_npi").alias("distinct_ids"),
        F.count_if((score <= -0.5) | (score >= 0.5)).cast("int").alias("out_of_range"), (F.max(score) > F.min(score)).cast("int").alias("varies"),
    )


@query("r3_score_properties", f"WITH {BASELINE} SELECT billing_npi, zscore_count, zscore_rank, 1 weighted_right FROM ranked")
def _(t):
    weighted = F.abs(F.col("dollar_weighted_score") - F.col("if_anomaly_score") * F.col("total_paid")) <= 1e-6 * F.greatest(F.lit(1.0), F.abs("dollar_weighted_score"))
    return stages.scores(t).select("billing_npi", "zscore_count", "zscore_rank", weighted.cast("int").alias("weighted_right"))


@query("r4_top_properties", f"WITH {FEATURES}, n AS (SELECT COUNT(*) n FROM features) SELECT 'if_rank' list, LEAST(50, n) n, 0 left_out FROM n UNION ALL SELECT 'dollar_rank', LEAST(20, n), 0 FROM n")
def _(t):
    def listed(rank, score, k):
        """Rows in the list, and providers outside it that have a higher score than one inside."""
        top = P.top_anomalies(stages.scores(t), rank, k).select("billing_npi")
        inside = stages.scores(t).join(F.broadcast(top), "billing_npi")
        outside = stages.scores(t).join(F.broadcast(top), "billing_npi", "left_anti")
        lowest = inside.agg(F.min(F.round(score, 6))).scalar()
        return outside.agg(F.count_if(F.round(score, 6) > lowest).cast("int").alias("left_out")).select(
            F.lit(rank).alias("list"), inside.agg(F.count(F.lit(1))).scalar().alias("n"), "left_out"
        )

    return listed("if_rank", "if_anomaly_score", 50).union(listed("dollar_rank", "dollar_weighted_score", 20))


@query("r4_top_anomalies_zscore", f"""WITH {BASELINE} SELECT billing_npi, zscore_rank, zscore_count, {r('total_paid')} total_paid, total_claims,
 {r('paid_per_claim')} paid_per_claim, {r('max_peer_zscore')} max_peer_zscore, num_hcpcs_codes, num_taxonomy_codes,
 {r('pct_round_dollar')} pct_round_dollar, {r('monthly_paid_cv')} monthly_paid_cv, is_deactivated, entity_type
 FROM ranked ORDER BY zscore_rank, billing_npi LIMIT 20""")
def _(t):
    return P.top_anomalies(stages.baseline(t), "zscore_rank", 20)


@query("r5_feature_contributions", f"""WITH {BASELINE}, chosen AS (SELECT * FROM ranked ORDER BY zscore_rank, billing_npi LIMIT 20),
long AS (""" + " UNION ALL ".join(
    f"SELECT billing_npi, '{c}' feature, ROUND(ABS(z.{c}), 9) abs_z, CAST(h.{c} AS DOUBLE) raw_value, h.zscore_rank FROM z JOIN chosen h USING (billing_npi)"
    for c in MODEL_FEATURES
) + f""") SELECT billing_npi, CAST(place AS INTEGER) place, feature, {r('abs_z')} abs_z, {r('raw_value')} raw_value, zscore_rank
 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY billing_npi ORDER BY abs_z DESC, feature) place FROM long) WHERE place <= 5""")
def _(t):
    return P.feature_contributions(stages.baseline(t), "zscore_rank", 20, 5)


@query("a23_zscore_distribution", f"""WITH {BASELINE}, c AS (SELECT zscore_count, COUNT(*) n FROM ranked GROUP BY 1)
SELECT zscore_count, n, {r('100.0 * n / (SELECT SUM(n) FROM c)')} pct, CAST(SUM(n) OVER (ORDER BY zscore_count DESC) AS BIGINT) n_at_least FROM c""")
def _(t):
    return P.zscore_distribution(stages.baseline(t))


@query("a23_entity_counts", f"WITH {FEATURES} SELECT entity_type, COUNT(*) n, {r('100.0 * COUNT(*) / (SELECT COUNT(*) FROM features)')} pct FROM features WHERE entity_type IS NOT NULL GROUP BY 1")
def _(t):
    return P.entity_counts(stages.features(t))


@query("a44_deactivated_summary", f"""WITH {FEATURES} SELECT COUNT(*) FILTER (is_deactivated = 1) num_deactivated,
 {r('SUM(total_paid) FILTER (is_deactivated = 1)')} total_paid, COUNT(*) FILTER (is_deactivated = 1 AND was_reactivated = 1) also_reactivated FROM features""")
def _(t):
    return P.deactivated_summary(stages.features(t))


@query("r6_deactivated_with_spending", f"""WITH {BASELINE} SELECT billing_npi, {r('total_paid')} total_paid, total_claims, {r('paid_per_claim')} paid_per_claim,
 {r('max_peer_zscore')} max_peer_zscore, num_hcpcs_codes, zscore_rank, {r('provider_age_years')} provider_age_years, num_taxonomy_codes
 FROM ranked WHERE is_deactivated = 1 ORDER BY total_paid DESC, billing_npi LIMIT 20""")
def _(t):
    return P.deactivated_with_spending(stages.baseline(t), 20)


RANKS = ["zscore_rank", "paid_rank", "peer_rank"]
PAIRS = [("zscore_rank", "paid_rank"), ("zscore_rank", "peer_rank"), ("paid_rank", "peer_rank"), tuple(RANKS)]


def within(ranks):
    """SQL: all of the ranks are among the first k."""
    return " AND ".join(f"{name} <= k" for name in ranks)


@query("a36_topk_agreement", f"""WITH {BASELINE}, places AS (SELECT billing_npi, {', '.join(f'ROW_NUMBER() OVER (ORDER BY {x}, billing_npi) {x}' for x in RANKS)} FROM ranked),
ks AS (SELECT UNNEST([20, 50, 100, 200]) k)
SELECT CAST(k AS INTEGER) k, """ + ", ".join(
    f"COUNT(*) FILTER ({within(p)}) {'_and_'.join(p)}, "
    f"{r(f'100.0 * COUNT(*) FILTER ({within(p)}) / k')} pct_{'_and_'.join(p)}"
    for p in PAIRS) + " FROM places, ks GROUP BY k")
def _(t):
    return P.topk_agreement(stages.baseline(t), RANKS)


@query("u3_agreement_ids", f"""WITH {BASELINE}, a AS (SELECT billing_npi FROM ranked ORDER BY zscore_rank, billing_npi LIMIT 50),
 b AS (SELECT billing_npi FROM ranked ORDER BY paid_rank, billing_npi LIMIT 50) SELECT billing_npi FROM a WHERE billing_npi IN (SELECT billing_npi FROM b)""")
def _(t):
    return P.agreement_ids(stages.baseline(t), ["zscore_rank", "paid_rank"], 50)


@query("a37_group_lift", f"""WITH {BASELINE}, total AS (SELECT COUNT(*) n FROM ranked),
base AS (SELECT LEFT(primary_taxonomy, 3) grp, 100.0 * COUNT(*) / (SELECT n FROM total) pct, COUNT(*) c FROM ranked GROUP BY 1 ORDER BY c DESC, 1 LIMIT 15),
best AS (SELECT LEFT(primary_taxonomy, 3) grp FROM ranked ORDER BY zscore_rank, billing_npi LIMIT 50),
top AS (SELECT grp, COUNT(*) n, 100.0 * COUNT(*) / (SELECT COUNT(*) FROM best) pct FROM best GROUP BY grp ORDER BY n DESC, grp LIMIT 15)
SELECT top.grp, top.n, {r('top.pct')} pct, {r('COALESCE(base.pct, 0)')} base_pct, {r('top.pct / NULLIF(COALESCE(base.pct, 0), 0)')} lift FROM top LEFT JOIN base ON top.grp = base.grp""")
def _(t):
    return P.specialty_lift(stages.baseline(t), "zscore_rank", 50, 15)


@query("a38_compare_groups", f"""WITH {BASELINE}, best AS (SELECT * FROM ranked ORDER BY zscore_rank, billing_npi LIMIT 50)
SELECT entity_type, COUNT(*) n, {r('AVG(total_paid)')} mean_paid, {r('100.0 * COUNT(*) / (SELECT COUNT(*) FROM ranked)')} pct,
 {r('QUANTILE_CONT(total_paid, 0.5)')} median_paid, {r('QUANTILE_CONT(paid_per_claim, 0.5)')} median_ppc, {r('QUANTILE_CONT(max_peer_zscore, 0.5)')} median_peer_z,
 (SELECT COUNT(*) FROM best b WHERE b.entity_type = ranked.entity_type) n_top,
 {r('100.0 * (SELECT COUNT(*) FROM best b WHERE b.entity_type = ranked.entity_type) / (SELECT COUNT(*) FROM best)')} pct_top
 FROM ranked GROUP BY entity_type""")
def _(t):
    return P.compare_entities(stages.baseline(t), "zscore_rank", 50)


@query("a39_coverage", f"""WITH {BASELINE}, best AS (SELECT total_paid FROM ranked ORDER BY zscore_rank, billing_npi LIMIT 50),
n AS (SELECT COUNT(DISTINCT billing_npi) national_providers FROM claims), s AS (SELECT COUNT(*) covered, SUM(total_paid) total_paid FROM ranked)
SELECT national_providers, covered, {r('total_paid', 3)} total_paid, national_providers - covered dropped, {r('100.0 * covered / national_providers', 3)} coverage_pct,
 {r('100.0 * (national_providers - covered) / national_providers', 3)} drop_pct, (SELECT COUNT(*) FROM best) top_providers,
 {r('(SELECT SUM(total_paid) FROM best)', 3)} top_paid, {r('100.0 * (SELECT SUM(total_paid) FROM best) / total_paid', 3)} top_pct FROM n, s""", digits=3)
def _(t):
    return P.coverage(t.claims, stages.baseline(t), "zscore_rank", 50)


CLAIM_COLUMNS = ["billing_npi", "servicing_npi", "hcpcs_code", "claim_from_month", "total_unique_beneficiaries", "total_claims", "total_paid"]
CLAIM_NUMBERS = CLAIM_COLUMNS[4:]
PROFILE_PARTS = [
    "SELECT 'code_lengths' part, CAST(LENGTH(hcpcs_code) AS STRING) item, CAST(COUNT(*) AS DOUBLE) value FROM claims GROUP BY 2",
    "SELECT 'billing_lengths', CAST(LENGTH(billing_npi) AS STRING), COUNT(*) FROM claims GROUP BY 2",
    "SELECT 'servicing_lengths', CAST(LENGTH(servicing_npi) AS STRING), COUNT(*) FROM claims GROUP BY 2",
    *[f"(SELECT 'top_{kind}', {column}, COUNT(*) n FROM claims GROUP BY 2 ORDER BY n DESC, 2 LIMIT {n})"
      for kind, column, n in (("codes", "hcpcs_code", 20), ("providers", "billing_npi", 10))],
    *[f"(SELECT 'top_{kind}_pct', {column}, {r('100.0 * COUNT(*) / (SELECT COUNT(*) FROM claims)')} FROM claims GROUP BY 2 ORDER BY COUNT(*) DESC, 2 LIMIT {n})"
      for kind, column, n in (("codes", "hcpcs_code", 20), ("providers", "billing_npi", 10))],
    *[f"SELECT 'numbers', '{c} {name}', {r(sql.format(c=c))} FROM claims" for c in CLAIM_NUMBERS for name, sql in {
        "min": "MIN({c})", "max": "MAX({c})", "mean": "AVG({c})", "std": "STDDEV_SAMP({c})",
        **{f"p{q}": f"QUANTILE_CONT(CAST({{c}} AS DOUBLE), {q / 100})" for q in (25, 50, 75, 95, 99)},
    }.items()],
    *[f"SELECT 'cardinality', '{c}', COUNT(DISTINCT {c}) FROM claims" for c in CLAIM_COLUMNS],
    *[f"SELECT 'nulls', '{c}', COUNT(*) FILTER ({c} IS NULL) FROM claims" for c in CLAIM_COLUMNS],
    "SELECT 'dates', 'unparseable', COUNT(*) FILTER (TRY_CAST(claim_from_month AS DATE) IS NULL) FROM claims",
    "SELECT 'dates', 'first', DATE_DIFF('day', DATE '1970-01-01', MIN(claim_from_month)) FROM claims",
    "SELECT 'dates', 'last', DATE_DIFF('day', DATE '1970-01-01', MAX(claim_from_month)) FROM claims",
    *[f"SELECT '{name}', '{what}', {r(sql)} FROM claims" for name, condition in {
        "same_npi": "billing_npi = servicing_npi", "whole_dollars": "total_paid = ROUND(total_paid, 0)", "multiples_of_100": "total_paid % 100 = 0",
    }.items() for what, sql in {"n": f"COUNT(*) FILTER ({condition})", "pct": f"100.0 * COUNT(*) FILTER ({condition}) / COUNT(*)"}.items()],
    "SELECT 'head', 'rows', LEAST(5, COUNT(*)) FROM claims",
]


@query("r1_profile_claims", " UNION ALL ".join(PROFILE_PARTS))
def _(t):
    parts = P.profile_claims(t.claims)

    def long(name, columns):
        """Statistics of a part as rows; a part with one statistic names only the item."""
        frame = parts[name]
        item = F.col("column") if "column" in frame.columns else None
        stats = [F.struct((F.lit(c) if item is None else F.concat(item, F.lit(" " + c))).alias("item"), F.col(c).cast("double").alias("value")) for c in columns]
        return frame.select(F.lit(name).alias("part"), F.inline(F.array(*stats)))

    def pairs(name, item, value, part=None):
        return parts[name].select(F.lit(part or name).alias("part"), F.col(item).cast("string").alias("item"), F.col(value).cast("double").alias("value"))

    day = lambda name: F.datediff(name, F.lit("1970-01-01").cast("date")).alias(name)
    parts["dates"] = parts["dates"].select("unparseable", day("first"), day("last"))
    frames = [
        pairs("code_lengths", "length", "n"), pairs("billing_lengths", "length", "n"), pairs("servicing_lengths", "length", "n"),
        pairs("top_codes", "hcpcs_code", "n"), pairs("top_providers", "billing_npi", "n"),
        pairs("top_codes", "hcpcs_code", "pct", "top_codes_pct"), pairs("top_providers", "billing_npi", "pct", "top_providers_pct"),
        long("numbers", ["min", "max", "mean", "std", "p25", "p50", "p75", "p95", "p99"]),
        pairs("cardinality", "column", "distinct_values"), pairs("nulls", "column", "null_count"), long("dates", ["unparseable", "first", "last"]),
        *[long(name, ["n", "pct"]) for name in ("same_npi", "whole_dollars", "multiples_of_100")],
        parts["head"].agg(F.lit("head").alias("part"), F.lit("rows").alias("item"), F.count(F.lit(1)).cast("double").alias("value")),
    ]
    result = frames[0]
    for frame in frames[1:]:
        result = result.union(frame)
    return result


# --- cohort --------------------------------------------------------------------------------------------------------

def cohort_sql(source: str, tag: str) -> str:
    """CTEs ``<tag>prices``, ``<tag>features`` and ``<tag>cohort`` over a relation of categorized cohort claims."""
    mix = ", ".join(f"SUM(CASE WHEN hh_category = '{c}' THEN total_paid ELSE 0 END) / NULLIF(SUM(total_paid), 0) pct_{c}" for c in HH_CATEGORIES)
    return f"""{tag}codes AS (SELECT billing_npi, hcpcs_code, SUM(total_paid) code_paid, SUM(total_paid) / NULLIF(SUM(total_claims), 0) ppc FROM {source} GROUP BY ALL),
{tag}stats AS (SELECT hcpcs_code, AVG(ppc) avg_ppc, STDDEV_SAMP(ppc) std_ppc FROM {tag}codes GROUP BY hcpcs_code HAVING COUNT(*) >= 3),
{tag}prices AS (SELECT c.*, s.avg_ppc, CASE WHEN s.std_ppc > 0 THEN (c.ppc - s.avg_ppc) / s.std_ppc ELSE 0 END peer_zscore
 FROM {tag}codes c LEFT JOIN {tag}stats s USING (hcpcs_code)),
{tag}peer AS (SELECT billing_npi, MAX(peer_zscore) hh_max_peer_zscore, CASE WHEN SUM(code_paid) > 0 THEN SUM(peer_zscore * code_paid) / SUM(code_paid) ELSE 0 END hh_mean_peer_zscore
 FROM {tag}prices GROUP BY billing_npi),
{tag}cv AS (SELECT billing_npi, COALESCE(STDDEV_SAMP(p) / NULLIF(AVG(p), 0), 0) monthly_paid_cv FROM (SELECT billing_npi, claim_from_month, SUM(total_paid) p FROM {source} GROUP BY ALL) GROUP BY billing_npi),
{tag}features AS (SELECT h.billing_npi, SUM(total_paid) total_paid, CAST(SUM(total_claims) AS BIGINT) total_claims, CAST(SUM(total_unique_beneficiaries) AS BIGINT) total_beneficiaries,
 COUNT(DISTINCT hcpcs_code) num_hcpcs_codes, COUNT(*) num_rows, SUM(total_paid) / SUM(total_claims) paid_per_claim,
 SUM(total_claims)::DOUBLE / SUM(total_unique_beneficiaries) claims_per_beneficiary, SUM(total_paid) / SUM(total_unique_beneficiaries) paid_per_beneficiary,
 MAX(primary_taxonomy) primary_taxonomy, MAX(provider_state) provider_state, MAX(is_deactivated) is_deactivated, {mix},
 SUM(CASE WHEN hh_category = 'skilled_nursing' THEN total_paid ELSE 0 END) / (SUM(CASE WHEN hh_category = 'aide' THEN total_paid ELSE 0 END) + 1) nursing_to_aide_ratio,
 COUNT(DISTINCT CASE WHEN hh_category <> 'non_hh' THEN hcpcs_code END) num_hh_codes, COUNT(DISTINCT claim_from_month) num_active_months,
 ANY_VALUE(monthly_paid_cv) monthly_paid_cv, ANY_VALUE(hh_max_peer_zscore) hh_max_peer_zscore, ANY_VALUE(hh_mean_peer_zscore) hh_mean_peer_zscore
 FROM {source} h JOIN {tag}cv USING (billing_npi) JOIN {tag}peer USING (billing_npi) GROUP BY h.billing_npi),
""" + z_sql(f"{tag}features", COHORT_SCORED, lambda c: f"COALESCE(CAST({c} AS DOUBLE), 0)").replace("matrix", f"{tag}matrix").replace(
        "moments", f"{tag}moments").replace("z AS (", f"{tag}z AS (") + f""",
{tag}risk AS (SELECT billing_npi, {' + '.join(f'(ROUND(ABS({c}), 9) > 2)::INT' for c in COHORT_SCORED)} hh_extreme_count,
 ROUND({' + '.join(f'{w} * {c}' for c, w in COHORT_WEIGHTS.items())}, 9) hh_risk_score FROM {tag}z),
{tag}cohort AS (SELECT f.*, k.hh_extreme_count, k.hh_risk_score, CAST(FLOOR(RANK() OVER (ORDER BY hh_risk_score DESC)
 + (COUNT(*) OVER (PARTITION BY hh_risk_score) - 1) / 2.0) AS BIGINT) hh_risk_rank,
 CASE LEFT(primary_taxonomy, 4) WHEN '251E' THEN 'Home Health Agency' WHEN '253Z' THEN 'In Home Supportive Care' WHEN '251J' THEN 'Nursing Care Agency' END taxonomy_type
 FROM {tag}features f JOIN {tag}risk k USING (billing_npi))"""


COHORT = f"{HH_CLAIMS}, {cohort_sql('hh', '')}"
LOCAL = f"local_hh AS (SELECT * FROM hh WHERE provider_state IN ({', '.join(repr(s) for s in stages.LOCAL_STATES)})), {cohort_sql('local_hh', 'local_')}"
COHORT_LIST = [
    "billing_npi", "total_paid", "total_claims", "total_beneficiaries", "num_hcpcs_codes", "num_rows", "paid_per_claim",
    "claims_per_beneficiary", "paid_per_beneficiary", "primary_taxonomy", "provider_state", "is_deactivated",
    *[f"pct_{c}" for c in HH_CATEGORIES], "nursing_to_aide_ratio", "num_hh_codes", "num_active_months", "monthly_paid_cv",
    "hh_max_peer_zscore", "hh_mean_peer_zscore",
]
TEXTS = {"provider_state", "taxonomy_type", "hcpcs_code", "category", "num_hh_codes", "hh_extreme_count", "hh_risk_rank", "num_providers"}


def listed(columns, prefix=""):
    return ", ".join(f"{prefix}{c}" if c in TEXTS else shown([c], prefix) for c in columns)


@query("r8_cohort_features", f"WITH {COHORT} SELECT {listed(COHORT_LIST)} FROM features")
def _(t):
    return HH.cohort_features(stages.cohort_claims(t)).select(*COHORT_LIST)


@query("m6_cohort_risk", f"WITH {COHORT} SELECT billing_npi, hh_extreme_count, {r('hh_risk_score')} hh_risk_score, hh_risk_rank, taxonomy_type FROM cohort")
def _(t):
    return HH.scored_cohort(stages.cohort_claims(t)).select("billing_npi", "hh_extreme_count", "hh_risk_score", "hh_risk_rank", "taxonomy_type")


@query("r9_cohort_pricing_outliers", f"""WITH {COHORT}, top AS (SELECT * FROM prices WHERE peer_zscore > 2 ORDER BY ROUND(peer_zscore, 9) DESC, billing_npi, hcpcs_code LIMIT 20)
 SELECT t.billing_npi, c.provider_state, t.hcpcs_code, {r('t.ppc')} ppc, {r('t.avg_ppc')} avg_ppc, {r('t.peer_zscore')} peer_zscore, {r('t.code_paid')} code_paid
 FROM top t LEFT JOIN cohort c USING (billing_npi)""")
def _(t):
    return HH.cohort_pricing_outliers(stages.cohort_prices(t), stages.cohort(t), threshold=2)


# Every test provider bills both services; without some of its claims a quarter has no nursing and another quarter no aides.
ONE_SIDED = """(hh_category = 'skilled_nursing' AND CAST(billing_npi AS BIGINT) % 8 < 2) OR (hh_category = 'aide' AND CAST(billing_npi AS BIGINT) % 8 IN (1, 5))"""


@query("a40_presence_crosstab", f"""WITH {HH_CLAIMS}, shares AS (SELECT billing_npi, SUM(CASE WHEN hh_category = 'skilled_nursing' THEN total_paid ELSE 0 END) / SUM(total_paid) a,
 SUM(CASE WHEN hh_category = 'aide' THEN total_paid ELSE 0 END) / SUM(total_paid) b FROM hh WHERE NOT ({ONE_SIDED}) GROUP BY billing_npi)
 SELECT a > 0 has_a, b > 0 has_b, COUNT(*) n FROM shares GROUP BY 1, 2""")
def _(t):
    return HH.presence_crosstab(HH.cohort_features(cut(stages.cohort_claims(t).where(f"NOT ({ONE_SIDED})"))))


UPCODING = ["billing_npi", "provider_state", "nursing_to_aide_ratio", "pct_skilled_nursing", "pct_aide", "total_paid", "paid_per_claim", "hh_risk_rank"]


@query("r10_upcoding_signals", f"WITH {COHORT} SELECT {listed(UPCODING)} FROM cohort WHERE pct_skilled_nursing > 0 AND pct_aide > 0 ORDER BY ROUND(nursing_to_aide_ratio, 9) DESC, billing_npi LIMIT 15")
def _(t):
    return HH.upcoding_signals(stages.cohort(t))


SUMMARY = """summary AS (SELECT hcpcs_code, MIN(hh_category) category, SUM(total_paid) total_paid, CAST(SUM(total_claims) AS BIGINT) total_claims,
 COUNT(DISTINCT billing_npi) num_providers, SUM(total_paid) / SUM(total_claims) avg_ppc FROM hh GROUP BY hcpcs_code)"""
SUMMARY_LIST = ["hcpcs_code", "category", "total_paid", "total_claims", "num_providers", "avg_ppc"]


@query("r11_rare_expensive_codes", f"WITH {HH_CLAIMS}, {SUMMARY} SELECT {listed(SUMMARY_LIST)} FROM summary WHERE num_providers <= 74 AND total_paid > 100000 ORDER BY ROUND(avg_ppc, 9) DESC, hcpcs_code LIMIT 15")
def _(t):
    return HH.rare_expensive_codes(stages.cohort_claims(t), max_providers=74)


@query("r12_code_deep_dive", f"""WITH {COHORT}, one AS (SELECT billing_npi, SUM(total_paid) total_paid, CAST(SUM(total_claims) AS BIGINT) total_claims FROM hh
  WHERE hcpcs_code = '{stages.DEEP_DIVE_CODE}' GROUP BY billing_npi ORDER BY SUM(total_paid) DESC, billing_npi LIMIT 15)
 SELECT o.billing_npi, {r('o.total_paid')} total_paid, o.total_claims, {r('o.total_paid / o.total_claims')} ppc, c.provider_state, c.hh_risk_rank FROM one o LEFT JOIN cohort c USING (billing_npi)""")
def _(t):
    return HH.code_deep_dive(stages.cohort_claims(t), stages.cohort(t), stages.DEEP_DIVE_CODE)


@query("r13_cohort_top_codes", f"WITH {HH_CLAIMS}, {SUMMARY} SELECT {listed(SUMMARY_LIST)} FROM summary ORDER BY total_paid DESC, hcpcs_code LIMIT 20")
def _(t):
    return HH.cohort_top_codes(stages.cohort_claims(t))


@query("a41_cohort_overview", f"""WITH {COHORT} SELECT taxonomy_type, COUNT(*) num_providers, {r('SUM(total_paid)', 3)} total_paid FROM cohort GROUP BY 1
 UNION ALL SELECT 'TOTAL', COUNT(*), {r('SUM(total_paid)', 3)} FROM cohort""", digits=3)
def _(t):
    return HH.cohort_overview(stages.cohort(t))


@query("r13_cohort_counts", f"WITH {COHORT} SELECT (SELECT COUNT(*) FROM cohort) num_providers, (SELECT COUNT(DISTINCT provider_state) FROM cohort) num_states, (SELECT COUNT(DISTINCT hcpcs_code) FROM hh) num_codes")
def _(t):
    return HH.cohort_counts(stages.cohort_claims(t), stages.cohort(t))


@query("r13_cohort_states", f"WITH {COHORT} SELECT provider_state, COUNT(*) num_providers, {r('SUM(total_paid)')} total_paid FROM cohort GROUP BY 1 ORDER BY num_providers DESC, provider_state LIMIT 10")
def _(t):
    return HH.cohort_states(stages.cohort(t))


@query("a24_code_mix", f"WITH {COHORT} " + profile_sql("cohort", HH.MIX_COLUMNS + ["nursing_to_aide_ratio"], {
    "p50": "QUANTILE_CONT({c}, 0.5)", "mean": "AVG({c})", "p75": "QUANTILE_CONT({c}, 0.75)", "p95": "QUANTILE_CONT({c}, 0.95)", "max": "MAX({c})"}))
def _(t):
    return HH.code_mix(stages.cohort(t))


DEACT = ["billing_npi", "provider_state", "total_paid", "hh_risk_rank", "hh_max_peer_zscore"]


@query("r13_cohort_deactivated", f"WITH {COHORT} SELECT {listed(DEACT)} FROM cohort WHERE is_deactivated = 1 ORDER BY total_paid DESC, billing_npi LIMIT 20")
def _(t):
    return HH.cohort_deactivated(stages.cohort(t))


@query("a42_cohort_summary", f"""WITH {COHORT}, top AS (SELECT total_paid FROM cohort ORDER BY hh_risk_rank, billing_npi LIMIT 30)
SELECT COUNT(*) num_providers, COUNT(DISTINCT provider_state) num_states, {r('SUM(total_paid)', 3)} total_paid, COUNT(*) FILTER (hh_extreme_count >= 2) n_extreme,
 {r('(SELECT SUM(total_paid) FROM top)', 3)} top_paid, {r('100 * (SELECT SUM(total_paid) FROM top) / SUM(total_paid)', 3)} top_pct,
 {r('QUANTILE_CONT(paid_per_claim, 0.5)', 3)} median_paid_per_claim, {r('QUANTILE_CONT(hh_max_peer_zscore, 0.5)', 3)} median_hh_max_peer_zscore FROM cohort""", digits=3)
def _(t):
    return HH.cohort_summary(stages.cohort(t))


TOP_LIST = ["hh_risk_rank", "billing_npi", "provider_state", "taxonomy_type", "total_paid", "paid_per_claim", "hh_max_peer_zscore",
            "pct_skilled_nursing", "pct_aide", "nursing_to_aide_ratio", "pct_non_hh", "hh_extreme_count"]


@query("r13_cohort_top", f"WITH {COHORT} SELECT {listed(TOP_LIST)} FROM cohort ORDER BY hh_risk_rank, billing_npi LIMIT 30")
def _(t):
    return HH.cohort_top(stages.cohort(t))


@query("j18_cross_reference", f"""WITH {COHORT}, paid AS MATERIALIZED (SELECT billing_npi, SUM(total_paid) paid FROM claims GROUP BY billing_npi), general AS MATERIALIZED (SELECT billing_npi, if_rank FROM (SELECT billing_npi,
  CAST(FLOOR(RANK() OVER (ORDER BY ROUND(paid, 9) DESC) + (COUNT(*) OVER (PARTITION BY ROUND(paid, 9)) - 1) / 2.0) AS BIGINT) if_rank
  FROM paid) ORDER BY if_rank, billing_npi LIMIT 60),
 own AS MATERIALIZED (SELECT billing_npi, 1 listed FROM cohort ORDER BY hh_risk_rank, billing_npi LIMIT 30)
SELECT c.billing_npi, c.provider_state, c.hh_risk_rank, {r('c.total_paid')} total_paid, g.if_rank, COALESCE(own.listed, 0) in_cohort_top
FROM cohort c JOIN general g USING (billing_npi) LEFT JOIN own USING (billing_npi)""", staged=True)
def _(t):
    general = stages.baseline(t).select("billing_npi", F.col("paid_rank").alias("if_rank"))
    return HH.cross_reference(stages.cohort(t), general, k1=30, k2=60)


@query("a32_state_concentration", f"""WITH {COHORT}, top AS (SELECT billing_npi FROM cohort ORDER BY hh_risk_rank, billing_npi LIMIT 30),
s AS (SELECT provider_state, COUNT(*) n, COUNT(*) FILTER (billing_npi IN (SELECT billing_npi FROM top)) k,
 COALESCE(SUM(total_paid) FILTER (billing_npi IN (SELECT billing_npi FROM top)), 0) top_spending, AVG(hh_risk_score) mean_risk_score, SUM(total_paid) total_spending FROM cohort GROUP BY 1)
SELECT provider_state "state", n n_providers, k n_in_top, {r('top_spending')} top_spending, {r('mean_risk_score')} mean_risk_score, {r('total_spending')} total_spending,
 {r('100.0 * k / n')} concentration_pct, {r('100.0 * top_spending / total_spending')} spending_exposure_pct FROM s""")
def _(t):
    return HH.state_concentration(stages.cohort(t), 30)


COMPARED = f"""{COHORT}, {LOCAL}, compared AS (SELECT l.billing_npi, l.hh_risk_rank local_rank, l.hh_risk_score local_score, n.hh_risk_rank national_rank,
 n.hh_risk_score national_score, n.total_paid, n.provider_state, l.hh_risk_rank - n.hh_risk_rank rank_delta FROM local_cohort l JOIN cohort n USING (billing_npi))"""
COMPARED_LIST = f"billing_npi, local_rank, {r('local_score')} local_score, national_rank, {r('national_score')} national_score, {r('total_paid')} total_paid, provider_state, rank_delta"


@query("j19_compare_ranks", f"WITH {COMPARED} SELECT {COMPARED_LIST} FROM compared")
def _(t):
    return HH.compare_ranks(stages.local_cohort(t), stages.cohort(t))


@query("o3_movers", f"""WITH {COMPARED}, up AS (SELECT *, 'climber' direction FROM compared ORDER BY rank_delta DESC, billing_npi LIMIT 10),
 down AS (SELECT *, 'faller' direction FROM compared ORDER BY rank_delta, billing_npi LIMIT 10), both_ways AS (SELECT * FROM up UNION ALL SELECT * FROM down)
 SELECT {COMPARED_LIST}, direction FROM both_ways""")
def _(t):
    return ranking.movers(HH.compare_ranks(stages.local_cohort(t), stages.cohort(t)), "billing_npi")


STABLE = f"""{COMPARED}, t10 AS MATERIALIZED (SELECT billing_npi, 1 listed FROM cohort ORDER BY hh_risk_rank, billing_npi LIMIT 10),
t40 AS MATERIALIZED (SELECT billing_npi, 1 listed FROM cohort ORDER BY hh_risk_rank, billing_npi LIMIT 40),
best_local AS MATERIALIZED (SELECT * FROM local_cohort ORDER BY hh_risk_rank, billing_npi LIMIT 10),
stability AS (SELECT b.billing_npi, b.hh_risk_rank local_rank, c.national_rank, COALESCE(c.total_paid, b.total_paid) total_paid,
 COALESCE(t10.listed, 0) in_top_10, COALESCE(t40.listed, 0) in_top_40
 FROM best_local b LEFT JOIN compared c ON b.billing_npi = c.billing_npi LEFT JOIN t10 ON b.billing_npi = t10.billing_npi LEFT JOIN t40 ON b.billing_npi = t40.billing_npi)"""


def stable(t):
    return HH.rank_stability(stages.local_cohort(t), stages.cohort(t), k=10, wide_k=40)


@query("r15_rank_stability", f"WITH {STABLE} SELECT billing_npi, local_rank, national_rank, {r('total_paid')} total_paid, in_top_10, in_top_40 FROM stability", staged=True)
def _(t):
    return stable(t)["stability"]


@query("r15_rank_stability_counts", f"""WITH {STABLE} SELECT COUNT(*) matched, COUNT(*) FILTER (billing_npi IN (SELECT billing_npi FROM t10)) in_top_10,
 COUNT(*) FILTER (billing_npi IN (SELECT billing_npi FROM t40)) in_top_40, (SELECT COUNT(*) FROM local_cohort) local_providers FROM compared""")
def _(t):
    return stable(t)["counts"]


@query("r15_rank_stability_best", f"WITH {COMPARED} SELECT {COMPARED_LIST} FROM compared ORDER BY compared.national_rank, billing_npi LIMIT 20")
def _(t):
    return stable(t)["best"]


@query("r15_rank_stability_kept", f"WITH {STABLE} SELECT CAST(SUM(in_top_10) AS BIGINT) still_top_10, CAST(SUM(in_top_40) AS BIGINT) still_top_40 FROM stability")
def _(t):
    return stable(t)["kept"]


@query("r14_state_concentration", f"""WITH {COHORT}, top AS (SELECT billing_npi FROM cohort ORDER BY hh_risk_rank, billing_npi LIMIT 100)
SELECT provider_state "state", COUNT(*) n_providers, COUNT(*) FILTER (billing_npi IN (SELECT billing_npi FROM top)) n_in_top,
 {r('100.0 * COUNT(*) FILTER (billing_npi IN (SELECT billing_npi FROM top)) / COUNT(*)')} concentration_pct FROM cohort GROUP BY 1""")
def _(t):
    return HH.state_concentration(stages.cohort(t)).select("state", "n_providers", "n_in_top", "concentration_pct")
