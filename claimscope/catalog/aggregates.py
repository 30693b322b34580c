"""Joins and aggregations over the claims, and column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimscope.catalog import stages
from claimscope.catalog.registry import query, r
from claimscope.catalog.rows import CODES
from claimscope.functions import columns as X
from claimscope.operators import claims as C
from claimscope.operators import peers, profile, ranking
from claimscope.plans import cohort as HH
from claimscope.plans import providers as P
from claimscope.session import cut

GATE = stages.GATE
MONTHS = "months AS (SELECT billing_npi, claim_from_month, SUM(total_paid) monthly_paid FROM claims GROUP BY ALL)"
STATS = f"""stats AS (SELECT hcpcs_code, AVG(ppc) avg_ppc, STDDEV_POP(ppc) std_ppc, COUNT(*) num_providers
 FROM codes GROUP BY hcpcs_code HAVING COUNT(*) >= {GATE})"""
SCORED = """scored AS (SELECT c.*, s.avg_ppc, s.std_ppc, s.num_providers,
 CASE WHEN s.std_ppc > 0 THEN (c.ppc - s.avg_ppc) / s.std_ppc ELSE 0 END peer_zscore FROM codes c LEFT JOIN stats s USING (hcpcs_code))"""
ROLLUP = """rollup_z AS (SELECT billing_npi, MAX(peer_zscore) max_peer_zscore,
 COALESCE(SUM(peer_zscore * code_paid) / NULLIF(SUM(code_paid), 0), 0) mean_peer_zscore FROM scored GROUP BY billing_npi)"""
TOTALS = """totals AS (SELECT billing_npi, SUM(total_paid) total_paid, CAST(SUM(total_claims) AS BIGINT) total_claims,
 CAST(SUM(total_unique_beneficiaries) AS BIGINT) total_beneficiaries, COUNT(DISTINCT hcpcs_code) num_hcpcs_codes,
 COUNT(DISTINCT claim_from_month) num_active_months, COUNT(*) num_rows,
 AVG((total_paid = ROUND(total_paid, 0))::INT) pct_round_dollar, AVG((total_paid % 100 = 0)::INT) pct_round_hundred,
 AVG((billing_npi <> servicing_npi)::INT) pct_npi_mismatch FROM claims GROUP BY billing_npi)"""
MONTHLY = """monthly AS (SELECT billing_npi, MAX(monthly_paid) max_monthly_paid,
 CASE WHEN AVG(monthly_paid) > 0 THEN STDDEV_POP(monthly_paid) / AVG(monthly_paid) ELSE 0 END monthly_paid_cv
 FROM months GROUP BY billing_npi)"""
TOP_CODE = "top_code AS (SELECT billing_npi, MAX(code_paid) top_code_paid, SUM(code_paid) all_paid FROM codes GROUP BY billing_npi)"
FEATURES = f"""{CODES}, {STATS}, {SCORED}, {ROLLUP}, {TOTALS}, {MONTHS}, {MONTHLY}, {TOP_CODE},
registry AS (SELECT *, CASE WHEN deactivation_date IS NOT NULL OR npi IN (SELECT npi FROM deactivated) THEN 1 ELSE 0 END is_deactivated,
 CASE WHEN reactivation_date IS NULL THEN 0 ELSE 1 END was_reactivated, CASE WHEN sole_proprietor = 'Y' THEN 1 ELSE 0 END is_sole_proprietor,
 CASE WHEN org_subpart = 'Y' THEN 1 ELSE 0 END is_org_subpart,
 1 + (taxonomy_2 IS NOT NULL)::INT + (taxonomy_3 IS NOT NULL)::INT num_taxonomy_codes,
 DATE_DIFF('day', enumeration_date, DATE '{stages.AS_OF}') / 365.25 provider_age_years FROM providers),
features AS (SELECT t.*, t.total_paid / NULLIF(t.total_claims, 0) paid_per_claim,
 t.total_claims::DOUBLE / NULLIF(t.total_beneficiaries, 0) claims_per_beneficiary,
 t.total_paid / NULLIF(t.total_beneficiaries, 0) paid_per_beneficiary, c.top_code_paid / NULLIF(t.total_paid, 0) revenue_concentration,
 m.monthly_paid_cv, m.max_monthly_paid, z.max_peer_zscore, z.mean_peer_zscore, g.entity_type, g.provider_age_years,
 g.is_deactivated, g.was_reactivated, g.is_sole_proprietor, g.is_org_subpart, g.num_taxonomy_codes, g.primary_taxonomy
 FROM totals t JOIN top_code c USING (billing_npi) JOIN monthly m USING (billing_npi) JOIN rollup_z z USING (billing_npi)
 JOIN registry g ON g.npi = t.billing_npi)"""
WHOLE = {
    "billing_npi", "total_claims", "total_beneficiaries", "num_hcpcs_codes", "num_active_months", "num_rows", "entity_type",
    "is_deactivated", "was_reactivated", "is_sole_proprietor", "is_org_subpart", "num_taxonomy_codes", "primary_taxonomy",
}


def shown(columns, prefix=""):
    """SQL select list in which every column that is no whole number or text is rounded."""
    return ", ".join(f"{prefix}{c} {c}" if c in WHOLE else f"{r(prefix + c)} {c}" for c in columns)


# --- joins ---------------------------------------------------------------------------------------------------------

@query("j1_enrich_claims", f"""SELECT billing_npi, hcpcs_code, {r('total_paid')} total_paid, state, entity_type, enumeration_date
 FROM claims JOIN providers ON billing_npi = npi WHERE state = 'NATION_3'""")
def _(t):
    return C.enrich_claims(t.claims, C.scope_state(t.providers, "NATION_3")).select(
        "billing_npi", "hcpcs_code", "total_paid", "state", "entity_type", "enumeration_date"
    )


@query("j2_attach_peer_stats", f"WITH {CODES}, {STATS} SELECT billing_npi, hcpcs_code, {r('ppc')} ppc, {r('avg_ppc')} avg_ppc, {r('std_ppc')} std_ppc, num_providers FROM codes LEFT JOIN stats USING (hcpcs_code)")
def _(t):
    codes = stages.codes(t)
    stats = peers.min_peers(peers.peer_stats(codes, ddof=0), GATE)
    return peers.attach_peer_stats(codes, stats).select("billing_npi", "hcpcs_code", "ppc", "avg_ppc", "std_ppc", "num_providers")


@query("j3_assemble", f"WITH {FEATURES} SELECT {shown(['billing_npi', 'total_paid', 'num_rows', 'revenue_concentration', 'monthly_paid_cv', 'max_monthly_paid', 'max_peer_zscore', 'mean_peer_zscore'])} FROM features")
def _(t):
    codes = stages.codes(t)
    z = peers.peer_zscore(codes, min_count=GATE, ddof=0)
    months = C.monthly_stats(C.provider_month(t.claims), ddof=0)
    joined = C.assemble(C.provider_totals(codes), C.concentration(codes), months, peers.peer_rollup(z))
    return joined.select(
        "billing_npi", "total_paid", "num_rows", "revenue_concentration", "monthly_paid_cv", "max_monthly_paid",
        "max_peer_zscore", "mean_peer_zscore",
    )


@query("j4_flag_in", "SELECT npi, state, CASE WHEN npi IN (SELECT npi FROM deactivated) THEN 1 ELSE 0 END listed FROM providers")
def _(t):
    return C.flag_in(t.providers, t.deactivated.unionByName(t.deactivated), "npi", "listed").select("npi", "state", "listed")


MULTI = "multi AS (SELECT ao_last, ao_first FROM org_npis GROUP BY ALL HAVING COUNT(DISTINCT npi) >= 2)"
EXPOSURE = f"""{MULTI}, members AS (SELECT DISTINCT npi, ao_last, ao_first FROM org_npis JOIN multi USING (ao_last, ao_first)),
exposure AS (SELECT billing_npi, SUM(total_paid) total_paid, CAST(SUM(total_claims) AS BIGINT) total_claims,
 CAST(SUM(total_unique_beneficiaries) AS BIGINT) total_beneficiaries, COUNT(DISTINCT hcpcs_code) num_hcpcs,
 COUNT(DISTINCT claim_from_month) num_months FROM org_claims WHERE billing_npi IN (SELECT npi FROM members) GROUP BY billing_npi)"""


@query("j5_claims_of", f"WITH {EXPOSURE} SELECT billing_npi, hcpcs_code, claim_from_month, {r('total_paid')} total_paid FROM org_claims WHERE billing_npi IN (SELECT npi FROM members)")
def _(t):
    claims = C.claims_of(t.org_claims, stages.networks(t).members)
    return claims.select("billing_npi", "hcpcs_code", "claim_from_month", "total_paid")


# --- aggregations over claims --------------------------------------------------------------------------------------

@query("a1_distinct_ids", "SELECT COUNT(DISTINCT billing_npi) national_providers FROM claims")
def _(t):
    return C.distinct_ids(t.claims)


@query("a2_provider_code", f"WITH {CODES} SELECT billing_npi, hcpcs_code, {r('code_paid')} code_paid, code_claims, {r('ppc')} ppc FROM codes")
def _(t):
    return C.provider_code(t.claims).select("billing_npi", "hcpcs_code", "code_paid", "code_claims", "ppc")


@query("a3_peer_stats_population", f"WITH {CODES} SELECT hcpcs_code, {r('AVG(ppc)')} avg_ppc, {r('STDDEV_POP(ppc)')} std_ppc, COUNT(*) num_providers FROM codes GROUP BY hcpcs_code")
def _(t):
    return peers.peer_stats(C.provider_code(t.claims), ddof=0)


@query("a3_peer_stats_sample", f"WITH {CODES} SELECT hcpcs_code, {r('AVG(ppc)')} avg_ppc, {r('STDDEV_SAMP(ppc)')} std_ppc, COUNT(DISTINCT billing_npi) num_providers FROM codes GROUP BY hcpcs_code")
def _(t):
    return peers.peer_stats(C.provider_code(t.claims), ddof=1)


@query("a4_peer_rollup", f"WITH {CODES}, {STATS}, {SCORED}, {ROLLUP} SELECT {shown(['billing_npi', 'max_peer_zscore', 'mean_peer_zscore'])} FROM rollup_z")
def _(t):
    return peers.peer_rollup(peers.peer_zscore(stages.codes(t), min_count=GATE, ddof=0))


@query("a5_provider_month", f"WITH {MONTHS} SELECT billing_npi, claim_from_month, {r('monthly_paid')} monthly_paid FROM months")
def _(t):
    return C.provider_month(t.claims)


@query("a6_monthly_stats_population", f"WITH {MONTHS}, {MONTHLY} SELECT {shown(['billing_npi', 'monthly_paid_cv', 'max_monthly_paid'])}, (SELECT COUNT(*) FROM months m WHERE m.billing_npi = monthly.billing_npi) num_active_months FROM monthly")
def _(t):
    return C.monthly_stats(C.provider_month(t.claims), ddof=0)


@query("a6_monthly_stats_sample", f"""WITH {MONTHS} SELECT billing_npi, COUNT(*) num_active_months, {r('MAX(monthly_paid)')} max_monthly_paid,
 {r('COALESCE(STDDEV_SAMP(monthly_paid) / NULLIF(AVG(monthly_paid), 0), 0)')} monthly_paid_cv FROM months GROUP BY billing_npi""")
def _(t):
    return C.monthly_stats(C.provider_month(t.claims), ddof=1)


@query("a7_concentration", f"WITH {CODES}, {TOP_CODE} SELECT billing_npi, {r('top_code_paid')} top_code_paid, {r('top_code_paid / NULLIF(all_paid, 0)')} revenue_concentration FROM top_code")
def _(t):
    return C.concentration(C.provider_code(t.claims))


VOLUME = ["billing_npi", "total_paid", "total_claims", "total_beneficiaries", "num_hcpcs_codes", "num_active_months", "num_rows",
          "paid_per_claim", "claims_per_beneficiary", "paid_per_beneficiary"]


@query("a8_provider_totals", f"WITH {FEATURES} SELECT {shown(VOLUME)} FROM features")
def _(t):
    months = C.monthly_stats(C.provider_month(t.claims), ddof=0)
    return C.provider_totals(C.provider_code(t.claims), months).select(*VOLUME)


@query("a8b_cohort_totals", f"""WITH {FEATURES} SELECT {shown(VOLUME, 'f.')}, p.primary_taxonomy, p.state provider_state,
 CASE WHEN p.deactivation_date IS NULL THEN 0 ELSE 1 END is_deactivated FROM features f JOIN providers p ON p.npi = f.billing_npi WHERE p.primary_taxonomy LIKE '25%'""")
def _(t):
    claims = stages.cohort_claims(t)
    attributes = C.constant_attrs(claims, "billing_npi", ["primary_taxonomy", "provider_state", "is_deactivated"])
    months = C.monthly_stats(C.provider_month(claims), ddof=1)
    return C.assemble(C.provider_totals(C.provider_code(claims), months), attributes).select(
        *VOLUME, "primary_taxonomy", "provider_state", "is_deactivated"
    )


@query("a9_billing_patterns", f"WITH {TOTALS} SELECT {shown(['billing_npi', 'pct_round_dollar', 'pct_round_hundred', 'pct_npi_mismatch'])} FROM totals")
def _(t):
    return C.billing_patterns(C.provider_code(t.claims))


@query("a9_share_where", f"WITH {TOTALS} SELECT {shown(['billing_npi', 'pct_round_dollar', 'pct_npi_mismatch'])} FROM totals")
def _(t):
    return C.share_where(t.claims, "billing_npi", {
        "pct_round_dollar": X.whole_dollars("total_paid"), "pct_npi_mismatch": F.col("billing_npi") != F.col("servicing_npi"),
    })


@query("a10_constant_attrs", "SELECT billing_npi, MAX(state) state, MAX(entity_type) entity_type, MAX(deactivation_date) deactivation_date FROM claims JOIN providers ON billing_npi = npi GROUP BY billing_npi")
def _(t):
    return C.constant_attrs(C.enrich_claims(t.claims, t.providers), "billing_npi", ["state", "entity_type", "deactivation_date"])


HH_CATEGORIES = ["skilled_nursing", "aide", "personal_care", "therapy", "assessment", "non_hh"]
HH_CLAIMS = """hh AS (SELECT c.*, p.primary_taxonomy, p.state provider_state, CASE WHEN p.deactivation_date IS NULL THEN 0 ELSE 1 END is_deactivated,
 COALESCE(k.hh_category, 'non_hh') hh_category FROM claims c JOIN providers p ON c.billing_npi = p.npi
 LEFT JOIN code_categories k ON c.hcpcs_code = k.hcpcs_code WHERE p.primary_taxonomy LIKE '25%')"""
MIX = "mix AS (SELECT billing_npi, SUM(total_paid) total_paid, " + ", ".join(
    f"SUM(CASE WHEN hh_category = '{c}' THEN total_paid ELSE 0 END) paid_{c}" for c in HH_CATEGORIES
) + " FROM hh GROUP BY billing_npi)"


@query("a11_category_mix", f"WITH {HH_CLAIMS}, {MIX} SELECT billing_npi, " + ", ".join(
    f"{r(f'paid_{c}')} paid_{c}, {r(f'paid_{c} / NULLIF(total_paid, 0)')} pct_{c}" for c in HH_CATEGORIES) + " FROM mix")
def _(t):
    return C.category_mix(stages.cohort_claims(t))


@query("a12_ratio", f"WITH {HH_CLAIMS}, {MIX} SELECT billing_npi, {r('paid_skilled_nursing / (paid_aide + 1)')} nursing_to_aide_ratio FROM mix")
def _(t):
    mix = C.add_ratio(C.category_mix(stages.cohort_claims(t)), "paid_skilled_nursing", "paid_aide", "nursing_to_aide_ratio")
    return mix.select("billing_npi", "nursing_to_aide_ratio")


@query("a13_cohort_codes", f"WITH {HH_CLAIMS} SELECT billing_npi, COUNT(DISTINCT CASE WHEN hh_category <> 'non_hh' THEN hcpcs_code END) num_hh_codes FROM hh GROUP BY billing_npi")
def _(t):
    return C.cohort_codes(stages.cohort_claims(t))


@query("a17_exposure_by_npi", f"WITH {EXPOSURE} SELECT billing_npi, {r('total_paid')} total_paid, total_claims, total_beneficiaries, num_hcpcs, num_months FROM exposure")
def _(t):
    return C.exposure_by_npi(C.claims_of(t.org_claims, stages.networks(t).members))


@query("a31_code_summary", f"""WITH {HH_CLAIMS} SELECT hcpcs_code, MIN(hh_category) category, {r('SUM(total_paid)')} total_paid,
 CAST(SUM(total_claims) AS BIGINT) total_claims, COUNT(DISTINCT billing_npi) num_providers, {r('SUM(total_paid) / SUM(total_claims)')} avg_ppc FROM hh GROUP BY hcpcs_code""")
def _(t):
    return C.code_summary(stages.cohort_claims(t))


# --- profiles ------------------------------------------------------------------------------------------------------

def profile_sql(source, columns, statistics):
    """One select per column: {output: aggregate of {c}}."""
    return " UNION ALL ".join(
        f"SELECT '{c}' \"column\", " + ", ".join(f"{r(text.replace('{c}', f'CAST({c} AS DOUBLE)'))} {name}" for name, text in statistics.items())
        + f" FROM {source}" for c in columns
    )


Q = {f"p{p}": f"QUANTILE_CONT({{c}}, {p / 100})" for p in (25, 50, 75, 95, 99)}
FULL = {"min": "MIN({c})", "max": "MAX({c})", "mean": "AVG({c})", "std": "STDDEV_SAMP({c})"}


@query("a22_numeric_profile", profile_sql("claims", ["total_unique_beneficiaries", "total_claims", "total_paid"], {**FULL, **Q}))
def _(t):
    return profile.numeric_profile(t.claims, ["total_unique_beneficiaries", "total_claims", "total_paid"])


@query("a23_feature_profile", f"WITH {FEATURES} " + profile_sql("features", P.PROFILE_FEATURES, {"p50": Q["p50"], "mean": FULL["mean"], "max": FULL["max"]}))
def _(t):
    return P.feature_summary(stages.features(t))


@query("a23_score_quantiles", f"WITH {FEATURES} " + profile_sql("features", ["max_peer_zscore"], {
    **FULL, **{f"p{p}": f"QUANTILE_CONT({{c}}, {p / 100})" for p in (25, 50, 75, 90, 95, 99, 100)}}))
def _(t):
    return P.score_quantiles(stages.features(t), "max_peer_zscore")


@query("a25_null_profile", " UNION ALL ".join(
    f"SELECT '{c}' \"column\", '{kind}' \"type\", COUNT(*) FILTER ({c} IS NULL) null_count, {r(f'100.0 * COUNT(*) FILTER ({c} IS NULL) / COUNT(*)')} null_pct FROM providers"
    for c, kind in {"npi": "string", "entity_type": "int", "state": "string", "primary_taxonomy": "string", "enumeration_date": "date",
                    "deactivation_date": "date", "reactivation_date": "date", "sole_proprietor": "string", "org_subpart": "string",
                    "taxonomy_2": "string", "taxonomy_3": "string"}.items()))
def _(t):
    return profile.null_profile(t.view("providers"))


@query("a26_cardinality", " UNION ALL ".join(
    f"SELECT '{c}' \"column\", COUNT(DISTINCT {c}) distinct_values FROM claims" for c in (
        "billing_npi", "servicing_npi", "hcpcs_code", "claim_from_month", "total_unique_beneficiaries", "total_claims", "total_paid")))
def _(t):
    return profile.cardinality(t.claims)


SKETCHED = ["billing_npi", "servicing_npi", "hcpcs_code", "total_claims", "total_paid"]


@query("a26_sketched_cardinality", " UNION ALL ".join(f"SELECT '{c}' \"column\", COUNT(DISTINCT {c}) distinct_values, TRUE within_margin FROM claims" for c in SKETCHED))
def _(t):
    # Sketches of each month, stored, then united, beside the exact counts.
    sketches = cut(profile.cardinality_sketches(t.claims, SKETCHED, "claim_from_month"))
    exact = profile.cardinality(t.claims.select(*SKETCHED))
    near = F.abs(F.col("about") - F.col("distinct_values")) <= F.col("margin")
    return exact.join(profile.sketched_cardinality(sketches, SKETCHED), "column").select("column", "distinct_values", near.alias("within_margin"))


@query("a27_length_histogram", "SELECT CAST(LENGTH(hcpcs_code) AS INTEGER) length, COUNT(*) n FROM claims GROUP BY 1")
def _(t):
    return profile.length_histogram(t.claims, "hcpcs_code")


@query("a28_date_profile", """SELECT MIN(TRY_CAST(d AS DATE)) "first", MAX(TRY_CAST(d AS DATE)) "last",
 COUNT(*) FILTER (TRY_CAST(d AS DATE) IS NULL) unparseable FROM (SELECT CASE WHEN total_claims = 7 THEN 'unknown' ELSE CAST(claim_from_month AS STRING) END d FROM claims)""")
def _(t):
    text = F.when(F.col("total_claims") == 7, F.lit("unknown")).otherwise(F.col("claim_from_month").cast("string"))
    return profile.date_profile(t.claims.select(text.alias("d")), "d")


@query("a29_frequency", f"SELECT hcpcs_code, COUNT(*) n, {r('100.0 * COUNT(*) / (SELECT COUNT(*) FROM claims)')} pct FROM claims GROUP BY hcpcs_code ORDER BY n DESC, hcpcs_code LIMIT 20")
def _(t):
    return profile.frequency(t.claims, "hcpcs_code", 20)


@query("a30_rate_where", f"""SELECT 'same_npi' kind, COUNT(*) FILTER (billing_npi = servicing_npi) n, COUNT(*) total, {r('100.0 * COUNT(*) FILTER (billing_npi = servicing_npi) / COUNT(*)')} pct FROM claims
 UNION ALL SELECT 'whole_dollars', COUNT(*) FILTER (total_paid = ROUND(total_paid, 0)), COUNT(*), {r('100.0 * COUNT(*) FILTER (total_paid = ROUND(total_paid, 0)) / COUNT(*)')} FROM claims
 UNION ALL SELECT 'hundreds', COUNT(*) FILTER (total_paid % 100 = 0), COUNT(*), {r('100.0 * COUNT(*) FILTER (total_paid % 100 = 0) / COUNT(*)')} FROM claims""")
def _(t):
    rates = {
        "same_npi": F.col("billing_npi") == F.col("servicing_npi"), "whole_dollars": X.whole_dollars("total_paid"),
        "hundreds": X.multiple_of_100("total_paid"),
    }
    result = None
    for name, condition in rates.items():
        row = profile.rate_where(t.claims, condition).select(F.lit(name).alias("kind"), "n", "total", "pct")
        result = row if result is None else result.unionByName(row)
    return result


# --- the flagship slice --------------------------------------------------------------------------------------------

@query("flagship_price_outliers", f"WITH {CODES}, {STATS}, {SCORED}, {ROLLUP} SELECT {shown(['billing_npi', 'max_peer_zscore', 'mean_peer_zscore'])} FROM rollup_z ORDER BY ROUND(mean_peer_zscore, 9) DESC, billing_npi LIMIT 20")
def _(t):
    z = peers.peer_zscore(stages.codes(t), min_count=GATE, ddof=0)
    return ranking.sort_head(peers.peer_rollup(z), [F.desc(F.round("mean_peer_zscore", 9)), "billing_npi"], 20)


@query("r7_extract_cohort_claims", f"WITH {HH_CLAIMS} SELECT billing_npi, servicing_npi, hcpcs_code, claim_from_month, total_unique_beneficiaries, total_claims, {r('total_paid')} total_paid, primary_taxonomy, provider_state, is_deactivated FROM hh")
def _(t):
    return HH.extract_cohort_claims(t.claims, t.providers)
