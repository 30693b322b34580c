"""Sources and sinks, projections and filters, scalar functions, ranks, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimscope.catalog import stages
from claimscope.catalog.registry import big, query, r
from claimscope.catalog.views import VIEWS
from claimscope.functions import columns as X
from claimscope.functions.constants import (
    EXCLUSION_COLUMNS, INDIVIDUAL_COLUMNS, MODEL_FEATURES, ORGANISATION_COLUMNS, PROVIDER_COLUMNS, SPENDING_COLUMNS,
)
from claimscope.operators import claims as C
from claimscope.operators import matching as M
from claimscope.operators import networks as N
from claimscope.operators import peers, ranking, risk, sets
from claimscope.operators.scale import lookup_join
from claimscope.plans import cohort as HH
from claimscope.session import scratch_path
from claimscope.sources import readers

CODES = """codes AS (
 SELECT billing_npi, hcpcs_code, SUM(total_paid) code_paid, CAST(SUM(total_claims) AS BIGINT) code_claims,
  SUM(total_paid) / NULLIF(SUM(total_claims), 0) ppc
 FROM claims GROUP BY billing_npi, hcpcs_code)"""
PAID = "paid AS (SELECT billing_npi, SUM(total_paid) total_paid, COUNT(*) n FROM claims GROUP BY billing_npi)"


def paid(t):
    return t.claims.groupBy("billing_npi").agg(F.sum("total_paid").alias("total_paid"), F.count(F.lit(1)).alias("n"))


def _as_file(t, df, mapping):
    """Write a view as a CSV file under the headers of the public file; headers it lacks become empty columns."""
    path = scratch_path(t.spark, "csv")
    cols = [(F.col(name) if name in df.columns else F.lit(None).cast("string")).alias(header) for header, name in mapping.items()]
    (
        df.select(*cols).write.option("header", True).option("escape", '"').option("dateFormat", "MM/dd/yyyy")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )
    return path


# --- sources and sinks -------------------------------------------------------------------------------------------

@query("s1_read_spending", f"SELECT billing_npi, servicing_npi, hcpcs_code, claim_from_month, total_unique_beneficiaries, total_claims, {r('total_paid')} total_paid FROM claims")
def _(t):
    path = scratch_path(t.spark, "spending")
    named = t.claims.select(*[F.col(name).alias(header) for header, (name, _) in SPENDING_COLUMNS.items()])
    named.write.option("header", True).csv(path)
    return readers.read_spending(t.spark, path)


@query("s2_read_registry", """SELECT npi, entity_type, enumeration_date, deactivation_date, reactivation_date, sole_proprietor,
 org_subpart, state, primary_taxonomy,
 1 + CASE WHEN taxonomy_2 IS NULL THEN 0 ELSE 1 END + CASE WHEN taxonomy_3 IS NULL THEN 0 ELSE 1 END num_taxonomy_codes FROM providers""")
def _(t):
    source = t.providers.withColumn("taxonomy_1", F.col("primary_taxonomy")).drop("primary_taxonomy")
    return readers.read_providers(t.spark, _as_file(t, source, PROVIDER_COLUMNS))


@query("s2_read_organisations", """SELECT npi, entity_type, org_name, org_dba, state, ao_last, ao_first, ao_middle,
 CAST(NULL AS STRING) parent_org_tin FROM raw_orgs""")
def _(t):
    read = readers.read_organisations(t.spark, _as_file(t, t.raw_orgs, ORGANISATION_COLUMNS))
    return read.select("npi", "entity_type", "org_name", "org_dba", "state", "ao_last", "ao_first", "ao_middle", "parent_org_tin")


@query("s2_read_individuals", "SELECT npi, entity_type, ind_last, ind_first, ind_state, deactivation_date, ind_taxonomy FROM individuals")
def _(t):
    return readers.read_individuals(t.spark, _as_file(t, t.individuals, INDIVIDUAL_COLUMNS))


@query("s3_read_deactivated", "SELECT DISTINCT npi FROM deactivated")
def _(t):
    path = scratch_path(t.spark, "deactivated")
    titles = t.deactivated.limit(2).select(F.lit("Deactivated NPI Report").alias("npi"))
    titles.unionByName(t.deactivated).unionByName(t.deactivated).write.csv(path)
    return readers.read_deactivated(t.spark, path)


@query("s3_read_deactivated_table", "SELECT DISTINCT npi FROM deactivated")
def _(t):
    path = scratch_path(t.spark, "listed")  # a folder name says nothing about the format
    t.deactivated.select("npi").write.parquet(path)
    return readers.read_deactivated(t.spark, path, format="parquet")


@query("s4_read_exclusions", "SELECT lastname, firstname, midname, busname, npi, city, state, excltype, excldate FROM exclusions")
def _(t):
    blank_to_null = t.exclusions.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in t.exclusions.columns})
    return readers.read_exclusions(t.spark, _as_file(t, blank_to_null, EXCLUSION_COLUMNS))


@query("s5_read_stage", f"SELECT billing_npi, {r('total_paid')} total_paid, n FROM (SELECT billing_npi, SUM(total_paid) total_paid, COUNT(*) n FROM claims GROUP BY billing_npi)")
def _(t):
    path = scratch_path(t.spark, "stage") + ".parquet"
    readers.write_stage(paid(t), path)
    return readers.read_stage(t.spark, path)


@query("s6_write_stage", f"WITH {CODES} SELECT billing_npi, hcpcs_code, {r('code_paid')} code_paid, code_claims, {r('ppc')} ppc FROM codes")
def _(t):
    path = scratch_path(t.spark, "stage")
    readers.write_stage(C.provider_code(t.claims), path)
    return readers.read_stage(t.spark, path).select("billing_npi", "hcpcs_code", "code_paid", "code_claims", "ppc")


CORRECTED = "DATE '1996-08-01'"


@query("s6_rerun_month", f"""SELECT claim_from_month, {r(f'SUM(CASE WHEN claim_from_month = {CORRECTED} THEN 2 * total_paid ELSE total_paid END)', 3)} paid,
 COUNT(*) num_rows FROM claims GROUP BY 1""", digits=3)
def _(t):
    path = scratch_path(t.spark, "months")
    readers.write_stage(C.month_sums(t.claims), path, partition_by=["claim_from_month"])
    corrected = t.claims.where(f"claim_from_month = {CORRECTED}").withColumn("total_paid", 2 * F.col("total_paid"))
    readers.rewrite_partitions(C.month_sums(corrected), path, ["claim_from_month"])
    months = readers.read_stage(t.spark, path).groupBy("claim_from_month")
    return months.agg(F.sum("code_paid").alias("paid"), F.sum("code_rows").alias("num_rows"))


@query("a2_provider_code_of_months", f"WITH {CODES} SELECT billing_npi, hcpcs_code, {r('code_paid')} code_paid, code_claims, {r('ppc')} ppc FROM codes")
def _(t):
    return C.provider_code_of(C.month_sums(t.claims)).select("billing_npi", "hcpcs_code", "code_paid", "code_claims", "ppc")


@query("s7_write_without_arrays", "SELECT ao_last, ao_first, COUNT(DISTINCT npi) npi_count FROM org_npis GROUP BY ao_last, ao_first")
def _(t):
    path = scratch_path(t.spark, "networks")
    grouped = t.orgs.groupBy("ao_last", "ao_first").agg(
        F.countDistinct("npi").alias("npi_count"), ranking.sorted_distinct("state").alias("states")
    )
    readers.write_stage(grouped, path, drop_arrays=True)
    return readers.read_stage(t.spark, path)


@query("s8_optional_input", f"SELECT billing_npi, hcpcs_code, {r('total_paid')} total_paid, 'CA' provider_state, 0 is_deactivated FROM claims")
def _(t):
    earlier_run = t.claims.select("billing_npi", "hcpcs_code", "total_paid")
    return HH.with_defaults(earlier_run, "CA")


@query("s9_head", f"""SELECT billing_npi, hcpcs_code, claim_from_month, {r('total_paid')} total_paid FROM claims
 ORDER BY total_paid DESC, billing_npi, hcpcs_code, claim_from_month LIMIT 10""")
def _(t):
    order = [F.desc("total_paid"), "billing_npi", "hcpcs_code", "claim_from_month"]
    return readers.head(t.claims, 10, order).select("billing_npi", "hcpcs_code", "claim_from_month", "total_paid")


DRAWN = "SELECT * FROM (SELECT *, ROW_NUMBER() OVER () - 1 row_address FROM lineitem) ORDER BY MD5('42|' || row_address) LIMIT 10000"
SAMPLED = VIEWS["claims"].strip().replace("{lineitem}", "drawn").replace("{part}", "part")


@query("s10_uniform_sample", f"""WITH drawn AS ({DRAWN}), sampled AS ({SAMPLED})
 SELECT billing_npi, servicing_npi, hcpcs_code, claim_from_month, total_unique_beneficiaries, total_claims, {r('total_paid')} total_paid,
 (SELECT COUNT(*) FROM lineitem) total_rows FROM sampled""")
def _(t):
    # Each claim is a row of the one file of line items: its number there is its address.
    rows = t.spark.read.parquet(f"{t.sf_dir}/lineitem.parquet").select("*", readers.row_address()[1].alias("row_address"))
    total, sample = readers.uniform_sample(rows, 10_000, 42, ["row_address"])
    part = t.spark.read.parquet(f"{t.sf_dir}/part.parquet")
    return t.spark.sql(VIEWS["claims"], lineitem=sample, part=part).withColumn("total_rows", F.lit(total).cast("bigint"))


@query("s10_sample_properties", "SELECT COUNT(*) total_rows, LEAST(10000, COUNT(*)) sample_rows, 0 not_in_claims FROM claims")
def _(t):
    total, sample = readers.uniform_sample(t.claims, 10_000, 42)
    strange = sample.exceptAll(t.claims)
    return sample.agg(F.count(F.lit(1)).alias("sample_rows")).select(
        F.lit(total).cast("bigint").alias("total_rows"), "sample_rows", strange.agg(F.count(F.lit(1))).scalar().cast("int").alias("not_in_claims")
    )


@query("s11_member_ids", """WITH multi AS (SELECT ao_last, ao_first FROM org_npis GROUP BY ALL HAVING COUNT(DISTINCT npi) >= 2)
 SELECT DISTINCT npi FROM org_npis JOIN multi USING (ao_last, ao_first)""")
def _(t):
    return N.member_ids(stages.networks(t).members)


# --- projections, filters, predicates -----------------------------------------------------------------------------

@query("p1_project", f"SELECT billing_npi npi, CAST(FLOOR(total_paid) AS BIGINT) paid_whole, UPPER(hcpcs_code) code, {r('total_paid/total_claims')} ppc FROM claims")
def _(t):
    return C.project(t.claims, {
        "npi": "billing_npi", "paid_whole": F.floor("total_paid"), "code": "upper(hcpcs_code)",
        "ppc": X.ratio("total_paid", "total_claims"),
    })


@query("p2_scope_state", "SELECT npi, state, entity_type FROM providers WHERE state = 'NATION_3'")
def _(t):
    return C.scope_state(t.providers, "NATION_3").select("npi", "state", "entity_type")


@query("p3_cohort", "SELECT npi, primary_taxonomy FROM providers WHERE primary_taxonomy LIKE '251E%' OR primary_taxonomy LIKE '253Z%' OR primary_taxonomy LIKE '251J%'")
def _(t):
    return C.cohort(t.providers).select("npi", "primary_taxonomy")


@query("p4_organisations", """SELECT npi, org_name, state, UPPER(TRIM(ao_last)) ao_last, UPPER(TRIM(ao_first)) ao_first,
 UPPER(TRIM(COALESCE(ao_middle, ''))) ao_middle FROM raw_orgs WHERE entity_type = '2' AND TRIM(COALESCE(ao_last, '')) <> ''""")
def _(t):
    return N.organisations(t.raw_orgs).select("npi", "org_name", "state", "ao_last", "ao_first", "ao_middle")


@query("p4_individuals", "SELECT npi, UPPER(TRIM(ind_last)) ind_last, UPPER(TRIM(ind_first)) ind_first FROM individuals WHERE entity_type = '1' AND TRIM(ind_last) <> ''")
def _(t):
    return N.individuals(t.individuals).select("npi", "ind_last", "ind_first")


@query("p5_deactivated_individuals", """SELECT npi, ind_last, ind_first, ind_state, deactivation_date FROM individuals
 WHERE entity_type = '1' AND (deactivation_date <> '' OR npi IN (SELECT npi FROM deactivated))""")
def _(t):
    return stages.deactivated_persons(t).select("npi", "ind_last", "ind_first", "ind_state", "deactivation_date")


@query("p6_org_flags", """SELECT npi, CASE WHEN deactivation_date <> '' THEN 1 ELSE 0 END is_deactivated,
 CASE WHEN reactivation_date <> '' THEN 1 ELSE 0 END is_reactivated, CASE WHEN primary_taxonomy LIKE '251E%' THEN 1 ELSE 0 END is_hh,
 CASE WHEN UPPER(TRIM(is_subpart)) = 'Y' THEN 1 ELSE 0 END is_subpart_flag FROM org_npis""")
def _(t):
    return t.orgs.select("npi", "is_deactivated", "is_reactivated", "is_hh", "is_subpart_flag")


@query("p7_registry_flags", """SELECT npi,
 CASE WHEN deactivation_date IS NOT NULL OR npi IN (SELECT npi FROM deactivated) THEN 1 ELSE 0 END is_deactivated,
 CASE WHEN reactivation_date IS NULL THEN 0 ELSE 1 END was_reactivated,
 CASE WHEN sole_proprietor = 'Y' THEN 1 ELSE 0 END is_sole_proprietor, CASE WHEN org_subpart = 'Y' THEN 1 ELSE 0 END is_org_subpart
FROM providers""")
def _(t):
    flags = C.registry_flags(t.providers, t.deactivated)
    return flags.select("npi", "is_deactivated", "was_reactivated", "is_sole_proprietor", "is_org_subpart")


@query("p8_count_non_null", """SELECT npi, (primary_taxonomy IS NOT NULL)::INT + (taxonomy_2 IS NOT NULL)::INT + (taxonomy_3 IS NOT NULL)::INT n
 FROM providers""")
def _(t):
    return t.view("providers").select("npi", X.count_non_null(["primary_taxonomy", "taxonomy_2", "taxonomy_3"]).alias("n"))


@query("p9_categorize", f"""SELECT c.billing_npi, c.hcpcs_code, {r('c.total_paid')} total_paid, COALESCE(k.hh_category, 'non_hh') hh_category
 FROM claims c LEFT JOIN code_categories k ON c.hcpcs_code = k.hcpcs_code""")
def _(t):
    return C.categorize(t.claims, t.code_categories).select("billing_npi", "hcpcs_code", "total_paid", "hh_category")


@query("p10_taxonomy_type", """SELECT npi, CASE LEFT(primary_taxonomy, 4) WHEN '251E' THEN 'Home Health Agency'
 WHEN '253Z' THEN 'In Home Supportive Care' WHEN '251J' THEN 'Nursing Care Agency' END taxonomy_type FROM providers""")
def _(t):
    return HH.taxonomy_type(t.providers).select("npi", "taxonomy_type")


@query("p11_split_exclusions", """SELECT COUNT(*) FILTER (TRIM(lastname) <> '') individuals,
 COUNT(*) FILTER (TRIM(lastname) = '' AND TRIM(busname) <> '') organisations_only,
 COUNT(*) FILTER (TRIM(lastname) <> '' AND TRIM(busname) <> '') "both" FROM exclusions""")
def _(t):
    return M.exclusion_breakdown(t.exclusions)


@query("p12_min_peers", f"WITH {CODES} SELECT hcpcs_code, {r('AVG(ppc)')} avg_ppc, {r('STDDEV_POP(ppc)')} std_ppc, COUNT(*) num_providers FROM codes GROUP BY hcpcs_code HAVING COUNT(*) >= {stages.GATE}")
def _(t):
    return peers.min_peers(peers.peer_stats(C.provider_code(t.claims), ddof=0), stages.GATE)


@query("p13_multi_member", "SELECT ao_last, ao_first, COUNT(DISTINCT npi) npi_count FROM org_npis GROUP BY ALL HAVING COUNT(DISTINCT npi) >= 2")
def _(t):
    return N.multi_member(N.network_counts(t.orgs)).select("ao_last", "ao_first", "npi_count")


@query("p14_valid_npi", "SELECT lastname, firstname, npi FROM exclusions WHERE TRIM(npi) <> '' AND npi <> '0000000000'")
def _(t):
    return M.valid_npi(t.exclusions, "npi").select("lastname", "firstname", "npi")


# --- scalar functions ----------------------------------------------------------------------------------------------

@query("f1_cast", "SELECT npi, TRY_CAST(npi AS BIGINT) npi_number, TRY_CAST(SUBSTRING(npi, 2) AS BIGINT) tail FROM org_npis")
def _(t):
    return t.orgs.select("npi", F.col("npi").try_cast("bigint").alias("npi_number"), F.substring("npi", 2, 20).try_cast("bigint").alias("tail"))


@query("f2_clean", "SELECT npi, UPPER(TRIM(COALESCE(ao_last, ''))) ao_last, UPPER(TRIM(COALESCE(ao_middle, ''))) ao_middle FROM raw_orgs")
def _(t):
    return t.raw_orgs.select("npi", X.clean("ao_last").alias("ao_last"), X.clean("ao_middle").alias("ao_middle"))


@query("f3_prefix", "SELECT npi, LEFT(zip5, 5) zip, LEFT(primary_taxonomy, 3) grp, LEFT(primary_taxonomy, 4) kind FROM org_npis")
def _(t):
    return t.orgs.select("npi", X.prefix("zip5", 5).alias("zip"), X.prefix("primary_taxonomy", 3).alias("grp"), X.prefix("primary_taxonomy", 4).alias("kind"))


@query("f4_address_key", "SELECT npi, UPPER(TRIM(address_line1)) || '|' || UPPER(TRIM(city)) || '|' || TRIM(state) || '|' || LEFT(TRIM(zip5), 5) addr_key FROM org_npis")
def _(t):
    return t.orgs.select("npi", X.address_key().alias("addr_key"))


@query("f5_text_tests", "SELECT npi, primary_taxonomy LIKE '251%' cohort_like, CAST(LENGTH(org_name) AS INTEGER) name_length, is_subpart = 'N' no_subpart FROM org_npis")
def _(t):
    return t.orgs.select(
        "npi", F.col("primary_taxonomy").startswith("251").alias("cohort_like"), F.length("org_name").alias("name_length"),
        (F.col("is_subpart") == "N").alias("no_subpart"),
    )


@query("f6_conditionals", f"""SELECT npi, CASE WHEN deactivation_date IS NULL THEN 'active' ELSE 'gone' END standing,
 NULLIF(ao_middle, '') middle, COALESCE(org_dba, org_name) shown_name, {r("1.0 / NULLIF(LENGTH(ao_middle), 0)")} guarded FROM org_npis""")
def _(t):
    return t.orgs.select(
        "npi", F.when(F.col("deactivation_date").isNull(), "active").otherwise("gone").alias("standing"),
        F.nullif(F.col("ao_middle"), F.lit("")).alias("middle"), F.coalesce("org_dba", "org_name").alias("shown_name"),
        X.ratio(F.lit(1), F.length("ao_middle")).alias("guarded"),
    )


@query("f7_round_amounts", """SELECT billing_npi, CAST(SUM((total_paid = ROUND(total_paid, 0))::INT) AS BIGINT) whole,
 CAST(SUM((total_paid % 100 = 0)::INT) AS BIGINT) hundreds FROM claims GROUP BY billing_npi""")
def _(t):
    return t.claims.groupBy("billing_npi").agg(
        X.count_of(X.whole_dollars("total_paid")).alias("whole"), X.count_of(X.multiple_of_100("total_paid")).alias("hundreds")
    )


@query("f8_age_years", f"SELECT npi, {r(f"DATE_DIFF('day', enumeration_date, DATE '{stages.AS_OF}') / 365.25")} provider_age_years FROM providers")
def _(t):
    return t.providers.select("npi", X.age_years("enumeration_date", stages.AS_OF).alias("provider_age_years"))


@query("f9_parse_date", "SELECT npi, TRY_CAST(deactivation_date AS DATE) gone_on, TRY_CAST(org_name AS DATE) no_date FROM org_npis")
def _(t):
    return t.orgs.select("npi", F.col("deactivation_date").try_cast("date").alias("gone_on"), F.col("org_name").try_cast("date").alias("no_date"))


@query("f10_math", f"SELECT billing_npi, {r('LN(1 + total_paid)')} log_paid, {r('LOG2(n)')} log_n, {r('ABS(total_paid - 1e7)')} distance, GREATEST(n, 500) clipped FROM (SELECT billing_npi, SUM(total_paid) total_paid, COUNT(*) n FROM claims GROUP BY billing_npi)")
def _(t):
    return paid(t).select(
        "billing_npi", F.log1p("total_paid").alias("log_paid"), F.log2("n").alias("log_n"),
        F.abs(F.col("total_paid") - 1e7).alias("distance"), F.greatest("n", F.lit(500)).alias("clipped"),
    )


STATES_OF = "SELECT ao_last, ao_first, LIST_SORT(LIST(DISTINCT state)) states FROM org_npis GROUP BY ao_last, ao_first"


@query("f11_list_functions", f"""SELECT ao_last, ao_first, LIST_CONTAINS(states, 'NATION_3') has_state, CAST(LEN(states) AS INTEGER) n,
 ARRAY_TO_STRING(states[1:3], '|') first_three FROM ({STATES_OF})""")
def _(t):
    states = t.orgs.groupBy("ao_last", "ao_first").agg(ranking.sorted_distinct("state").alias("states"))
    return states.select(
        "ao_last", "ao_first", F.array_contains("states", "NATION_3").alias("has_state"), F.size("states").alias("n"),
        F.slice("states", 1, 3).alias("first_three"),
    )


@query("f12_explode", "SELECT DISTINCT ao_last, ao_first, state FROM org_npis")
def _(t):
    states = t.orgs.groupBy("ao_last", "ao_first").agg(ranking.sorted_distinct("state").alias("states"))
    return states.select("ao_last", "ao_first", F.explode("states").alias("state"))


# --- ranks, top-k, sets --------------------------------------------------------------------------------------------

TIED = "tied AS (SELECT npi, CAST(LENGTH(org_name) AS DOUBLE) * (1 + LENGTH(ao_middle)) + LENGTH(ao_first) score FROM org_npis)"


def tied(t):
    score = F.length("org_name").cast("double") * (1 + F.length("ao_middle")) + F.length("ao_first")
    return t.orgs.select("npi", score.alias("score"))


@query("w1_rank_average", f"""WITH {TIED} SELECT npi, {r('score')} score,
 CAST(FLOOR(RANK() OVER (ORDER BY score DESC) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0) AS BIGINT) rnk FROM tied""")
def _(t):
    return ranking.global_rank(tied(t), "score", "average_floor", "rnk", spread_by=["npi"])


@query("w1_rank_claims", f"""WITH per_code AS (SELECT hcpcs_code, billing_npi, SUM(total_paid) paid FROM claims GROUP BY ALL)
 SELECT hcpcs_code, billing_npi, {r('paid')} paid,
 CAST(FLOOR(RANK() OVER (ORDER BY ROUND(paid, 4) DESC) + (COUNT(*) OVER (PARTITION BY ROUND(paid, 4)) - 1) / 2.0) AS BIGINT) rnk FROM per_code""")
def _(t):
    codes = C.provider_code(t.claims).select("hcpcs_code", "billing_npi", F.col("code_paid").alias("paid"))
    return ranking.global_rank(codes, "paid", "average_floor", "rnk", digits=4, spread_by=["billing_npi", "hcpcs_code"])


@query("w2_rank_min", f"WITH {TIED} SELECT npi, {r('score')} score, RANK() OVER (ORDER BY score DESC) rnk FROM tied")
def _(t):
    return ranking.global_rank(tied(t), "score", "min", "rnk", spread_by=["npi"])


@query("w3_rank_pct", f"""WITH {TIED} SELECT npi, {r('score')} score,
 {r('(RANK() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0) / COUNT(*) OVER ()')} pct FROM tied""")
def _(t):
    return ranking.global_rank(tied(t), "score", "pct", "pct", desc=False, spread_by=["npi"])


@query("w4_keep_first", """SELECT lastname, state, firstname, npi FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY lastname, state
 ORDER BY firstname DESC, npi, excldate) k FROM exclusions) WHERE k = 1""")
def _(t):
    kept = ranking.keep_first(t.exclusions, ["lastname", "state"], [F.desc("firstname"), "npi", "excldate"])
    return kept.select("lastname", "state", "firstname", "npi")


@query("o1_top_k", f"WITH {PAID} SELECT billing_npi, {r('total_paid')} total_paid FROM paid ORDER BY total_paid DESC, billing_npi LIMIT 20")
def _(t):
    return ranking.top_k(paid(t), "total_paid", 20, "billing_npi", desc=True).select("billing_npi", "total_paid")


@query("o2_sort_head", f"WITH {CODES} SELECT billing_npi, hcpcs_code, {r('code_paid')} code_paid FROM codes ORDER BY code_claims DESC, billing_npi, hcpcs_code LIMIT 15")
def _(t):
    rows = ranking.sort_head(C.provider_code(t.claims), [F.desc("code_claims"), "billing_npi", "hcpcs_code"], 15)
    return rows.select("billing_npi", "hcpcs_code", "code_paid")


@query("o4_sorted_distinct", f"SELECT ao_last, ao_first, ARRAY_TO_STRING(states, '|') states FROM ({STATES_OF})")
def _(t):
    return t.orgs.groupBy("ao_last", "ao_first").agg(ranking.sorted_distinct("state").alias("states"))


BY_NAME = "by_name AS (SELECT DISTINCT lastname ao_last, firstname ao_first FROM exclusions WHERE lastname <> '')"
BY_LIST = "by_list AS (SELECT DISTINCT ind_last ao_last, ind_first ao_first FROM individuals WHERE npi IN (SELECT npi FROM deactivated))"


def by_name(t):
    return t.exclusions.where(F.col("lastname") != "").select(F.col("lastname").alias("ao_last"), F.col("firstname").alias("ao_first"))


def by_list(t):
    listed = t.individuals.join(t.deactivated, "npi", "left_semi")
    return listed.select(F.col("ind_last").alias("ao_last"), F.col("ind_first").alias("ao_first"))


@query("u3_intersect_ids", f"""WITH {PAID}, a AS (SELECT billing_npi FROM paid ORDER BY total_paid DESC, billing_npi LIMIT 50),
 b AS (SELECT billing_npi FROM paid ORDER BY n DESC, billing_npi LIMIT 50) SELECT billing_npi FROM a WHERE billing_npi IN (SELECT billing_npi FROM b)""")
def _(t):
    return sets.intersect_ids(
        ranking.top_k(paid(t), "total_paid", 50, "billing_npi", desc=True).select("billing_npi"),
        ranking.top_k(paid(t), "n", 50, "billing_npi", desc=True).select("billing_npi"),
    )


@query("u4_union_ids", f"WITH {BY_NAME}, {BY_LIST} SELECT * FROM by_name UNION SELECT * FROM by_list")
def _(t):
    return sets.union_ids(by_name(t), by_list(t))


@query("u4_minus_ids", f"WITH {BY_NAME}, {BY_LIST} SELECT * FROM by_name EXCEPT SELECT * FROM by_list")
def _(t):
    return sets.minus_ids(by_name(t).distinct(), by_list(t).distinct())


@query("u5_distinct_keys", "SELECT DISTINCT ao_last, ao_first FROM org_npis")
def _(t):
    return sets.distinct_keys(t.orgs, ["ao_last", "ao_first"])
