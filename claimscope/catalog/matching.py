"""Networks of officials, matching to the lists, and network risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimscope.catalog import stages
from claimscope.catalog.aggregates import EXPOSURE
from claimscope.catalog.registry import big, query, r
from claimscope.functions import columns as X
from claimscope.operators import matching as M
from claimscope.operators import networks as N
from claimscope.operators import risk, sets
from claimscope.plans import networks as NET

OFFICIAL = ["ao_last", "ao_first"]

FLAGGED = """flagged AS (SELECT *, CASE WHEN deactivation_date <> '' THEN 1 ELSE 0 END is_deactivated, CASE WHEN reactivation_date <> '' THEN 1 ELSE 0 END is_reactivated,
 CASE WHEN primary_taxonomy LIKE '251E%' THEN 1 ELSE 0 END is_hh, CASE WHEN UPPER(TRIM(is_subpart)) = 'Y' THEN 1 ELSE 0 END is_subpart_flag,
 UPPER(TRIM(address_line1)) || '|' || UPPER(TRIM(city)) || '|' || TRIM(state) || '|' || LEFT(TRIM(zip5), 5) addr_key FROM org_npis)"""
EVERYONE = f"""{FLAGGED}, everyone AS (SELECT g.*, a.same_address_count, a.same_address_count::DOUBLE / npi_count same_address_ratio,
 CASE WHEN num_hh > 0 THEN 1 ELSE 0 END has_hh_taxonomy, CASE WHEN num_deactivated > 0 THEN 1 ELSE 0 END has_deactivated FROM
 (SELECT ao_last, ao_first, COUNT(DISTINCT npi) npi_count, COUNT(DISTINCT state) num_states, {big('SUM(is_deactivated)')} num_deactivated,
  {big('SUM(is_reactivated)')} num_reactivated, {big('SUM(is_hh)')} num_hh, {big('SUM(is_subpart_flag)')} num_subparts, COUNT(DISTINCT ao_phone) phone_count,
  ARG_MIN(ao_middle, npi) ao_middle FROM flagged GROUP BY ao_last, ao_first) g
 JOIN (SELECT ao_last, ao_first, MAX(n) same_address_count FROM (SELECT ao_last, ao_first, addr_key, COUNT(*) n FROM flagged GROUP BY ALL) GROUP BY ALL) a USING (ao_last, ao_first)),
officials AS (SELECT * FROM everyone WHERE npi_count >= 2)"""
TABLES = f"""{EVERYONE}, own_npi AS (SELECT DISTINCT ao_last, ao_first, npi FROM org_npis JOIN officials USING (ao_last, ao_first)),
own_state AS (SELECT DISTINCT f.ao_last, f.ao_first, f.state FROM org_npis f JOIN officials USING (ao_last, ao_first)),
own_city AS (SELECT DISTINCT f.ao_last, f.ao_first, UPPER(TRIM(f.city)) city FROM org_npis f JOIN officials USING (ao_last, ao_first))"""
PERSONS = """persons AS (SELECT UPPER(TRIM(lastname)) leie_last, UPPER(TRIM(firstname)) leie_first, UPPER(TRIM(midname)) leie_mid,
 UPPER(TRIM(city)) leie_city, TRIM(state) leie_state, npi leie_npi, excltype, excldate FROM exclusions WHERE TRIM(lastname) <> '')"""
BY_NPI = "by_npi AS (SELECT o.ao_last, o.ao_first, p.*, 1 tier FROM persons p JOIN own_npi o ON p.leie_npi = o.npi WHERE leie_npi NOT IN ('', '0000000000'))"
BY_NAME = """by_name AS (SELECT o.ao_last, o.ao_first, p.* FROM persons p JOIN own_state o ON o.ao_last = leie_last AND o.ao_first = leie_first AND o.state = leie_state)"""
CANDIDATES = """candidates AS (SELECT n.*, CASE WHEN leie_city <> '' AND EXISTS (SELECT 1 FROM own_city c WHERE c.ao_last = n.ao_last AND c.ao_first = n.ao_first AND c.city = n.leie_city) THEN 2
 WHEN leie_mid <> '' AND leie_mid = o.ao_middle THEN 3 ELSE 4 END tier FROM by_name n JOIN officials o USING (ao_last, ao_first))"""
TIERED = f"""{PERSONS}, {BY_NPI}, {BY_NAME}, {CANDIDATES}, candidates_all AS (SELECT * FROM by_npi UNION ALL SELECT * FROM candidates),
tiered AS (SELECT c.* FROM candidates_all c JOIN (SELECT ao_last, ao_first, MIN(tier) tier FROM candidates_all GROUP BY ALL) USING (ao_last, ao_first, tier))"""
MATCH_LIST = "ao_last, ao_first, leie_last, leie_first, leie_mid, leie_city, leie_state, leie_npi, excltype, excldate"
BUSINESSES = """businesses AS (SELECT UPPER(TRIM(busname)) leie_busname, state, npi leie_npi, excltype, excldate,
 ROW_NUMBER() OVER (PARTITION BY UPPER(TRIM(busname)), state ORDER BY excldate, excltype, npi) k FROM exclusions WHERE TRIM(busname) <> '')"""


def org_match(name, column, kind):
    return f"""{name} AS (SELECT f.npi, f.ao_last, f.ao_first, f.org_name, f.state, b.leie_busname, b.leie_npi, b.excltype, b.excldate, '{kind}' match_type
 FROM org_npis f JOIN businesses b ON UPPER(TRIM(f.{column})) = b.leie_busname AND f.state = b.state AND b.k = 1)"""


LEGAL, TRADE = org_match("legal", "org_name", "legal_business_name"), org_match("trade", "org_dba", "dba_name")
ORG_LIST = "npi, ao_last, ao_first, org_name, state, leie_busname, leie_npi, excltype, excldate, match_type"
ORG_MATCHES = f"""{BUSINESSES}, {LEGAL}, {TRADE}, org_matches AS (SELECT * EXCLUDE (k) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY npi ORDER BY match_type = 'dba_name') k
 FROM (SELECT * FROM legal UNION ALL SELECT * FROM trade) WHERE npi IN (SELECT npi FROM own_npi)) WHERE k = 1)"""
GONE = """gone AS (SELECT o.ao_last, o.ao_first, o.state ind_state, i.npi deact_npi, i.deactivation_date, i.ind_taxonomy FROM individuals i
 JOIN own_state o ON o.ao_last = i.ind_last AND o.ao_first = i.ind_first AND o.state = TRIM(i.ind_state)
 WHERE i.entity_type = '1' AND (i.deactivation_date <> '' OR i.npi IN (SELECT npi FROM deactivated)))"""
FREQ = "freq AS (SELECT ind_last ao_last, ind_first ao_first, COUNT(*) name_freq_count FROM individuals WHERE entity_type = '1' GROUP BY ALL)"
SPENT = """spent AS (SELECT own_npi.ao_last, own_npi.ao_first, SUM(total_paid) total_spending, CAST(SUM(total_claims) AS BIGINT) total_claims, COUNT(*) npis_with_spending
 FROM exposure JOIN own_npi ON billing_npi = npi GROUP BY ALL)"""
SPENDING = """with_spending AS (SELECT o.*, COALESCE(total_spending, 0) total_spending, COALESCE(total_claims, 0) total_claims, COALESCE(npis_with_spending, 0) npis_with_spending
 FROM officials o LEFT JOIN spent USING (ao_last, ao_first))"""


def pct(column):
    return f"(RANK() OVER (ORDER BY ROUND({column}, 9)) + (COUNT(*) OVER (PARTITION BY ROUND({column}, 9)) - 1) / 2.0) / COUNT(*) OVER ()"


RISK = f"""{TABLES}, {TIERED}, {ORG_MATCHES}, {GONE}, {FREQ}, {EXPOSURE}, {SPENT}, {SPENDING},
signals AS (SELECT w.*, COALESCE(f.name_freq_count, 0) name_freq_count, 1.0 / LOG2(GREATEST(COALESCE(f.name_freq_count, 0), 1) + 1) name_freq_penalty,
 COALESCE(b.tier, 0) leie_best_tier, CASE COALESCE(b.tier, 0) WHEN 1 THEN 3.0 WHEN 2 THEN 2.0 WHEN 3 THEN 1.5 WHEN 4 THEN 0.5 ELSE 0 END leie_weight,
 CASE WHEN b.tier IS NULL THEN 0 ELSE 1 END has_leie_ind_match,
 CASE WHEN (w.ao_last, w.ao_first) IN (SELECT (ao_last, ao_first) FROM org_matches) THEN 1 ELSE 0 END has_leie_org_match,
 CASE WHEN (w.ao_last, w.ao_first) IN (SELECT (ao_last, ao_first) FROM gone) THEN 1 ELSE 0 END has_deact_ind_match,
 {', '.join(f'{pct(c)} {c}_pct' for c in ('npi_count', 'num_states', 'num_deactivated', 'total_spending', 'same_address_ratio'))}
 FROM with_spending w LEFT JOIN freq f USING (ao_last, ao_first) LEFT JOIN (SELECT ao_last, ao_first, MIN(tier) tier FROM tiered GROUP BY ALL) b USING (ao_last, ao_first)),
composed AS (SELECT *, leie_weight * name_freq_penalty leie_ind_score, has_deact_ind_match temporal_flag,
 ROUND(leie_weight * name_freq_penalty + 2.0 * has_leie_org_match + 2.5 * has_deact_ind_match + 0.3 * has_hh_taxonomy + 1.5 * num_deactivated_pct + npi_count_pct
 + 0.8 * num_states_pct + 0.5 * total_spending_pct + 0.4 * same_address_ratio_pct, 9) risk_score FROM signals),
risk AS (SELECT *, CAST(FLOOR(RANK() OVER (ORDER BY risk_score DESC) + (COUNT(*) OVER (PARTITION BY risk_score) - 1) / 2.0) AS BIGINT) risk_rank FROM composed)"""


# --- networks ------------------------------------------------------------------------------------------------------

COUNTS = "ao_last, ao_first, npi_count, num_states, num_deactivated, num_reactivated, num_hh, num_subparts, phone_count, ao_middle"


@query("a14_network_counts", f"WITH {EVERYONE} SELECT {COUNTS} FROM everyone")
def _(t):
    return N.network_counts(t.orgs)


@query("a15_network_lists", """SELECT DISTINCT ao_last, ao_first, 'npi_list' list, npi item FROM org_npis
 UNION ALL SELECT DISTINCT ao_last, ao_first, 'states', state FROM org_npis WHERE state IS NOT NULL
 UNION ALL SELECT ao_last, ao_first, 'org_names', org_name FROM org_npis WHERE org_name IS NOT NULL
 UNION ALL SELECT DISTINCT ao_last, ao_first, 'cities', UPPER(TRIM(city)) FROM org_npis WHERE city IS NOT NULL""")
def _(t):
    return N.network_lists(t.orgs)


@query("a16_address_clusters", f"WITH {EVERYONE} SELECT ao_last, ao_first, same_address_count FROM everyone")
def _(t):
    return N.address_clusters(t.orgs)


@query("r16_build_networks", f"WITH {EVERYONE} SELECT {COUNTS}, same_address_count, {r('same_address_ratio')} same_address_ratio, has_hh_taxonomy, has_deactivated FROM officials")
def _(t):
    return NET.build_networks(t.orgs).officials


@query("r16_network_places", f"WITH {TABLES} SELECT 'npi' kind, ao_last, ao_first, npi item FROM own_npi UNION ALL SELECT 'state', * FROM own_state UNION ALL SELECT 'city', * FROM own_city")
def _(t):
    nets = stages.networks(t)
    frames = {"npi": nets.members, "state": nets.states, "city": nets.cities}
    named = [frame.select(F.lit(kind).alias("kind"), *OFFICIAL, F.col(kind).alias("item")) for kind, frame in frames.items()]
    return sets.union_on(["kind", *OFFICIAL, "item"], *named)


@query("a19_name_frequency", f"WITH {FREQ} SELECT * FROM freq")
def _(t):
    return N.name_frequency(N.individuals(t.individuals))


@query("a19_name_totals", f"WITH {FREQ} SELECT COUNT(*) num_names, CAST(SUM(name_freq_count) AS BIGINT) num_persons FROM freq")
def _(t):
    return N.name_totals(N.name_frequency(N.individuals(t.individuals)))


@query("a18_exposure_by_official", f"WITH {TABLES}, {EXPOSURE}, {SPENT} SELECT ao_last, ao_first, {r('total_spending')} total_spending, total_claims, npis_with_spending FROM spent")
def _(t):
    nets = stages.networks(t)
    return N.exposure_by_official(NET.spending_exposure(t.org_claims, nets), nets.members)


@query("r19_spending_exposure", f"WITH {EXPOSURE} SELECT billing_npi, {r('total_paid')} total_paid, total_claims, total_beneficiaries, num_hcpcs, num_months FROM exposure")
def _(t):
    return NET.spending_exposure(t.org_claims, stages.networks(t))


@query("j15_attach_spending", f"WITH {TABLES}, {EXPOSURE}, {SPENT}, {SPENDING} SELECT ao_last, ao_first, npi_count, {r('total_spending')} total_spending, total_claims, npis_with_spending FROM with_spending")
def _(t):
    nets = stages.networks(t)
    spending = N.exposure_by_official(NET.spending_exposure(t.org_claims, nets), nets.members)
    return N.attach_spending(nets.officials, spending).select(*OFFICIAL, "npi_count", "total_spending", "total_claims", "npis_with_spending")


# --- matching ------------------------------------------------------------------------------------------------------

@query("j6_match_npi", f"WITH {TABLES}, {PERSONS}, {BY_NPI} SELECT {MATCH_LIST} FROM by_npi")
def _(t):
    return M.match_npi(M.excluded_individuals(t.exclusions), stages.networks(t).members)


def _name_state(t, nets):
    """The list's entries whose person has an official's name and state."""
    individuals = M.excluded_individuals(t.exclusions)
    return M.entries_of(individuals, M.match_name_state(nets.states, M.distinct_persons(individuals)))


@query("j7_match_name_state", f"WITH {TABLES}, {PERSONS}, {BY_NAME} SELECT {MATCH_LIST} FROM by_name")
def _(t):
    return _name_state(t, stages.networks(t))


@query("j8_city_match", f"WITH {TABLES}, {PERSONS}, {BY_NAME}, {CANDIDATES} SELECT {MATCH_LIST}, tier = 2 same_city FROM candidates")
def _(t):
    nets = stages.networks(t)
    individuals = M.excluded_individuals(t.exclusions)
    persons = M.match_name_state(nets.states, M.distinct_persons(individuals))
    tiers = M.entries_of(individuals, M.candidate_tiers(nets, persons))
    return tiers.withColumn("same_city", F.col("tier") == 2).drop("tier")


@query("j9_middle_match", f"WITH {TABLES}, {PERSONS}, {BY_NAME} SELECT n.ao_last, n.ao_first, leie_mid, excldate, leie_state, leie_mid <> '' AND o.ao_middle <> '' AND leie_mid = o.ao_middle same_middle FROM by_name n JOIN officials o USING (ao_last, ao_first)")
def _(t):
    nets = stages.networks(t)
    found = _name_state(t, nets)
    joined = found.join(nets.officials.select(*OFFICIAL, "ao_middle"), OFFICIAL)
    return joined.select(*OFFICIAL, "leie_mid", "excldate", "leie_state", X.middle_match("leie_mid", "ao_middle").alias("same_middle"))


@query("j10_place_tiers", f"WITH {TABLES}, {TIERED} SELECT DISTINCT ao_last, ao_first, tier FROM tiered")
def _(t):
    nets = stages.networks(t)
    individuals = M.excluded_individuals(t.exclusions)
    found = M.candidate_tiers(nets, M.match_name_state(nets.states, M.distinct_persons(individuals)))
    by_npi = M.match_npi(individuals, nets.members).withColumn("tier", F.lit(1))
    return M.place_tiers(sets.union_on([*OFFICIAL, "tier"], by_npi, found).distinct())


@query("u1_union_tiers", f"WITH {TABLES}, {PERSONS}, {BY_NPI}, {BY_NAME}, {CANDIDATES} SELECT {MATCH_LIST}, tier FROM by_npi UNION ALL SELECT {MATCH_LIST}, tier FROM candidates")
def _(t):
    nets = stages.networks(t)
    persons = M.excluded_individuals(t.exclusions)
    by_npi = M.match_npi(persons, nets.members).withColumn("tier", F.lit(1))
    found = M.candidate_tiers(nets, M.match_name_state(nets.states, M.distinct_persons(persons)))
    return sets.union_on(M.MATCH_COLUMNS, by_npi, M.entries_of(persons, found))


@query("m7_match_individuals_tiered", f"WITH {TABLES}, {TIERED} SELECT {MATCH_LIST}, tier FROM tiered")
def _(t):
    return M.match_individuals_tiered(stages.networks(t), M.excluded_individuals(t.exclusions))


@query("a20_best_tier", f"WITH {TABLES}, {TIERED} SELECT ao_last, ao_first, MIN(tier) leie_best_tier FROM tiered GROUP BY ALL")
def _(t):
    return M.best_tier(stages.layer3(t).individual)


@query("a35_tier_counts", f"WITH {TABLES}, {TIERED} SELECT tier, COUNT(DISTINCT (ao_last, ao_first)) num_officials FROM tiered GROUP BY tier")
def _(t):
    return N.tier_counts(stages.layer3(t).individual)


@query("j11_match_legal_name", f"WITH {BUSINESSES}, {LEGAL} SELECT {ORG_LIST} FROM legal")
def _(t):
    return M.match_org_name(t.orgs, M.excluded_organisations(t.exclusions), "org_name")


def _dba_exclusions(t):
    """Exclusions under trade names: the list's business names with the prefix the test organisations use for theirs."""
    return t.exclusions.withColumn("busname", F.when(F.col("busname") != "", F.concat(F.lit("dba "), "busname")).otherwise(""))


DBA_BUSINESSES = BUSINESSES.replace("TRIM(busname)", "TRIM(CASE WHEN busname <> '' THEN 'DBA ' || busname ELSE '' END)")


@query("j12_match_trade_name", f"WITH {DBA_BUSINESSES}, {TRADE} SELECT {ORG_LIST} FROM trade")
def _(t):
    return M.match_org_name(t.orgs, M.excluded_organisations(_dba_exclusions(t)), "org_dba")


@query("u2_union_names", f"""WITH {BUSINESSES}, {LEGAL}, dba_businesses AS ({DBA_BUSINESSES[len('businesses AS ('):-1]}), {TRADE.replace('JOIN businesses', 'JOIN dba_businesses')}
 SELECT {ORG_LIST} FROM legal UNION ALL SELECT {ORG_LIST} FROM trade""")
def _(t):
    legal = M.match_org_name(t.orgs, M.excluded_organisations(t.exclusions), "org_name")
    trade = M.match_org_name(t.orgs, M.excluded_organisations(_dba_exclusions(t)), "org_dba")
    return sets.union_on(legal.columns, legal, trade)


@query("j13_keep_members", f"WITH {TABLES}, {BUSINESSES}, {LEGAL} SELECT {ORG_LIST} FROM legal WHERE npi IN (SELECT npi FROM own_npi)")
def _(t):
    legal = M.match_org_name(t.orgs, M.excluded_organisations(t.exclusions), "org_name")
    return M.keep_members(legal, stages.networks(t).members)


@query("r17_match_organisations", f"WITH {TABLES}, {ORG_MATCHES} SELECT {ORG_LIST} FROM org_matches")
def _(t):
    return NET.match_exclusions(stages.networks(t), t.orgs, t.exclusions)[1]


@query("r17_match_individuals", f"WITH {TABLES}, {TIERED} SELECT {MATCH_LIST}, tier FROM tiered")
def _(t):
    return NET.match_exclusions(stages.networks(t), t.orgs, t.exclusions)[0]


@query("j14_match_deactivated", f"WITH {TABLES}, {GONE} SELECT ao_last, ao_first, ind_state, deact_npi, deactivation_date, ind_taxonomy FROM gone")
def _(t):
    return M.match_deactivated(stages.networks(t).states, stages.deactivated_persons(t))


@query("r18_match_deactivated", f"WITH {TABLES}, {GONE} SELECT ao_last, ao_first, ind_state, deact_npi, deactivation_date, ind_taxonomy FROM gone")
def _(t):
    return NET.match_deactivated(stages.networks(t), stages.deactivated_persons(t))


@query("a21_common_names", f"WITH {TABLES}, {GONE} SELECT ao_last, ao_first, COUNT(DISTINCT deact_npi) deact_ind_match_count FROM gone GROUP BY ALL HAVING COUNT(DISTINCT deact_npi) >= 1")
def _(t):
    return N.common_names(stages.layer3(t).deactivated, 1)


# --- lookups, scores, risk -----------------------------------------------------------------------------------------

@query("j16_attach_lookup", f"WITH {EVERYONE}, {FREQ} SELECT ao_last, ao_first, COALESCE(name_freq_count, 0) name_freq_count FROM officials LEFT JOIN freq USING (ao_last, ao_first)")
def _(t):
    frequency = N.name_frequency(N.individuals(t.individuals))
    return sets.attach_lookup(stages.networks(t).officials.select(*OFFICIAL), frequency, OFFICIAL, "name_freq_count", 0)


@query("j17_attach_match_flag", f"WITH {TABLES}, {GONE} SELECT ao_last, ao_first, CASE WHEN (ao_last, ao_first) IN (SELECT (ao_last, ao_first) FROM gone) THEN 1 ELSE 0 END has_deact_ind_match FROM officials")
def _(t):
    return sets.attach_match_flag(stages.networks(t).officials.select(*OFFICIAL), stages.layer3(t).deactivated, OFFICIAL, "has_deact_ind_match")


@query("m8_name_penalty", f"WITH {FREQ} SELECT ao_last, ao_first, {r('1.0 / LOG2(name_freq_count + 1)')} name_freq_penalty FROM freq")
def _(t):
    frequency = N.name_frequency(N.individuals(t.individuals))
    return frequency.select(*OFFICIAL, X.name_penalty("name_freq_count").alias("name_freq_penalty"))


@query("m9_individual_score", f"WITH {RISK} SELECT ao_last, ao_first, leie_best_tier, {r('leie_ind_score')} leie_ind_score, has_leie_ind_match FROM risk")
def _(t):
    layer = stages.layer3(t)
    frequency = N.name_frequency(N.individuals(t.individuals))
    scored = sets.attach_lookup(layer.networks.officials, frequency, OFFICIAL, "name_freq_count", 0)
    scored = sets.attach_lookup(scored, M.best_tier(layer.individual), OFFICIAL, "leie_best_tier", 0)
    return scored.select(
        *OFFICIAL, "leie_best_tier", X.individual_score("leie_best_tier", X.name_penalty("name_freq_count")).alias("leie_ind_score"),
        X.flag(F.col("leie_best_tier") > 0).alias("has_leie_ind_match"),
    )


RISK_TEXT = """ao_last ao_first npi_count num_states num_deactivated num_reactivated num_hh num_subparts phone_count ao_middle same_address_count
 has_hh_taxonomy has_deactivated total_claims npis_with_spending name_freq_count leie_best_tier has_leie_ind_match has_leie_org_match has_deact_ind_match
 temporal_flag risk_rank""".split()
RISK_REAL = """same_address_ratio total_spending name_freq_penalty leie_ind_score npi_count_pct num_states_pct num_deactivated_pct total_spending_pct
 same_address_ratio_pct risk_score""".split()
RISK_LIST = ", ".join([*RISK_TEXT, *[f"{r(c)} {c}" for c in RISK_REAL]])


@query("m10_network_risk", f"WITH {RISK} SELECT {RISK_LIST} FROM risk")
def _(t):
    return stages.layer3(t).scored


@query("r20_network_flags", f"WITH {RISK} SELECT {RISK_LIST} FROM risk WHERE has_leie_ind_match = 1 OR has_leie_org_match = 1 OR has_deact_ind_match = 1 OR risk_rank <= 100")
def _(t):
    return NET.network_flags(stages.layer3(t).scored)


@query("p15_flag_subset", f"WITH {RISK} SELECT ao_last, ao_first, risk_rank FROM risk WHERE has_leie_ind_match + has_leie_org_match + has_deact_ind_match > 0 OR risk_rank <= 20")
def _(t):
    return risk.flag_subset(stages.layer3(t).scored, 20).select(*OFFICIAL, "risk_rank")


@query("m11_burn_and_churn", f"WITH {EVERYONE} SELECT ao_last, ao_first, npi_count, num_deactivated, npi_count - num_deactivated num_active FROM officials WHERE num_deactivated > 0 AND npi_count > num_deactivated")
def _(t):
    return N.burn_and_churn(stages.networks(t).officials).select(*OFFICIAL, "npi_count", "num_deactivated", "num_active")
