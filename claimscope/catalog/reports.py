"""Report tables of the networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimscope.catalog import stages
from claimscope.catalog.matching import EVERYONE, OFFICIAL, RISK
from claimscope.catalog.models import HH_CLAIMS, cohort_sql
from claimscope.catalog.registry import query, r
from claimscope.operators import networks as N
from claimscope.operators import ranking, sets
from claimscope.plans import networks as NET

BIN = "CASE WHEN npi_count >= 50 THEN '50+' WHEN npi_count >= 20 THEN '20-49' WHEN npi_count >= 10 THEN '10-19' WHEN npi_count >= 5 THEN '5-9' WHEN npi_count >= 2 THEN '2-4' ELSE '1' END"
TIER = "CASE WHEN total_spending >= 1e8 THEN '100M+' WHEN total_spending >= 1e7 THEN '10M-100M' WHEN total_spending >= 1e6 THEN '1M-10M' WHEN total_spending >= 1e5 THEN '100K-1M' ELSE '< 100K' END"


@query("a33_size_bins", f"WITH {EVERYONE} SELECT {BIN} bin, COUNT(*) num_officials, {r('100.0 * COUNT(*) / (SELECT COUNT(*) FROM everyone)')} pct FROM everyone GROUP BY 1")
def _(t):
    return NET.size_bins(stages.networks(t).everyone)


@query("a34_amount_tiers", f"WITH {RISK} SELECT {TIER} spending_tier, COUNT(*) num_officials, {r('SUM(total_spending)', 3)} total_spending FROM risk GROUP BY 1", digits=3)
def _(t):
    return NET.amount_tiers(stages.layer3(t).scored)


@query("a43_network_summary", f"""WITH {RISK} SELECT COUNT(*) num_officials, COUNT(*) FILTER (has_leie_ind_match = 1) n_has_leie_ind_match,
 COUNT(*) FILTER (has_leie_org_match = 1) n_has_leie_org_match, COUNT(*) FILTER (has_deact_ind_match = 1) n_has_deact_ind_match,
 {', '.join(f'COUNT(*) FILTER (leie_best_tier = {k}) n_tier_{k}' for k in (1, 2, 3, 4))},
 COUNT(*) FILTER (has_leie_ind_match + has_leie_org_match + has_deact_ind_match > 0) n_any_flag,
 {', '.join(f'COUNT(*) FILTER (npi_count >= {k}) n_{k}_npis' for k in (5, 10, 20))}, CAST(SUM(npis_with_spending) AS BIGINT) npis_with_spending,
 {r('SUM(total_spending)', 3)} total_spending FROM risk""", digits=3)
def _(t):
    return N.network_summary(stages.layer3(t).scored)


@query("r21_overview", f"WITH {RISK} SELECT (SELECT COUNT(*) FROM org_npis) num_orgs, (SELECT COUNT(*) FROM everyone) num_officials, COUNT(*) num_multi, {r('SUM(total_spending)', 3)} total_spending FROM risk", digits=3)
def _(t):
    layer = stages.layer3(t)
    return NET.overview(layer.networks.everyone, layer.scored, t.orgs)


@query("r21_top_officials", f"""WITH {RISK} SELECT risk_rank, ao_last, ao_first, npi_count, num_states, num_deactivated, has_leie_ind_match, leie_best_tier, has_leie_org_match,
 {r('total_spending')} total_spending, {r('risk_score')} risk_score FROM risk ORDER BY risk_rank, ao_last, ao_first LIMIT 30""")
def _(t):
    return NET.top_officials(stages.layer3(t).scored)


@query("r21_official_detail", f"""WITH {RISK}, best AS (SELECT ao_last, ao_first, risk_rank FROM risk ORDER BY risk_rank, ao_last, ao_first LIMIT 5),
detail AS (SELECT f.*, best.risk_rank, ROW_NUMBER() OVER (PARTITION BY f.ao_last, f.ao_first ORDER BY f.state, f.npi) k FROM flagged f JOIN best USING (ao_last, ao_first))
SELECT d.risk_rank, d.ao_last, d.ao_first, d.npi, d.state, d.org_name, {r('e.total_paid')} total_paid, d.is_deactivated, d.is_hh FROM detail d LEFT JOIN exposure e ON e.billing_npi = d.npi WHERE k <= 10""")
def _(t):
    layer = stages.layer3(t)
    return NET.official_detail(layer.scored, t.orgs, layer.exposure)


@query("r21_multi_state", f"""WITH {RISK}, wide AS (SELECT * FROM risk WHERE num_states >= 3 ORDER BY num_states DESC, ao_last, ao_first LIMIT 30)
SELECT ao_last, ao_first, npi_count, num_states, {r('total_spending')} total_spending, (SELECT ARRAY_TO_STRING(LIST(s.state ORDER BY s.state)[1:8], '|') FROM own_state s
 WHERE s.ao_last = wide.ao_last AND s.ao_first = wide.ao_first) states FROM wide""")
def _(t):
    layer = stages.layer3(t)
    return NET.multi_state(layer.scored, layer.networks)


@query("r21_exclusion_tiers", f"""WITH {RISK}, labels(tier, label) AS (VALUES (1, 'Tier 1 (direct NPI match)'), (2, 'Tier 2 (name + state + city)'), (3, 'Tier 3 (name + state + middle)'), (4, 'Tier 4 (name + state only)'))
SELECT tier, label, (SELECT COUNT(DISTINCT (ao_last, ao_first)) FROM tiered t WHERE t.tier = labels.tier) num_officials FROM labels""")
def _(t):
    return NET.exclusion_tiers(stages.layer3(t).individual)


@query("r21_exclusion_counts", f"WITH {RISK} SELECT (SELECT COUNT(DISTINCT (ao_last, ao_first)) FROM tiered) individual_officials, (SELECT COUNT(DISTINCT (ao_last, ao_first)) FROM org_matches) organisation_officials")
def _(t):
    layer = stages.layer3(t)
    return N.exclusion_counts(layer.individual, layer.organisation)


BEST = """best AS (SELECT ao_last, ao_first, tier, excltype, excldate FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ao_last, ao_first ORDER BY tier, excldate, excltype) k FROM tiered) WHERE k = 1)"""
BEST_LIST = f"""ao_last, ao_first, tier, excltype, excldate, {r('total_spending')} total_spending, npi_count, num_states, risk_rank, name_freq_count,
 {r('name_freq_penalty')} name_freq_penalty, {r('leie_ind_score')} leie_ind_score FROM best JOIN risk USING (ao_last, ao_first)"""


@query("w4_best_matches", f"WITH {RISK}, {BEST} SELECT {BEST_LIST}")
def _(t):
    layer = stages.layer3(t)
    return NET.best_matches(layer.individual, layer.scored)


@query("r21_tier_table", f"WITH {RISK}, {BEST} SELECT {BEST_LIST} WHERE tier IN (3, 4) ORDER BY risk.total_spending DESC, ao_last, ao_first LIMIT 10")
def _(t):
    layer = stages.layer3(t)
    return NET.tier_table(layer.individual, layer.scored, [3, 4])


@query("r21_tier_table_sure", f"WITH {RISK}, {BEST} SELECT {BEST_LIST} WHERE tier IN (1, 2) ORDER BY risk.total_spending DESC, ao_last, ao_first LIMIT 10")
def _(t):
    layer = stages.layer3(t)
    return NET.tier_table(layer.individual, layer.scored, [1, 2])


@query("r21_section_totals", f"""WITH {RISK} SELECT COUNT(*) FILTER (num_states >= 2) num_multi_state, COUNT(*) FILTER (num_deactivated > 0 AND npi_count > num_deactivated) num_cycling,
 COUNT(*) FILTER (same_address_count >= 2 AND npi_count >= 2) num_clustered, COUNT(*) FILTER (has_hh_taxonomy = 1 AND num_states >= 2) num_cohort_multi_state,
 (SELECT COUNT(*) FROM org_matches) num_org_matches, (SELECT COUNT(DISTINCT npi) FROM org_matches) num_matched_orgs, (SELECT COUNT(*) FROM gone) num_deactivated_matches FROM risk""")
def _(t):
    layer = stages.layer3(t)
    return NET.section_totals(layer.scored, layer.organisation, layer.deactivated, min_states=2, cluster=2)


@query("r21_organisation_matches", f"WITH {RISK} SELECT npi, leie_busname, org_name, state, match_type FROM org_matches ORDER BY npi LIMIT 20")
def _(t):
    return NET.organisation_matches(stages.layer3(t).organisation)


@query("r21_deactivated_officials", f"""WITH {RISK}, firsts AS (SELECT * FROM (SELECT ao_last, ao_first, deactivation_date,
 ROW_NUMBER() OVER (PARTITION BY ao_last, ao_first ORDER BY deactivation_date NULLS LAST, deact_npi) k FROM gone) WHERE k = 1)
SELECT ao_last, ao_first, firsts.deactivation_date, {r('total_spending')} total_spending, npi_count, num_states, risk_rank FROM firsts JOIN risk USING (ao_last, ao_first)
 ORDER BY risk.total_spending DESC, ao_last, ao_first LIMIT 20""")
def _(t):
    layer = stages.layer3(t)
    return NET.deactivated_officials(layer.deactivated, layer.scored)


@query("r21_cycling", f"""WITH {RISK} SELECT ao_last, ao_first, npi_count - num_deactivated num_active, num_deactivated, npi_count, num_states, {r('total_spending')} total_spending
 FROM risk WHERE num_deactivated > 0 AND npi_count > num_deactivated ORDER BY num_deactivated DESC, ao_last, ao_first LIMIT 20""")
def _(t):
    return NET.cycling(stages.layer3(t).scored)


@query("r21_clustered_addresses", f"""WITH {RISK} SELECT ao_last, ao_first, same_address_count, npi_count, {r('same_address_ratio')} same_address_ratio, {r('total_spending')} total_spending
 FROM risk WHERE same_address_count >= 2 AND npi_count >= 2 ORDER BY same_address_count DESC, ao_last, ao_first LIMIT 20""")
def _(t):
    return NET.clustered_addresses(stages.layer3(t).scored, k=2)


def _org_cohort(t):
    """The test cohort's providers under the ids of the test organisations."""
    from claimscope.session import cut

    return cut(stages.cohort(t).select(F.concat(F.lit("C"), "billing_npi").alias("billing_npi"), "hh_risk_rank"))


@query("r21_cohort_multi_state", f"""WITH {HH_CLAIMS}, {cohort_sql("hh", "c_")}, {RISK}, best AS (SELECT * FROM risk WHERE has_hh_taxonomy = 1 AND num_states >= 2 ORDER BY total_spending DESC, ao_last, ao_first LIMIT 20),
ranks AS (SELECT f.ao_last, f.ao_first, COUNT(*) num_ranked, ARRAY_TO_STRING(LIST(c.hh_risk_rank ORDER BY c.hh_risk_rank)[1:10], '|') hh_ranks FROM flagged f JOIN c_cohort c ON f.npi = 'C' || c.billing_npi WHERE f.is_hh = 1 GROUP BY ALL)
SELECT ao_last, ao_first, npi_count, num_states, num_hh, {r('best.total_spending')} total_spending, num_ranked, hh_ranks FROM best LEFT JOIN ranks USING (ao_last, ao_first)""")
def _(t):
    return NET.cohort_multi_state(stages.layer3(t).scored, t.orgs, _org_cohort(t))


@query("r21_top_spending", f"WITH {RISK} SELECT ao_last, ao_first, {r('total_spending')} total_spending, npi_count, num_states, risk_rank FROM risk ORDER BY risk.total_spending DESC, ao_last, ao_first LIMIT 10")
def _(t):
    return NET.top_spending(stages.layer3(t).scored)


@query("j20_attach", f"""WITH {RISK} SELECT o.npi, o.match_type, x.risk_rank, {r('x.total_spending')} total_spending FROM org_matches o LEFT JOIN risk x USING (ao_last, ao_first)""")
def _(t):
    layer = stages.layer3(t)
    joined = sets.attach(layer.organisation.select("npi", "match_type", *OFFICIAL), layer.scored, OFFICIAL, ["risk_rank", "total_spending"])
    return joined.drop(*OFFICIAL)


@query("s7_write_networks", f"WITH {RISK} SELECT ao_last, ao_first, risk_rank, {r('risk_score')} risk_score FROM risk")
def _(t):
    from claimscope.session import scratch_path
    from claimscope.sources import readers

    layer = stages.layer3(t)
    states = layer.networks.states.groupBy(*OFFICIAL).agg(ranking.sorted_distinct("state").alias("states"))
    path = scratch_path(t.spark, "networks")
    readers.write_stage(layer.scored.join(states, OFFICIAL).select(*OFFICIAL, "risk_rank", "risk_score", "states"), path, drop_arrays=True)
    return readers.read_stage(t.spark, path)
