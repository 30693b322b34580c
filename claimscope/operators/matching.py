"""Matching officials and organisations to the exclusion and deactivation lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions.columns import clean, is_blank, middle_match
from claimscope.functions.constants import NO_NPI
from claimscope.operators.networks import OFFICIAL, Networks
from claimscope.operators.ranking import keep_first
from claimscope.operators.scale import spread_join
from claimscope.session import cut

MATCH_COLUMNS = [
    *OFFICIAL, "leie_last", "leie_first", "leie_mid", "leie_city", "leie_state", "leie_npi", "excltype", "excldate", "tier",
]
_VARYING = ["leie_npi", "leie_mid", "leie_city", "excldate", "excltype"]


def excluded_individuals(exclusions: DataFrame) -> DataFrame:
    """Entries with a person's name, in the form in which names are compared."""
    return exclusions.where(~is_blank("lastname")).select(
        clean("lastname").alias("leie_last"), clean("firstname").alias("leie_first"),
        clean("midname").alias("leie_mid"), clean("city").alias("leie_city"),
        F.trim("state").alias("leie_state"), F.col("npi").alias("leie_npi"), "excltype", "excldate",
    )


def excluded_organisations(exclusions: DataFrame) -> DataFrame:
    """Entries with a business name."""
    return exclusions.where(~is_blank("busname")).select(
        clean("busname").alias("leie_busname"), F.col("state").alias("leie_state"), F.col("npi").alias("leie_npi"),
        "excltype", "excldate",
    )


def split_exclusions(exclusions: DataFrame) -> tuple[DataFrame, DataFrame]:
    return excluded_individuals(exclusions), excluded_organisations(exclusions)


def exclusion_breakdown(exclusions: DataFrame) -> DataFrame:
    """One row: entries with a person's name, with only a business name, with both."""
    person, business = ~is_blank("lastname"), ~is_blank("busname")
    return exclusions.agg(
        F.count_if(person).alias("individuals"),
        F.count_if(~person & business).alias("organisations_only"),
        F.count_if(person & business).alias("both"),
    )


def valid_npi(df: DataFrame, column: str = "leie_npi") -> DataFrame:
    return df.where((F.trim(column) != "") & (F.col(column) != NO_NPI))


def match_npi(individuals: DataFrame, members: DataFrame) -> DataFrame:
    """Excluded persons whose listed id is an organisation of an official."""
    keyed = members.withColumnRenamed("npi", "leie_npi")
    return spread_join(valid_npi(individuals), keyed, "leie_npi", "inner", spread_by=["leie_last", *_VARYING])


PERSON = ["leie_last", "leie_first", "leie_state", "leie_city", "leie_mid"]


def distinct_persons(individuals: DataFrame) -> DataFrame:
    """The list's persons without repetition. Tiers are decided on these: many entries of one name become few rows."""
    return individuals.select(*PERSON).distinct()


def match_name_state(states: DataFrame, persons: DataFrame) -> DataFrame:
    """Distinct persons with an official's name and one of the official's states.

    The official side has one row per (name, state), so every person matches at most once.
    """
    official = states.select(
        F.col("ao_last").alias("leie_last"), F.col("ao_first").alias("leie_first"), F.col("state").alias("leie_state"),
    )
    matched = persons.join(official, ["leie_last", "leie_first", "leie_state"])
    return matched.withColumns({"ao_last": F.col("leie_last"), "ao_first": F.col("leie_first")})


def candidate_tiers(networks: Networks, matches: DataFrame) -> DataFrame:
    """Tier of each matched person by itself: 2 with a city, 3 with the middle name of the official, else 4."""
    cities = networks.cities.where(F.col("city") != "").select(
        *OFFICIAL, F.col("city").alias("leie_city"), F.lit(True).alias("_city")
    )
    middles = networks.officials.select(*OFFICIAL, "ao_middle")
    joined = matches.join(cities, [*OFFICIAL, "leie_city"], "left").join(middles, OFFICIAL, "left")
    same_middle = middle_match("leie_mid", "ao_middle")
    return joined.withColumn(
        "tier", F.when(F.col("_city"), F.lit(2)).when(same_middle, F.lit(3)).otherwise(F.lit(4))
    ).drop("_city", "ao_middle")


def best_tier(matches: DataFrame) -> DataFrame:
    return matches.groupBy(*OFFICIAL).agg(F.min("tier").alias("leie_best_tier"))


def place_tiers(matches: DataFrame) -> DataFrame:
    """Keep, for every official, the matches of the official's best tier: tiers are exclusive by official."""
    best = best_tier(matches).withColumnRenamed("leie_best_tier", "tier")
    return matches.join(best, [*OFFICIAL, "tier"], "left_semi")


def entries_of(individuals: DataFrame, persons: DataFrame) -> DataFrame:
    """All entries of the list for matched persons. A person with very many entries is spread over tasks."""
    return spread_join(individuals, persons, PERSON, "inner", spread_by=_VARYING)


def match_individuals_tiered(networks: Networks, individuals: DataFrame) -> DataFrame:
    """Excluded persons matched to officials: by id (1), or name and state with city (2), middle name (3), neither (4)."""
    by_npi = match_npi(individuals, networks.members).withColumn("tier", F.lit(1))
    by_name = candidate_tiers(networks, match_name_state(networks.states, distinct_persons(individuals)))
    keys = [*OFFICIAL, "tier", *PERSON]
    candidates = cut(by_npi.select(*keys).distinct().unionByName(by_name.select(*keys)))
    kept = place_tiers(candidates).where(F.col("tier") > 1)
    return by_npi.select(*MATCH_COLUMNS).unionByName(entries_of(individuals, kept).select(*MATCH_COLUMNS))


def match_org_name(orgs: DataFrame, excluded: DataFrame, on: str = "org_name") -> DataFrame:
    """Organisations whose legal (``org_name``) or trade (``org_dba``) name and state are on the exclusion list.

    An organisation is matched once, to the entry first by date, type and id; the list is reduced to one entry per
    name and state before the join.
    """
    kind = {"org_name": "legal_business_name", "org_dba": "dba_name"}[on]
    first = keep_first(excluded, ["leie_busname", "leie_state"], ["excldate", "excltype", "leie_npi"])
    names = orgs.select("npi", *OFFICIAL, "org_name", "state", clean(on).alias("leie_busname")).where(
        F.col("leie_busname") != ""
    )
    keyed = first.withColumnRenamed("leie_state", "state")
    matched = spread_join(names, keyed, ["leie_busname", "state"], "inner", spread_by=["npi"])
    return matched.select(
        "npi", *OFFICIAL, "org_name", "state", "leie_busname", "leie_npi", "excltype", "excldate",
        F.lit(kind).alias("match_type"),
    )


def keep_members(matches: DataFrame, members: DataFrame) -> DataFrame:
    return matches.join(members.select("npi"), "npi", "left_semi")


def match_organisations(networks: Networks, orgs: DataFrame, excluded: DataFrame) -> DataFrame:
    """One match per organisation of a multi-member official, the legal name before the trade name."""
    legal = match_org_name(orgs, excluded, "org_name")
    trade = match_org_name(orgs, excluded, "org_dba")
    both = keep_members(legal.unionByName(trade), networks.members)
    return keep_first(both, ["npi"], [F.when(F.col("match_type") == "dba_name", 1).otherwise(0)])


def match_deactivated(states: DataFrame, deactivated: DataFrame) -> DataFrame:
    """Deactivated persons with an official's name and one of the official's states."""
    keys = ["ao_last", "ao_first", "ind_state"]
    persons = deactivated.select(
        F.col("ind_last").alias("ao_last"), F.col("ind_first").alias("ao_first"), F.trim("ind_state").alias("ind_state"),
        F.col("npi").alias("deact_npi"), "deactivation_date",
        *[name for name in ("ind_taxonomy",) if name in deactivated.columns],
    )
    official = states.select("ao_last", "ao_first", F.col("state").alias("ind_state"))
    return spread_join(persons, official, keys, "inner", spread_by=["deact_npi"])
