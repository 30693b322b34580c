"""Organisations grouped by their authorized official.

An official may control very many organisations, so ids, states and cities stay in long tables with one row per
(official, value); matching joins to those. lists stay long tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions.columns import address_key, clean, count_of, flag, in_cohort, is_blank, ratio
from claimscope.operators.scale import spread_join
from claimscope.operators.sets import with_scalars

OFFICIAL = ["ao_last", "ao_first"]


def organisations(registry: DataFrame) -> DataFrame:
    """Organisations with a named official; the official's names in the form in which they are compared."""
    return (
        registry.where((F.col("entity_type").cast("string") == "2") & ~is_blank("ao_last"))
        .withColumns({
            "ao_last": F.upper(F.trim("ao_last")),
            "ao_first": F.upper(F.trim("ao_first")),
            "ao_middle": clean("ao_middle"),
        })
    )


def individuals(registry: DataFrame) -> DataFrame:
    """Persons with a non-blank last name."""
    return (
        registry.where((F.col("entity_type").cast("string") == "1") & ~is_blank("ind_last"))
        .withColumns({"ind_last": F.upper(F.trim("ind_last")), "ind_first": F.upper(F.trim("ind_first"))})
    )


def deactivated_individuals(registry: DataFrame, deactivated: DataFrame) -> DataFrame:
    """Persons with a deactivation date in the registry, or on the deactivated list."""
    listed = deactivated.select("npi").distinct().withColumn("_listed", F.lit(True))
    persons = registry.where(F.col("entity_type").cast("string") == "1").withColumns(
        {"ind_last": F.upper(F.trim("ind_last")), "ind_first": F.upper(F.trim("ind_first"))}
    )
    dated = F.coalesce(F.col("deactivation_date").cast("string"), F.lit("")) != ""
    return persons.join(listed, "npi", "left").where(dated | F.col("_listed").isNotNull()).drop("_listed")


def org_flags(orgs: DataFrame) -> DataFrame:
    return orgs.withColumns({
        "is_deactivated": flag(~is_blank("deactivation_date")),
        "is_reactivated": flag(~is_blank("reactivation_date")),
        "is_hh": flag(in_cohort("primary_taxonomy")),
        "is_subpart_flag": flag(clean("is_subpart") == "Y"),
    })


def named(orgs: DataFrame) -> DataFrame:
    return orgs.where(F.col("ao_last").isNotNull() & F.col("ao_first").isNotNull())


def network_counts(orgs: DataFrame) -> DataFrame:
    """Per official: distinct organisations, states and phones, sums of the flags of ``org_flags``, and a middle name.

    The middle name, of the smallest id, has its own aggregation: text in the buffers would make the counts sort-based.
    """
    middles = named(orgs).groupBy(*OFFICIAL).agg(F.min_by("ao_middle", "npi").alias("ao_middle"))
    counts = named(orgs).groupBy(*OFFICIAL).agg(
        F.countDistinct("npi").alias("npi_count"),
        F.countDistinct("state").alias("num_states"),
        F.sum("is_deactivated").alias("num_deactivated"),
        F.sum("is_reactivated").alias("num_reactivated"),
        F.sum("is_hh").alias("num_hh"),
        F.sum("is_subpart_flag").alias("num_subparts"),
        F.countDistinct("ao_phone").alias("phone_count"),
    )
    return counts.join(middles, OFFICIAL)


def address_clusters(orgs: DataFrame) -> DataFrame:
    """Per official: the largest number of organisations at one address."""
    at_address = named(orgs).groupBy(*OFFICIAL, address_key().alias("addr_key")).agg(F.count(F.lit(1)).alias("n"))
    return at_address.groupBy(*OFFICIAL).agg(F.max("n").alias("same_address_count"))


def network_members(orgs: DataFrame) -> DataFrame:
    return named(orgs).select(*OFFICIAL, "npi").distinct()


def network_states(orgs: DataFrame) -> DataFrame:
    return named(orgs).where(F.col("state").isNotNull()).select(*OFFICIAL, "state").distinct()


def network_cities(orgs: DataFrame) -> DataFrame:
    return named(orgs).select(*OFFICIAL, clean("city").alias("city")).distinct()


def network_lists(orgs: DataFrame) -> DataFrame:
    """Ids, states, names and cities per official in long form: (official, list, item); a name per organisation, the rest once.

    One scan gives all four lists, and items are counted before they are shuffled.
    """
    lists = {"npi_list": F.col("npi"), "states": F.col("state"), "org_names": F.col("org_name"), "cities": clean("city")}
    entries = F.array(*[F.struct(F.lit(name).alias("list"), item.alias("item")) for name, item in lists.items()])
    long = named(orgs).select(*OFFICIAL, F.inline(entries)).where(F.col("item").isNotNull())
    counted = long.groupBy(*OFFICIAL, "list", "item").agg(F.count(F.lit(1)).alias("_n"))
    times = F.when(F.col("list") == "org_names", F.col("_n")).otherwise(F.lit(1)).cast("int")
    return counted.withColumn("_each", F.explode(F.sequence(F.lit(1), times))).select(*OFFICIAL, "list", "item")


def multi_member(networks: DataFrame, k: int = 2) -> DataFrame:
    return networks.where(F.col("npi_count") >= k)


def member_ids(members: DataFrame) -> DataFrame:
    return members.select("npi").distinct()


@dataclass(frozen=True)
class Networks:
    """Officials with two or more organisations, and what they control, one row per (official, value)."""

    everyone: DataFrame
    officials: DataFrame
    members: DataFrame
    states: DataFrame
    cities: DataFrame


def all_officials(orgs: DataFrame) -> DataFrame:
    """Every official with counts, address clustering and flags."""
    return (
        network_counts(orgs).join(address_clusters(orgs), OFFICIAL)
        .withColumns({
            "same_address_ratio": ratio("same_address_count", "npi_count"),
            "has_hh_taxonomy": flag(F.col("num_hh") > 0),
            "has_deactivated": flag(F.col("num_deactivated") > 0),
        })
    )


def build_networks(orgs: DataFrame, everyone: DataFrame | None = None) -> Networks:
    """``orgs`` has the flags of ``org_flags``; ``everyone`` may pass a stored result of ``all_officials``.

    An official with very many organisations is spread over tasks; the number of states and cities is bounded by itself.
    """
    everyone = all_officials(orgs) if everyone is None else everyone
    officials = multi_member(everyone)
    keep = officials.select(*OFFICIAL)
    sizes = officials.select(*OFFICIAL, F.col("npi_count").alias("n"))
    return Networks(
        everyone, officials,
        spread_join(network_members(orgs), keep, OFFICIAL, "left_semi", spread_by=["npi"], counts=sizes),
        network_states(orgs).join(keep, OFFICIAL, "left_semi"),
        network_cities(orgs).join(keep, OFFICIAL, "left_semi"),
    )


def name_frequency(persons: DataFrame) -> DataFrame:
    """Number of persons per name."""
    return persons.groupBy(
        F.upper(F.trim("ind_last")).alias("ao_last"), F.upper(F.trim("ind_first")).alias("ao_first")
    ).agg(F.count(F.lit(1)).alias("name_freq_count"))


def exposure_by_official(exposure: DataFrame, members: DataFrame) -> DataFrame:
    """Spending per official over the organisations that bill. An organisation counts for one official: the first by name."""
    owners = members.groupBy("npi").agg(F.min(F.struct(*OFFICIAL)).alias("owner")).select("npi", "owner.*")
    return exposure.withColumnRenamed("billing_npi", "npi").join(owners, "npi").groupBy(*OFFICIAL).agg(
        F.sum("total_paid").alias("total_spending"),
        F.sum("total_claims").alias("total_claims"),
        F.count("npi").alias("npis_with_spending"),
    )


def attach_spending(networks: DataFrame, spending: DataFrame) -> DataFrame:
    """Spending per official, 0 where there is none."""
    return networks.join(spending, OFFICIAL, "left").withColumns({
        "total_spending": F.coalesce("total_spending", F.lit(0.0)),
        "total_claims": F.coalesce("total_claims", F.lit(0)),
        "npis_with_spending": F.coalesce("npis_with_spending", F.lit(0)),
    })


def burn_and_churn(networks: DataFrame) -> DataFrame:
    """Officials with both active and deactivated organisations."""
    return networks.where(
        (F.col("num_deactivated") > 0) & (F.col("npi_count") > F.col("num_deactivated"))
    ).withColumn("num_active", F.col("npi_count") - F.col("num_deactivated"))


def name_totals(frequency: DataFrame) -> DataFrame:
    """One row: how many different names persons have, and how many persons there are, from ``name_frequency``."""
    return frequency.agg(F.count(F.lit(1)).alias("num_names"), F.sum("name_freq_count").alias("num_persons"))


def common_names(matches: DataFrame, k: int = 10) -> DataFrame:
    """Officials with k or more distinct deactivated persons of their name."""
    return matches.groupBy(*OFFICIAL).agg(
        F.countDistinct("deact_npi").alias("deact_ind_match_count")
    ).where(F.col("deact_ind_match_count") >= k)


def tier_counts(matches: DataFrame) -> DataFrame:
    """Officials per match tier."""
    return matches.select("tier", *OFFICIAL).distinct().groupBy("tier").agg(F.count(F.lit(1)).alias("num_officials"))


def exclusion_counts(individual: DataFrame, organisation: DataFrame) -> DataFrame:
    """Unique officials with an individual match and with an organisation match."""
    return with_scalars(
        individual.select(*OFFICIAL).distinct().agg(F.count(F.lit(1)).alias("individual_officials")),
        organisation.select(*OFFICIAL).distinct().agg(F.count(F.lit(1)).alias("organisation_officials")),
    )


def network_summary(risk: DataFrame) -> DataFrame:
    """One row of counts over the scored officials."""
    flags = ["has_leie_ind_match", "has_leie_org_match", "has_deact_ind_match"]
    any_flag = (F.col(flags[0]) == 1) | (F.col(flags[1]) == 1) | (F.col(flags[2]) == 1)
    return risk.agg(
        F.count(F.lit(1)).alias("num_officials"),
        *[count_of(F.col(name) == 1).alias(f"n_{name}") for name in flags],
        *[count_of(F.col("leie_best_tier") == tier).alias(f"n_tier_{tier}") for tier in (1, 2, 3, 4)],
        count_of(any_flag).alias("n_any_flag"),
        *[count_of(F.col("npi_count") >= k).alias(f"n_{k}_npis") for k in (5, 10, 20)],
        F.sum("npis_with_spending").alias("npis_with_spending"),
        F.sum("total_spending").alias("total_spending"),
    )
