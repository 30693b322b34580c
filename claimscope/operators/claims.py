"""Scoping and aggregation of spending rows per provider, procedure and month."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.functions.columns import count_of, flag, in_cohort, multiple_of_100, ratio, share_of, whole_dollars
from claimscope.functions.constants import CATEGORIES, COHORT_PREFIXES, OTHER_CATEGORY
from claimscope.operators.scale import lookup_join, summed_for

# Columns that vary among the rows of one provider, used to spread a provider with very many rows.
_VARYING = ["total_paid", "hcpcs_code", "claim_from_month"]


def _varying(claims: DataFrame) -> list[str]:
    return [name for name in _VARYING if name in claims.columns]


def project(df: DataFrame, expressions: Mapping[str, Column | str]) -> DataFrame:
    return df.select(*[
        (F.expr(value) if isinstance(value, str) else value).alias(name) for name, value in expressions.items()
    ])


def scope_state(df: DataFrame, states: str | Sequence[str], column: str = "state") -> DataFrame:
    return df.where(F.col(column).isin([states] if isinstance(states, str) else list(states)))


def cohort(df: DataFrame, prefixes: Sequence[str] = COHORT_PREFIXES, column: str = "primary_taxonomy") -> DataFrame:
    return df.where(in_cohort(column, prefixes))


def categorize(df: DataFrame, code_map: DataFrame, default: str = OTHER_CATEGORY) -> DataFrame:
    """Category of every row's code from a (hcpcs_code, hh_category) table; ``default`` for other codes."""
    joined = lookup_join(df, code_map, "hcpcs_code", "left", spread_by=[c for c in df.columns if c != "hcpcs_code"])
    return joined.withColumn("hh_category", F.coalesce("hh_category", F.lit(default)))


def enrich_claims(claims: DataFrame, providers: DataFrame) -> DataFrame:
    """Claims of the given providers, with the provider's columns. ``providers`` has one row per npi."""
    keyed = providers.withColumnRenamed("npi", "billing_npi")
    return lookup_join(claims, keyed, "billing_npi", "inner", spread_by=_varying(claims))


def claims_of(claims: DataFrame, ids: DataFrame) -> DataFrame:
    """Claims billed under one of the ids, without further columns."""
    keyed = ids.select(F.col("npi").alias("billing_npi"))
    return lookup_join(claims, keyed, "billing_npi", "left_semi", spread_by=_varying(claims))


def distinct_ids(claims: DataFrame) -> DataFrame:
    return claims.agg(F.countDistinct("billing_npi").alias("national_providers"))


def provider_code(claims: DataFrame, attributes: Sequence[str] = ()) -> DataFrame:
    """Sums per provider and procedure code; every volume figure of a provider can be summed up from these rows.

    ``attributes`` are columns that depend on the code alone, such as its category.
    """
    return claims.groupBy("billing_npi", "hcpcs_code", *attributes).agg(*_code_sums()).withColumn("ppc", ratio("code_paid", "code_claims"))


def _code_sums() -> list[Column]:
    return [
        F.sum("total_paid").alias("code_paid"),
        F.sum("total_claims").alias("code_claims"),
        F.sum("total_unique_beneficiaries").alias("code_beneficiaries"),
        F.count(F.lit(1)).alias("code_rows"),
        count_of(whole_dollars("total_paid")).alias("rows_round_dollar"),
        count_of(multiple_of_100("total_paid")).alias("rows_round_hundred"),
        count_of(F.col("billing_npi") != F.col("servicing_npi")).alias("rows_npi_mismatch"),
    ]


def provider_sums(claims: DataFrame) -> DataFrame:
    """The rows of ``provider_code`` and of ``provider_month`` in one table, from one scan and one aggregation of the claims.

    ``by_code`` tells them apart. Columns of the other kind are null, so aggregates of either kind run over the whole table.
    """
    keys = ["billing_npi", "hcpcs_code", "claim_from_month"]
    sums = claims.groupingSets([keys[:2], keys[::2]], *keys).agg(*_code_sums(), (F.grouping("claim_from_month") == 1).alias("by_code"))
    own = [name for name in sums.columns if name not in (*keys, "by_code")]
    return sums.select(
        *keys, "by_code", *[F.when(F.col("by_code"), F.col(name)).alias(name) for name in own],
        F.when(F.col("by_code"), ratio("code_paid", "code_claims")).alias("ppc"), F.when(~F.col("by_code"), F.col("code_paid")).alias("monthly_paid"),
    )


def month_sums(claims: DataFrame) -> DataFrame:
    """Sums per month, provider and code: a stage table to be partitioned by month, so that a month can be replaced alone."""
    return claims.groupBy("claim_from_month", "billing_npi", "hcpcs_code").agg(*_code_sums())


def provider_code_of(months: DataFrame) -> DataFrame:
    """The rows of ``provider_code`` from ``month_sums``, without the claims."""
    sums = [name for name in months.columns if name not in ("claim_from_month", "billing_npi", "hcpcs_code")]
    added = months.groupBy("billing_npi", "hcpcs_code").agg(*[F.sum(name).alias(name) for name in sums])
    return added.withColumn("ppc", ratio("code_paid", "code_claims"))


def provider_month(claims: DataFrame) -> DataFrame:
    return claims.groupBy("billing_npi", "claim_from_month").agg(F.sum("total_paid").alias("monthly_paid"))


def monthly_stats(monthly: DataFrame, ddof: int) -> DataFrame:
    """Active months, largest month and coefficient of variation per provider, as ``monthly_aggregates``."""
    return monthly.groupBy("billing_npi").agg(*monthly_aggregates(ddof))


def monthly_aggregates(ddof: int) -> list[Column]:
    """Of the months' sums of a provider.

    ``ddof`` 0: population deviation, and 0 unless the mean is positive. ``ddof`` 1: sample deviation, and 0 only for
    a zero mean or a single month.
    """
    mean = F.avg("monthly_paid")
    if ddof == 0:
        variation = F.when(mean > 0, ratio(F.stddev_pop("monthly_paid"), mean)).otherwise(F.lit(0.0))
    else:
        variation = F.coalesce(ratio(F.stddev_samp("monthly_paid"), mean), F.lit(0.0))
    return [
        F.count("claim_from_month").alias("num_active_months"),
        variation.alias("monthly_paid_cv"),
        F.max("monthly_paid").alias("max_monthly_paid"),
    ]


def with_intensity(totals: DataFrame) -> DataFrame:
    return totals.withColumns({
        "paid_per_claim": ratio("total_paid", "total_claims"),
        "claims_per_beneficiary": ratio("total_claims", "total_beneficiaries"),
        "paid_per_beneficiary": ratio("total_paid", "total_beneficiaries"),
    })


def provider_totals(codes: DataFrame, months: DataFrame | None = None) -> DataFrame:
    """Volume and intensity per provider, from ``provider_code`` rows (and ``monthly_stats`` for the active months)."""
    totals = with_intensity(codes.groupBy("billing_npi").agg(*total_aggregates()))
    if months is None:
        return totals
    return totals.join(months.select("billing_npi", "num_active_months"), "billing_npi", "left")


def total_aggregates() -> list[Column]:
    """Of the codes' sums of a provider."""
    return [
        F.sum("code_paid").alias("total_paid"),
        F.sum("code_claims").alias("total_claims"),
        F.sum("code_beneficiaries").alias("total_beneficiaries"),
        F.count("hcpcs_code").alias("num_hcpcs_codes"),
        F.sum("code_rows").alias("num_rows"),
    ]


def billing_patterns(codes: DataFrame) -> DataFrame:
    """Shares of whole-dollar rows, multiples of 100, and rows with another servicing provider, from code rows."""
    return codes.groupBy("billing_npi").agg(*pattern_aggregates())


def pattern_aggregates() -> list[Column]:
    rows = F.sum("code_rows")
    return [
        ratio(F.sum("rows_round_dollar"), rows).alias("pct_round_dollar"),
        ratio(F.sum("rows_round_hundred"), rows).alias("pct_round_hundred"),
        ratio(F.sum("rows_npi_mismatch"), rows).alias("pct_npi_mismatch"),
    ]


def concentration(codes: DataFrame) -> DataFrame:
    """Share of the best paid code in a provider's payments."""
    return codes.groupBy("billing_npi").agg(*concentration_aggregates())


def concentration_aggregates() -> list[Column]:
    return [F.max("code_paid").alias("top_code_paid"), ratio(F.max("code_paid"), F.sum("code_paid")).alias("revenue_concentration")]


def share_where(df: DataFrame, key: str, conditions: Mapping[str, Column]) -> DataFrame:
    """Per key, the share of its rows for which each condition holds."""
    return df.groupBy(key).agg(*[share_of(condition).alias(name) for name, condition in conditions.items()])


def constant_attrs(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """A non-null value per key of columns that are constant within the key.

    Distinct rows come first: the largest of texts is found by sorting, so it must not run over all rows. They are counted, as Spark
    would take a plain ``distinct`` below a maximum out again.
    """
    distinct = df.groupBy(key, *cols).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 0")
    return distinct.groupBy(key).agg(*[F.max(name).alias(name) for name in cols])


def assemble(base: DataFrame, *rollups: DataFrame, on: str = "billing_npi") -> DataFrame:
    for rollup in rollups:
        base = base.join(rollup, on, "left")
    return base


def flag_in(df: DataFrame, ids: DataFrame, on: str, out: str) -> DataFrame:
    """1 for rows whose key is in the list, else 0."""
    marked = ids.select(on).distinct().withColumn("_listed", F.lit(True))
    return df.join(marked, on, "left").withColumn(out, flag(F.col("_listed"))).drop("_listed")


def registry_flags(df: DataFrame, deactivated: DataFrame, id_col: str = "npi") -> DataFrame:
    """Flags from registry dates and Y/N fields; deactivated by the registry or by the list."""
    listed = flag_in(df, deactivated.select(F.col("npi").alias(id_col)), id_col, "_in_list")
    return listed.withColumns({
        "is_deactivated": flag(F.col("deactivation_date").isNotNull() | (F.col("_in_list") == 1)),
        "was_reactivated": flag(F.col("reactivation_date").isNotNull()),
        "is_sole_proprietor": flag(F.col("sole_proprietor") == "Y"),
        "is_org_subpart": flag(F.col("org_subpart") == "Y"),
    }).drop("_in_list")


def category_mix(
    claims: DataFrame, categories: Sequence[str] = (*CATEGORIES, OTHER_CATEGORY), amount: str = "total_paid",
) -> DataFrame:
    """Paid amount per category and its share of the provider's payments; all categories are always present."""
    paid = claims.groupBy("billing_npi").pivot("hh_category", list(categories)).agg(F.sum(amount))
    paid = paid.na.fill(0.0, list(categories))
    total = sum((F.col(name) for name in categories[1:]), F.col(categories[0]))
    return paid.select(
        "billing_npi",
        *[F.col(name).alias(f"paid_{name}") for name in categories],
        *[ratio(F.col(name), total).alias(f"pct_{name}") for name in categories],
    )


def add_ratio(df: DataFrame, numerator: str, denominator: str, out: str, plus: float = 1) -> DataFrame:
    return df.withColumn(out, ratio(F.col(numerator), F.col(denominator) + plus))


def cohort_codes(claims: DataFrame) -> DataFrame:
    """Number of distinct codes of a provider that have a category."""
    mapped = F.when(F.col("hh_category") != OTHER_CATEGORY, F.col("hcpcs_code"))
    return claims.groupBy("billing_npi").agg(F.countDistinct(mapped).alias("num_hh_codes"))


def exposure_by_npi(claims: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Spending per billing id, of the ids in ``ids`` (npi) if given; code and month counts come from the distinct pairs."""
    def by_code(rows: DataFrame) -> DataFrame:
        return rows.groupBy("billing_npi", "hcpcs_code").agg(
            F.sum("total_paid").alias("paid"), F.sum("total_claims").alias("claims"),
            F.sum("total_unique_beneficiaries").alias("beneficiaries"),
        )

    def by_month(rows: DataFrame) -> DataFrame:
        return rows.select("billing_npi", "claim_from_month").distinct()

    if ids is None:
        codes, pairs = by_code(claims), by_month(claims)
    else:
        codes, pairs = summed_for(claims, ids.select(F.col("npi").alias("billing_npi")), "billing_npi", by_code, by_month)
    totals = codes.groupBy("billing_npi").agg(
        F.sum("paid").alias("total_paid"), F.sum("claims").alias("total_claims"),
        F.sum("beneficiaries").alias("total_beneficiaries"), F.count("hcpcs_code").alias("num_hcpcs"),
    )
    months = pairs.groupBy("billing_npi").agg(F.count("claim_from_month").alias("num_months"))
    return totals.join(months, "billing_npi", "left")


def code_summary(claims: DataFrame) -> DataFrame:
    """Payments, claims, providers and average price per code."""
    pairs = claims.groupBy("hcpcs_code", "hh_category", "billing_npi").agg(
        F.sum("total_paid").alias("paid"), F.sum("total_claims").alias("claims")
    )
    return (
        pairs.groupBy("hcpcs_code", "hh_category").agg(
            F.sum("paid").alias("total_paid"), F.sum("claims").alias("total_claims"),
            F.count("billing_npi").alias("num_providers"),
        )
        .withColumnRenamed("hh_category", "category")
        .withColumn("avg_ppc", ratio("total_paid", "total_claims"))
    )
