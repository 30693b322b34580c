"""Standardization of feature columns, and counting extreme values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions.constants import FILL_FEATURES, LOG_FEATURES, MODEL_FEATURES

# A deviation this small against the mean is rounding noise: the column is constant.
CONSTANT = 1e-9


def preprocess(
    df: DataFrame, id_col: str = "billing_npi", features: Sequence[str] = tuple(MODEL_FEATURES),
    logs: Sequence[str] = tuple(LOG_FEATURES), fills: Mapping[str, float] | None = None,
) -> DataFrame:
    """Fill, log1p and standardize the features to mean 0 and population deviation 1; constant columns become 0.

    Means and deviations of all columns come from one pass; they reach the rows as one broadcast row.
    """
    fills = FILL_FEATURES if fills is None else fills
    prepared = []
    for name in features:
        value = f"CAST(`{name}` AS DOUBLE)"
        if name in fills:
            value = f"COALESCE({value}, {float(fills[name])}D)"
        if name in logs:
            value = f"LOG1P({value})"
        prepared.append(f"{value} AS `{name}`")
    matrix = df.selectExpr(id_col, *prepared)
    moments = matrix.selectExpr("STRUCT(" + ", ".join(
        f"AVG(`{name}`) AS `mean_{name}`, STDDEV_POP(`{name}`) AS `std_{name}`" for name in features
    ) + ") AS moments")
    scaled = matrix.withColumn("_moments", moments.scalar())

    def z(name: str) -> str:
        mean, std = f"_moments.`mean_{name}`", f"_moments.`std_{name}`"
        varies = f"{std} > {CONSTANT}D * GREATEST(ABS({mean}), 1D)"
        return f"CASE WHEN `{name}` IS NULL THEN NULL WHEN {varies} THEN (`{name}` - {mean}) / {std} ELSE 0D END AS `{name}`"

    return scaled.selectExpr(id_col, *[z(name) for name in features])


def extreme_count(z: DataFrame, features: Sequence[str], threshold: float, out: str) -> DataFrame:
    """How many features of a row lie more than ``threshold`` deviations from the mean.

    Compared to nine decimals: a value exactly at the threshold must not depend on the order of a distributed sum.
    """
    total = " + ".join(f"CAST(COALESCE(ROUND(ABS(`{name}`), 9) > {float(threshold)}D, FALSE) AS INT)" for name in features)
    return z.withColumn(out, F.expr(total))
