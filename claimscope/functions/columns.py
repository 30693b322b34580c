"""Column expressions shared by the operators. All are built-in Spark functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimscope.functions.constants import COHORT_PREFIXES, TIER_WEIGHTS


def as_col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """Quotient as a double, null where the denominator is zero."""
    return F.try_divide(as_col(numerator).cast("double"), as_col(denominator).cast("double"))


def clean(column: str | Column) -> Column:
    """Upper-cased and trimmed text, blank for null: the form in which names and cities are compared."""
    return F.upper(F.trim(F.coalesce(as_col(column), F.lit(""))))


def is_blank(column: str | Column) -> Column:
    return F.trim(F.coalesce(as_col(column), F.lit(""))) == ""


def flag(condition: Column) -> Column:
    """1 where the condition is true, else 0 (also for null)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def share_of(condition: Column) -> Column:
    """Aggregate: share of all rows for which the condition is true."""
    return F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0)))


def count_of(condition: Column) -> Column:
    """Aggregate: number of rows for which the condition is true, 0 for an empty input."""
    return F.count(F.when(condition, F.lit(1)))


def whole_dollars(paid: str | Column) -> Column:
    return as_col(paid) == F.round(as_col(paid), 0)


def multiple_of_100(paid: str | Column) -> Column:
    return as_col(paid) % 100 == 0


def age_years(start: str | Column, as_of: str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), as_col(start)) / F.lit(365.25)


def prefix(column: str | Column, length: int) -> Column:
    return F.substring(as_col(column), 1, length)


def in_cohort(taxonomy: str | Column, prefixes: Sequence[str] = COHORT_PREFIXES) -> Column:
    """Whether the taxonomy starts with one of the prefixes (of one length or several)."""
    by_length: dict[int, list[str]] = {}
    for item in prefixes:
        by_length.setdefault(len(item), []).append(item)
    tests = [prefix(taxonomy, length).isin(items) for length, items in by_length.items()]
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return result


def count_non_null(columns: Sequence[str]) -> Column:
    total = F.lit(0)
    for name in columns:
        total = total + F.col(name).isNotNull().cast("int")
    return total


def address_key(line: str = "address_line1", city: str = "city", state: str = "state", zip_code: str = "zip5") -> Column:
    """One text per physical address: street, city, state and five-digit zip."""
    text = lambda name: F.trim(F.coalesce(F.col(name), F.lit("")))
    return F.concat_ws("|", clean(line), clean(city), text(state), prefix(text(zip_code), 5))


def code_lookup(key: Column, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """Value of a small fixed mapping (a literal map), ``default`` for other keys."""
    pairs = [F.lit(part) for pair in mapping.items() for part in pair]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def binned(column: str | Column, edges: Sequence[tuple[float | None, str]]) -> Column:
    """Label of the last bin whose lower bound does not exceed the value; ``edges`` go upwards."""
    value = as_col(column)
    result = F.lit(None).cast("string")
    for lower, label in edges:
        inside = value.isNotNull() if lower is None else value >= lower
        result = F.when(inside, F.lit(label)).otherwise(result)
    return result


def name_penalty(count: str | Column) -> Column:
    """1 / log2(n + 1), with n at least 1: names borne by many people count for less."""
    return 1.0 / F.log2(F.greatest(as_col(count), F.lit(1)) + 1)


def individual_score(tier: str | Column, penalty: str | Column) -> Column:
    """Weight of the best match tier times the name penalty; 0 without a match."""
    result = F.lit(0.0)
    for number, weight in TIER_WEIGHTS.items():
        result = F.when(as_col(tier) == number, F.lit(weight) * as_col(penalty)).otherwise(result)
    return result


def middle_match(left: str | Column, right: str | Column) -> Column:
    return (as_col(left) != "") & (as_col(right) != "") & (as_col(left) == as_col(right))
