"""Scalar rules as native Column expressions (no Python runs per row)."""

from __future__ import annotations

import re
from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from leasemill.functions import vocabulary as V

# Money is held as exact decimals; 18 digits leave room for portfolio totals.
MONEY = "decimal(18,2)"

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as double; 0 where the denominator is null or not positive."""
    return F.when(
        denominator > 0, numerator.cast("double") / denominator.cast("double")
    ).otherwise(F.lit(0.0))


def percentage(numerator: Column, denominator: Column) -> Column:
    return F.when(
        denominator > 0, numerator.cast("double") / denominator.cast("double") * F.lit(100)
    ).otherwise(F.lit(0.0))


def number(value: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null."""
    text = F.trim(value)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def contains_any(text: Column, patterns: Iterable[str]) -> Column:
    return text.rlike("|".join(re.escape(p) for p in patterns))


def is_vacant(tenant: Column) -> Column:
    return F.coalesce(
        (tenant == "") | contains_any(F.lower(F.trim(tenant)), V.VACANCY_PATTERNS), F.lit(True)
    )


def is_own_use(tenant: Column, suite_id: Column) -> Column:
    both = F.concat_ws(" ", F.coalesce(tenant, F.lit("")), F.coalesce(suite_id, F.lit("")))
    return contains_any(F.lower(F.trim(both)), V.OWN_USE_PATTERNS)


def building_of(suite_id: Column) -> Column:
    """First letter A or B anywhere in the suite id, else null."""
    letter = F.regexp_extract(F.upper(suite_id), "[AB]", 0)
    return F.when(letter != "", letter)


def suite_status() -> Column:
    return (
        F.when(F.col("is_own_use"), F.lit("Own-Use"))
        .when(F.col("is_vacant"), F.lit("Vacant"))
        .otherwise(F.lit("Leased"))
    )


def roster_status() -> Column:
    return F.when(F.col("is_own_use"), F.lit("Own-Use")).otherwise(F.lit("Leased"))


def collection_band(rate: Column) -> Column:
    return (
        F.when(rate < V.COLLECTION_GOOD_FROM, F.lit(V.BELOW_TARGET_LABEL))
        .when(rate >= V.COLLECTION_TARGET, F.lit(V.PERFECT_LABEL))
        .otherwise(F.lit(V.GOOD_LABEL))
    )


def first_of_month(as_of_month: Column) -> Column:
    """'YYYY-MM' to the first day of that month."""
    return F.to_date(F.concat(as_of_month, F.lit("-01")))


def month_number(month: Column) -> Column:
    """Months since year 0: equal steps for range frames whatever the day counts are."""
    return F.year(month) * 12 + F.month(month)


def named_month(name: Column, year: Column) -> Column:
    """Month name and year to a date; an unknown name gives null."""
    names = F.array(*[F.lit(n) for n in V.MONTH_NAMES])
    position = F.array_position(names, F.lower(F.trim(name)))
    return F.when(position > 0, F.make_date(year.cast("int"), position.cast("int"), F.lit(1)))


def loose_date(text: Column) -> Column:
    """A date out of the spellings people put in cells, else null."""
    shapes = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM", "yyyy/MM/dd", "M/d/yyyy",
              "MMMM yyyy", "MMM yyyy", "MMMM d, yyyy"]
    tidy = F.trim(text)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(tidy, F.lit(s))) for s in shapes])


def safe_sheet_name(sheet: Column) -> Column:
    return F.translate(sheet, " /", "__")


def money(value: Column) -> Column:
    return value.cast(MONEY)


def cents(value: Column) -> Column:
    """Double to two decimals, rounding the value times one hundred half away from zero.

    A plain cast rounds the printed digits instead and differs on values such as 33701.534999999996.
    """
    hundredths = F.abs(value) * 100
    whole = F.floor(hundredths)
    rounded = F.when(hundredths - whole >= 0.5, whole + 1).otherwise(whole)
    signed = F.when(value < 0, -rounded).otherwise(rounded)
    return (signed.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def md5_key(value: Column) -> Column:
    return F.md5(value)
