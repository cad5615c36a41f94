"""Staging tables, dimensions, facts and KPI models.

Every model takes DataFrames and returns one. ``keys`` names extra grain columns such as a property id; with
them the same plan serves one property or a whole portfolio. Sums run on exact decimals and big integers, ratios
are double.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasemill.functions import vocabulary as V
from leasemill.functions.expressions import cents, md5_key, money, percentage, ratio

Keys = Sequence[str]


def _area(value: Column) -> Column:
    return F.round(value).cast("bigint")


def _audit() -> list[Column]:
    return [F.col("_file_md5"), F.col("_ingested_at").cast("timestamp").alias("ingested_at")]


# --- staging -----------------------------------------------------------------------------------------------


def stage_ledger(raw: DataFrame, keys: Keys = ()) -> DataFrame:
    return raw.where(F.col("as_of_month").isNotNull() & F.col("month").isNotNull()).select(
        *keys,
        "as_of_month",
        F.col("month").cast("date").alias("month"),
        cents(F.col("rent_base")).alias("rent_base"),
        cents(F.col("collected")).alias("collected"),
        cents(F.col("uncollected")).alias("uncollected"),
        _area(F.col("leased_sqft")).alias("leased_sqft"),
        cents(F.col("price_per_sf_yr")).alias("price_per_sf_yr"),
        *_audit(),
    )


def stage_expenses(raw: DataFrame, keys: Keys = ()) -> DataFrame:
    known = F.col("as_of_month").isNotNull() & F.col("item").isNotNull() & F.col("expense_category").isNotNull()
    return raw.where(known).select(
        *keys,
        "as_of_month",
        F.col("month").cast("date").alias("month"),
        "item",
        cents(F.col("actual")).alias("actual"),
        "expense_category",
        *_audit(),
    )


def stage_lease(raw: DataFrame, keys: Keys = ()) -> DataFrame:
    return raw.where(F.col("as_of_month").isNotNull() & F.col("suite_id").isNotNull()).select(
        *keys,
        "as_of_month",
        "suite_id",
        "building",
        "tenant",
        _area(F.col("sqft")).alias("sqft"),
        cents(F.col("rent_monthly")).alias("rent_monthly"),
        cents(F.col("rent_annual")).alias("rent_annual"),
        cents(F.col("rent_psf_yr")).alias("rent_psf_yr"),
        "is_vacant",
        "is_own_use",
        *_audit(),
    )


# --- dimensions --------------------------------------------------------------------------------------------


def dim_suite(lease: DataFrame, keys: Keys = ()) -> DataFrame:
    return lease.select(*keys, "suite_id", "building", "sqft").distinct()


def dim_tenant(lease: DataFrame, keys: Keys = ()) -> DataFrame:
    return (
        lease.select(*keys, F.col("tenant").alias("tenant_name"), "is_own_use")
        .distinct()
        .withColumn("tenant_id", md5_key(F.col("tenant_name")))
        .select(*keys, "tenant_id", "tenant_name", "is_own_use")
    )


def _latest_per(lease: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """One row per key out of the newest month; ties go to the greatest values, so re-runs agree."""
    pick = F.max(F.struct("as_of_month", *columns)).alias("newest")
    return lease.groupBy(*by).agg(pick).select(*by, *[F.col("newest")[c].alias(c) for c in columns])


def dim_suite_latest(lease: DataFrame, keys: Keys = ()) -> DataFrame:
    """Unique per suite: the newest snapshot's building and area."""
    return _latest_per(lease, [*keys, "suite_id"], ["building", "sqft"])


def dim_tenant_latest(lease: DataFrame, keys: Keys = ()) -> DataFrame:
    """Unique per tenant: the newest snapshot's own-use flag."""
    newest = _latest_per(lease.withColumnRenamed("tenant", "tenant_name"), [*keys, "tenant_name"], ["is_own_use"])
    return newest.select(*keys, md5_key(F.col("tenant_name")).alias("tenant_id"), "tenant_name", "is_own_use")


def dim_calendar(months: DataFrame, month: str = "month") -> DataFrame:
    """Every month between the first and the last one, gaps included."""
    ends = months.agg(F.min(month).alias("first"), F.max(month).alias("last"))
    every = F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 MONTH"))).alias("month")
    return ends.where(F.col("first").isNotNull()).select(every).select(
        F.date_format("month", "yyyy-MM").alias("month_id"),
        "month",
        F.year("month").alias("year"),
        F.month("month").alias("month_of_year"),
    )


# --- facts -------------------------------------------------------------------------------------------------


def fact_rent(ledger: DataFrame, keys: Keys = ()) -> DataFrame:
    return ledger.select(
        *keys,
        "as_of_month",
        "month",
        "rent_base",
        "collected",
        "uncollected",
        "leased_sqft",
        "price_per_sf_yr",
        percentage(F.col("collected"), F.col("rent_base")).alias("collection_rate_pct"),
        (F.col("collected") + F.col("uncollected")).alias("total_billed"),
    )


def fact_expense(expenses: DataFrame, keys: Keys = ()) -> DataFrame:
    return (
        expenses.where(F.col("actual").isNotNull())
        .groupBy(*keys, "as_of_month", "month", "expense_category")
        .agg(F.sum("actual").alias("total_actual"), F.count(F.lit(1)).alias("line_item_count"))
    )


# --- KPI models --------------------------------------------------------------------------------------------


def _sum_where(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(F.lit(0)))


def _earning() -> Column:
    return ~F.col("is_vacant") & ~F.col("is_own_use")


def prop_kpi(
    ledger: DataFrame,
    lease: DataFrame,
    total_sqft: int | Column | DataFrame = V.TOTAL_SQFT,
    exclude_own_use: bool = False,
    keys: Keys = (),
    revenue_sqft: bool = False,
) -> DataFrame:
    """Property KPIs per (snapshot month, month); a month without a roster keeps null areas and zero ratios.

    ``total_sqft`` is the area of every property, or a frame (*keys, total_sqft) with one row per property; a property without
    a row there has no area and a zero occupancy.

    The roster collapses to one row per month before the join, so only month-grain rows are joined; both sides
    are already partitioned by the join key.
    """
    grain = [*keys, "as_of_month"]
    area = F.col("sqft")
    counted = ~F.col("is_own_use") if exclude_own_use else F.lit(True)
    roster = lease.groupBy(*grain).agg(
        _sum_where(counted, area).alias("effective_sqft"),
        _sum_where(F.col("is_vacant"), area).alias("vacant_sqft"),
        _sum_where(F.col("is_own_use"), area).alias("own_use_sqft"),
        _sum_where(_earning(), area).alias("revenue_sqft"),
        F.lit(True).alias("has_roster"),
    )
    if isinstance(total_sqft, DataFrame):
        areas = total_sqft.select(*keys, F.col("total_sqft").cast("bigint").alias("property_sqft"))
        measured = ledger.join(areas, list(keys), "left")
    else:
        total = total_sqft if isinstance(total_sqft, Column) else F.lit(total_sqft)
        measured = ledger.withColumn("property_sqft", total.cast("bigint"))
    joined = (
        measured.join(roster, grain, "left")
        .withColumn("total_property_sqft", F.when(F.col("has_roster"), F.col("property_sqft")))
    )
    return joined.select(
        *grain,
        "month",
        "rent_base",
        "collected",
        "uncollected",
        "leased_sqft",
        "price_per_sf_yr",
        percentage(F.col("collected"), F.col("rent_base")).alias("collection_rate_pct"),
        "total_property_sqft",
        "effective_sqft",
        "vacant_sqft",
        "own_use_sqft",
        percentage(F.col("leased_sqft"), F.col("total_property_sqft")).alias("occupancy_pct"),
        percentage(F.col("leased_sqft"), F.col("effective_sqft")).alias("occupancy_pct_excl_own_use"),
        ratio(F.col("collected"), F.col("effective_sqft")).alias("collected_per_sf"),
        F.col("uncollected").alias("accounts_receivable"),
        F.lit(0).alias("fixed_expenses"),
        F.lit(0).alias("variable_expenses"),
        F.lit(0).alias("total_expenses"),
        F.col("collected").alias("noi_proto"),
        F.lit(100.0).alias("noi_margin_pct"),
        *(["revenue_sqft"] if revenue_sqft else []),
    )


def building_kpi(
    ledger: DataFrame,
    lease: DataFrame,
    exclude_own_use: bool = False,
    keys: Keys = (),
    revenue_sqft: bool = False,
) -> DataFrame:
    """Occupancy per building for every month that has both a ledger row and a roster."""
    grain = [*keys, "as_of_month"]
    area = F.col("sqft")
    occupied = ~F.col("is_vacant")
    split = (
        lease.where(F.col("building").isin(V.BUILDINGS))
        .groupBy(*grain, "building")
        .agg(
            F.sum(area).alias("total_sqft"),
            _sum_where(occupied, area).alias("occupied_sqft"),
            _sum_where(_earning() if exclude_own_use else occupied, area).alias("effective_occupied_sqft"),
            _sum_where(F.col("is_vacant"), area).alias("vacant_sqft"),
            _sum_where(F.col("is_own_use"), area).alias("own_use_sqft"),
            F.count(F.lit(1)).alias("suite_count"),
            F.count_if("is_vacant").alias("vacant_count"),
            F.count_if("is_own_use").alias("own_use_count"),
            _sum_where(_earning(), area).alias("revenue_sqft"),
        )
    )
    return (
        ledger.select(*grain, "month")
        .join(split, grain)
        .select(
            *grain,
            "month",
            "building",
            "total_sqft",
            "occupied_sqft",
            "effective_occupied_sqft",
            "vacant_sqft",
            "own_use_sqft",
            percentage(F.col("occupied_sqft"), F.col("total_sqft")).alias("occupancy_pct"),
            percentage(F.col("effective_occupied_sqft"), F.col("total_sqft")).alias("occupancy_pct_excl_own_use"),
            "suite_count",
            "vacant_count",
            "own_use_count",
            *(["revenue_sqft"] if revenue_sqft else []),
        )
    )


def noi(rent: DataFrame, expense: DataFrame, keys: Keys = ()) -> DataFrame:
    """Net operating income: collected rent less fixed and variable expenses of the same month."""
    grain = [*keys, "as_of_month", "month"]
    zero = money(F.lit(0))
    spent = (
        expense.groupBy(*grain)
        .pivot("expense_category", V.EXPENSE_CATEGORIES)
        .agg(F.sum("total_actual"))
        .select(*grain, *[F.coalesce(money(F.col(c)), zero).alias(f"{c}_expenses") for c in V.EXPENSE_CATEGORIES])
    )
    joined = rent.select(*grain, "collected").join(spent, grain, "left")
    for category in V.EXPENSE_CATEGORIES:
        joined = joined.withColumn(f"{category}_expenses", F.coalesce(f"{category}_expenses", zero))
    operating = F.col("fixed_expenses") + F.col("variable_expenses")
    return joined.select(
        *grain,
        "collected",
        "fixed_expenses",
        "variable_expenses",
        "other_expenses",
        operating.alias("total_expenses"),
        (F.col("collected") - operating).alias("noi"),
        percentage(F.col("collected") - operating, F.col("collected")).alias("noi_margin_pct"),
    )
