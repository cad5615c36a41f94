"""The named reports. Each takes model frames and returns the labelled report rows.

Where several snapshots repeat a month, a report reads the newest snapshot of the month it shows; every report
with a row limit has a total order.

With ``keys`` a report is made for each property of a portfolio: its newest months are the property's own, and the keys are its first columns.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leasemill.functions import vocabulary as V
from leasemill.functions.expressions import collection_band, md5_key, money, ratio, roster_status
from leasemill.operators.windows import Keys, latest, since, top_by

def _newest_first() -> tuple[Column, Column]:
    return F.desc("month"), F.desc("as_of_month")


def _named(df: DataFrame, labels: Mapping[str, str], keys: Keys = ()) -> DataFrame:
    return df.select(*keys, *[F.col(f"`{column}`").alias(label) for column, label in labels.items()])


def property_overview(prop_kpi: DataFrame, keys: Keys = ()) -> DataFrame:
    """KPIs of the newest month that has collections."""
    known = prop_kpi.where(F.col("month").isNotNull() & F.col("collected").isNotNull())
    return _named(
        top_by(known, 1, *_newest_first(), keys=keys),
        {
            "month": "month",
            "occupancy_pct": "Occupancy %",
            "leased_sqft": "Leased SqFt",
            "total_property_sqft": "Total SqFt",
            "collected": "Revenue Collected",
            "rent_base": "Rent Base",
            "collection_rate_pct": "Collection Rate %",
            "price_per_sf_yr": "Price $/SF/Year",
            "accounts_receivable": "AR (Uncollected)",
        },
        keys,
    )


def revenue_trends(rent: DataFrame, months: int = 6, keys: Keys = ()) -> DataFrame:
    """The newest six ledger months with the rate recomputed and rounded."""
    known = rent.where(F.col("month").isNotNull() & F.col("rent_base").isNotNull())
    recomputed = F.col("collected").cast("double") / F.nullif(F.col("rent_base").cast("double"), F.lit(0.0)) * 100
    return _named(
        top_by(known, months, *_newest_first(), keys=keys).withColumn("calc", F.round(recomputed, 2)),
        {
            "month": "month",
            "rent_base": "Rent Base",
            "collected": "Collected",
            "uncollected": "Uncollected",
            "collection_rate_pct": "Collection %",
            "calc": "Collection Rate (Calc)",
        },
        keys,
    )


def building_comparison(building_kpi: DataFrame, keys: Keys = ()) -> DataFrame:
    """Newest month, one row per building (needs the revenue area)."""
    newest = latest(building_kpi.where(F.col("month").isNotNull()), "month", keys).withColumn(
        "occupancy_pct", F.round("occupancy_pct", 2)
    )
    return _named(
        newest,
        {
            "building": "building",
            "total_sqft": "Total SqFt",
            "occupied_sqft": "Occupied SqFt",
            "occupancy_pct": "Occupancy %",
            "suite_count": "Total Suites",
            "vacant_count": "Vacant Suites",
            "own_use_count": "Own-Use Suites",
            "revenue_sqft": "Revenue SqFt",
        },
        keys,
    ).orderBy(*keys, "building")


def vacant_suites(lease: DataFrame, months: DataFrame | None = None, keys: Keys = ()) -> DataFrame:
    """Vacant suites of the newest snapshot next to their building's average rent per area and year.

    The average covers all suites of the building with a known rate. Building is one of two letters, so the averages of one property
    are a handful of rows and are broadcast: a join by shuffle would put half of the suites in one task. Those of a portfolio are
    joined by property and building as the planner measures them.
    """
    newest = latest(lease, keys=keys, months=months)
    # Rates are decimals: their sum is exact in any order.
    rate = F.col("rent_psf_yr")
    mean = newest.groupBy(*keys, "building").agg(F.try_divide(F.sum(rate).cast("double"), F.count(rate).cast("double")).alias("mean_rate"))
    return _named(
        newest.where("is_vacant")
        .join(mean if keys else F.broadcast(mean), [*keys, "building"], "left")
        .withColumn("mean_rate", F.coalesce("mean_rate", F.lit(0.0))),
        {"suite_id": "Suite", "building": "Building", "sqft": "SqFt", "mean_rate": "Avg $/SF/Yr (Building)"},
        keys,
    ).orderBy(*keys, "Building", "Suite")


def all_suites(dim_suite: DataFrame, keys: Keys = ()) -> DataFrame:
    return _named(dim_suite, {"suite_id": "Suite", "building": "Building", "sqft": "SqFt"}, keys).orderBy(
        *keys, F.asc_nulls_last("Building"), "Suite", "SqFt"
    )


def tenant_roster(dim_tenant: DataFrame, keys: Keys = ()) -> DataFrame:
    """Rows per tenant and own-use flag, leased tenants first."""
    return (
        dim_tenant.groupBy(*keys, F.col("tenant_name").alias("Tenant"), "is_own_use")
        .agg(F.count(F.lit(1)).alias("# Suites"))
        .select(*keys, "Tenant", roster_status().alias("Status"), "# Suites")
        .orderBy(*keys, F.when(F.col("Status") == "Own-Use", 1).otherwise(0), F.asc_nulls_last("Tenant"))
    )


def occupancy_history(prop_kpi: DataFrame, keys: Keys = ()) -> DataFrame:
    rounded = prop_kpi.where(F.col("month").isNotNull() & F.col("occupancy_pct").isNotNull()).withColumns(
        {"occupancy_pct": F.round("occupancy_pct", 2), "price": F.round("price_per_sf_yr", 2)}
    )
    return _named(
        rounded.orderBy(*keys, *_newest_first()),
        {
            "month": "month",
            "occupancy_pct": "Occupancy %",
            "leased_sqft": "Leased SqFt",
            "total_property_sqft": "Total SqFt",
            "price": "Avg $/SF/Year",
        },
        keys,
    )


def revenue_by_building(rent: DataFrame, prop_kpi: DataFrame, building_kpi: DataFrame, keys: Keys = ()) -> DataFrame:
    """Collections of the newest month split over the buildings by revenue area."""
    grain = [*keys, "as_of_month", "month"]
    newest = latest(building_kpi, "month", keys).select(*grain, "building", "occupied_sqft", "revenue_sqft")
    whole = prop_kpi.select(*grain, F.col("revenue_sqft").alias("property_revenue_sqft"))
    paid = rent.where(F.col("collected").isNotNull()).select(*grain, "collected")
    share = ratio(F.col("revenue_sqft"), F.col("property_revenue_sqft"))
    estimate = F.col("collected").cast("double") * share
    return (
        newest.join(paid, grain)
        .join(whole, grain)
        .select(
            *keys,
            F.col("building").alias("Building"),
            F.col("occupied_sqft").alias("Occupied SqFt"),
            F.round(estimate, 2).alias("Est. Revenue"),
            F.round(F.try_divide(estimate, F.col("occupied_sqft").cast("double")), 2).alias("Revenue per SqFt"),
        )
        .orderBy(*keys, "Building")
    )


def kpi_summary(prop_kpi: DataFrame, building_kpi: DataFrame, keys: Keys = ()) -> DataFrame:
    """One row: newest month's KPIs with the occupied area of each building and the suite counts."""
    grain = [*keys, "as_of_month", "month"]

    def occupied(building: str):
        return F.max(F.when(F.col("building") == building, F.col("occupied_sqft")))

    split = building_kpi.groupBy(*grain).agg(
        occupied("A").alias("a_sqft"),
        occupied("B").alias("b_sqft"),
        F.sum("suite_count").alias("suites"),
        F.sum("vacant_count").alias("vacant"),
    )
    known = prop_kpi.where(F.col("month").isNotNull() & F.col("collected").isNotNull())
    newest = top_by(known, 1, *_newest_first(), keys=keys).withColumns(
        {
            "occupancy_pct": F.round("occupancy_pct", 1),
            "collection_rate_pct": F.round("collection_rate_pct", 1),
            "price": F.round("price_per_sf_yr", 2),
        }
    )
    return _named(
        newest.join(split, grain, "left"),
        {
            "month": "Report Month",
            "occupancy_pct": "Occupancy %",
            "leased_sqft": "Leased SqFt",
            "total_property_sqft": "Total SqFt",
            "collected": "Revenue Collected",
            "rent_base": "Rent Base",
            "collection_rate_pct": "Collection Rate %",
            "accounts_receivable": "AR",
            "price": "Avg $/SF/Year",
            "a_sqft": "Building A SqFt",
            "b_sqft": "Building B SqFt",
            "suites": "Total Suites",
            "vacant": "Vacant Suites",
        },
        keys,
    )


def collection_analysis(rent: DataFrame, keys: Keys = ()) -> DataFrame:
    known = rent.where(F.col("month").isNotNull() & F.col("rent_base").isNotNull()).withColumns(
        {"rate": F.round("collection_rate_pct", 1), "band": collection_band(F.col("collection_rate_pct"))}
    )
    return _named(
        known.orderBy(*keys, *_newest_first()),
        {
            "month": "month",
            "rent_base": "Rent Base",
            "collected": "Collected",
            "uncollected": "Uncollected",
            "rate": "Collection %",
            "band": "Status",
        },
        keys,
    )


def high_value_suites(dim_suite: DataFrame, above_sqft: int = V.LARGE_SUITE_SQFT, keys: Keys = ()) -> DataFrame:
    potential = (F.col("sqft") * money(F.lit(V.WHAT_IF_RENT_PER_SQFT))).alias("Potential Annual Revenue @ $30/SF")
    return (
        dim_suite.where(F.col("sqft") > above_sqft)
        .select(*keys, "suite_id", "building", "sqft", potential)
        .orderBy(*keys, F.desc("sqft"), "suite_id")
    )


def size_by_building(dim_suite: DataFrame, keys: Keys = ()) -> DataFrame:
    return (
        dim_suite.groupBy(*keys, "building")
        .agg(
            F.count(F.lit(1)).alias("Suite Count"),
            F.round(F.avg(F.col("sqft").cast("double")), 0).alias("Avg SqFt"),
            F.sum("sqft").alias("Total SqFt"),
        )
        .orderBy(*keys, F.asc_nulls_last("building"))
    )


def year_month_averages(prop_kpi: DataFrame, keys: Keys = ()) -> DataFrame:
    return (
        prop_kpi.where(F.col("month").isNotNull())
        .groupBy(*keys, F.year("month").alias("year"), F.month("month").alias("month_num"))
        .agg(
            F.round(F.avg("occupancy_pct"), 2).alias("Avg Occupancy %"),
            F.round(F.avg(F.col("price_per_sf_yr").cast("double")), 2).alias("Avg $/SF/Year"),
        )
        .orderBy(*keys, F.desc("year"), F.desc("month_num"))
    )


# --- query patterns of the schema guide ---------------------------------------------------------------------


def latest_kpis(prop_kpi: DataFrame, keys: Keys = ()) -> DataFrame:
    return latest(prop_kpi, "month", keys)


def recent_occupancy(prop_kpi: DataFrame, run_date, keys: Keys = ()) -> DataFrame:
    return since(prop_kpi, run_date).select(*keys, "month", "occupancy_pct").orderBy(*keys, "month")


def latest_buildings(building_kpi: DataFrame, keys: Keys = ()) -> DataFrame:
    return latest(building_kpi, "month", keys).select(*keys, "building", "occupied_sqft", "occupancy_pct")


def tenant_suite_count(dim_tenant: DataFrame, lease: DataFrame, keys: Keys = ()) -> DataFrame:
    """Distinct suites per tenant over the hash-key join.

    Suites are counted per tenant first, so the join has one row per tenant on either side and no key is hot.
    """
    counts = lease.select(*keys, "tenant", "suite_id").distinct().groupBy(*keys, "tenant").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(*keys, md5_key(F.col("tenant")).alias("tenant_id"), "n")
    tenants = dim_tenant.select(*keys, "tenant_id", "tenant_name").distinct()
    return counts.join(tenants, [*keys, "tenant_id"]).groupBy(*keys, "tenant_name").agg(F.sum("n").alias("suite_count"))


def parameterised(spark: SparkSession, text: str, params: Mapping[str, Any], **frames: DataFrame) -> DataFrame:
    """Run report text whose ``${name}`` places are bound as named parameters, never spliced into the text.

    Frames are referred to as ``{frame_name}``.
    """
    marked = re.sub(r"\$\{(\w+)\}", r":\1", text)
    return spark.sql(marked, args=dict(params), **frames)
