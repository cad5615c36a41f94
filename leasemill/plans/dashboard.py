"""Data sets behind the dashboard views (data only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasemill import schemas
from leasemill.functions import vocabulary as V
from leasemill.functions.expressions import percentage, suite_status
from leasemill.operators.windows import last_row_per, latest, top_by, window_filter

Keys = Sequence[str]

_SERIES = [
    "as_of_month", "month", "rent_base", "collected", "uncollected", "leased_sqft", "price_per_sf_yr",
    "collection_rate_pct", "occupancy_pct", "occupancy_pct_excl_own_use", "accounts_receivable", "noi_proto",
    "noi_margin_pct", "fixed_expenses", "variable_expenses", "total_expenses",
]


def _shown_occupancy(exclude_own_use: bool):
    return F.col("occupancy_pct_excl_own_use" if exclude_own_use else "occupancy_pct")


def property_series(
    prop_kpi: DataFrame, window: str | None = None, exclude_own_use: bool = False, keys: Keys = ()
) -> DataFrame:
    """KPI rows inside the window, with the occupancy the toggle selects as ``shown_occupancy_pct``."""
    rows = window_filter(prop_kpi.where(F.col("month").isNotNull()), window, keys=keys)
    return rows.select(*keys, *_SERIES, _shown_occupancy(exclude_own_use).alias("shown_occupancy_pct"))


def building_series(
    building_kpi: DataFrame, window: str | None = None, exclude_own_use: bool = False, keys: Keys = ()
) -> DataFrame:
    known = building_kpi.where(F.col("month").isNotNull() & F.col("building").isNotNull())
    rows = window_filter(known, window, keys=keys)
    return rows.withColumn("shown_occupancy_pct", _shown_occupancy(exclude_own_use))


def building_latest(building_kpi: DataFrame, exclude_own_use: bool = False, keys: Keys = ()) -> DataFrame:
    """One row (per property) with both buildings' occupancy in the newest month; 0 for a building that month lacks."""
    newest = latest(building_kpi, "month", keys)
    shown = _shown_occupancy(exclude_own_use)
    return newest.groupBy(*keys, "month").agg(
        *[
            F.coalesce(F.max(F.when(F.col("building") == b, shown)), F.lit(0.0)).alias(f"building_{b.lower()}_pct")
            for b in V.BUILDINGS
        ]
    )


def building_last_rows(building_kpi: DataFrame, keys: Keys = ()) -> DataFrame:
    """Newest row of every building, whichever month that is."""
    return last_row_per(building_kpi, [*keys, "building"], ["month", "as_of_month"])


def window_listing(kpi_windows: DataFrame) -> DataFrame:
    return kpi_windows.orderBy(F.desc("end_month"), "window_size")


def expense_stack(expense: DataFrame, keys: Keys = ()) -> DataFrame:
    """Expense per month with one column per category; 0 where a category has no rows."""
    grain = [*keys, "as_of_month", "month"]
    return (
        expense.groupBy(*grain)
        .pivot("expense_category", V.EXPENSE_CATEGORIES)
        .agg(F.sum("total_actual"))
        .na.fill(0, V.EXPENSE_CATEGORIES)
    )


def expense_against_budget(expense: DataFrame, budget: DataFrame) -> DataFrame:
    """Actual against an optional budget table (as_of_month, expense_category, total_budget)."""
    actual = expense.groupBy("as_of_month", "expense_category").agg(F.sum("total_actual").alias("total_actual"))
    return actual.join(budget, ["as_of_month", "expense_category"], "left").select(
        "as_of_month",
        "expense_category",
        "total_actual",
        "total_budget",
        (F.col("total_actual") - F.col("total_budget")).alias("total_variance"),
        percentage(F.col("total_actual"), F.col("total_budget")).alias("budget_adherence_pct"),
    )


def suite_details(lease: DataFrame, months: DataFrame | None = None, keys: Keys = ()) -> DataFrame:
    return latest(lease, keys=keys, months=months).select(
        *keys, "suite_id", "building", "tenant", "sqft", "rent_monthly", "rent_annual", "rent_psf_yr",
        "is_vacant", "is_own_use", suite_status().alias("status"),
    )


def summary_cards(
    prop_kpi: DataFrame,
    lease: DataFrame,
    total_sqft: int = V.TOTAL_SQFT,
    exclude_own_use: bool = False,
    months: DataFrame | None = None,
    keys: Keys = (),
) -> DataFrame:
    """One card row: newest KPIs with collections, suite counts of the newest snapshot, zeros where empty.

    Both halves are global aggregates, so the row exists even when a source is empty. They are stacked and folded
    into one row rather than joined. With ``keys`` there is such a row for every property that has either.
    """
    known = prop_kpi.where(F.col("month").isNotNull() & F.col("collected").isNotNull())
    newest = top_by(known, 1, F.desc("month"), F.desc("as_of_month"), keys=keys)
    figures = {
        "occupancy": _shown_occupancy(exclude_own_use),
        "monthly_revenue": F.col("collected").cast("double"),
        "price_per_sf": F.col("price_per_sf_yr").cast("double"),
        "collection_rate": F.col("collection_rate_pct"),
        "noi_proto": F.col("noi_proto").cast("double"),
        "noi_margin_pct": F.col("noi_margin_pct").cast("double"),
        "leased_sqft": F.col("leased_sqft").cast("double"),
    }
    cards = newest.groupBy(*keys).agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(n) for n, c in figures.items()])
    counts = latest(lease, keys=keys, months=months).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_suites"),
        F.count_if("is_vacant").alias("vacant_suites"),
        F.count_if("is_own_use").alias("own_use_suites"),
    )
    both = cards.unionByName(counts, allowMissingColumns=True)
    shown = [c for c in both.columns if c not in keys]
    folded = both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in shown])
    return folded.na.fill(0, shown).withColumn("total_sqft", F.lit(total_sqft).cast("bigint"))


def portfolio_totals(building_kpi: DataFrame, rent: DataFrame, keys: Keys = ()) -> DataFrame:
    """Buildings, suites, occupied suites, share occupied and collected revenue of the newest months; the newest snapshot of them counts.

    Every property counts with its own newest month, so one that reports late is not lost; ``month`` is the newest of all. One row
    for the whole portfolio, or with ``keys`` one per property. Suites are summed per property and month before rent is
    joined, so neither side multiplies the other.
    """
    own = [c for c in (schemas.PROPERTY,) if c in building_kpi.columns]
    newest = latest(latest(building_kpi, "month", own), "as_of_month", own)
    grain = [*own, "as_of_month", "month"]
    suites = newest.groupBy(*grain).agg(
        F.countDistinct("building").alias("buildings"), F.sum("suite_count").alias("suites"), F.sum("vacant_count").alias("vacant"))
    totals = suites.join(rent.select(*grain, "collected"), grain).groupBy(*keys).agg(
        F.max("month").alias("month"),
        F.sum("buildings").alias("buildings"),
        F.sum("suites").alias("total_suites"),
        (F.sum("suites") - F.sum("vacant")).alias("occupied_suites"),
        F.sum("collected").alias("total_revenue"),
    )
    return totals.where(F.col("month").isNotNull()).withColumn(
        "avg_occupancy_pct", percentage(F.col("occupied_suites"), F.col("total_suites")))


def last_points(prop_kpi: DataFrame, n: int = 12) -> DataFrame:
    """The newest n rows of the revenue series."""
    newest = top_by(prop_kpi, n, F.desc("month"), F.desc("as_of_month"))
    return newest.select("month", "collected", "occupancy_pct", "price_per_sf_yr")


def history_and_forecast(prop_kpi: DataFrame, forecast: DataFrame, keys: Keys = ()) -> DataFrame:
    """History rows followed by the forecast rows with their band, one row per month and metric."""
    history = prop_kpi.select(*keys, "month", F.expr(_stack(V.FORECAST_METRICS))).where(F.col("value").isNotNull())
    return (
        history.withColumn("part", F.lit("history"))
        .unionByName(
            forecast.select(
                *keys,
                F.col("forecast_month").alias("month"),
                "metric",
                F.col("p50").alias("value"),
                F.col("p10"),
                F.col("p90"),
                F.lit("forecast").alias("part"),
            ),
            allowMissingColumns=True,
        )
        .select(*keys, "month", "metric", "part", "value", "p10", "p90")
    )


def _stack(metrics: Sequence[str]) -> str:
    pairs = ", ".join(f"'{m}', cast({m} AS double)" for m in metrics)
    return f"stack({len(metrics)}, {pairs}) AS (metric, value)"


def against_target(prop_kpi: DataFrame) -> DataFrame:
    """Distance of occupancy and collection rate from their targets."""
    occupancy = F.col("occupancy_pct") - F.lit(V.OCCUPANCY_TARGET)
    collection = F.col("collection_rate_pct") - F.lit(V.COLLECTION_TARGET)
    return prop_kpi.select(
        "as_of_month",
        "month",
        "occupancy_pct",
        F.lit(V.OCCUPANCY_TARGET).alias("occupancy_target"),
        occupancy.alias("occupancy_gap"),
        (occupancy >= 0).alias("occupancy_met"),
        "collection_rate_pct",
        F.lit(V.COLLECTION_TARGET).alias("collection_target"),
        collection.alias("collection_gap"),
        (collection >= 0).alias("collection_met"),
    )
