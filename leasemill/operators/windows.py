"""Trailing windows, latest-month picks and month filters.

Window groups hold month-grain rows only: one row per key and month, so a group can be no longer than the calendar,
whatever the number of source rows behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leasemill.functions import vocabulary as V
from leasemill.functions.expressions import first_of_month, month_number

Keys = Sequence[str]

AVERAGES = {
    "avg_occupancy_pct": "occupancy_pct",
    "avg_collection_rate_pct": "collection_rate_pct",
    "avg_price_per_sf_yr": "price_per_sf_yr",
    "avg_noi_proto": "noi_proto",
    "avg_noi_margin_pct": "noi_margin_pct",
}
TOTALS = {"total_collected": "collected", "total_rent_base": "rent_base", "total_uncollected": "uncollected"}


def _average(column: str) -> Column:
    """Mean as double (a decimal mean would be cut at a fixed scale)."""
    return F.avg(F.col(column).cast("double"))


def trailing_kpis(kpi: DataFrame, keys: Keys = (), sizes: Sequence[int] = V.WINDOW_SIZES) -> DataFrame:
    """Averages and sums over the last n calendar months for every end month and window size.

    The axis is the snapshot month; a snapshot that repeats earlier months contributes its own month only. The
    frames run over month numbers, so a missing month shrinks the window instead of stretching it. All sizes share
    one sort; the rows are unfolded to one per size afterwards.
    """
    own = kpi.where(F.col("month") == first_of_month(F.col("as_of_month"))).withColumn(
        "month_no", month_number(F.col("month"))
    )
    ordered = Window.partitionBy(*keys).orderBy("month_no")

    def over(size: int) -> Column:
        frame = ordered.rangeBetween(-(size - 1), 0)
        return F.struct(
            F.lit(f"{size}m").alias("window_size"),
            *[_average(source).over(frame).alias(name) for name, source in AVERAGES.items()],
            *[F.sum(source).over(frame).alias(name) for name, source in TOTALS.items()],
        )

    return own.select(
        *keys, F.col("as_of_month").alias("end_month"), F.array(*[over(size) for size in sizes]).alias("w")
    ).select(*keys, "end_month", F.inline("w"))


def pair_counted_kpis(kpi: DataFrame, keys: Keys = (), sizes: Sequence[int] = V.WINDOW_SIZES) -> DataFrame:
    """The self-join reading of the windows: own-month averages, own-month sums times the rows in range.

    Each row pairs with every row whose snapshot month is in range and the pair keeps the row's own values, so the
    join reduces to a count of rows in range and needs no pairs.
    """
    per_month = (
        kpi.groupBy(*keys, "as_of_month")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            *[_average(source).alias(name) for name, source in AVERAGES.items()],
            *[F.sum(source).alias(name) for name, source in TOTALS.items()],
        )
        .withColumn("month_no", month_number(first_of_month(F.col("as_of_month"))))
    )
    ordered = Window.partitionBy(*keys).orderBy("month_no")

    def over(size: int) -> Column:
        pairs = F.sum("n_rows").over(ordered.rangeBetween(-(size - 1), 0))
        return F.struct(
            F.lit(f"{size}m").alias("window_size"),
            *[F.col(name).alias(name) for name in AVERAGES],
            *[(F.col(name) * pairs).cast("decimal(38,2)").alias(name) for name in TOTALS],
        )

    return per_month.select(
        *keys, F.col("as_of_month").alias("end_month"), F.array(*[over(size) for size in sizes]).alias("w")
    ).select(*keys, "end_month", F.inline("w"))


def _compare_with_latest(df: DataFrame, column: str, bound, keys: Keys, keep) -> DataFrame:
    """Filter by a bound taken from the largest value of ``column``.

    Without keys the bound is a scalar subquery, which reaches the scan as a literal and prunes partitions. With
    keys it is a grouped maximum joined back; the planner broadcasts it when it measures small.
    """
    if not keys:
        limit = df.agg(bound(F.max(column)).alias("bound")).scalar()
        return df.where(keep(F.col(column), limit))
    limits = df.groupBy(*keys).agg(bound(F.max(column)).alias("_bound"))
    return df.join(limits, list(keys)).where(keep(F.col(column), F.col("_bound"))).drop("_bound")


def latest(df: DataFrame, column: str = "as_of_month", keys: Keys = (), months: DataFrame | None = None) -> DataFrame:
    """Rows of the newest month. ``months`` may name a cheaper frame that has the same newest month."""
    if months is not None and not keys:
        return df.where(F.col(column) == months.agg(F.max(column)).scalar())
    return _compare_with_latest(df, column, lambda newest: newest, keys, lambda c, b: c == b)


def last_months(df: DataFrame, n: int, month: str = "month", keys: Keys = ()) -> DataFrame:
    """The newest month and the n-1 calendar months before it."""
    return _compare_with_latest(df, month, lambda newest: F.add_months(newest, -(n - 1)), keys, lambda c, b: c >= b)


def year_to_date(df: DataFrame, month: str = "month", keys: Keys = ()) -> DataFrame:
    return _compare_with_latest(df, month, lambda newest: F.trunc(newest, "year"), keys, lambda c, b: c >= b)


def window_filter(df: DataFrame, window: str | None, month: str = "month", keys: Keys = ()) -> DataFrame:
    """'3m', '6m', '9m', '12m' or 'ytd'; None keeps everything."""
    if window is None:
        return df
    if window == "ytd":
        return year_to_date(df, month, keys)
    if window in {f"{size}m" for size in V.WINDOW_SIZES}:
        return last_months(df, int(window[:-1]), month, keys)
    raise ValueError(f"no such window: {window}")


def since(df: DataFrame, run_date, months: int = 6, month: str = "month") -> DataFrame:
    """Rows whose month is at most ``months`` months before the run date."""
    return df.where(F.col(month) >= F.add_months(F.lit(run_date).cast("date"), -months))


def last_row_per(df: DataFrame, by: Keys, order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` values per group; combined before the shuffle, no sort."""
    rest = [c for c in df.columns if c not in by]
    ranked = [*order, *[c for c in rest if c not in order]]
    return (
        df.groupBy(*by)
        .agg(F.max(F.struct(*ranked)).alias("top"))
        .select(*by, *[F.col("top")[c].alias(c) for c in rest])
        .select(*df.columns)
    )


def top_by(df: DataFrame, n: int, *order: Column, keys: Keys = ()) -> DataFrame:
    """First n rows in a total order (planned as a per-partition top-n), with keys of each group, without an order among the groups."""
    if keys:
        ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        return ranked.where(F.col("_rank") <= n).drop("_rank")
    return df.orderBy(*order).limit(n)
