"""Twelve-month forecasts with P10/P50/P90 for any number of series in one job.

Two closed-form models replace an iterative fit. A short series (fewer than 24 points) is a first-order
autoregression around its mean; a longer one repeats its last twelve points plus the average change over a year.
Both need only lagged sums, so every series costs one window and one grouped aggregation. Values are held as
integer units (cents, or millionths of a percent), which makes the sums exact in any order.

A series holds at most one point per calendar month, so a window group is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leasemill.functions import vocabulary as V

Keys = Sequence[str]

# Units per whole value; money is counted in cents.
UNITS = {"occupancy_pct": 1_000_000}
MONEY_UNITS = 100

_EXACT = "decimal(38,0)"


def long_series(
    kpi: DataFrame,
    keys: Keys = (),
    exclude_own_use: bool = False,
    metrics: Sequence[str] = V.FORECAST_METRICS,
) -> DataFrame:
    """Unpivot the metrics to (keys, metric, month, y), newest snapshot per month; null values stay as rows."""
    source = {"occupancy_pct": "occupancy_pct_excl_own_use"} if exclude_own_use else {}
    pairs = ", ".join(f"'{m}', cast({source.get(m, m)} AS double)" for m in metrics)
    unfolded = kpi.select(
        *keys,
        F.to_date("month").alias("month"),
        "as_of_month",
        F.expr(f"stack({len(metrics)}, {pairs}) AS (metric, y)"),
    ).where(F.col("month").isNotNull())
    return unfolded.groupBy(*keys, "metric", "month").agg(F.max_by("y", "as_of_month").alias("y"))


def usable(series: DataFrame, keys: Keys = (), min_points: int = V.MIN_POINTS) -> DataFrame:
    """Points with a value, of series with enough of them."""
    whole = Window.partitionBy(*keys, "metric")
    return (
        series.where(F.col("y").isNotNull())
        .withColumn("n", F.count(F.lit(1)).over(whole))
        .where(F.col("n") >= min_points)
    )


def model_choice(series: DataFrame, keys: Keys = ()) -> DataFrame:
    """Points per series and the model they allow."""
    counts = series.where(F.col("y").isNotNull()).groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= V.MIN_POINTS).withColumn("model", _model())


def _model() -> Column:
    return F.when(F.col("n") >= V.SEASONAL_FROM, "seasonal").otherwise("autoregressive")


def _scale(units: Mapping[str, int]) -> Column:
    chain = F.lit(MONEY_UNITS)
    for metric, factor in units.items():
        chain = F.when(F.col("metric") == metric, factor).otherwise(chain)
    return chain.cast("double")


def _double(column: str) -> Column:
    return F.col(column).cast("double")


def fit(series: DataFrame, keys: Keys = (), units: Mapping[str, int] = UNITS) -> DataFrame:
    """One row per series with the exact sums both models need."""
    grain = [*keys, "metric"]
    whole = Window.partitionBy(*grain)
    ordered = whole.orderBy("month")
    points = (
        usable(series, keys)
        .withColumn("scale", _scale(units))
        .withColumn("u", F.round(F.col("y") * F.col("scale")).cast(_EXACT))
        .withColumns(
            {
                "total": F.sum("u").over(whole),
                "position": F.row_number().over(ordered),
                "change": (F.col("u") - F.lag("u", V.SEASON).over(ordered)).cast(_EXACT),
            }
        )
        # n times the distance from the mean, still an integer.
        .withColumn("v", (F.col("u") * F.col("n") - F.col("total")).cast(_EXACT))
        .withColumn("v1", F.lag("v").over(ordered))
        .withColumn("short", F.col("n") < V.SEASONAL_FROM)
    )

    def exact_sum(value: Column) -> Column:
        return F.sum(value.cast(_EXACT)).cast(_EXACT)

    def if_short(value: Column) -> Column:
        return F.when(F.col("short"), value)

    slot = F.col("position") - F.col("n") + V.SEASON
    return (
        points.groupBy(*grain)
        .agg(
            F.first("n").alias("n"),
            F.first("scale").alias("scale"),
            F.first("total").alias("total"),
            F.max("month").alias("last_month"),
            F.max_by("v", "month").alias("v_last"),
            exact_sum(if_short(F.col("v") * F.col("v1"))).alias("cross"),
            exact_sum(if_short(F.col("v1") * F.col("v1"))).alias("before"),
            exact_sum(if_short(F.when(F.col("v1").isNotNull(), F.col("v") * F.col("v")))).alias("after"),
            exact_sum(F.col("change")).alias("change_sum"),
            exact_sum(F.col("change") * F.col("change")).alias("change_sq"),
            F.count("change").alias("m"),
            # The last twelve points only.
            F.map_from_entries(
                F.collect_list(F.when(slot >= 1, F.struct(slot.alias("slot"), _double("u").alias("u"))))
            ).alias("season"),
        )
        .withColumn("model", _model())
    )


def project(fitted: DataFrame, keys: Keys = (), horizons: int = V.FORECAST_HORIZON) -> DataFrame:
    """Unfold each fitted series to its horizons with P10, P50 and P90."""
    steps = fitted.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizons))))
    n, h = _double("n"), _double("horizon")

    phi = F.when(F.col("before") > 0, _double("cross") / _double("before")).otherwise(F.lit(0.0))
    squares = _double("after") - F.lit(2.0) * F.col("phi") * _double("cross") + F.col("phi") * F.col("phi") * _double(
        "before"
    )
    noise = F.greatest(squares, F.lit(0.0)) / (n * n) / (n - F.lit(2.0))
    ar_mid = _double("total") / n + F.pow(F.col("phi"), h) * (_double("v_last") / n)
    growth = F.when(
        F.abs(F.col("phi")) < 1,
        (F.lit(1.0) - F.pow(F.col("phi"), F.lit(2.0) * h)) / (F.lit(1.0) - F.col("phi") * F.col("phi")),
    ).otherwise(h)

    drift = _double("change_sum") / _double("m")
    spread = (F.col("change_sq") * F.col("m") - F.col("change_sum") * F.col("change_sum")).cast(_EXACT).cast("double")
    season_slot = F.pmod(F.col("horizon") - 1, F.lit(V.SEASON)) + 1
    lap = F.floor((F.col("horizon") - 1) / V.SEASON) + 1
    seasonal_mid = F.col("season")[season_slot] + drift * lap
    seasonal_sigma = F.sqrt(F.greatest(spread, F.lit(0.0)) / (_double("m") * (_double("m") - F.lit(1.0))))

    seasonal = F.col("model") == "seasonal"
    banded = (
        steps.withColumn("phi", phi)
        .withColumn("noise", noise)
        .withColumn("mid", F.when(seasonal, seasonal_mid).otherwise(ar_mid))
        .withColumn("sigma", F.when(seasonal, seasonal_sigma).otherwise(F.sqrt(F.col("noise") * growth)))
    )
    half = F.lit(V.Z80) * F.col("sigma")
    return banded.select(
        *keys,
        "metric",
        "horizon",
        F.add_months("last_month", F.col("horizon")).alias("forecast_month"),
        "model",
        F.col("n").alias("n_points"),
        ((F.col("mid") - half) / F.col("scale")).alias("p10"),
        (F.col("mid") / F.col("scale")).alias("p50"),
        ((F.col("mid") + half) / F.col("scale")).alias("p90"),
    )


def forecast(
    series: DataFrame,
    keys: Keys = (),
    horizons: int = V.FORECAST_HORIZON,
    units: Mapping[str, int] = UNITS,
    label_after_last_row: bool = False,
) -> DataFrame:
    """Fit and project every series.

    Labels count on from the last month with a value; ``label_after_last_row`` counts on from the last month of
    the series even where its value is null.
    """
    fitted = fit(series, keys, units)
    if label_after_last_row:
        ends = series.groupBy(*keys, "metric").agg(F.max("month").alias("end_month"))
        fitted = (
            fitted.join(ends, [*keys, "metric"]).withColumn("last_month", F.col("end_month")).drop("end_month")
        )
    return project(fitted, keys, horizons)


def at_horizons(forecasts: DataFrame, horizons: Sequence[int] = V.WINDOW_SIZES) -> DataFrame:
    return forecasts.where(F.col("horizon").isin(*horizons))


def wide(forecasts: DataFrame, keys: Keys = (), metrics: Sequence[str] = V.FORECAST_METRICS) -> DataFrame:
    """One row per forecast month with metric x {p10, p50, p90} columns."""
    return (
        forecasts.groupBy(*keys, F.date_format("forecast_month", "yyyy-MM").alias("forecast_month"), "horizon")
        .agg(
            *[
                F.max(F.when(F.col("metric") == m, F.col(p))).alias(f"{m}_{p}")
                for m in metrics
                for p in ("p10", "p50", "p90")
            ]
        )
    )


def backtest(series: DataFrame, keys: Keys = (), held_out: int = 3, units: Mapping[str, int] = UNITS) -> DataFrame:
    """Hold back the last months of every series, forecast them and report MAE and RMSE."""
    grain = [*keys, "metric"]
    from_end = F.row_number().over(Window.partitionBy(*grain).orderBy(F.desc("month")))
    marked = series.where(F.col("y").isNotNull()).withColumn("from_end", from_end)
    guesses = forecast(marked.where(F.col("from_end") > held_out).select(*grain, "month", "y"), keys, units=units)
    actual = marked.where(F.col("from_end") <= held_out).select(*grain, F.col("month").alias("forecast_month"), "y")
    miss = F.col("p50") - F.col("y")
    return (
        guesses.join(actual, [*grain, "forecast_month"])
        .groupBy(*grain)
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.avg(F.abs(miss)).alias("mae"),
            F.sqrt(F.avg(miss * miss)).alias("rmse"),
        )
    )
