"""Forecasts whose model is chosen per series: exponential smoothing on a parameter grid, against last year's months.

A series becomes one row with its values in order. Every candidate of the grid is folded over them: from the level and trend of the
months before, it forecasts the next one, and learns from the miss. The candidates are compared by these one-step errors over the
last ``TESTED`` origins (fewer for short series), none of which has seen what it forecasts; the smallest wins, the earlier candidate of
equals. Series of 24 points and more are compared with the value twelve months before as well. Everything is folding and
comparing within the row, so any number of series costs the one shuffle that brings their points together.

A series holds one point per calendar month, so a row is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasemill.functions import vocabulary as V
from leasemill.operators.forecast import usable

Keys = Sequence[str]

TESTED = 12
LEVELS = (0.1, 0.3, 0.5, 0.7, 0.9)
#: Share of a correction of the level that goes to the trend, and how much of the trend a month keeps. Without a trend both are 0.
TRENDS = ((0.0, 0.0), (0.1, 1.0), (0.1, 0.9), (0.3, 1.0), (0.3, 0.9))
#: (alpha, beta, phi), in the order in which ties are settled.
GRID = [(alpha, beta, phi) for beta, phi in TRENDS for alpha in LEVELS]


def _double(value: float) -> Column:
    return F.lit(float(value))


def _folded(candidate: Column, points: Column, n: Column, tested: Column) -> Column:
    """struct(level, trend, sse) after the last point; ``points`` are struct(t, y), t from 1."""
    alpha, beta, phi = candidate["alpha"], candidate["beta"], candidate["phi"]
    begin = F.struct(points[0]["y"].alias("level"), _double(0).alias("trend"), _double(0).alias("sse"))

    def step(state: Column, point: Column) -> Column:
        guess = state["level"] + phi * state["trend"]
        miss = point["y"] - guess
        return F.struct(
            (guess + alpha * miss).alias("level"),
            (phi * state["trend"] + alpha * beta * miss).alias("trend"),
            (state["sse"] + F.when(point["t"] > n - tested, miss * miss).otherwise(_double(0))).alias("sse"))

    return F.aggregate(F.slice(points, F.lit(2), n - 1), begin, step)


def selected(series: DataFrame, keys: Keys = ()) -> DataFrame:
    """One row per series: its points in order, the best candidate with its state, and the mean square of its tested errors."""
    grain = [*keys, "metric"]
    rows = usable(series, keys).groupBy(*grain).agg(
        F.array_sort(F.collect_list(F.struct("month", "y"))).alias("by_month"), F.max("month").alias("last_month"))
    rows = rows.withColumns({
        "n": F.size("by_month"),
        "points": F.transform("by_month", lambda p, i: F.struct((i + 1).alias("t"), p["y"].alias("y"))),
    })
    n, points = F.col("n"), F.col("points")
    rows = rows.withColumn("tested", F.least(F.lit(TESTED), n - 2))
    tested = F.col("tested")
    grid = F.array(*[F.struct(F.lit(i).alias("candidate"), *[_double(x).alias(name) for name, x in zip(("alpha", "beta", "phi"), c)])
                     for i, c in enumerate(GRID)])

    def fitted(c: Column) -> Column:
        state = _folded(c, points, n, tested)
        return F.struct((state["sse"] / tested).alias("mse"), c["candidate"].alias("candidate"), c["alpha"].alias("alpha"), c["beta"].alias("beta"),
                        c["phi"].alias("phi"), state["level"].alias("level"), state["trend"].alias("trend"))

    def squared(total: Column, point: Column) -> Column:
        miss = point["y"] - F.get(points, point["t"] - 1 - V.SEASON)["y"]
        return total + miss * miss

    season = F.aggregate(F.slice(points, n - tested + 1, tested), _double(0), squared) / tested
    none = [_double(0).alias(c) for c in ("alpha", "beta", "phi", "level", "trend")]
    last_year = F.struct(season.alias("mse"), F.lit(len(GRID)).alias("candidate"), *none)
    compared = F.transform(grid, fitted)
    all_fits = F.when(n >= V.SEASONAL_FROM, F.concat(compared, F.array(last_year))).otherwise(compared)
    return rows.withColumn("best", F.array_min(all_fits)).select(*grain, "n", "last_month", "points", "best.*")


def _reach(phi: Column, h: Column) -> Column:
    """phi + phi**2 + ... + phi**h."""
    begin = F.struct(_double(1).alias("power"), _double(0).alias("total"))
    steps = F.slice(F.sequence(F.lit(1), F.lit(V.FORECAST_HORIZON)), F.lit(1), h)
    return F.aggregate(steps, begin, lambda s, _: F.struct((s["power"] * phi).alias("power"), (s["total"] + s["power"] * phi).alias("total")))["total"]


def project(chosen: DataFrame, keys: Keys = (), horizons: int = V.FORECAST_HORIZON) -> DataFrame:
    """Unfold the chosen models to their horizons with P10, P50 and P90; ``horizons`` is at most ``V.FORECAST_HORIZON``."""
    steps = chosen.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizons))))
    h, phi, alpha, beta = F.col("horizon"), F.col("phi"), F.col("alpha"), F.col("beta")
    seasonal = F.col("candidate") == len(GRID)
    repeated = F.get("points", F.col("n") - V.SEASON + F.pmod(h - 1, F.lit(V.SEASON)))["y"]
    mid = F.when(seasonal, repeated).otherwise(F.col("level") + _reach(phi, h) * F.col("trend"))

    def grown(total: Column, j: Column) -> Column:
        weight = alpha + alpha * beta * _reach(phi, j)
        return total + weight * weight

    before = F.slice(F.sequence(F.lit(1), F.lit(V.FORECAST_HORIZON)), F.lit(1), h - 1)
    factor = F.when(seasonal, _double(1) + F.floor((h - 1) / V.SEASON)).otherwise(F.aggregate(before, _double(1), grown))
    half = F.lit(V.Z80) * F.sqrt(F.col("mse") * factor)
    model = F.when(seasonal, "seasonal").when(beta == 0, "level").when(phi < 1, "damped").otherwise("trend")
    banded = steps.withColumns({"mid": mid, "half": half})
    return banded.select(
        *keys, "metric", "horizon", F.add_months("last_month", h).alias("forecast_month"), model.alias("model"), F.col("n").alias("n_points"),
        F.sqrt("mse").alias("tested_rmse"), (F.col("mid") - F.col("half")).alias("p10"), F.col("mid").alias("p50"), (F.col("mid") + F.col("half")).alias("p90"))


def forecast(series: DataFrame, keys: Keys = (), horizons: int = V.FORECAST_HORIZON) -> DataFrame:
    """Choose and project every series (keys, metric, month, y); those of fewer than three points have no forecast."""
    return project(selected(series, keys), keys, horizons)
