"""Chosen models against plain loops."""

import math
import random
from datetime import date

import pytest

from leasemill.functions import vocabulary as V
from leasemill.operators import smoothing as S


def months(n):
    return [date(2015 + m // 12, m % 12 + 1, 1) for m in range(n)]


def brute(y):
    """(model, rmse, p50 per horizon, half band per horizon) of the best candidate."""
    n = len(y)
    tested = min(S.TESTED, n - 2)
    fits = []
    for i, (alpha, beta, phi) in enumerate(S.GRID):
        level, trend, sse = y[0], 0.0, 0.0
        for t in range(1, n):
            guess = level + phi * trend
            miss = y[t] - guess
            level, trend = guess + alpha * miss, phi * trend + alpha * beta * miss
            sse += miss * miss if t + 1 > n - tested else 0.0
        fits.append((sse / tested, i, alpha, beta, phi, level, trend))
    if n >= V.SEASONAL_FROM:
        fits.append((sum((y[t] - y[t - 12]) ** 2 for t in range(n - tested, n)) / tested, len(S.GRID), 0, 0, 0, 0, 0))
    mse, i, alpha, beta, phi, level, trend = min(fits)
    out = []
    for h in range(1, 13):
        if i == len(S.GRID):
            out.append((y[n - 12 + h - 1], V.Z80 * math.sqrt(mse)))
            continue
        reach = [sum(phi**k for k in range(1, j + 1)) for j in range(h + 1)]
        factor = 1 + sum((alpha + alpha * beta * reach[j]) ** 2 for j in range(1, h))
        out.append((level + reach[h] * trend, V.Z80 * math.sqrt(mse * factor)))
    name = "seasonal" if i == len(S.GRID) else "level" if beta == 0 else "damped" if phi < 1 else "trend"
    return name, math.sqrt(mse), out


def test_equals_loops(spark):
    rng = random.Random(2)
    shapes = {
        "flat": lambda t: 100 + rng.random(),
        "rising": lambda t: 50 + 3 * t + rng.random(),
        "yearly": lambda t: 200 + 80 * math.sin(2 * math.pi * t / 12) + rng.random(),
        "walk": lambda t: 10 * t % 37,
        "constant": lambda t: 5.0,
    }
    series = {(name, n): [float(f(t)) for t in range(n)] for name, f in shapes.items() for n in (3, 4, 13, 23, 24, 60)}
    rows = [(f"{name}{n}", "collected", m, v) for (name, n), y in series.items() for m, v in zip(months(n), y)]
    # Too short, without a value in between, and empty.
    rows += [("two", "collected", m, 1.0) for m in months(2)] + [("gap13", "collected", m, None if i == 3 else 1.0) for i, m in enumerate(months(13))]
    df = spark.createDataFrame(rows, "property_id string, metric string, month date, y double").repartition(3)
    got = {}
    for r in S.forecast(df, ["property_id"]).collect():
        got.setdefault(r["property_id"], {})[r["horizon"]] = r
    assert set(got) == {f"{name}{n}" for name, n in series} | {"gap13"}
    models = set()
    for (name, n), y in series.items():
        model, rmse, steps = brute(y)
        models.add(model)
        mine = got[f"{name}{n}"]
        assert len(mine) == 12 and mine[1]["model"] == model and mine[1]["n_points"] == n
        assert mine[1]["tested_rmse"] == pytest.approx(rmse)
        for h, (mid, half) in enumerate(steps, 1):
            assert (mine[h]["p50"], mine[h]["p10"], mine[h]["p90"]) == pytest.approx((mid, mid - half, mid + half))
    assert {"seasonal", "level", "trend"} <= models
    assert got["flat60"][1]["forecast_month"] == date(2020, 1, 1) and got["gap13"][12]["p50"] == 1.0


def test_no_python_and_one_shuffle(spark):
    df = spark.createDataFrame([], "metric string, month date, y double")
    plan = S.forecast(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert S.forecast(df).count() == 0
