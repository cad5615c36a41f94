"""Forecast formulas against plain Python floats."""

import math
from datetime import date

import pytest

from leasemill.functions import vocabulary as V
from leasemill.operators import forecast as fc

SCHEMA = "metric string, month date, y double"


def month(n):
    return date(2020 + n // 12, n % 12 + 1, 1)


def series(spark, values, metric="collected"):
    return spark.createDataFrame([(metric, month(i), v) for i, v in enumerate(values)], SCHEMA)


def wave(n):
    return [round(1000 + 100 * math.sin(i) + 7 * i + (i * i % 13), 2) for i in range(n)]


def autoregressive(y, h):
    n = len(y)
    mean = sum(y) / n
    z = [v - mean for v in y]
    phi = sum(a * b for a, b in zip(z[1:], z)) / sum(a * a for a in z[:-1])
    s2 = sum((a - phi * b) ** 2 for a, b in zip(z[1:], z)) / (n - 2)
    growth = (1 - phi ** (2 * h)) / (1 - phi * phi) if abs(phi) < 1 else h
    return mean + phi**h * z[-1], math.sqrt(s2 * growth)


def seasonal(y, h):
    d = [b - a for a, b in zip(y, y[12:])]
    mean = sum(d) / len(d)
    return y[len(y) - 12 + h - 1] + mean, math.sqrt(sum((v - mean) ** 2 for v in d) / (len(d) - 1))


@pytest.mark.parametrize("n, model", [(3, autoregressive), (10, autoregressive), (23, autoregressive),
                                      (24, seasonal), (40, seasonal)])
def test_formulas(spark, n, model):
    y = wave(n)
    got = {r["horizon"]: r for r in fc.forecast(series(spark, y)).collect()}
    assert sorted(got) == list(range(1, 13))
    for h, row in got.items():
        mid, sigma = model(y, h)
        assert row["model"] == ("seasonal" if n >= 24 else "autoregressive")
        assert row["p50"] == pytest.approx(mid, rel=1e-9)
        assert row["p90"] - row["p50"] == pytest.approx(V.Z80 * sigma, rel=1e-6, abs=1e-6)
        assert row["p50"] - row["p10"] == pytest.approx(row["p90"] - row["p50"])
        assert row["forecast_month"] == month(n - 1 + h)


def test_explosive_series_widens_with_the_root_of_the_horizon(spark):
    y = [1.0, 2.0, 4.0, 8.0, 160.0]
    got = {r["horizon"]: r for r in fc.forecast(series(spark, y)).collect()}
    mid, sigma = autoregressive(y, 4)
    assert got[4]["p90"] - got[4]["p50"] == pytest.approx(V.Z80 * sigma)


def test_too_short_and_constant(spark):
    assert fc.forecast(series(spark, [1.0, 2.0])).count() == 0
    assert fc.forecast(series(spark, [1.0, 2.0, None])).count() == 0
    flat = fc.forecast(series(spark, [5.0] * 6)).collect()
    assert {(r["p10"], r["p50"], r["p90"]) for r in flat} == {(5.0, 5.0, 5.0)}


def test_labels_follow_the_last_value_or_the_last_row(spark):
    df = series(spark, [*wave(5), None])
    assert fc.forecast(df).where("horizon = 1").first()["forecast_month"] == month(5)
    assert fc.forecast(df, label_after_last_row=True).where("horizon = 1").first()["forecast_month"] == month(6)


def test_wide_shape_and_horizons(spark):
    both = series(spark, wave(6)).unionByName(series(spark, [50.0, 51.5, 49.25, 60.0], "occupancy_pct"))
    wide = fc.wide(fc.at_horizons(fc.forecast(both)), metrics=["occupancy_pct", "collected"])
    assert wide.columns == ["forecast_month", "horizon", "occupancy_pct_p10", "occupancy_pct_p50", "occupancy_pct_p90",
                            "collected_p10", "collected_p50", "collected_p90"]
    # The two series end in different months, so their rows stand under their own labels.
    assert wide.count() == 8


def test_many_series_do_not_mix(spark):
    df = series(spark, wave(10), "a").unionByName(series(spark, [-v for v in wave(10)], "b"))
    got = {(r["metric"], r["horizon"]): r["p50"] for r in fc.forecast(df).collect()}
    assert all(got["a", h] == pytest.approx(-got["b", h]) for h in range(1, 13))


def test_backtest(spark):
    y = wave(30)
    row = fc.backtest(series(spark, y), held_out=3).first()
    misses = [seasonal(y[:27], h)[0] - y[26 + h] for h in (1, 2, 3)]
    assert row["mae"] == pytest.approx(sum(map(abs, misses)) / 3)
    assert row["rmse"] == pytest.approx(math.sqrt(sum(m * m for m in misses) / 3))


def test_newest_snapshot_of_a_month_counts(spark):
    schema = "as_of_month string, month date, occupancy_pct double, collected double, noi_proto double"
    kpi = spark.createDataFrame([("2020-01", month(0), 1.0, 10.0, 1.0), ("2020-02", month(0), 2.0, 20.0, None)], schema)
    got = {r["metric"]: r["y"] for r in fc.long_series(kpi).collect()}
    assert got["collected"] == 20.0 and got["occupancy_pct"] == 2.0
