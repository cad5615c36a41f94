"""Trailing windows against plain Python over the same rows."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from leasemill.operators import windows

COLUMNS = ["occupancy_pct", "collection_rate_pct", "price_per_sf_yr", "noi_proto", "noi_margin_pct", "collected",
           "rent_base", "uncollected"]
SCHEMA = "property_id string, as_of_month string, month date, " + ", ".join(f"{c} decimal(18,2)" for c in COLUMNS)


def month(n):
    return date(n // 12, n % 12 + 1, 1)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    rows = []
    for prop, gone in (("p", {24290, 24291}), ("q", {24300})):
        for n in range(24280, 24306):
            if n not in gone:
                values = [rng.choice([None, 1, 2, 3.5, 80, 90]) if c == "occupancy_pct" else rng.randint(1, 99)
                          for c in COLUMNS]
                rows.append((prop, month(n).strftime("%Y-%m"), month(n), *values))
                # A later snapshot that repeats the month before.
                rows.append((prop, month(n).strftime("%Y-%m"), month(n - 1), *values))
    return rows


@pytest.fixture(scope="module")
def kpi(spark, data):
    from decimal import Decimal

    rows = [r[:3] + tuple(None if v is None else Decimal(str(v)) for v in r[3:]) for r in data]
    return spark.createDataFrame(rows, SCHEMA)


def number(text):
    return int(text[:4]) * 12 + int(text[5:])


def test_windows_by_calendar_month(kpi, data):
    got = {(r["property_id"], r["end_month"], r["window_size"]): r
           for r in windows.trailing_kpis(kpi, ["property_id"]).collect()}
    own = [r for r in data if r[2].strftime("%Y-%m") == r[1]]
    assert len(got) == len(own) * 4
    for prop, end, _, *_ in own:
        for size in (3, 6, 9, 12):
            inside = [r for r in own if r[0] == prop and number(end) - size < number(r[1]) <= number(end)]
            occupancy = [r[3] for r in inside if r[3] is not None]
            row = got[prop, end, f"{size}m"]
            assert row["total_collected"] == sum(r[8] for r in inside)
            if occupancy:
                assert row["avg_occupancy_pct"] == pytest.approx(sum(occupancy) / len(occupancy))
            else:
                assert row["avg_occupancy_pct"] is None


def test_window_of_one_month_is_the_month(kpi):
    own = kpi.where("date_format(month, 'yyyy-MM') = as_of_month")
    one = windows.trailing_kpis(kpi, ["property_id"], sizes=[1])
    joined = one.join(own, (own.property_id == one.property_id) & (own.as_of_month == one.end_month))
    assert joined.count() == own.count()
    assert joined.where(F.col("total_collected") != F.col("collected")).count() == 0


def test_pair_counting_equals_the_self_join(kpi, data):
    rows = [r for r in data if r[0] == "p"]
    got = {(r["end_month"], r["window_size"]): r
           for r in windows.pair_counted_kpis(kpi.where("property_id = 'p'")).collect()}
    for end in {r[1] for r in rows}:
        for size in (3, 12):
            pairs = [p for p in rows if p[1] == end for q in rows if number(end) - size < number(q[1]) <= number(end)]
            row = got[end, f"{size}m"]
            assert row["total_collected"] == sum(p[8] for p in pairs)
            occupancy = [p[3] for p in pairs if p[3] is not None]
            assert row["avg_occupancy_pct"] == (pytest.approx(sum(occupancy) / len(occupancy)) if occupancy else None)


def test_last_rows_and_latest(kpi):
    last = windows.last_row_per(kpi, ["property_id"], ["month", "as_of_month"]).collect()
    assert {r["property_id"]: r["as_of_month"] for r in last} == {"p": "2025-06", "q": "2025-06"}
    assert windows.latest(kpi).count() == 4
    assert windows.latest(kpi, keys=["property_id"]).count() == 4
    assert windows.last_months(kpi.where("property_id = 'q'"), 3, keys=["property_id"]).count() == 5
