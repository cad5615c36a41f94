"""Type-2 history against a month-by-month replay in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from leasemill.operators import history, incremental

SCHEMA = ("property_id string, as_of_month string, suite_id string, tenant string, rent_monthly decimal(18,2), "
          "is_vacant boolean, _file_md5 string, ingested_at timestamp")
CHECKED = ["tenant", "rent_monthly", "is_vacant"]


def replay(rows, close_missing=True):
    """Apply the snapshots one month at a time, the way an incremental run would."""
    result = set()
    for prop in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == prop]
        open_rows = {}
        for month in sorted({r[1] for r in mine}):
            seen = {r[2]: r[3:6] for r in mine if r[1] == month}
            for suite in list(open_rows):
                start, state = open_rows[suite]
                gone = close_missing and suite not in seen
                if gone or (suite in seen and seen[suite] != state):
                    result.add((prop, suite, start, month, *state))
                    del open_rows[suite]
            for suite, state in seen.items():
                open_rows.setdefault(suite, (month, state))
        result |= {(prop, suite, start, None, *state) for suite, (start, state) in open_rows.items()}
    return result


@pytest.fixture(scope="module")
def snapshots():
    from datetime import datetime
    from decimal import Decimal

    rng = random.Random(11)
    months = [f"{2020 + m // 12}-{m % 12 + 1:02d}" for m in range(18) if m != 7]
    rows = []
    for prop in "pq":
        for month in months[:: 1 if prop == "p" else 2]:
            for suite in ("1A", "2A", "3B"):
                if rng.random() < 0.8:
                    tenant = rng.choice(["x", "y", None])
                    rows.append((prop, month, suite, tenant, Decimal(rng.choice([100, 200])), tenant is None, "h",
                                 datetime(2024, 1, 1)))
    return rows


def taken(df):
    columns = ["property_id", "suite_id", "valid_from", "valid_to", *CHECKED]
    return {tuple(r) for r in df.select(*columns).collect()}


@pytest.mark.parametrize("close_missing", [True, False])
def test_equals_replay(spark, snapshots, close_missing):
    df = spark.createDataFrame(snapshots, SCHEMA)
    got = history.versions(df, keys=["property_id"], checked=CHECKED, close_missing=close_missing)
    assert taken(got) == replay(snapshots, close_missing)


def test_single_property_without_keys(spark, snapshots):
    mine = [r for r in snapshots if r[0] == "p"]
    got = history.versions(spark.createDataFrame(mine, SCHEMA), checked=CHECKED, one_row_per_month=True)
    assert taken(got) == replay(mine)


def test_one_row_per_month_comes_from_the_last_file(spark, snapshots):
    df = spark.createDataFrame(snapshots, SCHEMA)
    older = df.withColumns({"tenant": F.lit("stale"), "ingested_at": F.lit("2023-01-01").cast("timestamp")})
    got = history.versions(df.unionByName(older), keys=["property_id"], checked=CHECKED)
    assert taken(got) == replay(snapshots)


def test_one_open_row_unless_deleted(spark, snapshots):
    df = spark.createDataFrame(snapshots, SCHEMA)
    versions = history.versions(df, keys=["property_id"], checked=CHECKED)
    open_rows = versions.where("is_current").groupBy("property_id", "suite_id").count()
    assert open_rows.where("count > 1").count() == 0
    last = {p: max(r[1] for r in snapshots if r[0] == p) for p in "pq"}
    present = {(r[0], r[2]) for r in snapshots if r[1] == last[r[0]]}
    assert {(r[0], r[1]) for r in open_rows.collect()} == present


def test_deletes_are_closed_versions_without_follower(spark):
    rows = [("p", m, s, "x", None, False, "h", None)
            for m, suites in (("2020-01", "ab"), ("2020-02", "b"), ("2020-03", "ab"), ("2020-04", "a")) for s in suites]
    versions = history.versions(spark.createDataFrame(rows, SCHEMA), checked=["tenant"], one_row_per_month=True)
    got = {(r["suite_id"], r["valid_from"], r["valid_to"], r["returned_in"])
           for r in history.hard_deletes(versions).collect()}
    assert got == {("a", "2020-01", "2020-02", "2020-03"), ("b", "2020-01", "2020-04", None)}


def test_load_modes(spark, rows):
    def table(*pairs):
        return spark.createDataFrame(list(pairs), "as_of_month string, v int")

    target, source = table(("2020-01", 1), ("2020-03", 3)), table(("2020-02", 20), ("2020-03", 30), ("2020-04", 40))
    key = ["as_of_month"]
    assert rows(incremental.load(source, target, key, "new_months")) == [
        ("2020-01", 1), ("2020-03", 3), ("2020-04", 40)]
    assert rows(incremental.load(source, target, key, "touched")) == [
        ("2020-01", 1), ("2020-02", 20), ("2020-03", 30), ("2020-04", 40)]
    assert rows(incremental.load(source, target, key, "full")) == rows(source)
    assert rows(incremental.newer_months(source, target.where("false"))) == rows(source)
    with pytest.raises(ValueError):
        incremental.load(source, target, key, "other")


def test_unseen_looks_at_all_rows_and_at_the_month(spark, rows):
    schema = "file string, _file_md5 string, as_of_month string"
    arrivals = spark.createDataFrame([("b", "h1", "2020-01"), ("a", "h1", "2020-01"), ("c", "h2", "2020-01"),
                                      ("d", "h2", "2020-02")], schema)
    stored = spark.createDataFrame([("h0", "2020-01"), ("h2", "2020-01")], "_file_md5 string, as_of_month string")
    assert rows(incremental.unseen(arrivals, stored)) == [("a", "h1", "2020-01"), ("d", "h2", "2020-02")]
