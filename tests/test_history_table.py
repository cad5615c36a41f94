"""The stored history, month by month in any order, against the replay of all months."""

import random
import re
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from leasemill.operators import history
from leasemill.operators.history_table import HistoryTable, merged

SCHEMA = ("property_id string, as_of_month string, suite_id string, tenant string, rent_monthly decimal(18,2), "
          "is_vacant boolean, sqft int, _file_md5 string, ingested_at timestamp")
CHECKED = ["tenant", "rent_monthly", "is_vacant"]


def snapshots(rng, months, properties="pq"):
    rows = []
    for prop in properties:
        for month in months:
            if rng.random() < 0.85:
                for suite in ("1A", "2A", "3B", "4B"):
                    if rng.random() < 0.75:
                        tenant = rng.choice(["x", "x", "y", None])
                        rows.append((prop, month, suite, tenant, Decimal(rng.choice([100, 100, 200])), tenant is None, rng.randrange(50), "h", datetime(2024, 1, 1)))
    return rows


def shown(df):
    columns = sorted(c for c in df.columns if c != "ingested_at")
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_equals_the_replay(spark, tmp_path, seed):
    rng = random.Random(seed)
    months = [f"2020-{m:02d}" for m in (1, 2, 3, 5, 6)]
    rows = snapshots(rng, months)
    table = HistoryTable(spark, str(tmp_path / "h"), keys=["property_id"], checked=CHECKED)
    have = {}
    first = rng.choice(months)
    have[first] = [r for r in rows if r[1] == first]

    def now():
        return spark.createDataFrame([r for m in have.values() for r in m], SCHEMA)

    table.rebuild(now())
    order = [m for m in months if m != first]
    rng.shuffle(order)
    # Two months are sent again with other rows, one of them without one of its properties.
    again = rng.sample(months, 2)
    for n, month in enumerate(order + again):
        if n < len(order):
            have[month] = [r for r in rows if r[1] == month]
        else:
            have[month] = [r for r in snapshots(rng, [month]) if n == len(order) or r[0] == "p"]
        table.take(month, now())
    assert shown(table.read()) == shown(history.versions(now(), keys=["property_id"], checked=CHECKED))


def test_single_property(spark, tmp_path):
    rng = random.Random(10)
    rows = snapshots(rng, ["2020-01", "2020-02", "2020-03"], "p")
    df = spark.createDataFrame(rows, SCHEMA).drop("property_id")
    assert len({r[1] for r in rows}) == 3
    table = HistoryTable(spark, str(tmp_path / "h"), checked=CHECKED)
    table.rebuild(df.where("false"))
    assert shown(table.read()) == []
    table.take("2020-03", df.where("as_of_month = '2020-03'"))
    table.take("2020-01", df.where("as_of_month <> '2020-02'"))
    table.take("2020-02", df)
    table.take("2020-02", df)
    assert shown(table.read()) == shown(history.versions(df, checked=CHECKED))


def test_a_new_month_reads_open_versions_only(spark, tmp_path):
    """Closed history is out of reach: with its files spoilt, a new month is taken up all the same."""
    df = spark.createDataFrame([("p", f"2020-{m:02d}", s, f"t{m // 3}", Decimal(1), False, 1, "h", None) for m in range(1, 10) for s in ("1A", "2B")], SCHEMA)
    table = HistoryTable(spark, str(tmp_path / "h"), keys=["property_id"], checked=CHECKED)
    table.rebuild(df.where("as_of_month < '2020-09'"))
    for part in (tmp_path / "h" / "versions").glob("closes=2020-0[36]/*.parquet"):
        part.write_bytes(b"spoilt")
    for crc in (tmp_path / "h" / "versions").glob("closes=2020-0[36]/.*.crc"):
        crc.unlink()
    table.take("2020-09", df)
    now = spark.read.parquet(*map(str, (tmp_path / "h" / "versions").glob("closes=*[n9]")))
    assert {(r["suite_id"], r["valid_from"]) for r in now.collect()} == {(s, m) for s in ("1A", "2B") for m in ("2020-06", "2020-09")}


def test_a_stopped_replacement_is_finished(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("p", m, "1A", t, Decimal(1), False, 1, "h", None) for m, t in (("2020-01", "x"), ("2020-02", "y"))], SCHEMA)
    table = HistoryTable(spark, str(tmp_path / "h"), keys=["property_id"], checked=CHECKED)
    table.rebuild(df.where("as_of_month = '2020-01'"))
    calls = []
    recover = HistoryTable._recover
    monkeypatch.setattr(HistoryTable, "_recover", lambda self: calls.append(1) or (recover(self) if len(calls) == 1 else None))
    table.take("2020-02", df)
    monkeypatch.undo()
    assert shown(table.read()) == shown(history.versions(df, keys=["property_id"], checked=CHECKED))


def test_versions_are_not_dealt_by_property(spark):
    """However large the tables are thought to be: a portfolio of five properties would put all versions into five tasks."""
    lease = spark.createDataFrame([("p", "2020-02", "1A", "x", Decimal(1), False, 1, "h", None)], SCHEMA)
    reach = lease.withColumns({"valid_from": F.lit("2020-01"), "closes": F.lit("open")})
    places = spark.createDataFrame([("p", "2020-01", None, True)], "property_id string, before string, after string, seen boolean")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = ["property_id"]
        plan = merged(reach, lease, lease.where("false"), places, "2020-02", [*keys, "suite_id"], keys, CHECKED)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.findall(r"hashpartitioning\(property_id#\d+, \d+\)", plan)
