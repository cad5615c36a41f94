from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from leasemill import schemas
from leasemill.operators import quality as Q
from leasemill.sources import sinks


def lease(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.RAW_LEASE)


GOOD = ("2025-01", "1A", "A", "Acme", 10.0, 1.0, 12.0, 1.2, False, False, "h", "t")
BAD = ("2025-02", "2C", "C", None, -1.0, None, 12.0, 1.2, None, False, "h", "t")


def test_every_failure_is_reported(spark):
    rules = Q.bronze_rules(schemas.LEASE_TABLE)
    cases = Q.failure_cases(lease(spark, GOOD, BAD), schemas.LEASE_TABLE, rules, ["as_of_month", "suite_id"])
    got = {(r["row_key"], r["column"], r["check"], r["failure_case"]) for r in cases.collect()}
    assert got == {
        ("2025-02|2C", "building", "accepted_values", "C"),
        ("2025-02|2C", "tenant", "not_null", None),
        ("2025-02|2C", "sqft", "at_least_0", "-1.0"),
        ("2025-02|2C", "is_vacant", "not_null", None),
    }


def test_nulls_pass_where_allowed(spark):
    row = ("2025-01", "77", None, "Acme", None, None, None, None, False, False, "h", "t")
    assert Q.failure_cases(lease(spark, row), "t", Q.bronze_rules(schemas.LEASE_TABLE), ["suite_id"]).count() == 0


def test_uncollected_may_be_negative_in_the_bronze_rules_only(spark):
    row = [("2025-01", date(2025, 1, 1), 100.0, 120.0, -20.0, 1.0, 1.0, "h", "t")]
    ledger = spark.createDataFrame(row, schemas.RAW_LEDGER)
    assert Q.failure_cases(ledger, "t", Q.bronze_rules(schemas.LEDGER_TABLE), ["as_of_month"]).count() == 0
    sanity = Q.check_summary(ledger, "t", Q.ledger_sanity_rules()).where("failure_count > 0")
    assert {(r["check"], r["severity"]) for r in sanity.collect()} == {
        ("at_least_0", "error"), ("at_most_110_pct_of_base", "warning")}


def test_verdict_per_partition_and_gate(spark):
    tables = {schemas.LEASE_TABLE: lease(spark, GOOD, BAD),
              schemas.LEDGER_TABLE: spark.createDataFrame([], schemas.RAW_LEDGER)}
    cases, summary = Q.validate_bronze(tables)
    assert {(r["as_of_month"], r["passed"]) for r in Q.partition_verdicts(summary).collect()} == {
        ("2025-01", True), ("2025-02", False)}
    assert Q.gate(summary, hard_fail=False) == [schemas.LEASE_TABLE]
    with pytest.raises(Q.ValidationError, match=schemas.LEASE_TABLE):
        Q.gate(summary)
    assert cases.count() == 4
    assert Q.sound_rows(tables[schemas.LEASE_TABLE], Q.bronze_rules(schemas.LEASE_TABLE)).count() == 1


def test_warnings_do_not_fail_a_partition(spark):
    rule = Q.Rule("sqft", "small", F.col("sqft") < 100, "warning")
    summary = Q.check_summary(lease(spark, GOOD), "t", [rule])
    assert summary.first()["failure_count"] == 1 and Q.partition_verdicts(summary).first()["passed"]


def test_type_coercion(spark):
    df = spark.createDataFrame([("m", "1.5"), ("m", "x"), ("m", None)], "as_of_month string, amount string")
    assert Q.check_summary(df, "t", [Q.coercible("amount", "double")]).first()["failure_count"] == 1


def test_model_tests_cover_the_declared_list(spark):
    frames = {
        "dim_suite": spark.createDataFrame([("1A",), ("1A",), (None,)], "suite_id string"),
        "kpi_windows": spark.createDataFrame([("2025-01", "3m"), (None, "4m"), ("2025-01", None)],
                                             "end_month string, window_size string"),
    }
    got = {(r["model"], r["column"], r["test"]): (r["failures"], r["passed"]) for r in Q.model_tests(frames).collect()}
    assert got == {
        ("dim_suite", "suite_id", "not_null"): (1, False),
        ("dim_suite", "suite_id", "unique"): (1, False),
        ("kpi_windows", "end_month", "not_null"): (1, False),
        ("kpi_windows", "window_size", "accepted_values"): (1, False),
    }
    assert len(Q.MODEL_TESTS) == 28


def test_empty_model_passes(spark):
    empty = spark.createDataFrame([], "suite_id string")
    assert all(r["passed"] for r in Q.model_tests({"dim_suite": empty}).collect())


def test_kpi_rules_find_a_wrong_formula(spark):
    schema = ("occupancy_pct double, leased_sqft int, total_property_sqft int, accounts_receivable int, "
              "uncollected int, price_per_sf_yr double")
    df = spark.createDataFrame([(50.0, 50, 100, 1, 1, 20.0), (51.0, 50, 100, 1, 2, 0.5), (0.0, None, 90, 1, 1, None)], schema)
    got = {r["check"]: r["failure_count"] for r in Q.check_summary(df, "t", Q.prop_kpi_rules(100), ()).collect()}
    assert got == {"constant_total": 1, "occupancy_formula": 1, "equals_uncollected": 1, "between_1_1000": 1}


def test_reconcile_is_null_safe(spark, rows):
    left = spark.createDataFrame([("a", 1), ("b", None), ("c", 3), (None, 4)], "k string, v int")
    right = spark.createDataFrame([("a", 1), ("b", None), ("c", 4), (None, 4), ("d", 5)], "k string, v int")
    assert rows(Q.reconcile(left, right, ["k"], ["v"])) == [("c", "unequal", "v"), ("d", "right_only", "v")]


def test_quarantine_and_check_log(spark, tmp_path):
    cases, summary = Q.validate_bronze({schemas.LEASE_TABLE: lease(spark, GOOD, BAD)})
    sinks.write_failures(cases, str(tmp_path))
    stored = spark.read.parquet(f"{tmp_path}/_errors")
    assert stored.where("table_name = 'raw_lease_rate_snapshot' AND as_of_month = '2025-02'").count() == 4
    log = sinks.check_entries(summary, "run1", datetime(2025, 1, 1))
    sinks.append_log(log, f"{tmp_path}/checks")
    sinks.append_log(log, f"{tmp_path}/checks")
    written = spark.read.parquet(f"{tmp_path}/checks")
    assert written.count() == 2 * summary.count()
    assert written.select("check_id").distinct().count() == summary.count()
    one = written.where("check_type = 'accepted_values' AND NOT passed").first()
    assert '"as_of_month":"2025-02"' in one["details"]


def test_layer_totals_are_exact(spark):
    df = spark.createDataFrame([(Decimal("0.10"),)] * 3, "v decimal(18,2)")
    got = {r["layer"]: (r["row_count"], r["v"]) for r in Q.layer_totals({"a": df, "b": df.limit(1)}, ["v"]).collect()}
    assert got == {"a": (3, Decimal("0.30")), "b": (1, Decimal("0.10"))}


def test_reconcile_by_digest_joins_differing_months_only(spark, rows, tmp_path):
    """Rows differ in one month, are missing in another and repeated in a third; the files of equal months are never joined."""
    def layer(values):
        return spark.createDataFrame(values, "as_of_month string, month string, v double")

    base = [(f"2020-{m:02d}", f"2020-{m:02d}", float(m)) for m in range(1, 13)] + [(None, "x", 1.0)]
    other = [r for r in base if r[0] not in ("2020-03", "2020-05")] + [("2020-05", "2020-05", None)]
    left, right = layer(base), layer(other)
    key, values = ["as_of_month", "month"], ["v"]
    assert rows(Q.reconcile_by_digest(left, right, key, values)) == rows(Q.reconcile(left, right, key, values)) != []
    assert rows(Q.reconcile_by_digest(left, left.orderBy(F.rand()), key, values)) == []
    left.where("as_of_month is not null").write.partitionBy("as_of_month").parquet(str(tmp_path / "l"))
    stored = spark.read.schema("as_of_month string, month string, v double").parquet(str(tmp_path / "l"))
    plan = Q.reconcile_by_digest(stored, right, key, values)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2020-03" in plan and "2020-04" not in plan
