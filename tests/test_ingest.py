"""Workbook files through decoding, bronze, staging, models, forecast and export."""

from pathlib import Path

import pytest
from books import monthly_book, workbook
from pyspark.sql import functions as F

from leasemill import schemas
from leasemill.operators import quality
from leasemill.plans import refresh
from leasemill.sources import bronze, sinks
from leasemill.sources import workbook as wb
from leasemill.streaming import arrivals


def put(folder: Path, name: str, content: bytes) -> None:
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(content)


@pytest.mark.parametrize("shared", [True, False])
def test_decode_values(spark, tmp_path, shared):
    book = workbook({"One & two": {(1, 1): "a<b", (2, 28): 1.5, (3, 1): ("date", 45672), (4, 1): None},
                     "Empty": {}, "Last": {(7, 2): "x"}}, shared)
    put(tmp_path, "b.xlsx", book)
    got = {(r["sheet"], r["sheet_no"], r["row"], r["col"]): r["value"]
           for r in wb.read_workbooks(spark, str(tmp_path)).collect()}
    assert got == {("One & two", 1, 1, 1): "a<b", ("One & two", 1, 2, 28): "1.5",
                   ("One & two", 1, 3, 1): "2025-01-15 00:00:00", ("Last", 3, 7, 2): "x"}


def test_hash_per_file(spark, tmp_path):
    put(tmp_path, "a.xlsx", b"same")
    put(tmp_path, "b.xlsx", b"same")
    put(tmp_path, "c.xlsx", b"other")
    hashes = bronze.file_hashes(spark, str(tmp_path), "*.xlsx")
    assert hashes.count() == 3 and hashes.select("_file_md5").distinct().count() == 2


class Feed:
    """A landing folder and the tables it fills."""

    def __init__(self, spark, base: Path):
        self.spark, self.base = spark, base
        self.landing, self.root, self.staged = base / "landing", str(base / "bronze"), str(base / "staged")

    def run(self) -> None:
        after = arrivals.refresh_staging(self.root, self.staged)
        arrivals.stream_workbooks(self.spark, str(self.landing), self.root, str(self.base / "checkpoint"),
                                  after).awaitTermination()

    def lease(self, month: str) -> dict:
        df = bronze.read_bronze(self.spark, self.root, schemas.LEASE_TABLE, [month])
        return {r["suite_id"]: r["tenant"] for r in df.collect()}

    def log(self) -> list:
        rows = arrivals.read_log(self.spark, self.root).collect()
        return sorted((r["as_of_month"], r["status"], r["rows_ingested"]) for r in rows)


def test_arrivals_replace_months_and_skip_copies(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    march = monthly_book(3, suites={"1A": ("Acme", 100, 200), "2B": ("Beta", 50, 100)})
    put(feed.landing, "1-book_2025-03.xlsx", march)
    feed.run()
    assert feed.lease("2025-03") == {"1A": "Acme", "2B": "Beta"}
    assert feed.log() == [("2025-03", "success", 3 + 3 + 2)]

    # A copy under another name, an older month that arrives late, and a file that is no workbook content.
    put(feed.landing, "2-copy_2025-03.xlsx", march)
    put(feed.landing, "3-book_2025-02.xlsx", monthly_book(2))
    put(feed.landing, "4-empty_2025-04.xlsx", workbook({"Notes": {(1, 1): "nothing"}}))
    feed.run()
    assert feed.lease("2025-02") == {"1A": "Acme"}
    assert feed.log() == [("2025-02", "success", 5), ("2025-03", "skipped", 0), ("2025-03", "success", 8),
                          ("2025-04", "failed", 0)]

    # A corrected March: the month is replaced in bronze, merged by key in staging.
    put(feed.landing, "5-book_2025-03.xlsx", monthly_book(3, suites={"1A": ("Gamma", 100, 300)}))
    feed.run()
    assert feed.lease("2025-03") == {"1A": "Gamma"}
    staged = spark.read.parquet(f"{feed.staged}/stg_lease_rate").where("as_of_month = '2025-03'")
    assert {(r["suite_id"], r["tenant"]) for r in staged.collect()} == {("1A", "Gamma"), ("2B", "Beta")}
    assert spark.read.parquet(f"{feed.staged}/stg_dashboard_monthly").count() == 5


def test_two_files_of_one_month_in_one_batch(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    put(feed.landing, "1-book_2025-01.xlsx", monthly_book(1, suites={"1A": ("Old", 1, 1)}))
    put(feed.landing, "2-book_2025-01.xlsx", monthly_book(1, suites={"1A": ("New", 1, 1)}))
    feed.run()
    assert feed.lease("2025-01") == {"1A": "New"}
    assert [status for _, status, _ in feed.log()] == ["skipped", "success"]


def test_bad_files_fail_alone(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    put(feed.landing, "a_2025-01.xlsx", monthly_book(1))
    put(feed.landing, "b_2025-01.xlsx", b"PK no archive")
    put(feed.landing, "c_2025-01.xlsx", workbook({"Empty": {}}))
    put(feed.landing, "d_2025-01.xls", b"\xd0\xcf\x11\xe0 old format")
    feed.run()
    rows = {r["file"][-14:]: (r["status"], bool(r["error"])) for r in arrivals.read_log(spark, feed.root).collect()}
    assert rows == {"a_2025-01.xlsx": ("success", False), "b_2025-01.xlsx": ("failed", True), "c_2025-01.xlsx": ("failed", True),
                    "/d_2025-01.xls": ("failed", True)}
    assert feed.lease("2025-01") == {"1A": "Acme"}


def test_two_properties_keep_their_months(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    for org, tenant in (("org1/b1", "One"), ("org2/b9", "Two")):
        put(feed.landing / f"raw/{org}/2025/03/05", "1700000000-book_2025-03.xlsx", monthly_book(3, suites={"1A": (tenant, 100, 200)}))
    feed.run()
    put(feed.landing / "raw/org3/b1/2025/03/06", "1700000001-book_2025-03.xlsx", monthly_book(3, suites={"1A": ("Three", 1, 2)}))
    # Uploaded before the one that is there: it comes too late to replace it.
    put(feed.landing / "raw/org1/b1/2025/03/04", "1600000000-book_2025-03.xlsx", monthly_book(3, suites={"1A": ("Old", 1, 2)}))
    feed.run()
    lease = bronze.read_bronze(spark, feed.root, schemas.LEASE_TABLE)
    assert {(r["property_id"], r["tenant"]) for r in lease.collect()} == {("org1-b1", "One"), ("org2-b9", "Two"), ("org3-b1", "Three")}
    assert spark.read.parquet(f"{feed.staged}/stg_lease_rate").count() == 3


def test_replaced_month_loses_the_rows_it_no_longer_has(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    lease_only = workbook({"Lease Rate": {(4, 1): "Suite", (4, 2): "Tenant", (5, 1): "9Z", (5, 2): "Solo"}})
    put(feed.landing, "1_2025-02.xlsx", monthly_book(2))
    feed.run()
    put(feed.landing, "2_2025-02.xlsx", monthly_book(2, expenses=False))
    feed.run()
    assert bronze.read_bronze(spark, feed.root, schemas.EXPENSE_TABLE).count() == 0
    assert bronze.read_bronze(spark, feed.root, schemas.LEDGER_TABLE).count() == 2
    put(feed.landing, "3_2025-05.xlsx", lease_only)
    feed.run()
    put(feed.landing, "4_2025-05.xlsx", lease_only)
    feed.run()
    assert [(m, s) for m, s, _ in feed.log() if m == "2025-05"] == [("2025-05", "skipped"), ("2025-05", "success")]


def test_month_of_a_file_without_one(spark, tmp_path):
    landed = spark.createDataFrame([("a.xlsx", "Notes", 1, 1, 1, "x", "m", 1_600_000_000)], f"{arrivals.LANDED_CELLS}, _arrived BIGINT")
    assert [r["as_of_month"] for r in arrivals.arrivals_of(landed).collect()] == ["2020-09"]
    assert [r["as_of_month"] for r in arrivals.arrivals_of(landed, "2024-01").collect()] == ["2024-01"]


def test_batch_equals_stream(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    for month in (1, 2, 3):
        put(feed.landing, f"book_2025-{month:02d}.xlsx", monthly_book(month))
    feed.run()
    files = bronze.file_hashes(spark, str(feed.landing)).select("file", "_file_md5")
    landed = wb.read_workbooks(spark, str(feed.landing)).join(files, "file")
    other = str(tmp_path / "batch")
    assert arrivals.ingest(spark, landed, other) == ["2025-01", "2025-02", "2025-03"]
    for table in schemas.BRONZE:
        columns = [c for c in bronze.read_bronze(spark, other, table).columns if c != "_ingested_at"]
        streamed = bronze.read_bronze(spark, feed.root, table).select(*columns)
        batch = bronze.read_bronze(spark, other, table).select(*columns)
        assert streamed.count() > 0 and streamed.exceptAll(batch).count() == batch.exceptAll(streamed).count() == 0


def landed_books(spark, folder: Path, books: dict):
    for name, content in books.items():
        put(folder, name, content)
    files = bronze.file_hashes(spark, str(folder)).select("file", "_file_md5")
    return wb.read_workbooks(spark, str(folder)).join(files, "file")


def test_whole_run(spark, tmp_path):
    landed = landed_books(spark, tmp_path / "landing", {f"b_2025-{m:02d}.xlsx": monthly_book(m) for m in (1, 2, 3)})
    run = refresh.Run(spark, str(tmp_path / "run"), landed, total_sqft=1000)
    assert refresh.run_stages(run) == list(refresh.STAGES)
    assert run.read_gold("prop_kpi_monthly").count() == 6
    assert run.read_gold("kpi_windows").count() == 12
    assert run.read_gold("snap_lease_rate_scd2").count() == 1
    assert run.read_gold("model_tests").count() == len(quality.MODEL_TESTS)
    forecast = spark.read.parquet(f"{run.root}/gold/prop_kpi_forecast.parquet")
    assert forecast.count() == 12 and len(forecast.columns) == 12
    exported = spark.read.option("header", True).csv(f"{run.root}/exports/kpi_windows.csv")
    assert exported.count() == 12 and "avg_noi_margin_pct" in exported.columns
    log = spark.read.parquet(f"{run.root}/logs/pipeline_runs")
    assert {(r["pipeline_name"], r["status"]) for r in log.collect()} == {(s, "success") for s in refresh.STAGES}
    assert f'"run":"{run.run_id}"' in log.first()["metadata"]
    records = {r["pipeline_name"]: r["records_processed"] for r in log.collect()}
    assert records["ingest"] == 3 + 6 + 6 and records["models"] > records["ingest"] and records["quality"] > 0


def test_second_run_stages_touched_months_only(spark, tmp_path):
    books = {f"b_2025-{m:02d}.xlsx": monthly_book(m) for m in (1, 2, 3)}
    root = str(tmp_path / "run")
    stop = ["quality", "forecast", "export"]
    refresh.run_stages(refresh.Run(spark, root, landed_books(spark, tmp_path / "a", books), total_sqft=1000), skip=stop)
    first = refresh.Run(spark, root)
    assert refresh.stale_months(first) == []

    # A new month, and a correction of the second without its expenses.
    later = {"b_2025-04.xlsx": monthly_book(4), "c_2025-02.xlsx": monthly_book(2, rent=70000.0, expenses=False)}
    landed = landed_books(spark, tmp_path / "b", later)
    touched = refresh.Run(spark, root, landed, total_sqft=1000)
    refresh.ingest(touched)
    # A staged month that no file changed is left as it is: its marked row survives.
    lease = f"{root}/gold/stg_lease_rate"
    january = touched.read_gold("stg_lease_rate").where("as_of_month = '2025-01'").withColumn("tenant", F.lit("marked"))
    marked = spark.createDataFrame(january.collect(), january.schema)
    sinks.write_months(marked, lease)
    refresh.stage_tables(touched)
    months = {r["as_of_month"] for r in touched.read_gold("stg_lease_rate").where("tenant = 'marked'").collect()}
    assert months == {"2025-01"}
    assert refresh.stale_months(touched) == []
    plan = refresh.staged(touched, "stg_lease_rate", ["2025-04"])._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "as_of_month" in filters and "2025-04" in filters
    expenses = touched.read_gold("stg_expenses_monthly")
    assert {r["as_of_month"] for r in expenses.collect()} == {"2025-01", "2025-03", "2025-04"}

    # A full refresh replaces what is stale, and agrees with the tables staged month by month elsewhere.
    step = {t: touched.read_gold(t).where("as_of_month <> '2025-01'").collect() for t in refresh.STAGERS}
    whole = refresh.Run(spark, root, full_refresh=True)
    refresh.stage_tables(whole)
    assert whole.read_gold("stg_lease_rate").where("tenant = 'marked'").isEmpty()
    for table, rows in step.items():
        again = whole.read_gold(table).where("as_of_month <> '2025-01'").collect()
        assert rows and sorted(map(str, rows)) == sorted(map(str, again))


def test_run_without_expenses(spark, tmp_path):
    landed = landed_books(spark, tmp_path / "landing", {"b_2025-01.xlsx": monthly_book(1, expenses=False)})
    run = refresh.Run(spark, str(tmp_path / "run"), landed, total_sqft=1000)
    assert refresh.run_stages(run, skip=["forecast", "export"]) == ["ingest", "quality", "models"]
    assert run.read_gold("stg_expenses_monthly").isEmpty() and run.read_gold("prop_kpi_monthly").count() > 0


def test_run_stops_at_the_failing_stage(spark, tmp_path):
    landed = landed_books(spark, tmp_path / "landing", {"b_2025-01.xlsx": monthly_book(1, rent=-50000.0)})
    run = refresh.Run(spark, str(tmp_path / "run"), landed)
    with pytest.raises(quality.ValidationError):
        refresh.run_stages(run)
    log = spark.read.parquet(f"{run.root}/logs/pipeline_runs").collect()
    assert {(r["pipeline_name"], r["status"]) for r in log} == {("ingest", "success"), ("quality", "failed")}
    errors = spark.read.parquet(f"{run.bronze()}/_errors")
    assert {(r["column"], r["check"]) for r in errors.collect()} == {("rent_base", "at_least_0"), ("collected", "at_least_0")}
    assert refresh.run_stages(run, skip=["ingest", "quality", "forecast"]) == ["models", "export"]


def test_publish_and_verify(spark):
    a, b = spark.range(3).toDF("x"), spark.range(5).toDF("y")
    broken = spark.range(1).selectExpr("raise_error('no') AS z")
    first = {r["table_name"]: (r["status"], r["row_count"])
             for r in sinks.publish(spark, {"pub_a": a, "pub_bad": broken, "pub_b": b}, "mill_out").collect()}
    assert first == {"pub_a": ("success", 3), "pub_bad": ("failed", 0), "pub_b": ("success", 5)}
    sinks.publish(spark, {"pub_a": spark.range(7).toDF("x")}, "mill_out")
    copied = sinks.publish(spark, None, "mill_copy", "mill_out", ["pub_a", "pub_b"])
    assert {r["table_name"]: r["row_count"] for r in copied.collect()} == {"pub_a": 7, "pub_b": 5}
    verified = {r["table_name"]: (r["present"], r["row_count"])
                for r in sinks.verify_tables(spark, ["pub_a", "pub_none"], "mill_copy").collect()}
    assert verified == {"pub_a": (True, 7), "pub_none": (False, None)}
    for name in ("mill_out", "mill_copy"):
        spark.sql(f"DROP DATABASE {name} CASCADE")


def test_lake_copy_dry_run_and_views(spark, tmp_path):
    root, lake = str(tmp_path / "bronze"), str(tmp_path / "lake")
    landed = landed_books(spark, tmp_path / "landing", {f"b_2025-{m:02d}.xlsx": monthly_book(m, expenses=False) for m in (1, 2)})
    arrivals.ingest(spark, landed, root)
    listed = sinks.copy_bronze(spark, root, lake, dry_run=True)
    assert listed.where("path LIKE '%as_of_month=2025-02%'").count() >= 2 and not Path(lake).exists()
    status = {r["table_name"]: (r["status"], r["row_count"]) for r in sinks.copy_bronze(spark, root, lake).collect()}
    assert status[schemas.LEDGER_TABLE] == ("success", 3) and status[schemas.LEASE_TABLE] == ("success", 2)
    assert {r["as_of_month"] for r in sinks.verify_files(spark, lake).collect()} == {"2025-01", "2025-02"}
    bronze.register_views(spark, {"raw_lease": f"{lake}/{schemas.LEASE_TABLE}"})
    assert spark.sql("SELECT as_of_month FROM raw_lease WHERE as_of_month > '2025-01'").count() == 1


def test_month_filter_reaches_the_partitions(spark, tmp_path):
    root = str(tmp_path / "bronze")
    landed = landed_books(spark, tmp_path / "landing", {f"b_2025-{m:02d}.xlsx": monthly_book(m) for m in (1, 2)})
    arrivals.ingest(spark, landed, root)
    df = bronze.read_bronze(spark, root, schemas.LEASE_TABLE).where("as_of_month = '2025-02'").select("suite_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(as_of_month" in plan and "ReadSchema: struct<suite_id:string>" in plan
