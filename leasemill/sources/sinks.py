"""Writers: bronze partitions, sheet files, exports, publishing, verification and logs."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leasemill import schemas
from leasemill.operators.incremental import touched_months, upsert
from leasemill.sources.bronze import path_exists, read_bronze, read_partitioned, table_path

PARTITION = "as_of_month"
WRITTEN = "source STRING, path STRING, row_count BIGINT, column_count INT, compression STRING"


def _replace_partitions(df: DataFrame, path: str, *partition: str) -> None:
    """Overwrite only the partitions present in ``df``.

    The rebalance hint gathers a month into few files and lets adaptive execution split a month that is far larger
    than the others, so no single task writes a hot month.
    """
    (
        df.hint("rebalance", *partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy(*partition)
        .parquet(path)
    )


def write_bronze(df: DataFrame, root: str, table: str) -> None:
    """Replace the months of ``df``, each of its property, in a bronze table."""
    if schemas.PROPERTY not in df.columns:
        df = df.withColumn(schemas.PROPERTY, F.lit(schemas.DEFAULT_PROPERTY))
    columns = [c.split()[0] for c in schemas.BRONZE[table][0].split(", ")]
    _replace_partitions(df.select(*columns), table_path(root, table), schemas.PROPERTY, PARTITION)


def write_months(df: DataFrame, path: str, by: str = PARTITION) -> None:
    _replace_partitions(df, path, by)


def upsert_months(spark: SparkSession, batch: DataFrame, path: str, key: Sequence[str]) -> list[str]:
    """Merge a batch by key into the months it touches and rewrite those months only.

    Other partitions are neither read nor written.
    """
    months = touched_months(batch)
    if months:
        if path_exists(spark, path):
            current = read_partitioned(spark, path).where(F.col(PARTITION).isin(months))
            batch = upsert(current.select(*batch.columns), batch, key)
        write_months(batch, path)
    return months


def write_sheets(rows: DataFrame, path: str) -> None:
    """Every sheet of every file to its own folder."""
    _replace_partitions(rows, path, "file", "sheet_safe")


def write_sheet_tables(tables: DataFrame, path: str) -> int:
    """Every sheet of ``workbook.sheet_tables`` to its own folder, with the columns of its header; returns the number of layouts.

    A column's type is that of its values: numbers stay numbers where all are, anything mixed is text. Sheets of one layout are written
    by one job, so the number of jobs follows the layouts, not the sheets.
    """
    spark = tables.sparkSession
    grain = ["file", "sheet_safe"]
    layout = tables.groupBy(*grain).agg(F.first("names").alias("names"), F.expr("schema_of_variant_agg(record)").alias("kinds"))
    layout = layout.withColumn("layout", F.md5(F.to_json(F.struct("names", "kinds"))))
    marked = tables.drop("names").join(layout.select(*grain, "layout"), grain)
    found = layout.groupBy("layout").agg(F.first("names").alias("names"), F.first("kinds").alias("kinds")).collect()
    for r in found:
        kinds = {f.name: f.dataType for f in T._parse_datatype_string(r["kinds"].replace("OBJECT<", "STRUCT<", 1))}
        plain = {n: k for n, k in kinds.items() if isinstance(k, (T.NumericType, T.BooleanType))}
        quoted = {n: "`" + n.replace("`", "``") + "`" for n in r["names"]}
        ddl = ", ".join(f"{quoted[n]}: {plain[n].simpleString() if n in plain else 'string'}" for n in r["names"] if n in kinds)
        values = F.variant_get("record", "$", f"struct<{ddl}>")
        named = [F.col("v")[n].alias(n) if n in kinds else F.lit(None).cast("string").alias(n) for n in r["names"]]
        rows = marked.where(F.col("layout") == r["layout"]).select(*grain, "row", values.alias("v"))
        # In the order of the sheet within each file that is written.
        ordered = rows.hint("rebalance", *grain).sortWithinPartitions(*grain, "row").select(*grain, *named)
        ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy").partitionBy(*grain).parquet(path)
    return len(found)


def read_sheets(spark: SparkSession, path: str, sheet_safe: str, files: Sequence[str]) -> DataFrame:
    """The rows of a sheet of some files that have it in one layout, with the file as a column."""
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    folders = [f"{path.rstrip('/')}/file={escaped(f)}/sheet_safe={escaped(sheet_safe)}" for f in files]
    return spark.read.option("basePath", path).parquet(*folders).drop("sheet_safe")


def _attempt(action: Callable[[], int]) -> tuple[str, int, str | None]:
    try:
        return "success", action(), None
    except Exception as error:  # one failing table must not stop the others
        return "failed", 0, str(error).splitlines()[0]


def _outcomes(spark: SparkSession, results: list[tuple]) -> DataFrame:
    return spark.createDataFrame(results, "table_name STRING, status STRING, row_count BIGINT, error STRING")


def export_csv(spark: SparkSession, tables: Mapping[str, DataFrame], root: str) -> DataFrame:
    """CSV with header per table; a table that fails is reported and the rest go on.

    Rows are counted while they are written.
    """
    results = []
    for name, df in tables.items():
        def write(name=name, df=df) -> int:
            seen = Observation()
            observed = df.observe(seen, F.count(F.lit(1)).alias("n"))
            observed.write.mode("overwrite").option("header", True).csv(f"{root.rstrip('/')}/{name}.csv")
            return seen.get["n"]

        results.append((name, *_attempt(write)))
    return _outcomes(spark, results)


def write_recorded(df: DataFrame, path: str, source: str) -> DataFrame:
    """Write snappy Parquet and return its record: source, path, rows, columns and compression.

    Rows are counted while they are written. The record is kept next to the files, as ``_written``, for whoever reads them.
    """
    spark, seen = df.sparkSession, Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("compression", "snappy").parquet(path)
    record = spark.createDataFrame([(source, path, seen.get["n"], len(df.columns), "snappy")], WRITTEN)
    record.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/_written")
    return record


def read_record(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WRITTEN).json(f"{path.rstrip('/')}/_written")


def write_forecast(df: DataFrame, root: str) -> None:
    """The forecast as Parquet and CSV; the CSV is written from the stored Parquet, not computed again."""
    base = f"{root.rstrip('/')}/prop_kpi_forecast"
    df.write.mode("overwrite").parquet(f"{base}.parquet")
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{base}.parquet")
    stored.write.mode("overwrite").option("header", True).csv(f"{base}.csv")


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Create or replace a catalog table bucketed and sorted by its keys; tables of one key and number of buckets are joined and
    grouped by it without a shuffle. One file per bucket; the number of buckets is that of the shuffle partitions unless given.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *keys).write.mode("overwrite").bucketBy(n, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)


def publish(spark: SparkSession, tables: Mapping[str, DataFrame] | None = None, database: str = "default",
            source_database: str = "default", names: Sequence[str] | None = None) -> DataFrame:
    """Create or replace catalog tables; without frames, copies the listed (or all) tables of a database, but no temporary views."""
    if tables is None:
        listed = names or [t.name for t in spark.catalog.listTables(source_database) if not t.isTemporary]
        loaders = {n: functools.partial(spark.table, f"{source_database}.{n}") for n in listed}
    else:
        loaders = {n: functools.partial(lambda d: d, df) for n, df in tables.items()}
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    results = []
    for name, load in loaders.items():
        def copy(name=name, load=load) -> int:
            load().write.mode("overwrite").saveAsTable(f"{database}.{name}")
            return spark.table(f"{database}.{name}").count()

        results.append((name, *_attempt(copy)))
    return _outcomes(spark, results)


# Tables whose presence is verified after publishing.
VERIFIED_TABLES = ["prop_kpi_monthly", "building_kpi_monthly", "fact_expense_monthly", "dim_suite", "dim_tenant"]


def verify_tables(spark: SparkSession, names: Sequence[str] = VERIFIED_TABLES, database: str = "default") -> DataFrame:
    """Presence and row count of published tables, counted in one job."""
    counts = [
        spark.table(f"{database}.{n}").agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(n).alias("table_name"), F.lit(True).alias("present"), "row_count")
        if spark.catalog.tableExists(f"{database}.{n}")
        else spark.range(1).select(F.lit(n).alias("table_name"), F.lit(False).alias("present"),
                                   F.lit(None).cast("bigint").alias("row_count"))
        for n in names
    ]
    return functools.reduce(lambda a, b: a.unionByName(b), counts)


def verify_files(spark: SparkSession, root: str) -> DataFrame:
    """Files and rows per stored bronze table and month."""
    parts = []
    for table in schemas.BRONZE:
        if path_exists(spark, table_path(root, table)):
            parts.append(
                read_bronze(spark, root, table)
                .select(F.lit(table).alias("table_name"), "as_of_month", F.col("_metadata.file_path").alias("path"))
                .groupBy("table_name", "as_of_month")
                .agg(F.countDistinct("path").alias("files"), F.count(F.lit(1)).alias("row_count"))
            )
    empty = spark.createDataFrame([], "table_name STRING, as_of_month STRING, files BIGINT, row_count BIGINT")
    return functools.reduce(lambda a, b: a.unionByName(b), parts, empty)


def copy_bronze(spark: SparkSession, root: str, lake: str, dry_run: bool = False) -> DataFrame:
    """Copy the bronze tables to the lake root in the same layout; missing tables are skipped.

    A dry run lists the files that would be copied.
    """
    listing, results = [], []
    for table in schemas.BRONZE:
        path = table_path(root, table)
        if not path_exists(spark, path):
            results.append((table, "missing", 0, None))
            continue
        df = read_partitioned(spark, path, schemas.BRONZE[table][0])
        if dry_run:
            listing.append(df.select(F.lit(table).alias("table_name"), F.col("_metadata.file_path").alias("path")).distinct())
            continue
        def copy(df=df, table=table) -> int:
            _replace_partitions(df, table_path(lake, table), schemas.PROPERTY, PARTITION)
            return df.count()

        results.append((table, *_attempt(copy)))
    if dry_run:
        empty = spark.createDataFrame([], "table_name STRING, path STRING")
        return functools.reduce(lambda a, b: a.unionByName(b), listing, empty)
    return _outcomes(spark, results)


# --- logs --------------------------------------------------------------------------------------------------


def ingestion_entries(arrivals: DataFrame, stored: Sequence[DataFrame], started: datetime,
                      finished: datetime) -> DataFrame:
    """One log row per arrival (property_id, file, _file_md5, as_of_month, arrived, role, error).

    ``role`` is 'take' for files that were loaded, 'fail' for files that could not be; others are skipped. A loaded file without
    any stored row failed. ``stored`` are the bronze tables after the load.
    """
    key = ["_file_md5", schemas.PROPERTY, "as_of_month"]
    counted = functools.reduce(
        lambda a, b: a.unionByName(b),
        [r.groupBy(*key).agg(F.count(F.lit(1)).alias("n")) for r in stored],
    ).groupBy(*key).agg(F.sum("n").alias("n"))
    return log_entries(arrivals.join(counted, key, "left"), started, finished)


def log_entries(arrivals: DataFrame, started: datetime, finished: datetime) -> DataFrame:
    """The log rows of arrivals with a role and ``n``, the number of rows that were loaded from them."""
    taken = F.col("role") == "take"
    status = (
        F.when(F.col("role") == "fail", "failed").when(~taken, "skipped").when(F.col("n") > 0, "success").otherwise("failed")
    )
    return arrivals.select(
        schemas.PROPERTY, "file", "_file_md5", "as_of_month", "arrived",
        F.when(taken, F.coalesce("n", F.lit(0))).otherwise(0).cast("bigint").alias("rows_ingested"),
        F.lit(started).cast("timestamp").alias("started_at"),
        F.lit(finished).cast("timestamp").alias("finished_at"),
        status.alias("status"),
        F.when(status == "failed", F.coalesce("error", F.lit("no known block"))).alias("error"),
    )


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def run_entry(spark: SparkSession, name: str, status: str, started: datetime, finished: datetime, records: int = 0,
              error: str | None = None, details: Mapping[str, str] | None = None,
              run_id: str | None = None) -> DataFrame:
    """One run-log row; details are stored as JSON text."""
    row = [(run_id or uuid.uuid4().hex, started, name, status, records,
            (finished - started).total_seconds(), error, dict(details or {}))]
    schema = schemas.PIPELINE_RUNS.replace("metadata STRING", "metadata MAP<STRING, STRING>")
    return spark.createDataFrame(row, schema).withColumn("metadata", F.to_json("metadata"))


def check_entries(summary: DataFrame, run_id: str, at: datetime) -> DataFrame:
    """Check-log rows out of a check summary."""
    whose = [c for c in (schemas.PROPERTY,) if c in summary.columns]
    details = F.to_json(F.struct(*whose, "as_of_month", "column", "severity", "row_count"))
    identity = F.md5(F.concat_ws("|", F.lit(run_id), "table_name", *whose, "as_of_month", "column", "check"))
    return summary.select(
        identity.alias("check_id"),
        F.lit(run_id).alias("run_id"),
        F.lit(at).cast("timestamp").alias("check_timestamp"),
        "table_name",
        F.col("check").alias("check_type"),
        "passed",
        "failure_count",
        details.alias("details"),
    )


def write_failures(cases: DataFrame, root: str) -> None:
    """Quarantine report: every failing case by table and month, below ``_errors``."""
    (
        cases.hint("rebalance", "table_name", PARTITION)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("table_name", PARTITION)
        .parquet(f"{root.rstrip('/')}/_errors")
    )
