"""Arrival-driven ingestion: new worksheets become bronze months, in any order of arrival.

The stream has two queries. The first parses what has landed into records by file, whatever becomes of them. The second decides: its state
holds, for every property and month, the file that the month has and when it arrived, and the files handled lately. So a decision
costs the same whether the history has ten files or ten million; the log is written but not read. Only a stream with a new checkpoint
begins with the files of the log.

A file whose content its month already holds is left out, and so is one that arrived before it; a newer file replaces the month in
all tables, also in those it has no rows for. A file that cannot be read, or has no known rows, fails alone, with a log row. A
batch that is replayed after a failure has the same state and decides the same, writes the same months, and writes its log last, in a
folder of its own, so nothing is logged twice. Late months are handled like any other month, because work follows the touched partitions.

``ingest`` does the same for one set of landed cells without a stream; it decides by the log. One root is fed by one of the two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from leasemill import schemas
from leasemill.operators.clean import detect_months, month_header
from leasemill.operators.incremental import FILE_KEY, touched_months
from leasemill.plans import models
from leasemill.session import shared_folder
from leasemill.sources import grid, sinks
from leasemill.sources.bronze import (
    WORKBOOK_GLOB, delete_partition, path_exists, property_of, read_bronze, table_path, upload_epoch,
)
from leasemill.sources.workbook import cells_of

LANDED_CELLS = f"{schemas.CELLS}, _file_md5 STRING"
FollowUp = Callable[[SparkSession, list[str]], None]

MONTH = [schemas.PROPERTY, "as_of_month"]

_PARSERS = {
    schemas.EXPENSE_TABLE: grid.expense_records,
    schemas.LEASE_TABLE: grid.lease_records,
    schemas.LEDGER_TABLE: grid.ledger_records,
}


def log_path(root: str) -> str:
    return f"{root.rstrip('/')}/_ingestion_log"


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """All log rows: those of ``ingest``, and those of every batch of a stream."""
    return spark.read.schema(schemas.INGESTION_LOG).option("recursiveFileLookup", "true").parquet(log_path(root))


def _stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a small frame to the shared folder and read it back: later steps must not recompute it."""
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def current_files(spark: SparkSession, root: str) -> DataFrame:
    """The file that each property's month holds: the last to arrive of those that were loaded."""
    if not path_exists(spark, log_path(root)):
        return spark.createDataFrame([], "property_id STRING, as_of_month STRING, known STRUCT<arrived: BIGINT, file: STRING, _file_md5: STRING>")
    loaded = read_log(spark, root).where("status = 'success'")
    return loaded.groupBy(*MONTH).agg(F.max(F.struct("arrived", "file", "_file_md5")).alias("known"))


def roles(arrivals: DataFrame, current: DataFrame) -> DataFrame:
    """Mark each arrival 'take', 'skip' or 'fail'.

    ``arrivals`` holds (file, _file_md5, property_id, as_of_month, arrived, error). Files with an error fail. Skipped are contents
    that their month already holds, files older than the one it holds, and files that another arrival of the same month
    replaces: the last to arrive wins, then the later name, whichever batch a file comes in.
    """
    order = F.struct("arrived", "file")
    newer = F.col("known").isNull() | (
        (order >= F.struct("known.arrived", "known.file")) & (F.col("_file_md5") != F.col("known._file_md5")))
    held = arrivals.join(current, MONTH, "left").withColumn("fits", F.col("error").isNull() & newer)
    winners = held.where("fits").groupBy(*MONTH).agg(F.max(order).alias("winner"))
    return held.join(winners, MONTH, "left").select(
        *arrivals.columns,
        F.when(F.col("error").isNotNull(), "fail").when(F.col("fits") & (order == F.col("winner")), "take").otherwise("skip").alias("role"),
    )


def sheets_of(landed: DataFrame) -> DataFrame:
    """The sheets of all landed files, with what is wrong with a file, if anything, and when it was seen.

    Errors are grouped by, not compared: cells combine before the shuffle without being sorted.
    """
    seen = F.max("_arrived") if "_arrived" in landed.columns else F.lit(None).cast("bigint")
    error = F.when(F.col("sheet").isNull(), F.coalesce("value", F.lit("no cells"))).alias("error")
    return landed.groupBy("file", "_file_md5", "sheet", "sheet_no", error).agg(seen.alias("seen"))


def arrivals_of(landed: DataFrame, run_month: str | None = None, sheets: DataFrame | None = None, top: DataFrame | None = None) -> DataFrame:
    """One row per landed file: whose it is, its month, when it arrived, and what is wrong with it, if anything.

    ``sheets`` names the result of ``sheets_of`` and ``top`` the first rows of all sheets, where these are stored.

    A file without a month of its own belongs to the run month or, without one, to the month it arrived in, so that a replay
    puts it in the same place.
    """
    files = (sheets_of(landed) if sheets is None else sheets).groupBy("file", "_file_md5").agg(F.max("error").alias("error"), F.max("seen").alias("seen"))
    arrived = F.coalesce(upload_epoch(F.col("file")), F.col("seen"), F.lit(0).cast("bigint"))
    month = F.when((F.col("rule") == "run_month") & F.lit(run_month is None) & (F.col("arrived") > 0),
                   F.date_format(F.timestamp_seconds("arrived"), "yyyy-MM")).otherwise(F.col("as_of_month"))
    return files.withColumn("arrived", arrived).join(detect_months(landed, run_month, sheets, top), "file").select(
        "file", "_file_md5", property_of(F.col("file")).alias(schemas.PROPERTY), month.alias("as_of_month"), "arrived", "error")


def _clear_replaced(spark: SparkSession, root: str, have: dict[str, set[tuple[str, str]]]) -> None:
    """Remove the months of tables for which the file that now holds them has no rows.

    ``have`` names the (property, month) that the taken files have rows for, by table. A file without rows in any table replaces
    nothing. The lists are at most three entries per file of the batch.
    """
    for table, places in have.items():
        for owner, month in set().union(*have.values()) - places:
            delete_partition(spark, table_path(root, table), {schemas.PROPERTY: owner, "as_of_month": month})


def _loaded(spark: SparkSession, root: str, taken: DataFrame, months: list[str]) -> dict[str, set[tuple[str, str]]]:
    """The months that bronze has from the taken files, by table."""
    have = {}
    for table in _PARSERS:
        rows = read_bronze(spark, root, table, months).select(*FILE_KEY, schemas.PROPERTY).distinct()
        kept = rows.join(taken.select(*FILE_KEY, schemas.PROPERTY), [*FILE_KEY, schemas.PROPERTY], "left_semi")
        have[table] = {(r[schemas.PROPERTY], r["as_of_month"]) for r in kept.collect()}
    return have


def ingest(spark: SparkSession, landed: DataFrame, root: str, run_month: str | None = None) -> list[str]:
    """Take one set of landed cells (with content hash) into bronze; returns the months written."""
    started = datetime.now(timezone.utc)
    arrivals = _stored(spark, arrivals_of(landed, run_month), "arrivals")
    marked = _stored(spark, roles(arrivals, current_files(spark, root)), "roles")
    taken = marked.where("role = 'take'")
    months = touched_months(taken)
    if months:
        mine = landed.select("file", "sheet", "sheet_no", "row", "col", "value").join(taken.select("file"), "file", "left_semi")
        for table, parse in _PARSERS.items():
            sinks.write_bronze(grid.stamp(parse(mine, taken), taken), root, table)
        _clear_replaced(spark, root, _loaded(spark, root, taken, months))
    stored = [read_bronze(spark, root, table, months) for table in _PARSERS]
    sinks.append_log(sinks.ingestion_entries(marked, stored, started, datetime.now(timezone.utc)), log_path(root))
    return months


# --- the stream --------------------------------------------------------------------------------------------

#: A file that a month has handled is known for so long, by arrival time: sent again within it, the same file is no news.
KNOWN_SECONDS = 400 * 24 * 3600
#: Parsed batches that one decision takes up.
PARSED_PER_DECISION = 100
_PARSED = (
    "file STRING, _file_md5 STRING, property_id STRING, as_of_month STRING, arrived BIGINT, error STRING, "
    "row_counts MAP<STRING, BIGINT>, parsed BIGINT"
)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def parsed_path(root: str, stream: str, name: str) -> str:
    """Where a stream, named by its checkpoint, keeps what it has parsed and not yet decided about."""
    return f"{root.rstrip('/')}/_parsed/{stream}/{name}"


def _parse_into(root: str, stream: str, to_cells):
    """Parses a micro-batch: records of every table by file, and a row per file, written last."""

    def parse(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = f"{parsed_path(root, stream, 'arrivals')}/batch={batch_id}"
        if path_exists(spark, f"{done}/_SUCCESS"):
            return
        landed = to_cells(batch)
        # What is small is stored, so that its size is known: it goes to the cells, which are neither dealt nor sorted for it. Files go
        # by number, their names are long.
        number = F.min("id").over(Window.partitionBy("file")).cast("string")
        sheets = _stored(spark, sheets_of(landed).withColumn("id", F.monotonically_increasing_id()).withColumn("no", number), "sheets")
        names = sheets.select("file", "no").distinct()
        top = _stored(spark, landed.where(F.col("row") <= grid.TOP_ROWS).join(names, "file"), "top")
        below = top if top.where(month_header()).isEmpty() else landed
        found = _stored(spark, arrivals_of(below, None, sheets, top).join(names, "file"), "arrivals")
        good = found.where("error is null").select(F.col("no").alias("file"), F.col("file").alias("name"), "_file_md5", *MONTH)
        mine, first = (df.select(F.col("no").alias("file"), "sheet", "sheet_no", "row", "col", "value") for df in (landed.join(names, "file"), top))
        parsed = {table: records(first, good) for table, records in _PARSERS.items() if table != schemas.LEASE_TABLE}
        parsed[schemas.LEASE_TABLE] = grid.lease_records(mine, good, _stored(spark, grid.lease_columns(mine), "columns"))
        counts = None
        for table, records in parsed.items():
            path = f"{parsed_path(root, stream, table)}/batch={batch_id}"
            stamped = grid.stamp(records, good, keep_file=True).join(good.select("file", "name").distinct(), "file")
            stamped = stamped.drop("file").withColumnRenamed("name", "file")
            stamped.write.mode("overwrite").parquet(path)
            n = spark.read.schema(stamped.schema).parquet(path).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
            n = n.select("file", F.struct(F.lit(table).alias("key"), F.col("n").alias("value")).alias("entry"))
            counts = n if counts is None else counts.unionByName(n)
        # One entry per table.
        counts = counts.groupBy("file").agg(F.map_from_entries(F.collect_list("entry")).alias("row_counts"))
        found = found.join(counts, "file", "left").withColumn("parsed", F.lit(batch_id).cast("bigint"))
        nothing = F.create_map().cast("map<string, bigint>")
        found = found.withColumns({
            "row_counts": F.coalesce("row_counts", nothing),
            "error": F.when(F.col("error").isNull() & F.col("row_counts").isNull(), "no known block").otherwise(F.col("error")),
        })
        found.select("file", "_file_md5", *MONTH, "arrived", "error", "row_counts", "parsed").coalesce(1).write.mode("overwrite").parquet(done)

    return parse


def latest_file(known_seconds: int = KNOWN_SECONDS) -> StatefulProcessor:
    """Decides about the files of one (property, month): 'take', 'skip' or 'fail', as ``roles`` does from the log.

    The class is local, so that workers get it with the query and need no package of their own.
    """

    class LatestFile(StatefulProcessor):
        def init(self, handle) -> None:
            self.current = handle.getValueState("current", "arrived BIGINT, file STRING, _file_md5 STRING")
            self.known = handle.getMapState("known", "file STRING, _file_md5 STRING", "arrived BIGINT")

        def handleInitialState(self, key, initialState, timerValues) -> None:
            self.current.update((initialState["arrived"], initialState["file"], initialState["_file_md5"]))
            self.known.updateValue((initialState["file"], initialState["_file_md5"]), (initialState["arrived"],))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            # The files of one month in one batch.
            sent = sorted((r.asDict() for r in rows), key=lambda r: (r["arrived"], r["file"]))
            current = tuple(self.current.get()) if self.current.exists() else None
            winner = None
            for r in sent:
                handled = self.known.containsKey((r["file"], r["_file_md5"]))
                newer = current is None or (r["arrived"], r["file"]) >= current[:2] and r["_file_md5"] != current[2]
                r["role"] = "fail" if r["error"] is not None else "skip"
                if r["error"] is None and newer and not handled:
                    winner = r
            if winner:
                winner["role"] = "take"
                current = (winner["arrived"], winner["file"], winner["_file_md5"])
                self.current.update(current)
            for r in sent:
                self.known.updateValue((r["file"], r["_file_md5"]), (r["arrived"],))
            if current:
                old = [k for k, (arrived,) in self.known.iterator() if arrived < current[0] - known_seconds]
                for k in old:
                    self.known.removeKey(k)
            for r in sent:
                yield Row(**r)

        def close(self) -> None:
            pass

    return LatestFile()


def _apply_to(root: str, stream: str, after: FollowUp | None):
    """Applies the decisions of a micro-batch to bronze, follows up, logs, and drops the parsed records."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = f"{log_path(root)}/stream={stream}/batch={batch_id}"
        if path_exists(spark, f"{log}/_SUCCESS"):
            return
        started = datetime.now(timezone.utc)
        # Written once: the state is updated by exactly one run of the operator.
        marked = _stored(spark, batch, "roles")
        taken = marked.where("role = 'take'")
        months = touched_months(taken)
        batches = sorted(r["parsed"] for r in marked.select("parsed").distinct().collect())
        if months:
            have = {}
            for table in _PARSERS:
                files = [f"{parsed_path(root, stream, table)}/batch={b}" for b in batches]
                records = spark.read.schema(f"file STRING, {schemas.BRONZE[table][0]}").parquet(*files)
                sinks.write_bronze(records.join(taken.select("file", "_file_md5"), ["file", "_file_md5"], "left_semi"), root, table)
                some = taken.where(F.coalesce(F.col("row_counts")[table], F.lit(0)) > 0).select(*MONTH)
                have[table] = {tuple(r) for r in some.collect()}
            _clear_replaced(spark, root, have)
            if after:
                after(spark, months)
        n = F.aggregate(F.map_values("row_counts"), F.lit(0).cast("bigint"), lambda a, b: a + b)
        sinks.log_entries(marked.withColumn("n", n), started, datetime.now(timezone.utc)).write.mode("overwrite").parquet(log)
        for b in batches:
            for table in _PARSERS:
                delete_partition(spark, parsed_path(root, stream, table), {"batch": str(b)})

    return apply


class Ingestion:
    """A running ingestion of what has landed: parsing first, then deciding."""

    def __init__(self, parsing: StreamingQuery, decide: Callable[[], StreamingQuery]) -> None:
        self.parsing, self._decide, self.deciding = parsing, decide, None

    def awaitTermination(self) -> None:
        self.parsing.awaitTermination()
        self.deciding = self._decide()
        self.deciding.awaitTermination()


def _run(spark: SparkSession, source: DataFrame, to_cells, root: str, checkpoint: str, after: FollowUp | None,
         parsed_per_decision: int = PARSED_PER_DECISION) -> Ingestion:
    checkpoint = checkpoint.rstrip("/")
    stream = hashlib.md5(checkpoint.encode()).hexdigest()

    def started(df: DataFrame, step: str, action) -> StreamingQuery:
        return df.writeStream.foreachBatch(action).option("checkpointLocation", f"{checkpoint}/{step}").trigger(availableNow=True).start()

    def decide() -> StreamingQuery:
        parsed = spark.readStream.schema(_PARSED).option("recursiveFileLookup", "true").option(
            "maxFilesPerTrigger", parsed_per_decision).parquet(parsed_path(root, stream, "arrivals"))
        known = current_files(spark, root).select(*MONTH, "known.*").groupBy(*MONTH)
        before = spark.conf.get(_PROVIDER, None)
        # This kind of state is kept by RocksDB only; the query keeps the setting it was started with.
        spark.conf.set(_PROVIDER, _ROCKS)
        try:
            decided = parsed.groupBy(*MONTH).transformWithState(
                latest_file(), f"{_PARSED}, role STRING", "Append", "None", initialState=known)
            return started(decided, "decide", _apply_to(root, stream, after))
        finally:
            spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)

    return Ingestion(started(source, "parse", _parse_into(root, stream, to_cells)), decide)


def stream_cells(
    spark: SparkSession, landing: str, root: str, checkpoint: str, after: FollowUp | None = None,
    files_per_trigger: int = 1000, parsed_per_decision: int = PARSED_PER_DECISION,
) -> Ingestion:
    """Process landed Parquet files of decoded cells. A landing file holds whole workbooks."""
    source = (
        spark.readStream.schema(LANDED_CELLS)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(landing)
    )
    return _run(spark, source, lambda batch: batch, root, checkpoint, after, parsed_per_decision)


def stream_workbooks(
    spark: SparkSession, landing: str, root: str, checkpoint: str, after: FollowUp | None = None,
    files_per_trigger: int = 1000, parsed_per_decision: int = PARSED_PER_DECISION,
) -> Ingestion:
    """Process landed workbook files, then stop. The cells of a batch are decoded once and kept for its steps."""
    source = (
        spark.readStream.format("binaryFile")
        .schema(schemas.FILES)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", WORKBOOK_GLOB)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(landing)
    )

    def decode(batch: DataFrame) -> DataFrame:
        files = batch.select(F.col("path").alias("file"), F.md5("content").alias("_file_md5"),
                             F.unix_timestamp("modificationTime").alias("_arrived"))
        return _stored(batch.sparkSession, cells_of(batch).join(files, "file"), "cells")

    return _run(spark, source, decode, root, checkpoint, after, parsed_per_decision)


def refresh_staging(root: str, staged_root: str) -> FollowUp:
    """Follow-up that merges the touched months into the staged tables by key."""
    stagers = {
        schemas.LEDGER_TABLE: models.stage_ledger,
        schemas.EXPENSE_TABLE: models.stage_expenses,
        schemas.LEASE_TABLE: models.stage_lease,
    }

    def refresh(spark: SparkSession, months: list[str]) -> None:
        for table, stage in stagers.items():
            path = f"{staged_root.rstrip('/')}/{schemas.STAGED[table]}"
            staged = stage(read_bronze(spark, root, table, months), [schemas.PROPERTY])
            sinks.upsert_months(spark, staged, path, [schemas.PROPERTY, *schemas.BRONZE[table][1]])

    return refresh
