"""The monthly run: ingest, validate, build the models, forecast, export.

Stages are plain functions over stored tables, in order; any of them can be skipped. A stage reads what the stage
before it wrote, so a run that stops can start again at the failed stage.

Staging follows the files: it reads the bronze months that hold another file than the one they were staged from, and
replaces those months. Gold follows staging: facts, KPIs and NOI of a month depend on that month alone and are stored by month; the
trailing windows of a month reach the following months (``REACH``); the history takes up the changed months (``HistoryTable``).
So a new, late or re-sent month reads and writes what depends on it, whatever the length of the history. Dimensions, being small,
are built whole. ``full_refresh``, and a change of the settings that KPIs depend on, builds everything anew. A month counts as done when all
that depends on it is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leasemill import schemas
from leasemill.functions import vocabulary as V
from leasemill.operators import distinct, quality, windows
from leasemill.operators import forecast as fc
from leasemill.operators.history_table import HistoryTable
from leasemill.operators.incremental import touched_months
from leasemill.plans import models
from leasemill.sources import sinks
from leasemill.sources.bronze import delete_partition, path_exists, read_bronze
from leasemill.streaming import arrivals

STAGES = ("ingest", "quality", "models", "forecast", "export")
# The grain of every table: one property or a portfolio, the same run.
KEYS = [schemas.PROPERTY]
STAGERS = {
    schemas.STAGED[schemas.LEDGER_TABLE]: (schemas.LEDGER_TABLE, models.stage_ledger),
    schemas.STAGED[schemas.EXPENSE_TABLE]: (schemas.EXPENSE_TABLE, models.stage_expenses),
    schemas.STAGED[schemas.LEASE_TABLE]: (schemas.LEASE_TABLE, models.stage_lease),
}
# The files that bronze held when staging began, those of the last staging and of the last build that ended, and its settings.
SEEN, DONE, BUILT, SETTINGS = "_files_seen", "_files_staged", "_files_built", "_settings"
# Models stored by month, and how many months from a changed one on they have to be written anew.
REACH = {
    "fact_rent_monthly": 1,
    "fact_expense_monthly": 1,
    "prop_kpi_monthly": 1,
    "building_kpi_monthly": 1,
    "noi_monthly": 1,
    "kpi_windows": max(V.WINDOW_SIZES),
}
HISTORY = "snap_lease_rate_scd2"
# Suites of every tenant and month as sets that merge, and the numbers that suites have in them.
SETS, SUITE_NUMBERS = "tenant_suite_sets", "_suite_numbers"
SETS_SCHEMA = f"{schemas.PROPERTY} STRING, tenant STRING, word BIGINT, bits BIGINT, as_of_month STRING"
NUMBERS_SCHEMA = f"{schemas.PROPERTY} STRING, suite_id STRING, number BIGINT"
EXPORTS = ("prop_kpi_monthly", "building_kpi_monthly", "kpi_windows", "fact_expense_monthly")


@dataclass
class Run:
    """Settings of one run. ``root`` is a shared folder; bronze, staged and gold tables live below it.

    ``total_sqft`` is one area for every property, or a frame (property_id, total_sqft).
    """

    spark: SparkSession
    root: str
    landed: DataFrame | None = None
    total_sqft: int | DataFrame = V.TOTAL_SQFT
    exclude_own_use: bool = False
    full_refresh: bool = False
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    records: int = 0

    def bronze(self) -> str:
        return f"{self.root}/bronze"

    def gold(self, table: str) -> str:
        return f"{self.root}/gold/{table}"

    def read_gold(self, table: str) -> DataFrame:
        """A gold table. Those stored by month have a declared schema, for they may be without a single month."""
        if table == HISTORY:
            return self.history().read()
        reader = self.spark.read
        if table == SETS:
            reader = reader.schema(SETS_SCHEMA)
        elif table in STAGERS:
            reader = reader.schema(self.no_rows(table).schema)
        elif table in REACH:
            frames = monthly_models(self, *map(self.no_rows, STAGERS))
            reader = reader.schema(frames[table].schema)
        return reader.parquet(self.gold(table))

    def no_rows(self, staged_table: str) -> DataFrame:
        raw, stage = STAGERS[staged_table]
        return stage(self.spark.createDataFrame([], schemas.BRONZE[raw][0]), KEYS)

    def history(self) -> HistoryTable:
        return HistoryTable(self.spark, self.gold(HISTORY), keys=KEYS)

    def save(self, table: str, df: DataFrame) -> None:
        """Write a gold table and add its rows to the records of the running stage."""
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(self.gold(table))
        self.records += seen.get["n"]

    def save_months(self, table: str, df: DataFrame, months: Sequence[str] | None = None) -> None:
        """The same, by month: a later month filter reads that month's folder only. Given months are replaced, the others stay."""
        by = "end_month" if table == "kpi_windows" else sinks.PARTITION
        if months is not None and not months:
            return
        seen = Observation()
        observed = df.observe(seen, F.count(F.lit(1)).alias("n"))
        if months is None:
            observed.write.mode("overwrite").partitionBy(by).parquet(self.gold(table))
        else:
            for month in months:  # also those that have no rows any more
                delete_partition(self.spark, self.gold(table), {by: month})
            sinks.write_months(observed, self.gold(table), by)
        self.records += seen.get["n"]


def ingest(run: Run) -> None:
    if run.landed is not None:
        months = arrivals.ingest(run.spark, run.landed, run.bronze())
        # Counted from file metadata.
        run.records += sum(read_bronze(run.spark, run.bronze(), t, months).count() for t in schemas.BRONZE)


def validate(run: Run) -> None:
    tables = {t: read_bronze(run.spark, run.bronze(), t) for t in schemas.BRONZE}
    cases, summary = quality.validate_bronze(tables)
    sinks.write_failures(cases, run.bronze())
    # The log and the gate read the written summary, so bronze is checked once.
    run.save("quality_summary", summary)
    summary = run.read_gold("quality_summary")
    path = f"{run.root}/logs/quality_checks"
    sinks.append_log(sinks.check_entries(summary, run.run_id, datetime.now(timezone.utc)), path)
    quality.gate(summary)


def stale_months(run: Run, since: str = DONE) -> list[str] | None:
    """Months whose files are not those they were staged (or ``BUILT``) from; None where everything has to be done."""
    if run.full_refresh or not path_exists(run.spark, f"{run.gold(since)}/_SUCCESS"):
        return None
    return touched_months(run.read_gold(SEEN).subtract(run.read_gold(since)))


def mark(run: Run, step: str) -> None:
    """A step has taken up all files that were seen; without a log it is always done whole."""
    if path_exists(run.spark, arrivals.log_path(run.bronze())):
        run.read_gold(SEEN).write.mode("overwrite").parquet(run.gold(step))


def staged(run: Run, table: str, months: Sequence[str] | None) -> DataFrame:
    """A staged table's rows of some months, or of all; the month list reaches bronze as a partition filter."""
    raw, stage = STAGERS[table]
    return stage(read_bronze(run.spark, run.bronze(), raw, months), KEYS)


def stage_tables(run: Run) -> None:
    """Bring the staged tables up to the files of the ingestion log.

    The list of files is kept before bronze is read and becomes that of the staged ones at the end: a staging that stops
    is done again, and a file that arrives meanwhile is staged by the next run. Bronze without a log is always staged whole.
    """
    arrivals.current_files(run.spark, run.bronze()).write.mode("overwrite").parquet(run.gold(SEEN))
    months = stale_months(run)
    for table in STAGERS:
        run.save_months(table, staged(run, table, months), months)
    mark(run, DONE)


def months_from(months: Sequence[str], back: int, on: int) -> list[str]:
    """The calendar months from ``back`` before to ``on`` after each of the given ones."""
    numbers = {int(m[:4]) * 12 + int(m[5:]) - 1 + d for m in months for d in range(-back, on + 1)}
    return [f"{n // 12:04d}-{n % 12 + 1:02d}" for n in sorted(numbers)]


def monthly_models(run: Run, ledger: DataFrame, expenses: DataFrame, lease: DataFrame) -> dict[str, DataFrame]:
    """The models stored by month, from staged rows of any months; every month but of the windows depends on its own rows only."""
    rent, expense = models.fact_rent(ledger, KEYS), models.fact_expense(expenses, KEYS)
    kpi = models.prop_kpi(ledger, lease, run.total_sqft, run.exclude_own_use, KEYS)
    return {
        "fact_rent_monthly": rent,
        "fact_expense_monthly": expense,
        "prop_kpi_monthly": kpi,
        "building_kpi_monthly": models.building_kpi(ledger, lease, run.exclude_own_use, KEYS),
        "noi_monthly": models.noi(rent, expense, KEYS),
        "kpi_windows": windows.trailing_kpis(kpi, KEYS),
    }


def _settings(run: Run) -> str:
    """What the KPIs depend on besides the tables."""
    if not isinstance(run.total_sqft, DataFrame):
        return f"{run.exclude_own_use} {run.total_sqft}"
    digest = run.total_sqft.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*KEYS, "total_sqft").cast("decimal(38,0)"))).first()
    return f"{run.exclude_own_use} {digest[0]} {digest[1]}"


def _same_settings(run: Run, settings: str) -> bool:
    return path_exists(run.spark, run.gold(SETTINGS)) and run.spark.read.parquet(run.gold(SETTINGS)).first()[0] == settings


def build_months(run: Run, months: Sequence[str] | None) -> None:
    """Write the monthly models of the given months and of those they reach, from the staged rows of these months; None: of all."""
    def read(chosen: Sequence[str] | None) -> list[DataFrame]:
        frames = [run.read_gold(t) for t in STAGERS]
        return frames if chosen is None else [df.where(F.col(sinks.PARTITION).isin(list(chosen))) for df in frames]

    frames = monthly_models(run, *read(months))
    for table in ("fact_rent_monthly", "fact_expense_monthly", "prop_kpi_monthly", "building_kpi_monthly"):
        run.save_months(table, frames[table], months)
    of = (lambda t: run.read_gold(t)) if months is None else (lambda t: run.read_gold(t).where(F.col(sinks.PARTITION).isin(list(months))))
    run.save_months("noi_monthly", models.noi(of("fact_rent_monthly"), of("fact_expense_monthly"), KEYS), months)

    kpi, reach = run.read_gold("prop_kpi_monthly"), REACH["kpi_windows"] - 1
    if months is None:
        run.save_months("kpi_windows", windows.trailing_kpis(kpi, KEYS))
    else:
        # An end month needs the months before it that its windows hold.
        near = kpi.where(F.col(sinks.PARTITION).isin(months_from(months, reach, reach)))
        ends = months_from(months, 0, reach)
        run.save_months("kpi_windows", windows.trailing_kpis(near, KEYS).where(F.col("end_month").isin(ends)), ends if months else [])


def build_history(run: Run, months: Sequence[str] | None) -> None:
    """The history of all months anew, or with the given months taken up in order."""
    table, lease = run.history(), run.read_gold("stg_lease_rate")
    if months is None or not table.exists():
        table.rebuild(lease)
        return
    for month in sorted(months):
        table.take(month, lease)


def build_sets(run: Run, months: Sequence[str] | None) -> None:
    """Every tenant's suites by month as sets that merge (``distinct.counts_by_window``), of the given months or of all.

    Numbers once given to suites stay, also over a full refresh: a stage that stops halfway leaves no set with another's numbers.
    """
    lease = run.read_gold("stg_lease_rate")
    if not path_exists(run.spark, run.gold(SETS)):
        months = None
    if months is not None:
        if not months:
            return
        lease = lease.where(F.col(sinks.PARTITION).isin(list(months)))
    path, value = run.gold(SUITE_NUMBERS), "suite_id"
    reader = run.spark.read.schema(NUMBERS_SCHEMA)
    known = reader.parquet(path) if path_exists(run.spark, path) else None
    distinct.new_numbers(known, lease, value, KEYS).write.mode("append").parquet(path)
    sets = distinct.words(lease, reader.parquet(path), value, [*KEYS, "tenant", sinks.PARTITION], KEYS)
    run.save_months(SETS, sets, months)


def build_models(run: Run) -> None:
    """Stage, then dimensions, facts, KPIs, windows and history of what changed; shared inputs are read from what was saved."""
    settings = _settings(run)
    stage_tables(run)
    months = stale_months(run, BUILT)
    ledger, lease = run.read_gold("stg_dashboard_monthly"), run.read_gold("stg_lease_rate")
    if months is None or months:
        run.save("dim_suite", models.dim_suite(lease, KEYS))
        run.save("dim_tenant", models.dim_tenant(lease, KEYS))
        run.save("dim_calendar_month", models.dim_calendar(ledger))
    build_months(run, months if _same_settings(run, settings) else None)
    build_history(run, months)
    build_sets(run, months)
    # Failed model tests are recorded, not fatal: some declared uniqueness does not hold for a changing roster.
    names = sorted({model for model, *_ in quality.MODEL_TESTS})
    run.save("model_tests", quality.model_tests({n: run.read_gold(n) for n in names}))
    run.spark.createDataFrame([(settings,)], "settings STRING").coalesce(1).write.mode("overwrite").parquet(run.gold(SETTINGS))
    mark(run, BUILT)


def build_forecast(run: Run) -> None:
    series = fc.long_series(run.read_gold("prop_kpi_monthly"), KEYS, exclude_own_use=run.exclude_own_use)
    sinks.write_forecast(fc.wide(fc.forecast(series, KEYS), KEYS), f"{run.root}/gold")


def export(run: Run) -> None:
    sinks.export_csv(run.spark, {t: run.read_gold(t) for t in EXPORTS}, f"{run.root}/exports")


_ACTIONS = {
    "ingest": ingest,
    "quality": validate,
    "models": build_models,
    "forecast": build_forecast,
    "export": export,
}


def run_stages(run: Run, skip: Sequence[str] = ()) -> list[str]:
    """Run the stages in order; every stage gets a run-log row, the first failure ends the run."""
    done = []
    for stage in STAGES:
        if stage in skip:
            continue
        started = datetime.now(timezone.utc)
        status, error, run.records = "success", None, 0
        try:
            _ACTIONS[stage](run)
            done.append(stage)
        except Exception as failure:
            status, error = "failed", str(failure).splitlines()[0]
            raise
        finally:
            entry = sinks.run_entry(run.spark, stage, status, started, datetime.now(timezone.utc), run.records, error,
                                    details={"run": run.run_id})
            sinks.append_log(entry, f"{run.root}/logs/pipeline_runs")
    return done
