"""Every operator and model as a query over the star-schema tables.

``present`` renders a result for comparison with another engine: decimals and doubles as doubles with six places,
integers as bigint, dates as text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leasemill import schemas
from leasemill.functions import expressions as X
from leasemill.functions import vocabulary as V
from leasemill.operators import clean, distinct, history, incremental, quality, smoothing, windows
from leasemill.operators import forecast as fc
from leasemill.operators.history_table import HistoryTable
from leasemill.plans import dashboard, models, refresh, reports, table_functions
from leasemill.session import shared_folder
from leasemill.sources import bronze, grid, sinks, star, workbook
from leasemill.streaming import arrivals

Query = Callable[[SparkSession, str], DataFrame]

PLACES = 6


def present(df: DataFrame, places: int = PLACES) -> DataFrame:
    def render(name: str, kind: T.DataType) -> str:
        if isinstance(kind, (T.DecimalType, T.DoubleType)):
            return f"round(cast(`{name}` AS double), {places}) AS `{name}`"
        if isinstance(kind, T.IntegralType):
            return f"cast(`{name}` AS bigint) AS `{name}`"
        if isinstance(kind, T.DateType):
            return f"date_format(`{name}`, 'yyyy-MM-dd') AS `{name}`"
        return f"`{name}`"

    return df.selectExpr(*[render(f.name, f.dataType) for f in df.schema.fields])


class Portfolio:
    """Frames over one set of tables. ``by_property`` carries the property id through every model."""

    def __init__(self, spark: SparkSession, sf_dir: str, by_property: bool = False):
        self.spark, self.sf_dir, self.by_property = spark, sf_dir, by_property
        self.keys = star.PROPERTY if by_property else []

    def stored(self, *names: str) -> Portfolio:
        """The same portfolio over written tables: for queries that read them several times.

        Lines and orders are then joined once, whatever number of branches the query has.
        """
        copy = Portfolio(self.spark, self.sf_dir, self.by_property)
        for name in names:
            copy.__dict__[name] = _stored(self.spark, getattr(self, name), name)
        if "raw_lease" in names and not self.by_property:
            copy.__dict__["lease_months"] = copy.raw_lease.select("as_of_month")
        return copy

    def stored_prop(self) -> DataFrame:
        return _stored(self.spark, self.prop(), "prop")

    def stored_building(self, revenue_sqft: bool = False) -> DataFrame:
        return _stored(self.spark, self.building(revenue_sqft=revenue_sqft), "building")

    @cached_property
    def raw_ledger(self) -> DataFrame:
        return star.ledger(self.spark, self.sf_dir, self.by_property)

    @cached_property
    def raw_lease(self) -> DataFrame:
        return star.lease(self.spark, self.sf_dir, self.by_property)

    @cached_property
    def raw_expenses(self) -> DataFrame:
        return star.expenses(self.spark, self.sf_dir, self.by_property)

    @cached_property
    def lease_months(self) -> DataFrame:
        return star.lease_months(self.spark, self.sf_dir)

    @cached_property
    def ledger(self) -> DataFrame:
        return models.stage_ledger(self.raw_ledger, self.keys)

    @cached_property
    def lease(self) -> DataFrame:
        return models.stage_lease(self.raw_lease, self.keys)

    @cached_property
    def expenses(self) -> DataFrame:
        return models.stage_expenses(self.raw_expenses, self.keys)

    def prop(self, exclude_own_use: bool = False, revenue_sqft: bool = False) -> DataFrame:
        return models.prop_kpi(self.ledger, self.lease, V.TOTAL_SQFT, exclude_own_use, self.keys, revenue_sqft)

    def building(self, exclude_own_use: bool = False, revenue_sqft: bool = False) -> DataFrame:
        return models.building_kpi(self.ledger, self.lease, exclude_own_use, self.keys, revenue_sqft)

    @cached_property
    def areas(self) -> DataFrame:
        """An area for every property but one: the largest leased area of its months."""
        return self.ledger.where("property_id <> '3'").groupBy(*self.keys).agg(F.max("leased_sqft").alias("total_sqft"))

    @cached_property
    def rent(self) -> DataFrame:
        return models.fact_rent(self.ledger, self.keys)

    @cached_property
    def expense(self) -> DataFrame:
        return models.fact_expense(self.expenses, self.keys)

    @cached_property
    def series(self) -> DataFrame:
        return fc.long_series(self.prop(), self.keys)


def _audit_free(df: DataFrame) -> DataFrame:
    return df.drop("_file_md5", "_ingested_at", "ingested_at")


def _stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back as a stored table."""
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _landed(spark: SparkSession, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells as a stored landing table, and the month of every file."""
    landed = _stored(spark, cells, "cells")
    return landed, clean.detect_months(landed, "1900-01").select("file", "as_of_month")


# --- sources and cleaning ----------------------------------------------------------------------------------


def partition_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze write, hive-partitioned read, month filter on the partition column."""
    root = shared_folder(spark, "bronze")
    sinks.write_bronze(Portfolio(spark, sf_dir).raw_ledger, root, schemas.LEDGER_TABLE)
    stored = bronze.read_bronze(spark, root, schemas.LEDGER_TABLE)
    return _audit_free(stored.where(F.col("as_of_month") >= "2000-01")).drop(schemas.PROPERTY)


def bronze_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored expenses as a named view over all month folders, read with SQL."""
    root = shared_folder(spark, "bronze")
    sinks.write_bronze(Portfolio(spark, sf_dir).raw_expenses, root, schemas.EXPENSE_TABLE)
    bronze.register_views(spark, {"stored_expenses": bronze.table_path(root, schemas.EXPENSE_TABLE)})
    return spark.sql(
        "SELECT as_of_month, expense_category, count(*) AS items, max(actual) AS largest "
        "FROM stored_expenses GROUP BY as_of_month, expense_category"
    )


def partition_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A re-sent year replaces its months and leaves the others alone."""
    root = shared_folder(spark, "bronze")
    raw = Portfolio(spark, sf_dir).raw_ledger
    sinks.write_bronze(raw, root, schemas.LEDGER_TABLE)
    resent = raw.where(F.col("as_of_month").startswith("1996")).withColumn("collected", F.col("rent_base"))
    sinks.write_bronze(resent, root, schemas.LEDGER_TABLE)
    return bronze.read_bronze(spark, root, schemas.LEDGER_TABLE).select("as_of_month", "rent_base", "collected")


def grid_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, months = _landed(spark, star.ledger_cells(spark, sf_dir))
    return grid.ledger_records(cells, months).drop("file")


def grid_expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, months = _landed(spark, star.ledger_cells(spark, sf_dir))
    return grid.expense_records(cells, months).drop("file")


def grid_lease(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, months = _landed(spark, star.lease_cells(spark, sf_dir))
    return grid.lease_records(cells, months).drop("file")


def sheet_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks with differing sheet names; first pattern wins, then the first sheet."""
    names = F.array(
        F.struct(F.lit("Notes").alias("sheet"), F.lit(1).alias("sheet_no")),
        F.struct(F.concat(F.lit("Plan "), F.substring("as_of_month", 1, 4)).alias("sheet"), F.lit(2).alias("sheet_no")),
        F.struct(
            F.when(F.substring("as_of_month", 6, 2) < "07", "DASHBOARD old").otherwise("Summary 2025").alias("sheet"),
            F.lit(3).alias("sheet_no"),
        ),
        F.struct(F.lit("My Dashboard").alias("sheet"), F.lit(4).alias("sheet_no")),
    )
    months = Portfolio(spark, sf_dir).raw_ledger.select("as_of_month")
    sheets = months.select(star.file_name(F.col("as_of_month")).alias("file"), F.inline(names))
    return clean.pick_sheets(sheets, V.LEDGER_SHEET_PATTERNS)


def alias_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names stand in for headers: known wording maps, anything else is only tidied."""
    header = (
        F.when(F.col("p_size") % 4 == 0, F.lit(" Inquilino "))
        .when(F.col("p_size") % 4 == 1, F.lit("RENTA MENSUAL"))
        .when(F.col("p_size") % 4 == 2, F.lit("$/SF/Yr"))
        .otherwise(F.initcap("p_name"))
    )
    headers = star.table(spark, sf_dir, "part").select("p_partkey", header.alias("header"))
    return headers.select(
        "p_partkey",
        clean.canonical_name(F.col("header"), V.LEASE_ALIASES).alias("lease_column"),
        clean.canonical_name(F.col("header"), V.LEDGER_ALIASES).alias("ledger_column"),
    )


def alias_every_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every known header wording, padded and in capitals, and an unknown one, under the aliases of each worksheet."""
    wording = [*dict.fromkeys([*V.LEDGER_ALIASES, *V.EXPENSE_ALIASES, *V.LEASE_ALIASES]), "Note"]
    place = F.col("p_partkey") % len(wording)
    header = F.concat(F.lit(" "), F.upper(F.element_at(F.array(*map(F.lit, wording)), place.cast("int") + 1)), F.lit("  "))
    tables = {"ledger_column": V.LEDGER_ALIASES, "expense_column": V.EXPENSE_ALIASES, "lease_column": V.LEASE_ALIASES}
    return star.table(spark, sf_dir, "part").select(
        "p_partkey", *[clean.canonical_name(header, aliases).alias(name) for name, aliases in tables.items()])


def expense_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expense sheets with their own headers, Spanish in even months: read by alias, numbers coerced, the variance filled in."""
    cells = _stored(spark, star.expense_sheet_cells(spark, sf_dir), "cells")
    return grid.expense_sheet_records(cells)


def clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty rows and the empty column go, text is trimmed."""
    orders = star.table(spark, sf_dir, "orders")
    kept = F.col("o_orderstatus") != "P"
    padded = orders.select(
        F.when(kept, F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" "))).alias("priority"),
        F.when(kept, F.col("o_orderkey")).alias("order_key"),
        F.lit(None).cast("string").alias("empty"),
    )
    return clean.drop_empty(padded)


def numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers, decimals and exponents survive; text and currency marks become null."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    text = (
        F.when(key % 5 == 0, F.concat(F.lit(" "), price, F.lit(" ")))
        .when(key % 5 == 1, F.concat(F.lit("$"), price))
        .when(key % 5 == 2, F.lit("n/a"))
        .when(key % 5 == 3, F.concat(key.cast("string"), F.lit("e2")))
        .otherwise(F.concat(F.lit("-"), price))
    )
    return star.table(spark, sf_dir, "orders").select("o_orderkey", X.number(text).alias("value"))


def lease_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags and building re-derived from the wording; a third of the tenants is missing or blank."""
    lease = Portfolio(spark, sf_dir).lease
    gap = F.length("suite_id") + F.substring("as_of_month", 6, 2).cast("int")
    tenant = F.when(gap % 3 == 0, F.lit(None)).when(gap % 3 == 1, F.col("tenant")).otherwise(F.upper("tenant"))
    worded = lease.withColumn("wording", tenant)
    return worded.select(
        "as_of_month",
        "suite_id",
        X.building_of(F.col("suite_id")).alias("building"),
        X.is_vacant(F.col("wording")).alias("is_vacant"),
        X.is_own_use(F.col("wording"), F.col("suite_id")).alias("is_own_use"),
    )


def as_of_month_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months found by each of the four rules; clutter that must not match is mixed in."""
    month = F.col("month")
    kind = X.month_number(month) % 4

    def cell(sheet: str, number: int, row: int, col: int, value: Column) -> Column:
        return F.struct(
            F.lit(sheet).alias("sheet"), F.lit(number).alias("sheet_no"), F.lit(row).alias("row"),
            F.lit(col).alias("col"), value.cast("string").alias("value"),
        )

    day = F.date_format(month, "yyyy-MM-dd")
    found = F.array(
        cell("Dashboard", 1, 1, 1, F.lit("Overview")),
        F.when(kind == 0, cell("Dashboard", 1, 29, 2, F.lit("Month"))),
        F.when(kind == 0, cell("Dashboard", 1, 31, 2, day)),
        F.when(kind == 0, cell("Dashboard", 1, 35, 2, F.lit("1990-01-01"))),
        F.when(kind <= 1, cell("Notes", 2, 60, 1, F.lit("Period"))),
        F.when(kind <= 1, cell("Notes", 2, 60, 2, F.lit("1991-01-01"))),
        F.when(kind == 1, cell("Notes", 2, 7, 3, F.lit("Reporting PERIOD:"))),
        F.when(kind == 1, cell("Notes", 2, 7, 4, F.lit("see right"))),
        F.when(kind == 1, cell("Notes", 2, 7, 5, day)),
    )
    name = F.when(kind == 2, F.concat(F.lit("in/report_20"), F.date_format(month, "yy-MM"), F.lit("_final.xlsx")))
    cells = (
        Portfolio(spark, sf_dir)
        .raw_ledger.select(
            F.coalesce(name, F.concat(F.lit("in/upload "), F.date_format(month, "MMMyyyy"), F.lit(".xlsx"))).alias("file"),
            F.explode(F.filter(found, lambda c: c.isNotNull())).alias("c"),
        )
        .select("file", "c.*")
    )
    return clean.detect_months(_stored(spark, cells, "cells"), "1999-12")


def landing_path_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload paths built from orders; wrong roots and endings are dropped."""
    key = F.col("o_orderkey")
    path = F.concat_ws(
        "/",
        F.when(key % 7 == 0, "tmp").otherwise("raw"),
        F.concat(F.lit("org"), (F.col("o_custkey") % 5).cast("string")),
        F.concat(F.lit("b"), (F.col("o_custkey") % 3).cast("string")),
        F.date_format("o_orderdate", "yyyy/MM/dd"),
        F.concat((F.lit(1_700_000_000) + key).cast("string"), F.lit("-book "), key.cast("string"),
                 F.when(key % 5 == 0, ".csv").when(key % 5 == 1, ".xls").otherwise(".xlsx")),
    )
    paths = star.table(spark, sf_dir, "orders").select(path.alias("path"))
    return bronze.landing_parts(paths).withColumn(
        "converted", bronze.converted_path(F.col("path"), F.lit("Lease Rate/A"))
    )


def sheet_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-empty sheet written to its own folder; rows counted per folder."""
    rows = workbook.sheet_rows(_stored(spark, star.cells(spark, sf_dir), "cells"))
    path = shared_folder(spark, "sheets")
    sinks.write_sheets(rows, path)
    stored = bronze.read_partitioned(spark, path)
    return stored.groupBy("file", "sheet_safe").agg(F.count(F.lit(1)).alias("row_count"))


def sheet_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook per region with two sheets of different headers, each written with its own columns; the accounts of all of them."""
    nations = star.table(spark, sf_dir, "nation")
    owned = star.table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    file = F.concat(F.lit("book_"), F.col("n_regionkey").cast("string"))

    def sheet(df: DataFrame, name: str, number: int, row: Column, values: list[Column]) -> DataFrame:
        cells = F.array(*[F.struct(row.cast("int").alias("row"), F.lit(i + 1).alias("col"), v.cast("string").alias("value")) for i, v in enumerate(values)])
        return df.select(file.alias("file"), F.lit(name).alias("sheet"), F.lit(number).alias("sheet_no"), F.inline(cells))

    accounts = [F.col("c_custkey"), F.concat(F.lit(" "), F.col("c_name")), F.col("c_acctbal").cast("decimal(12,2)"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"),
                F.col("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise("odd")]
    regions = nations.select("n_regionkey").distinct()
    head = [F.lit(v) for v in ("Key", " Name", "Balance", "Code", None, "Key")]
    cells = sheet(owned, "Key Accounts", 1, F.col("c_custkey") + 7, accounts).unionByName(sheet(regions, "Key Accounts", 1, F.lit(3), head))
    cells = cells.unionByName(sheet(nations, "Nations/All", 2, F.col("n_nationkey") + 2, [F.col("n_name"), F.col("n_nationkey")]))
    cells = cells.unionByName(sheet(regions, "Nations/All", 2, F.lit(1), [F.lit("Nation"), F.lit("Number")]))
    path = shared_folder(spark, "sheets")
    sinks.write_sheet_tables(workbook.sheet_tables(_stored(spark, cells, "cells")), path)
    return sinks.read_sheets(spark, path, "Key_Accounts", [f"book_{r[0]}" for r in regions.collect()])


def rent_psf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guarded yearly rent per area; every seventh suite loses its area."""
    lease = Portfolio(spark, sf_dir).lease
    area = F.when(F.col("sqft") % 7 != 0, F.col("sqft"))
    return lease.select("as_of_month", "suite_id", X.ratio(F.col("rent_annual"), area).alias("rent_psf"))


# --- incremental and history -------------------------------------------------------------------------------


def _files(p: Portfolio) -> DataFrame:
    return p.raw_ledger.select(
        star.file_name(F.col("as_of_month")).alias("file"), "_file_md5", "as_of_month"
    )


def file_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months before 1999 are stored; every file arrives again, some under two names."""
    p = Portfolio(spark, sf_dir)
    files = _files(p)
    twice = files.where(F.col("as_of_month") >= "2000-06").withColumn("file", F.concat(F.lit("z_"), F.col("file")))
    stored = p.raw_lease.where(F.col("as_of_month") < "1999-01")
    return incremental.unseen(files.unionByName(twice), stored)


def incremental_new_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Portfolio(spark, sf_dir)
    loaded = p.ledger.where(F.col("as_of_month") <= "1999-06")
    return _audit_free(incremental.newer_months(p.ledger, loaded))


def upsert_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suites of building B re-sent with new rents for 1997; building A and all other months stay."""
    lease = _audit_free(Portfolio(spark, sf_dir).stored("raw_lease").lease)
    batch = lease.where(F.col("as_of_month").startswith("1997") & (F.col("building") == "B")).withColumn(
        "rent_monthly", F.col("rent_monthly") + X.money(F.lit(100))
    )
    return incremental.upsert(lease, batch, ["as_of_month", "suite_id"]).select(
        "as_of_month", "suite_id", "building", "sqft", "rent_monthly"
    )


def full_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Portfolio(spark, sf_dir)
    stale = p.expenses.where(F.col("as_of_month") < "1996-01")
    return _audit_free(incremental.load(p.expenses, stale, ["as_of_month", "month", "item"], "full"))


def late_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month that arrives late is loaded because work follows the touched months."""
    p = Portfolio(spark, sf_dir).stored("raw_ledger")
    loaded = p.ledger.where(F.col("as_of_month") != "1998-03")
    batch = p.ledger.where(F.col("as_of_month") == "1998-03")
    return _audit_free(incremental.load(batch, loaded, ["as_of_month", "month"], "touched"))


def _built(p: Portfolio, months: Column | None = None) -> refresh.Run:
    """A run over bronze tables and a log that have the given months of the portfolio, by property."""
    run = refresh.Run(p.spark, shared_folder(p.spark, "run"))
    _land(run, p, F.lit(True) if months is None else months)
    return run


def _land(run: refresh.Run, p: Portfolio, months: Column, factor: int = 1) -> None:
    """Rows of some months arrive in bronze, their rents multiplied, and in the log."""
    raw = p.raw_ledger.where(months).withColumn("collected", F.col("collected") * factor)
    for table, df in ((schemas.LEDGER_TABLE, raw), (schemas.EXPENSE_TABLE, p.raw_expenses.where(months)), (schemas.LEASE_TABLE, p.raw_lease.where(months))):
        sinks.write_bronze(df, run.bronze(), table)
    arrived = F.unix_micros(F.current_timestamp())
    files = raw.select(*p.keys, F.concat_ws("-", "as_of_month", F.lit(str(factor))).alias("file"), F.md5(F.lit(str(factor))).alias("_file_md5"),
                       "as_of_month", arrived.alias("arrived"), F.lit("take").alias("role"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("n"))
    now = datetime(2025, 1, 1)
    sinks.append_log(sinks.log_entries(files, now, now), arrivals.log_path(run.bronze()))


def gold_after_late_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold is built without a month and with a wrong one; both arrive later, and what depends on them is written: windows, with the month's own NOI."""
    p = Portfolio(spark, sf_dir, by_property=True).stored("raw_ledger", "raw_lease", "raw_expenses")
    month = F.col("as_of_month")
    run = _built(p, ~month.isin("1998-03", "2000-11"))
    _land(run, p, month == "2000-11", factor=3)
    refresh.stage_tables(run)
    refresh.build_months(run, None)
    refresh.mark(run, refresh.BUILT)
    _land(run, p, month.isin("1998-03", "2000-11"))
    refresh.stage_tables(run)
    refresh.build_months(run, refresh.stale_months(run, refresh.BUILT))
    noi = run.read_gold("noi_monthly").select(*p.keys, month.alias("end_month"), "noi")
    return run.read_gold("kpi_windows").join(noi, [*p.keys, "end_month"])


def scd2_lease(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Portfolio(spark, sf_dir).stored("raw_lease")
    return _audit_free(history.versions(p.lease, one_row_per_month=True, months=p.lease_months))


def scd2_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored history takes up months out of order: two late ones, one that is sent again with its right rents, and the newest."""
    p = Portfolio(spark, sf_dir, by_property=True).stored("raw_lease")
    lease = p.lease
    late, wrong, newest = ("1995-01", "1998-03"), "1997-05", "2001-07"
    started = lease.where(~F.col("as_of_month").isin(*late) & (F.col("as_of_month") < newest))
    mistaken = F.when(F.col("as_of_month") == wrong, F.col("rent_monthly") + 1).otherwise(F.col("rent_monthly"))
    table = HistoryTable(spark, shared_folder(spark, "history"), keys=p.keys)
    table.rebuild(started.withColumn("rent_monthly", mistaken.cast(lease.schema["rent_monthly"].dataType)))
    after = [r[0] for r in lease.where(F.col("as_of_month") >= newest).select("as_of_month").distinct().collect()]
    for month in [late[1], wrong, *sorted(after, reverse=True), late[0]]:
        table.take(month, lease)
    return table.read().select("property_id", "suite_id", "version", "valid_from", "valid_to", "is_current", "tenant", "rent_monthly", "sqft", "as_of_month")


def scd2_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of tenant and vacancy only."""
    p = Portfolio(spark, sf_dir).stored("raw_lease")
    versions = history.versions(
        p.lease.select("as_of_month", "suite_id", "tenant", "is_vacant"), checked=("tenant", "is_vacant"),
        one_row_per_month=True, months=p.lease_months,
    )
    return versions.drop("as_of_month")


def scd2_by_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Portfolio(spark, sf_dir, by_property=True).stored("raw_lease")
    versions = history.versions(_audit_free(p.lease), keys=p.keys, one_row_per_month=True)
    return versions.select(
        "property_id", "suite_id", "version", "valid_from", "valid_to", "is_current", "tenant", "rent_monthly"
    )


def scd2_hard_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suites that were missing from a snapshot: when, and when they came back."""
    p = Portfolio(spark, sf_dir).stored("raw_lease")
    versions = history.versions(
        p.lease.select("as_of_month", "suite_id", "is_vacant"), checked=("is_vacant",), one_row_per_month=True,
        months=p.lease_months,
    )
    return history.hard_deletes(versions).select("suite_id", "version", "valid_from", "valid_to", "returned_in")


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Portfolio(spark, sf_dir).stored("raw_lease")
    return _audit_free(windows.latest(p.lease, months=p.lease_months))


def latest_snapshot_by_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Portfolio(spark, sf_dir, by_property=True).stored("raw_lease")
    return _audit_free(windows.latest(p.lease, keys=p.keys))


# --- quality -----------------------------------------------------------------------------------------------


def _flawed_lease(p: Portfolio) -> DataFrame:
    """Bronze lease rows with known damage."""
    area, month = F.col("sqft").cast("bigint"), F.col("as_of_month")
    return p.raw_lease.withColumns(
        {
            "sqft": F.when(area % 11 == 0, -F.col("sqft")).otherwise(F.col("sqft")),
            "building": F.when(area % 13 == 0, "C").when(area % 17 == 0, None).otherwise(F.col("building")),
            "tenant": F.when((area % 19 == 0) & (month > "1998"), None).otherwise(F.col("tenant")),
        }
    )


def quality_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality.bronze_rules(schemas.LEASE_TABLE)
    return quality.failure_cases(
        _flawed_lease(Portfolio(spark, sf_dir)), schemas.LEASE_TABLE, rules, ["as_of_month", "suite_id"]
    )


def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality.bronze_rules(schemas.LEASE_TABLE)
    summary = quality.check_summary(_flawed_lease(Portfolio(spark, sf_dir)), schemas.LEASE_TABLE, rules)
    return summary


def quality_bronze_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Portfolio(spark, sf_dir)
    tables = {
        schemas.LEDGER_TABLE: p.raw_ledger,
        schemas.EXPENSE_TABLE: p.raw_expenses,
        schemas.LEASE_TABLE: _flawed_lease(p),
    }
    return quality.partition_verdicts(quality.validate_bronze(tables)[1])


def quality_type_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that does not coerce is counted per month."""
    orders = star.table(spark, sf_dir, "orders")
    amount = F.when(F.col("o_orderkey") % 6 == 0, F.lit("unknown")).otherwise(F.col("o_totalprice").cast("string"))
    typed = orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("as_of_month"), amount.alias("amount"))
    return quality.check_summary(typed, "orders", [quality.coercible("amount", "double"), quality.not_null("amount")])


def lease_suite_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots in which every eleventh area comes twice and the flags of own use are lost for every thirteenth."""
    raw = Portfolio(spark, sf_dir).raw_lease
    area = F.col("sqft").cast("bigint")
    flawed = raw.withColumn("is_own_use", F.when(area % 13 == 0, False).otherwise(F.col("is_own_use")))
    return quality.lease_suite_rules(flawed.unionByName(flawed.where(area % 11 == 0)))


def quality_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicates(models.dim_suite(Portfolio(spark, sf_dir).lease), ["suite_id"])


def quality_accepted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Portfolio(spark, sf_dir)
    only_two = [quality.accepted("expense_category", ["fixed", "variable"])]
    return quality.check_summary(p.expenses, "stg_expenses_monthly", only_two)


def quality_dimensions_by_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tests of the dimensions of a portfolio: a suite or tenant of two properties is no repetition."""
    p = Portfolio(spark, sf_dir, by_property=True).stored("raw_lease")
    frames = {"dim_suite": models.dim_suite(p.lease, p.keys), "dim_tenant": models.dim_tenant(p.lease, p.keys)}
    return quality.model_tests(frames)


def quality_model_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared tests of every model."""
    p = Portfolio(spark, sf_dir).stored("raw_ledger", "raw_lease", "raw_expenses")
    lease = p.lease
    prop = p.prop()
    return quality.model_tests(
        {
            "stg_dashboard_monthly": p.ledger,
            "stg_expenses_monthly": p.expenses,
            "stg_lease_rate": lease,
            "dim_suite": models.dim_suite(lease),
            "dim_tenant": models.dim_tenant(lease),
            "fact_rent_monthly": p.rent,
            "fact_expense_monthly": p.expense,
            "prop_kpi_monthly": prop,
            "building_kpi_monthly": p.building(),
            "kpi_windows": windows.trailing_kpis(prop),
            "snap_lease_rate_scd2": history.versions(lease, one_row_per_month=True, months=p.lease_months),
            "dim_calendar_month": models.dim_calendar(p.ledger),
        }
    )


def kpi_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI arithmetic and plausibility, per rule."""
    p = Portfolio(spark, sf_dir).stored("raw_ledger", "raw_lease")
    parts = [
        quality.check_summary(p.prop(), "prop_kpi_monthly", quality.prop_kpi_rules(), ()),
        quality.check_summary(p.rent, "fact_rent_monthly", quality.rent_rules(), ()),
        quality.check_summary(p.raw_ledger, schemas.LEDGER_TABLE, quality.ledger_sanity_rules(), ()),
        quality.check_summary(p.raw_lease, schemas.LEASE_TABLE, quality.lease_sanity_rules(), ()),
    ]
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def reconcile_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze ledger against a KPI layer that lost a year and has one changed year."""
    p = Portfolio(spark, sf_dir).stored("raw_ledger")
    year = F.substring("as_of_month", 1, 4)
    changed = (
        p.rent.where(year != "1996")
        .withColumn("collected", F.when(year == "1999", F.col("rent_base")).otherwise(F.col("collected")))
    )
    return quality.reconcile(p.ledger, changed, ["as_of_month", "month"], ["rent_base", "collected", "leased_sqft"])


def reconcile_by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layers of ``reconcile_layers``: only the months whose digests differ are joined."""
    p = Portfolio(spark, sf_dir).stored("raw_ledger")
    year = F.substring("as_of_month", 1, 4)
    changed = p.rent.where(year != "1996").withColumn(
        "collected", F.when(year == "1999", F.col("rent_base")).otherwise(F.col("collected")))
    return quality.reconcile_by_digest(p.ledger, changed, ["as_of_month", "month"], ["rent_base", "collected", "leased_sqft"])


def layer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Portfolio(spark, sf_dir).stored("raw_ledger")
    layers = {"bronze": p.raw_ledger, "staging": p.ledger, "mart": p.rent, "gold": p.prop()}
    return quality.layer_totals(layers, ["rent_base", "collected", "leased_sqft"])


def freshness_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Portfolio(spark, sf_dir).stored("raw_ledger", "raw_lease")
    return quality.freshness(
        {"prop_kpi_monthly": p.prop(), "building_kpi_monthly": p.building(), "dim_suite": models.dim_suite(p.lease)}
    )


def quarantine_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing cases written by table and month, then counted from the stored report."""
    root = shared_folder(spark, "quarantine")
    sinks.write_failures(quality_failures(spark, sf_dir), root)
    stored = bronze.read_partitioned(spark, f"{root}/_errors")
    return stored.groupBy("table_name", "as_of_month", "column", "check").agg(F.count(F.lit(1)).alias("cases"))


def check_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check-log rows as appended to the log table."""
    summary = quality_summary(spark, sf_dir)
    path = shared_folder(spark, "checks")
    sinks.append_log(sinks.check_entries(summary, "run", datetime(2025, 1, 1)), path)
    return spark.read.schema(schemas.QUALITY_CHECKS).parquet(path).drop("check_timestamp")


def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per category and flag counts per month, as the ingester logs them."""
    p = Portfolio(spark, sf_dir)
    by_category = grid.row_count_by_category(p.raw_expenses).groupBy("as_of_month").agg(
        *[F.max(F.when(F.col("expense_category") == c, F.col("records"))).alias(c) for c in V.EXPENSE_CATEGORIES]
    )
    return grid.lease_flag_counts(p.raw_lease).join(by_category, "as_of_month", "left").na.fill(
        0, list(V.EXPENSE_CATEGORIES)
    )


# --- forecast ----------------------------------------------------------------------------------------------


def forecast_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.wide(fc.forecast(Portfolio(spark, sf_dir).series))


def forecast_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per calendar year: at most twelve points, too short for the seasonal model."""
    yearly = Portfolio(spark, sf_dir).series.withColumn("year", F.year("month"))
    return fc.forecast(yearly, ["year"])


def forecast_by_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Portfolio(spark, sf_dir, by_property=True)
    return fc.forecast(p.series, p.keys)


def forecast_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model with the smallest tested errors for every metric."""
    return smoothing.forecast(Portfolio(spark, sf_dir).series)


def forecast_selected_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per calendar year and metric, too short for last year's months."""
    yearly = Portfolio(spark, sf_dir).series.withColumn("year", F.year("month"))
    return smoothing.forecast(yearly, ["year"])


def history_and_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The KPI rows are stored first: the history part and the fit both read them."""
    kpi = Portfolio(spark, sf_dir).stored_prop()
    return dashboard.history_and_forecast(kpi, fc.forecast(fc.long_series(kpi)))


# --- sinks and streaming -----------------------------------------------------------------------------------


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported row counts, one of the tables failing."""
    p = Portfolio(spark, sf_dir)
    tables = {
        "prop_kpi_monthly": p.prop(),
        "broken": p.ledger.select(F.raise_error(F.lit("no such table")).alias("x")),
        "fact_expense_monthly": p.expense,
    }
    return sinks.export_csv(spark, tables, shared_folder(spark, "exports")).drop("error")


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Portfolio(spark, sf_dir)
    root = shared_folder(spark, "exports")
    sinks.export_csv(spark, {"fact_expense_monthly": p.expense}, root)
    return spark.read.schema(p.expense.schema).option("header", True).csv(f"{root}/fact_expense_monthly.csv")


def forecast_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide forecast written as Parquet and CSV, read back from the CSV."""
    root = shared_folder(spark, "forecast")
    wide = fc.wide(fc.forecast(Portfolio(spark, sf_dir).series))
    sinks.write_forecast(wide, root)
    return spark.read.schema(wide.schema).option("header", True).csv(f"{root}/prop_kpi_forecast.csv")


def published_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables published to the catalog, one of them failing, copied on to another database, and verified there."""
    p = Portfolio(spark, sf_dir).stored("raw_ledger", "raw_lease")
    name = f"mill_{uuid.uuid4().hex}"
    frames = {
        "prop_kpi_monthly": p.prop(),
        "building_kpi_monthly": p.building(),
        "broken": p.ledger.select(F.raise_error(F.lit("no such table")).alias("x")),
        "dim_suite": models.dim_suite(p.lease),
    }
    first = sinks.publish(spark, frames, name).select("table_name", F.lit("published").alias("step"), "status", "row_count")
    copied = sinks.publish(spark, None, f"{name}_copy", name)
    second = copied.select("table_name", F.lit("copied").alias("step"), "status", "row_count")
    found = sinks.verify_tables(spark, database=f"{name}_copy")
    third = found.select("table_name", F.lit("verified").alias("step"), F.when(F.col("present"), "present").otherwise("missing").alias("status"), "row_count")
    out = _stored(spark, first.unionByName(second).unionByName(third), "published")
    for database in (name, f"{name}_copy"):
        spark.sql(f"DROP DATABASE {database} CASCADE")
    return out


def _bucketed(p: Portfolio, database: str) -> tuple[DataFrame, DataFrame]:
    """Staged ledger and lease as tables bucketed by property and month."""
    p.spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    keys = [*p.keys, "as_of_month"]
    return (sinks.write_bucketed(p.ledger, f"{database}.stg_dashboard_monthly", keys), sinks.write_bucketed(p.lease, f"{database}.stg_lease_rate", keys))


def prop_kpi_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property KPIs over staged tables that are bucketed by property and month: grouped and joined where they lie."""
    p = Portfolio(spark, sf_dir, by_property=True).stored("raw_ledger", "raw_lease")
    database = f"mill_{uuid.uuid4().hex}"
    ledger, lease = _bucketed(p, database)
    out = _stored(spark, models.prop_kpi(ledger, lease, keys=p.keys), "prop")
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return out


def _in_sql(text: str) -> Query:
    """A statement that calls the table functions over the portfolio's gold."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = Portfolio(spark, sf_dir, by_property=True).stored("raw_ledger", "raw_lease")
        table_functions.register(spark, {"prop_kpi_monthly": p.prop(), "fact_rent_monthly": p.rent, "building_kpi_monthly": p.building()})
        return spark.sql(text)

    return run


def recorded_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the writer notes next to the files of each bronze table, as read back from there."""
    p = Portfolio(spark, sf_dir)
    root = shared_folder(spark, "recorded")
    out = None
    for table, df in ((schemas.LEDGER_TABLE, p.raw_ledger), (schemas.EXPENSE_TABLE, p.raw_expenses), (schemas.LEASE_TABLE, p.raw_lease)):
        sinks.write_recorded(_audit_free(df), f"{root}/{table}", table)
        record = sinks.read_record(spark, f"{root}/{table}").drop("path")
        out = record if out is None else out.unionByName(record)
    return out


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash and size of a text file per nation."""
    path = shared_folder(spark, "files")
    nations = star.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    nations.repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    key = F.regexp_extract("file", "n_nationkey=([0-9]+)", 1).cast("bigint")
    return bronze.file_hashes(spark, path, "*.txt").select(key.alias("n_nationkey"), "_file_md5", "length")


def audit_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed ledger rows with the hash of their file, its month and whether the time of ingestion is a time."""
    cells, months = _landed(spark, star.ledger_cells(spark, sf_dir))
    files = cells.select("file", F.md5("file").alias("_file_md5")).distinct()
    stamped = grid.stamp(grid.ledger_records(cells, months), files)
    age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(F.to_timestamp("_ingested_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return stamped.groupBy("as_of_month", "_file_md5").agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(age) < 3600).alias("just_now"))


def lake_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze copied to a lake root and verified there per month."""
    p = Portfolio(spark, sf_dir)
    root, lake = shared_folder(spark, "bronze"), shared_folder(spark, "lake")
    sinks.write_bronze(p.raw_ledger, root, schemas.LEDGER_TABLE)
    sinks.write_bronze(p.raw_lease, root, schemas.LEASE_TABLE)
    sinks.copy_bronze(spark, root, lake)
    return sinks.verify_files(spark, lake).drop("files")


def _stream_into(spark: SparkSession, landed: DataFrame, root: str, staged: str) -> None:
    """``landed`` has every workbook in one partition, as a landing file holds whole workbooks.

    A trigger takes up few files; these have several row groups, so that more tasks than files read a batch.
    """
    landing = shared_folder(spark, "landing")
    landed.write.option("parquet.block.size", 4 << 20).parquet(landing)
    query = arrivals.stream_cells(
        spark, landing, root, shared_folder(spark, "checkpoint"), arrivals.refresh_staging(root, staged),
        files_per_trigger=4,
    )
    query.awaitTermination()


def _with_hash(cells: DataFrame) -> DataFrame:
    return cells.withColumn("_file_md5", F.md5("file"))


def stream_ingest_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger and lease sheets streamed through bronze into staging; the staged lease rows."""
    root, staged = shared_folder(spark, "bronze"), shared_folder(spark, "staged")
    _stream_into(spark, _with_hash(star.cells(spark, sf_dir).repartition("file")), root, staged)
    return _audit_free(bronze.read_partitioned(spark, f"{staged}/stg_lease_rate")).drop(schemas.PROPERTY)


def stream_two_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same months of two buildings arrive together, one of them again with other rents: rows and rent per building and month."""
    root, staged = shared_folder(spark, "bronze"), shared_folder(spark, "staged")
    # Four workbooks a month are made from them. They are dealt by month before they get long names and hashes.
    cells = _stored(spark, star.lease_cells(spark, sf_dir), "cells").repartition("file")

    def landed(building: str, epoch: str, factor: int) -> DataFrame:
        name = F.concat(F.lit(f"raw/org/{building}/2003/01/01/{epoch}-"), F.col("file"))
        rent = F.when((F.col("col") == 4) & (F.col("row") > V.LEASE_HEADER_ROW) & (F.col("row") < 1_048_576),
                      (F.col("value").cast("decimal(28,2)") * factor).cast("string")).otherwise(F.col("value"))
        return cells.withColumns({"file": name, "value": rent}).withColumn("_file_md5", F.md5("file"))

    _stream_into(spark, landed("b1", "100", 1).unionByName(landed("b2", "100", 1)), root, staged)
    _stream_into(spark, landed("b2", "200", 2), root, staged)
    _stream_into(spark, landed("b2", "150", 3), root, staged)
    return bronze.read_bronze(spark, root, schemas.LEASE_TABLE).groupBy(schemas.PROPERTY, "as_of_month").agg(
        F.count(F.lit(1)).alias("suites"), F.sum(F.col("rent_monthly").cast("decimal(18,2)")).alias("rent"))


def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ledger sheets arrive in a second stream: bronze keeps its rows and the log says skipped."""
    root, staged = shared_folder(spark, "bronze"), shared_folder(spark, "staged")
    landed = _with_hash(_stored(spark, star.ledger_cells(spark, sf_dir), "cells").repartition("file"))
    _stream_into(spark, landed, root, staged)
    _stream_into(spark, landed, root, staged)
    log = arrivals.read_log(spark, root)
    return log.groupBy("as_of_month", "status").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("rows_ingested").alias("rows_ingested")
    )


def expense_against_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice the actual as budget, none for the category 'other'."""
    expense = _stored(spark, Portfolio(spark, sf_dir).expense, "expense")
    budget = expense.where("expense_category <> 'other'").select(
        "as_of_month", "expense_category", (F.col("total_actual") * 2).alias("total_budget")
    )
    return dashboard.expense_against_budget(expense, budget)


# --- the list ----------------------------------------------------------------------------------------------


def _with(p: Portfolio, build: Callable[[Portfolio], DataFrame]) -> DataFrame:
    return build(p)


def _of(build: Callable[[Portfolio], DataFrame], by_property: bool = False) -> Query:
    return lambda spark, sf_dir: build(Portfolio(spark, sf_dir, by_property))


def _suites_by_window(*by: str) -> Callable[[Portfolio], DataFrame]:
    """Distinct suites over the last months from stored sets of every month; lease rows are read for the sets only."""

    def build(p: Portfolio) -> DataFrame:
        lease = p.stored("raw_lease").lease
        numbers = _stored(p.spark, distinct.extend(None, lease, "suite_id", p.keys), "suite_numbers")
        sets = distinct.words(lease, numbers, "suite_id", [*p.keys, *by, "as_of_month"], p.keys)
        sets = _stored(p.spark, sets, "suite_sets")
        return distinct.counts_by_window(sets, [*p.keys, *by], p.keys, name="suite_count")

    return build


_SMALL_PLACES = {"forecast_wide": 2, "forecast_long": 2, "forecast_short": 2, "forecast_by_property": 2,
                 "forecast_horizons": 2, "forecast_sink": 2, "forecast_backtest": 2, "forecast_selected": 2, "forecast_selected_short": 2, "history_and_forecast": 2}

_QUERIES: dict[str, Query] = {
    # sources, cleaning
    "partition_scan": partition_scan,
    "bronze_view": bronze_view,
    "partition_replace": partition_replace,
    "staging_ledger": _of(lambda p: _audit_free(p.ledger)),
    "staging_expenses": _of(lambda p: _audit_free(p.expenses)),
    "staging_lease": _of(lambda p: _audit_free(p.lease)),
    "grid_ledger": grid_ledger,
    "grid_expenses": grid_expenses,
    "grid_lease": grid_lease,
    "sheet_pick": sheet_pick,
    "sheet_outputs": sheet_outputs,
    "sheet_tables": sheet_tables,
    "alias_columns": alias_columns,
    "alias_every_header": alias_every_header,
    "expense_sheet": expense_sheet,
    "clean_rows": clean_rows,
    "numeric_coerce": numeric_coerce,
    "lease_flags": lease_flags,
    "as_of_month_detect": as_of_month_detect,
    "landing_path_parse": landing_path_parse,
    "rent_psf": rent_psf,
    # incremental, history
    "file_dedupe": file_dedupe,
    "incremental_new_months": incremental_new_months,
    "upsert_by_key": upsert_by_key,
    "full_refresh": full_refresh,
    "late_month": late_month,
    "gold_after_late_month": gold_after_late_month,
    "scd2_lease": scd2_lease,
    "scd2_incremental": scd2_incremental,
    "scd2_status": scd2_status,
    "scd2_by_property": scd2_by_property,
    "scd2_hard_delete": scd2_hard_delete,
    "latest_snapshot": latest_snapshot,
    "latest_snapshot_by_property": latest_snapshot_by_property,
    # quality
    "quality_failures": quality_failures,
    "quality_summary": quality_summary,
    "quality_bronze_verdicts": quality_bronze_verdicts,
    "quarantine_report": quarantine_report,
    "check_log": check_log,
    "quality_type_coercion": quality_type_coercion,
    "quality_unique": quality_unique,
    "lease_suite_rules": lease_suite_rules,
    "quality_accepted_values": quality_accepted_values,
    "quality_dimensions_by_property": quality_dimensions_by_property,
    "quality_model_tests": quality_model_tests,
    "kpi_rules": kpi_rules,
    "reconcile_layers": reconcile_layers,
    "reconcile_by_digest": reconcile_by_digest,
    "layer_totals": layer_totals,
    "freshness_counts": freshness_counts,
    "ingest_counts": ingest_counts,
    # models
    "dim_suite": _of(lambda p: models.dim_suite(p.lease)),
    "dim_suite_latest": _of(lambda p: models.dim_suite_latest(p.lease)),
    "dim_tenant": _of(lambda p: models.dim_tenant(p.lease)),
    "dim_tenant_latest": _of(lambda p: models.dim_tenant_latest(p.lease)),
    "dim_calendar": _of(lambda p: models.dim_calendar(p.ledger)),
    "fact_rent": _of(lambda p: p.rent),
    "fact_expense": _of(lambda p: p.expense),
    "prop_kpi": _of(lambda p: p.prop()),
    "prop_kpi_excl_own_use": _of(lambda p: p.prop(exclude_own_use=True)),
    "prop_kpi_with_areas": _of(
        lambda p: models.prop_kpi(p.ledger, p.lease, p.areas, keys=p.keys), by_property=True
    ),
    "prop_kpi_by_property": _of(lambda p: p.prop(), by_property=True),
    "building_kpi": _of(lambda p: p.building()),
    "building_kpi_excl_own_use": _of(lambda p: p.building(exclude_own_use=True)),
    "building_kpi_by_property": _of(lambda p: p.building(), by_property=True),
    "noi_monthly": _of(lambda p: models.noi(p.rent, p.expense)),
    "noi_by_property": _of(lambda p: models.noi(p.rent, p.expense, p.keys), by_property=True),
    # windows
    "kpi_windows": _of(lambda p: windows.trailing_kpis(p.prop())),
    "kpi_windows_by_property": _of(lambda p: windows.trailing_kpis(p.prop(), p.keys), by_property=True),
    "kpi_windows_literal": _of(lambda p: windows.pair_counted_kpis(p.prop())),
    "kpi_last_3m": _of(lambda p: dashboard.property_series(p.stored_prop(), "3m")),
    "kpi_last_6m": _of(lambda p: dashboard.property_series(p.stored_prop(), "6m")),
    "kpi_last_9m": _of(lambda p: dashboard.property_series(p.stored_prop(), "9m")),
    "kpi_last_12m": _of(lambda p: dashboard.property_series(p.stored_prop(), "12m", exclude_own_use=True)),
    "kpi_ytd": _of(lambda p: dashboard.property_series(p.stored_prop(), "ytd")),
    "kpi_ytd_by_property": _of(
        lambda p: dashboard.property_series(p.stored_prop(), "ytd", keys=p.keys), by_property=True
    ),
    "kpi_all_months": _of(lambda p: dashboard.property_series(p.prop())),
    "kpi_since": _of(lambda p: reports.recent_occupancy(p.prop(), "2001-03-01")),
    # reports
    "r01_property_overview": _of(lambda p: reports.property_overview(p.prop())),
    "r02_revenue_trends": _of(lambda p: reports.revenue_trends(p.rent)),
    "r03_building_comparison": _of(lambda p: reports.building_comparison(p.stored_building(revenue_sqft=True))),
    "r01_by_property": _of(lambda p: reports.property_overview(p.prop(), p.keys), by_property=True),
    "r02_by_property": _of(lambda p: reports.revenue_trends(p.rent, keys=p.keys), by_property=True),
    "r03_by_property": _of(
        lambda p: reports.building_comparison(p.stored_building(revenue_sqft=True), p.keys), by_property=True
    ),
    "r07_by_property": _of(
        lambda p: _with(
            p.stored("raw_ledger", "raw_lease"),
            lambda s: reports.revenue_by_building(
                s.rent, s.prop(revenue_sqft=True), s.stored_building(revenue_sqft=True), s.keys
            ),
        ),
        by_property=True,
    ),
    "r08_by_property": _of(
        lambda p: _with(
            p.stored("raw_ledger", "raw_lease"), lambda s: reports.kpi_summary(s.prop(), s.building(), s.keys)
        ),
        by_property=True,
    ),
    "r04_by_property": _of(
        lambda p: _with(p.stored("raw_lease"), lambda s: reports.vacant_suites(s.lease, keys=s.keys)), by_property=True
    ),
    "r04b_by_property": _of(lambda p: reports.all_suites(models.dim_suite(p.lease, p.keys), p.keys), by_property=True),
    "r05_by_property": _of(lambda p: reports.tenant_roster(models.dim_tenant(p.lease, p.keys), p.keys), by_property=True),
    "r06_by_property": _of(lambda p: reports.occupancy_history(p.prop(), p.keys), by_property=True),
    "r09_by_property": _of(lambda p: reports.collection_analysis(p.rent, p.keys), by_property=True),
    "r10a_by_property": _of(
        lambda p: reports.high_value_suites(models.dim_suite(p.lease, p.keys), 45, p.keys), by_property=True
    ),
    "r10b_by_property": _of(lambda p: reports.size_by_building(models.dim_suite(p.lease, p.keys), p.keys), by_property=True),
    "r10c_by_property": _of(lambda p: reports.year_month_averages(p.prop(), p.keys), by_property=True),
    "latest_kpis_by_property": _of(lambda p: reports.latest_kpis(p.stored_prop(), p.keys), by_property=True),
    "kpi_since_by_property": _of(lambda p: reports.recent_occupancy(p.prop(), "2001-03-01", p.keys), by_property=True),
    "latest_buildings_by_property": _of(lambda p: reports.latest_buildings(p.stored_building(), p.keys), by_property=True),
    "tenant_suite_count_by_property": _of(
        lambda p: _with(p.stored("raw_lease"), lambda s: reports.tenant_suite_count(models.dim_tenant(s.lease, s.keys), s.lease, s.keys)),
        by_property=True,
    ),
    "building_latest_by_property": _of(
        lambda p: dashboard.building_latest(p.stored_building(), keys=p.keys), by_property=True
    ),
    "suite_status_by_property": _of(
        lambda p: _with(p.stored("raw_lease"), lambda s: dashboard.suite_details(s.lease, keys=s.keys)), by_property=True
    ),
    "summary_cards_by_property": _of(
        lambda p: _with(p.stored("raw_ledger", "raw_lease"), lambda s: dashboard.summary_cards(s.prop(), s.lease, keys=s.keys)),
        by_property=True,
    ),
    "r04_vacant_suites": _of(lambda p: _with(p.stored("raw_lease"), lambda s: reports.vacant_suites(s.lease))),
    "r04b_all_suites": _of(lambda p: reports.all_suites(models.dim_suite(p.lease))),
    "r05_tenant_roster": _of(lambda p: reports.tenant_roster(models.dim_tenant(p.lease))),
    "r06_occupancy_history": _of(lambda p: reports.occupancy_history(p.prop())),
    "r07_revenue_by_building": _of(
        lambda p: _with(
            p.stored("raw_ledger", "raw_lease"),
            lambda s: reports.revenue_by_building(
                s.rent, s.prop(revenue_sqft=True), s.stored_building(revenue_sqft=True)
            ),
        )
    ),
    "r08_kpi_summary": _of(
        lambda p: _with(p.stored("raw_ledger", "raw_lease"), lambda s: reports.kpi_summary(s.prop(), s.building()))
    ),
    "r09_collection_analysis": _of(lambda p: reports.collection_analysis(p.rent)),
    "r10a_high_value": _of(lambda p: reports.high_value_suites(models.dim_suite(p.lease), above_sqft=45)),
    "r10b_size_by_building": _of(lambda p: reports.size_by_building(models.dim_suite(p.lease))),
    "r10c_year_month": _of(lambda p: reports.year_month_averages(p.prop())),
    "r11_parameterised": _of(
        lambda p: reports.parameterised(
            p.spark,
            "SELECT as_of_month, collected FROM {rent} WHERE as_of_month >= ${first} AND leased_sqft > ${area}",
            {"first": "1999-01", "area": 100},
            rent=p.rent,
        )
    ),
    "latest_kpis": _of(lambda p: reports.latest_kpis(p.stored_prop())),
    "latest_buildings": _of(lambda p: reports.latest_buildings(p.stored_building())),
    "tenant_suite_count_by_window": _of(_suites_by_window("tenant")),
    "building_suite_count_by_window": _of(_suites_by_window("building"), by_property=True),
    "tenant_suite_count": _of(
        lambda p: _with(p.stored("raw_lease"), lambda s: reports.tenant_suite_count(models.dim_tenant(s.lease), s.lease))
    ),
    # dashboard data sets
    "building_series": _of(lambda p: dashboard.building_series(p.stored_building(), "6m")),
    "building_latest": _of(lambda p: dashboard.building_latest(p.stored_building())),
    "building_last_rows": _of(lambda p: dashboard.building_last_rows(p.building())),
    "window_listing": _of(lambda p: dashboard.window_listing(windows.trailing_kpis(p.prop()))),
    "expense_stack": _of(lambda p: dashboard.expense_stack(p.expense)),
    "expense_against_budget": expense_against_budget,
    "suite_status": _of(lambda p: _with(p.stored("raw_lease"), lambda s: dashboard.suite_details(s.lease, s.lease_months))),
    "summary_cards": _of(
        lambda p: _with(p.stored("raw_lease"), lambda s: dashboard.summary_cards(s.prop(), s.lease))
    ),
    "portfolio_totals": _of(lambda p: dashboard.portfolio_totals(p.stored_building(), p.rent)),
    "portfolio_totals_by_property": _of(
        lambda p: dashboard.portfolio_totals(p.stored_building(), p.rent, p.keys), by_property=True
    ),
    "portfolio_totals_all": _of(lambda p: dashboard.portfolio_totals(p.stored_building(), p.rent), by_property=True),
    "last_12_points": _of(lambda p: dashboard.last_points(p.prop())),
    "vs_target": _of(lambda p: dashboard.against_target(p.prop())),
    # forecast
    "forecast_series": _of(lambda p: p.series),
    "forecast_model_choice": _of(lambda p: fc.model_choice(p.series)),
    "forecast_long": _of(lambda p: fc.forecast(p.series)),
    "forecast_short": forecast_short,
    "forecast_horizons": _of(lambda p: fc.at_horizons(fc.forecast(p.series))),
    "forecast_wide": forecast_wide,
    "forecast_by_property": forecast_by_property,
    "forecast_selected": forecast_selected,
    "forecast_selected_short": forecast_selected_short,
    "forecast_backtest": _of(lambda p: fc.backtest(fc.long_series(p.stored_prop()))),
    "history_and_forecast": history_and_forecast,
    # sinks, streaming
    "csv_export": csv_export,
    "csv_round_trip": csv_round_trip,
    "forecast_sink": forecast_sink,
    "published_tables": published_tables,
    "prop_kpi_bucketed": prop_kpi_bucketed,
    "sql_revenue_trends": _in_sql(
        "SELECT '1' AS property_id, * FROM revenue_trends('1') UNION ALL SELECT '3', * FROM revenue_trends(property => '3', months => 9)"),
    "sql_building_comparison": _in_sql(
        "SELECT b.*, o.collected FROM building_comparison('2') b JOIN property_overview('2') o ON o.month = b.month"),
    "recorded_writes": recorded_writes,
    "content_hashes": content_hashes,
    "audit_columns": audit_columns,
    "lake_copy": lake_copy,
    "stream_ingest_equals_batch": stream_ingest_equals_batch,
    "stream_replay": stream_replay,
    "stream_two_properties": stream_two_properties,
}


def _presented(name: str, query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(query(spark, sf_dir), _SMALL_PLACES.get(name, PLACES))

    run.__doc__ = query.__doc__
    return run


def queries() -> dict[str, Query]:
    return {name: _presented(name, query) for name, query in _QUERIES.items()}
