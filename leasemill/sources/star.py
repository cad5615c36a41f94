"""Rent-roll inputs derived from an order/line star schema.

An order is a billed month entry, a line is floor area let by a supplier's suite, a part type is an expense
item. Every derivation is one join of lines to orders and one grouped aggregation, so lines never go through a
single task: sums are combined before the shuffle, and adaptive execution splits an order that holds many lines.
Passing ``by_property=True`` adds the customer's region as ``property_id``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leasemill.functions import vocabulary as V
from leasemill.functions.expressions import first_of_month, ratio

PROPERTY = ["property_id"]


_schemas: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A source table; its schema is read from the files once per application."""
    path = f"{sf_dir}/{name}.parquet"
    known = (spark.sparkContext.applicationId, path)
    if known not in _schemas:
        _schemas[known] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[known]).parquet(path)


def _to_cents(amount: Column) -> Column:
    """Amounts with two decimals as whole cents: bigint sums are exact, fast and raise on overflow."""
    return F.rint(amount * 100).cast("bigint")


def _from_cents(total: Column, digits: int = 2) -> Column:
    return total.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-digits))


def _month_text() -> Column:
    """Rows are grouped by the month as a date (four bytes); the text form is made once per result row."""
    return F.date_format("month", "yyyy-MM").alias("as_of_month")


def _orders(spark: SparkSession, sf_dir: str, by_property: bool, *columns: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("month", F.trunc(F.col("o_orderdate").cast("date"), "MM"))
    if not by_property:
        return orders.select("o_orderkey", "month", *columns)
    # 25 nations whatever the scale; the customer table grows, so its join is left to the planner.
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("string").alias("property_id")
    )
    customer = (
        table(spark, sf_dir, "customer")
        .select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        .join(F.broadcast(nation), "c_nationkey")
        .select("o_custkey", "property_id")
    )
    return orders.join(customer, "o_custkey").select("property_id", "o_orderkey", "month", *columns)


def _audit(df: DataFrame) -> DataFrame:
    """Audit columns with values that depend only on the month, so a re-run gives the same table."""
    return df.withColumns(
        {
            "_file_md5": F.md5(file_name(F.col("as_of_month"))),
            "_ingested_at": F.concat(F.col("as_of_month"), F.lit("-28T00:00:00")),
        }
    )


def file_name(as_of_month: Column) -> Column:
    return F.concat(F.lit("portfolio_"), as_of_month, F.lit(".xlsx"))


def ledger(spark: SparkSession, sf_dir: str, by_property: bool = False) -> DataFrame:
    """Bronze monthly ledger, one row per month (and property)."""
    keys = PROPERTY if by_property else []
    # Lines collapse to one row per order before they meet the orders, which removes any hot order.
    let = (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_linestatus") == "F")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("let_sqft"))
    )
    price = _to_cents(F.col("o_totalprice"))
    per_month = (
        _orders(spark, sf_dir, by_property, "o_totalprice", "o_orderstatus")
        .join(let, "o_orderkey", "left")
        .groupBy(*keys, "month")
        .agg(
            F.sum(price).alias("base"),
            F.coalesce(F.sum(F.when(F.col("o_orderstatus") != "O", price)), F.lit(0).cast("bigint")).alias("paid"),
            F.coalesce(F.sum("let_sqft"), F.lit(0).cast("bigint")).alias("let_sqft"),
        )
    )
    rent = _from_cents(F.col("base")).cast("double")
    return _audit(
        per_month.select(
            *keys,
            _month_text(),
            "month",
            rent.alias("rent_base"),
            _from_cents(F.col("paid")).cast("double").alias("collected"),
            _from_cents(F.col("base") - F.col("paid")).cast("double").alias("uncollected"),
            F.col("let_sqft").cast("double").alias("leased_sqft"),
            ratio(F.lit(12.0) * rent, F.col("let_sqft")).alias("price_per_sf_yr"),
        )
    )


def lease(spark: SparkSession, sf_dir: str, by_property: bool = False) -> DataFrame:
    """Bronze lease snapshot, one row per month and suite (and property)."""
    keys = PROPERTY if by_property else []
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_suppkey").alias("supplier"),
        F.when(F.col("l_linestatus") == "F", "A").otherwise("B").alias("building"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        _to_cents(F.col("l_extendedprice")).alias("price"),
    )
    suites = lines.join(_orders(spark, sf_dir, by_property, "o_custkey"), "o_orderkey")
    grouped = suites.groupBy(*keys, "month", "supplier", "building").agg(
        F.sum("quantity").alias("area"),
        F.sum("price").alias("rent"),
        F.max("o_custkey").alias("ck"),
    )
    rent = _from_cents(F.col("rent"))
    annual = _from_cents(F.col("rent") * 12)
    kind = F.col("ck") % 10
    return _audit(
        grouped.select(
            *keys,
            _month_text(),
            F.concat(F.col("supplier").cast("string"), F.col("building")).alias("suite_id"),
            "building",
            F.when(kind == 0, "Vacant")
            .when(kind == 1, "Owner Use")
            .otherwise(F.concat(F.lit("Tenant "), F.col("ck").cast("string")))
            .alias("tenant"),
            F.col("area").cast("double").alias("sqft"),
            rent.cast("double").alias("rent_monthly"),
            annual.cast("double").alias("rent_annual"),
            ratio(annual, F.col("area")).alias("rent_psf_yr"),
            (kind == 0).alias("is_vacant"),
            (kind == 1).alias("is_own_use"),
        )
    )


def lease_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months that have a lease snapshot, without building the snapshots."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return _orders(spark, sf_dir, False).join(lines, "o_orderkey", "left_semi").select("month").distinct().select(
        _month_text()
    )


def expenses(spark: SparkSession, sf_dir: str, by_property: bool = False) -> DataFrame:
    """Bronze expenses, one row per month and item (and property)."""
    keys = PROPERTY if by_property else []
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_partkey").alias("p_partkey"),
        (_to_cents(F.col("l_extendedprice")) * _to_cents(F.col("l_tax"))).alias("cost"),
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("item"))
    # Lines are combined by month and part before they meet the parts: one shuffle of lines, not two.
    per_part = (
        lines.join(_orders(spark, sf_dir, by_property), "o_orderkey")
        .groupBy(*keys, "month", "p_partkey")
        .agg(F.sum("cost").alias("cost"))
    )
    grouped = per_part.join(parts, "p_partkey").groupBy(*keys, "month", "item").agg(F.sum("cost").alias("cost"))
    return _audit(
        grouped.select(
            *keys,
            _month_text(),
            "month",
            "item",
            F.round(_from_cents(F.col("cost"), 4), 2).cast("double").alias("actual"),
            F.when(F.col("item").isin("MEDIUM", "STANDARD"), "fixed")
            .when(F.col("item").isin("LARGE", "PROMO"), "variable")
            .otherwise("other")
            .alias("expense_category"),
        )
    )


# Worksheet rows that carry the six expense items: two fixed, two variable, two other.
ITEM_ROWS = {"MEDIUM": 42, "STANDARD": 43, "LARGE": 53, "PROMO": 54, "SMALL": 60, "ECONOMY": 61}
LEDGER_SHEET = "Dashboard (2025)"
LEASE_SHEET = "Lease Rate"


def _cell(row: Column, col: Column, value: Column) -> Column:
    return F.struct(row.cast("int").alias("row"), col.cast("int").alias("col"), value.cast("string").alias("value"))


def _plain(value: Column, digits: int = 2) -> Column:
    """Number as plain digits, the way a cell shows it."""
    return value.cast(f"decimal(28,{digits})").cast("string")


def _period_cells() -> Column:
    """The month as a 'Period' cell with its date two cells to the right.

    Only for files of the 1990s: the file-name rule knows months from 2000 on.
    """
    start = F.date_format(first_of_month(F.col("as_of_month")), "yyyy-MM-dd")
    found = F.array(
        _cell(F.lit(2), F.lit(1), F.lit("Period")),
        _cell(F.lit(2), F.lit(3), start),
    )
    return F.when(F.col("as_of_month") < "2000", found).otherwise(F.slice(found, 1, 0))


def _year_to_date(monthly: DataFrame) -> DataFrame:
    """Each month's workbook repeats the earlier months of its year."""
    # Month-grain rows: a year has twelve files at most, and the frame is derived once.
    files = F.collect_set("as_of_month").over(Window.partitionBy(F.substring("as_of_month", 1, 4)))
    shown = monthly.drop("_file_md5", "_ingested_at").withColumn("files", files).withColumnRenamed("as_of_month", "shown_month")
    return shown.select(F.explode("files").alias("as_of_month"), *[c for c in shown.columns if c != "files"]).where(
        F.col("shown_month") <= F.col("as_of_month")
    )


def ledger_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashboard worksheets of every month: ledger block and expense block, with the usual clutter.

    The January 'collected' cell of a later workbook holds text instead of a number, and the header row starts
    with a target label.
    """
    slot = F.lit(V.FIRST_MONTH_COLUMN - 1) + F.month("month")
    name = F.initcap(F.date_format("month", "MMMM"))
    garbled = (F.month("month") == 1) & (F.col("shown_month") != F.col("as_of_month"))
    block = _year_to_date(ledger(spark, sf_dir)).select(
        "as_of_month",
        F.explode(
            F.array(
                _cell(F.lit(V.LEDGER_HEADER_ROW), slot, name),
                *[
                    _cell(
                        F.lit(row),
                        slot,
                        F.when(garbled, F.lit("pending")).otherwise(_plain(F.col(metric)))
                        if metric == "collected"
                        else _plain(F.col(metric), 8 if metric == "price_per_sf_yr" else 2),
                    )
                    for metric, row in V.LEDGER_METRIC_ROWS.items()
                ],
                _cell(F.lit(V.EXPENSE_HEADER_ROW), slot, name),
            )
        ).alias("cell"),
    )
    row_of = F.create_map(*[F.lit(x) for pair in ITEM_ROWS.items() for x in pair])
    spent = _year_to_date(expenses(spark, sf_dir)).select(
        "as_of_month",
        F.explode(
            F.array(
                _cell(row_of[F.col("item")], slot, _plain(F.col("actual"))),
                # The label is written once, next to the newest month.
                F.when(
                    F.col("shown_month") == F.col("as_of_month"),
                    _cell(row_of[F.col("item")], F.lit(V.EXPENSE_LABEL_COLUMN),
                          F.concat(F.lit(" "), F.col("item"), F.lit(" "))),
                ),
            )
        ).alias("cell"),
    ).where(F.col("cell").isNotNull())
    labels = ledger(spark, sf_dir).select(
        "as_of_month",
        F.explode(
            F.concat(
                F.array(_cell(F.lit(V.LEDGER_HEADER_ROW), F.lit(V.FIRST_MONTH_COLUMN - 1), F.lit("Collection Target"))),
                _period_cells(),
            )
        ).alias("cell"),
    )
    return block.unionByName(spent).unionByName(labels).select(
        file_name(F.col("as_of_month")).alias("file"),
        F.lit(LEDGER_SHEET).alias("sheet"),
        F.lit(1).alias("sheet_no"),
        "cell.*",
    )


def lease_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lease worksheets of every month: headers in row 4, one suite per row, padded names, one blank suite."""
    suites = lease(spark, sf_dir)
    number = F.regexp_extract("suite_id", "^([0-9]+)", 1).cast("int") * 2 + (F.col("building") == "B").cast("int")
    row = F.lit(V.LEASE_HEADER_ROW + 1) + number
    values = [
        F.col("suite_id"),
        F.concat(F.lit("  "), F.col("tenant"), F.lit(" ")),
        _plain(F.col("sqft")),
        _plain(F.col("rent_monthly")),
        _plain(F.col("rent_annual")),
    ]
    body = suites.select(
        "as_of_month", F.explode(F.array(*[_cell(row, F.lit(i + 1), v) for i, v in enumerate(values)])).alias("cell")
    )
    head = (
        lease_months(spark, sf_dir)
        .select(
            "as_of_month",
            F.explode(
                F.concat(
                    F.array(
                        *[_cell(F.lit(V.LEASE_HEADER_ROW), F.lit(i + 1), F.lit(h)) for i, h in enumerate(V.LEASE_HEADERS)],
                        _cell(F.lit(1_048_576), F.lit(1), F.lit("   ")),
                        _cell(F.lit(1_048_576), F.lit(2), F.lit("Total")),
                    ),
                    _period_cells(),
                )
            ).alias("cell"),
        )
    )
    return body.unionByName(head).select(
        file_name(F.col("as_of_month")).alias("file"),
        F.lit(LEASE_SHEET).alias("sheet"),
        F.lit(2).alias("sheet_no"),
        "cell.*",
    )


def expense_sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expense worksheets with headers of their own: English with vendor and variance in odd months, Spanish below a title in even ones.

    A sheet of notes with the same wording stands before them, and every third budget is text.
    """
    place = F.array_position(F.array(*[F.lit(i) for i in ITEM_ROWS]), F.col("item")).cast("int") - 1
    given = expenses(spark, sf_dir).withColumns({"place": place, "odd": F.month("month") % 2 == 1})
    item = F.concat(F.lit(" "), F.col("item"), F.lit("  "))
    budget = F.when(F.col("place") % 3 == 0, F.lit("n/a")).otherwise((F.col("place") * 1000).cast("string"))
    english = [item, F.concat(F.lit("Vendor "), F.col("place").cast("string")), _plain(F.col("actual")), budget, F.lit("-7")]
    spanish = [budget, item, _plain(F.col("actual"))]
    body = given.select("as_of_month", "odd", F.explode(F.when(
        F.col("odd"), F.array(*[_cell(F.col("place") + 4, F.lit(2 + i), v) for i, v in enumerate(english)]),
    ).otherwise(F.array(*[_cell(F.col("place") + 6, F.lit(1 + i), v) for i, v in enumerate(spanish)]))).alias("cell"))
    head = given.select("as_of_month", "odd").distinct().select("as_of_month", "odd", F.explode(F.when(
        F.col("odd"), F.array(*[_cell(F.lit(3), F.lit(2 + i), F.lit(v)) for i, v in enumerate(["Item", "VENDOR", "Actual ", "Budget", "Variance"])]),
    ).otherwise(F.array(
        _cell(F.lit(2), F.lit(2), F.lit("Presupuesto")),
        *[_cell(F.lit(5), F.lit(1 + i), F.lit(v)) for i, v in enumerate([" Presupuesto", "Concepto", "REAL", "Concepto"])],
    ))).alias("cell"))
    notes = head.withColumns({"sheet": F.lit("Notes"), "sheet_no": F.lit(1)})
    sheet = F.when(F.col("odd"), "Expense plan").otherwise("Gastos")
    sheets = body.unionByName(head).withColumns({"sheet": sheet, "sheet_no": F.lit(2)}).unionByName(notes)
    return sheets.select(file_name(F.col("as_of_month")).alias("file"), "sheet", "sheet_no", "cell.*")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_cells(spark, sf_dir).unionByName(lease_cells(spark, sf_dir))
