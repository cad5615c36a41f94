from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from leasemill.functions import expressions as X
from leasemill.functions import vocabulary as V
from leasemill.operators import clean


def one(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


def test_number(spark):
    texts = [" 12 ", "1,000", "-3.5", ".5", "5.", "1e3", "1d", "NaN", "abc", "", None, "1 2"]
    assert one(spark, texts, X.number) == [12, None, -3.5, 0.5, 5, 1000, None, None, None, None, None, None]


def test_vacancy(spark):
    names = [None, "", "VACANTE", "now available", "disponible ya", "Acme"]
    assert one(spark, names, X.is_vacant) == [True, True, True, True, True, False]


def test_own_use(spark):
    df = spark.createDataFrame(
        [("Black Label LLC", "1A"), ("Acme", "101b"), (None, "101B"), ("uso propio", None), ("Acme", "2A")],
        "t string, s string",
    )
    assert [r[0] for r in df.select(X.is_own_use(F.col("t"), F.col("s"))).collect()] == [True, True, True, True, False]


def test_building_is_first_letter_anywhere(spark):
    assert one(spark, ["101A", "205b", "LOBBY", "77", None], X.building_of) == ["A", "B", "B", None, None]


def test_guarded_ratios(spark):
    df = spark.createDataFrame([(50.0, 200.0), (1.0, 0.0), (1.0, None), (None, 4.0), (1.0, -2.0)], "n double, d double")
    got = df.select(X.ratio(F.col("n"), F.col("d")), X.percentage(F.col("n"), F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(0.25, 25.0), (0, 0), (0, 0), (None, None), (0, 0)]


def test_month_names(spark):
    df = spark.createDataFrame([(" March ", "2025"), ("DECEMBER", "2024"), ("Total", "2025"), (None, "2025")],
                               "m string, y string")
    got = [r[0] for r in df.select(X.named_month(F.col("m"), F.col("y"))).collect()]
    assert got == [date(2025, 3, 1), date(2024, 12, 1), None, None]


def test_loose_dates(spark):
    texts = ["2025-03-15", "2025-03-15 00:00:00", "2025-03", "3/5/2025", "March 2025", "Mar 2025", "soon", None]
    months = one(spark, texts, lambda c: F.date_format(X.loose_date(c), "yyyy-MM"))
    assert months == ["2025-03"] * 6 + [None, None]


def test_cents(spark):
    values = [33701.534999999996, 0.125, 2.345, -0.125, None, 1e12]
    assert one(spark, values, X.cents, "double") == [
        Decimal("33701.53"), Decimal("0.13"), Decimal("2.35"), Decimal("-0.13"), None, Decimal("1000000000000.00")]


def test_collection_band(spark):
    assert one(spark, [94.99, 95.0, 99.9, 100.0], X.collection_band, "double") == [
        V.BELOW_TARGET_LABEL, V.GOOD_LABEL, V.GOOD_LABEL, V.PERFECT_LABEL]


def test_status_prefers_own_use(spark):
    df = spark.createDataFrame([(True, True), (False, True), (False, False)], "is_own_use boolean, is_vacant boolean")
    assert [r[0] for r in df.select(X.suite_status()).collect()] == ["Own-Use", "Vacant", "Leased"]


def test_alias_tables_are_per_sheet(spark):
    headers = ["$/SF/Yr", " Mes ", "renta $/m2/año", "Whatever"]
    assert one(spark, headers, lambda c: clean.canonical_name(c, V.LEDGER_ALIASES)) == [
        "price_per_sf_yr", "month", "renta $/m2/año", "whatever"]
    assert one(spark, headers, lambda c: clean.canonical_name(c, V.LEASE_ALIASES))[0] == "rent_psf_yr"
    assert clean.rename_by_alias(spark.createDataFrame([("a", 1)], "`Inquilino` string, `M2` int"),
                                 V.LEASE_ALIASES).columns == ["tenant", "sqft"]


def test_drop_empty(spark, rows):
    df = spark.createDataFrame([(" a ", None, 1), (None, None, None), ("b", None, None)], "t string, e string, n int")
    cleaned = clean.drop_empty(df)
    assert cleaned.columns == ["t", "n"]
    assert rows(cleaned) == [("a", 1), ("b", None)]


def test_row_positions_cross_blocks(spark):
    df = spark.createDataFrame([("f", r) for r in (3, 7, 8, 9, 20, 41)] + [("g", 5)], "file string, row int")
    got = clean.row_positions(df, ["file"], "row", block=8).orderBy("file", "row").collect()
    assert [r["position"] for r in got] == [1, 2, 3, 4, 5, 6, 1]
