from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from leasemill import schemas
from leasemill.operators import windows
from leasemill.plans import dashboard, models, reports

LEDGER = [
    # month, base, collected, uncollected, leased area, price
    ("2025-01", 19130.0, 19130.0, 0.0, 8240.0, 27.86),
    ("2025-02", 15036.0, 15036.0, 0.0, 8820.0, 20.46),
    ("2025-12", 16805.0, 18735.0, -1930.0, 8129.0, 24.81),
]
ROSTER = [
    # suite, building, tenant, area, monthly, annual, psf, vacant, own use
    ("201A", "A", "Acme", 218.0, 400.0, 4800.0, 22.02, False, False),
    ("300B", "B", "Beta", 1800.0, 3500.0, 42000.0, 23.33, False, False),
    ("101B", "B", "Owner", 285.0, 650.0, 7800.0, 27.37, False, True),
    ("202A", "A", "Vacant", 100.0, 0.0, 0.0, 0.0, True, False),
    ("77", None, "Gamma", 50.0, 10.0, 120.0, 2.4, False, False),
]


@pytest.fixture(scope="module")
def ledger(spark):
    data = [(m, date(int(m[:4]), int(m[5:]), 1), *rest, "h", "2025-01-01T00:00:00") for m, *rest in LEDGER]
    return models.stage_ledger(spark.createDataFrame(data, schemas.RAW_LEDGER))


@pytest.fixture(scope="module")
def lease(spark):
    data = [(m, *r, "h", "2025-01-01T00:00:00") for m in ("2025-01", "2025-02") for r in ROSTER]
    return models.stage_lease(spark.createDataFrame(data, schemas.RAW_LEASE))


def by_month(df):
    return {r["as_of_month"]: r for r in df.collect()}


def test_occupancy_of_the_published_audit(ledger, lease):
    kpi = by_month(models.prop_kpi(ledger, lease))
    assert round(kpi["2025-01"]["occupancy_pct"], 2) == 83.09
    assert round(kpi["2025-02"]["occupancy_pct"], 2) == 88.94
    assert kpi["2025-01"]["collection_rate_pct"] == 100.0


def test_missing_roster_keeps_the_month_with_zero_ratios(ledger, lease):
    row = by_month(models.prop_kpi(ledger, lease))["2025-12"]
    assert row["effective_sqft"] is None and row["total_property_sqft"] is None
    assert (row["occupancy_pct"], row["occupancy_pct_excl_own_use"], row["collected_per_sf"]) == (0, 0, 0)
    assert row["accounts_receivable"] == Decimal("-1930.00")
    assert "2025-12" not in by_month(models.building_kpi(ledger, lease))


def test_toggle_changes_effective_area_only(ledger, lease):
    plain = by_month(models.prop_kpi(ledger, lease))["2025-01"].asDict()
    without = by_month(models.prop_kpi(ledger, lease, exclude_own_use=True))["2025-01"].asDict()
    changed = {k for k in plain if plain[k] != without[k]}
    assert changed == {"effective_sqft", "occupancy_pct_excl_own_use", "collected_per_sf"}
    assert (plain["effective_sqft"], without["effective_sqft"]) == (2453, 2168)


def test_buildings_leave_out_unknown_ones(ledger, lease):
    got = {r["building"]: r for r in models.building_kpi(ledger, lease).where("as_of_month = '2025-01'").collect()}
    assert set(got) == {"A", "B"}
    assert (got["A"]["total_sqft"], got["A"]["occupied_sqft"], got["A"]["vacant_count"]) == (318, 218, 1)
    assert got["B"]["occupancy_pct"] == 100.0 and got["B"]["own_use_sqft"] == 285
    toggled = models.building_kpi(ledger, lease, exclude_own_use=True).where("as_of_month = '2025-01'")
    b = {r["building"]: r for r in toggled.collect()}["B"]
    assert (b["effective_occupied_sqft"], b["occupied_sqft"]) == (1800, 2085)


def test_building_areas_add_up(ledger, lease):
    known = lease.where(F.col("building").isNotNull()).groupBy("as_of_month").agg(F.sum("sqft").alias("s"))
    split = models.building_kpi(ledger, lease).groupBy("as_of_month").agg(F.sum("total_sqft").alias("s"))
    assert known.exceptAll(split).count() == 0


def test_zero_base_and_null_keys(spark):
    data = [("2025-01", date(2025, 1, 1), 0.0, 5.0, None, None, None, "h", "2025-01-01"),
            ("2025-02", None, 1.0, 1.0, 1.0, 1.0, 1.0, "h", "2025-01-01"),
            (None, date(2025, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0, "h", "2025-01-01")]
    rent = models.fact_rent(models.stage_ledger(spark.createDataFrame(data, schemas.RAW_LEDGER))).collect()
    assert len(rent) == 1 and rent[0]["collection_rate_pct"] == 0.0 and rent[0]["total_billed"] is None


def test_noi_takes_fixed_and_variable_expenses(spark, ledger):
    data = [("2025-01", date(2025, 1, 1), item, amount, category, "h", "2025-01-01")
            for item, amount, category in (("Water", 130.0, "fixed"), ("Repairs", 1000.0, "variable"),
                                           ("CAPEX", 5000.0, "other"), ("Internet", None, "fixed"))]
    expense = models.fact_expense(models.stage_expenses(spark.createDataFrame(data, schemas.RAW_EXPENSES)))
    assert {r["expense_category"]: r["line_item_count"] for r in expense.collect()} == {
        "fixed": 1, "variable": 1, "other": 1}
    got = by_month(models.noi(models.fact_rent(ledger), expense))
    assert got["2025-01"]["noi"] == Decimal("18000.00") and got["2025-01"]["total_expenses"] == Decimal("1130.00")
    assert got["2025-02"]["noi"] == Decimal("15036.00") and got["2025-02"]["noi_margin_pct"] == 100.0


def test_dimensions_keep_conflicting_rows_and_latest_resolves_them(spark):
    data = [("2025-01", "1A", "A", "Acme", 10.0, 1.0, 12.0, 1.2, False, False, "h", "2025-01-01"),
            ("2025-02", "1A", "A", "Acme", 12.0, 1.0, 12.0, 1.0, False, True, "h", "2025-01-01"),
            ("2025-02", "2A", "A", None, 12.0, 1.0, 12.0, 1.0, True, False, "h", "2025-01-01")]
    lease = models.stage_lease(spark.createDataFrame(data, schemas.RAW_LEASE))
    assert models.dim_suite(lease).count() == 3 and models.dim_tenant(lease).count() == 3
    latest = {r["suite_id"]: r["sqft"] for r in models.dim_suite_latest(lease).collect()}
    assert latest == {"1A": 12, "2A": 12}
    tenants = {r["tenant_name"]: (r["tenant_id"], r["is_own_use"]) for r in models.dim_tenant_latest(lease).collect()}
    assert tenants["Acme"][1] is True and tenants[None] == (None, False)


def test_calendar_fills_gaps(spark, ledger):
    assert models.dim_calendar(ledger).count() == 12
    assert models.dim_calendar(ledger.where("false")).count() == 0


def test_summary_card_exists_without_kpis(ledger, lease):
    card = dashboard.summary_cards(models.prop_kpi(ledger.where("false"), lease), lease).first()
    assert (card["occupancy"], card["monthly_revenue"], card["total_suites"], card["vacant_suites"]) == (0, 0, 5, 1)


def test_overview_skips_months_without_collections(spark, ledger, lease):
    later = ledger.where("as_of_month = '2025-02'").withColumns(
        {"as_of_month": F.lit("2025-03"), "month": F.lit(date(2025, 3, 1)), "collected": F.lit(None).cast("decimal(18,2)")})
    kpi = models.prop_kpi(ledger.where("as_of_month <= '2025-02'").unionByName(later), lease)
    assert reports.property_overview(kpi).first()["month"] == date(2025, 2, 1)


def test_reports_keep_every_property(ledger, lease):
    keys = ["property_id"]

    def two(df):
        older = df.where("as_of_month <= '2025-01'").withColumn("property_id", F.lit("q"))
        return df.withColumn("property_id", F.lit("p")).unionByName(older)

    prop = two(models.prop_kpi(ledger, lease, revenue_sqft=True))
    building = two(models.building_kpi(ledger, lease, revenue_sqft=True))
    rent = two(models.fact_rent(ledger))
    made = [(reports.property_overview, (prop,)), (reports.revenue_trends, (rent,)), (reports.building_comparison, (building,)),
            (reports.revenue_by_building, (rent, prop, building)), (reports.kpi_summary, (prop, building))]
    for report, frames in made:
        got = report(*frames, keys=keys).collect()
        for who in ("p", "q"):
            alone = report(*[f.where(F.col("property_id") == who).drop("property_id") for f in frames]).collect()
            assert alone and sorted(map(repr, alone)) == sorted(repr(type(r)(**{k: v for k, v in r.asDict().items() if k != "property_id"})) for r in got if r["property_id"] == who)


def test_reports_read_one_snapshot_when_months_repeat(ledger, lease):
    again = ledger.where("as_of_month = '2025-01'").withColumn("as_of_month", F.lit("2025-02"))
    both = ledger.where("as_of_month <= '2025-02'").unionByName(again)
    building = models.building_kpi(both, lease, revenue_sqft=True)
    prop = models.prop_kpi(both, lease, revenue_sqft=True)
    assert reports.kpi_summary(prop, building).count() == 1
    split = reports.revenue_by_building(models.fact_rent(both), prop, building).collect()
    assert [r["Building"] for r in split] == ["A", "B"]


def test_parameters_are_bound_not_spliced(spark, ledger):
    hostile = "x' OR '1' = '1"
    text = "SELECT * FROM {ledger} WHERE as_of_month = ${month}"
    assert reports.parameterised(spark, text, {"month": hostile}, ledger=ledger).count() == 0
    assert reports.parameterised(spark, text, {"month": "2025-01"}, ledger=ledger).count() == 1


def test_history_and_band(ledger, lease):
    windowed = windows.window_filter(models.fact_rent(ledger), "12m")
    assert windowed.count() == 3 and windows.window_filter(models.fact_rent(ledger), "3m").count() == 1
    assert windows.window_filter(models.fact_rent(ledger), "ytd").count() == 3
    assert windows.since(models.fact_rent(ledger), "2025-12-15", 6).count() == 1
