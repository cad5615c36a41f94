"""Models over empty inputs give empty results, not errors."""

import pytest

from leasemill import schemas
from leasemill.operators import forecast as fc
from leasemill.operators import history, windows
from leasemill.plans import dashboard, models, reports


@pytest.fixture(scope="module")
def empty(spark):
    def staged(stage, table):
        return stage(spark.createDataFrame([], schemas.BRONZE[table][0]))

    return (staged(models.stage_ledger, schemas.LEDGER_TABLE), staged(models.stage_lease, schemas.LEASE_TABLE),
            staged(models.stage_expenses, schemas.EXPENSE_TABLE))


def test_empty_inputs(empty):
    ledger, lease, expenses = empty
    prop = models.prop_kpi(ledger, lease, revenue_sqft=True)
    building = models.building_kpi(ledger, lease, revenue_sqft=True)
    rent = models.fact_rent(ledger)
    frames = [
        prop, building, rent, models.noi(rent, models.fact_expense(expenses)),
        windows.trailing_kpis(prop), windows.pair_counted_kpis(prop), windows.window_filter(prop, "ytd"),
        history.versions(lease), fc.wide(fc.forecast(fc.long_series(prop))),
        reports.kpi_summary(prop, building), reports.revenue_by_building(rent, prop, building),
        reports.vacant_suites(lease), dashboard.portfolio_totals(building, rent), dashboard.building_latest(building),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)
    assert dashboard.summary_cards(prop, lease).first()["total_suites"] == 0
