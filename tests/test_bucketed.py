"""Plans over tables that are bucketed by their join key."""

import uuid

import pytest

from leasemill.plans import models, reports
from leasemill.registry import Portfolio
from leasemill.sources import sinks

SF = "/root/testdata/sf0.001"
GRAIN = ["property_id", "as_of_month"]


@pytest.fixture
def database(spark):
    name = f"mill_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name}")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield name
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    spark.sql(f"DROP DATABASE {name} CASCADE")


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_kpis_are_joined_where_they_lie(spark, database):
    p = Portfolio(spark, SF, by_property=True)
    ledger = sinks.write_bucketed(p.ledger, f"{database}.ledger", GRAIN, 6)
    lease = sinks.write_bucketed(p.lease, f"{database}.lease", GRAIN, 6)
    kpi = models.prop_kpi(ledger, lease, keys=p.keys)
    assert shuffles(models.prop_kpi(ledger.where("true"), lease.repartition(3), keys=p.keys)) > 0
    assert shuffles(kpi) == 0 and kpi.count() == p.ledger.count()
    building = models.building_kpi(ledger, lease, keys=p.keys)
    # Buildings are grouped by a longer key, which the buckets serve as well.
    assert shuffles(building) == 0 and building.count() > 0


def test_three_tables_of_one_key(spark, database):
    p = Portfolio(spark, SF, by_property=True)
    frames = {"rent": p.rent, "prop": p.prop(revenue_sqft=True), "bld": p.building(revenue_sqft=True)}
    rent, prop, bld = (sinks.write_bucketed(df, f"{database}.{n}", GRAIN, 6) for n, df in frames.items())
    joined = bld.join(rent.select(*GRAIN, "collected"), GRAIN).join(prop.select(*GRAIN, "revenue_sqft"), GRAIN)
    assert shuffles(joined) == 0
    got = sorted(map(tuple, reports.revenue_by_building(rent, prop, bld, p.keys).collect()))
    assert got == sorted(map(tuple, reports.revenue_by_building(*frames.values(), p.keys).collect())) != []
