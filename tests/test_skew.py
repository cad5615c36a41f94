"""Tables in which one order holds a third of all lines and one month a third of all orders, joined by shuffle."""

from datetime import datetime

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from compare import connect, differences

import __spark_entry__ as driver

SOURCE = "/root/testdata/sf0.001"
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
}


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    for name in ("region", "nation", "customer", "part", "supplier"):
        pq.write_table(pq.read_table(f"{SOURCE}/{name}.parquet"), folder / f"{name}.parquet")
    lines = pq.read_table(f"{SOURCE}/lineitem.parquet")
    third = pa.array([i % 3 == 0 for i in range(len(lines))])
    key = pc.if_else(third, pa.scalar(0, lines["l_orderkey"].type), lines["l_orderkey"])
    lines = lines.set_column(lines.schema.get_field_index("l_orderkey"), "l_orderkey", key)
    pq.write_table(lines, folder / "lineitem.parquet", row_group_size=1000)
    orders = pq.read_table(f"{SOURCE}/orders.parquet")
    third = pa.array([i % 3 == 0 for i in range(len(orders))])
    day = pc.if_else(third, pa.scalar(datetime(1998, 5, 5), orders["o_orderdate"].type), orders["o_orderdate"])
    orders = orders.set_column(orders.schema.get_field_index("o_orderdate"), "o_orderdate", day)
    pq.write_table(orders, folder / "orders.parquet")
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield str(folder)
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["building_kpi", "prop_kpi_by_property", "noi_monthly", "kpi_windows", "scd2_lease",
                                  "scd2_by_property", "r04_vacant_suites", "tenant_suite_count", "quality_failures"])
def test_hot_keys_give_whole_results(spark, skewed, name):
    sql = driver.oracle_sql()[name]
    assert differences(driver.queries()[name](spark, skewed), connect(skewed), sql) is None
