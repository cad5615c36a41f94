"""How time grows with rows: headline models on copies of the tables with shifted order keys.

Usage: python tools/growth.py <sf_dir> <scratch_dir> [factors...]; 'skew' as a factor repeats factor 5 with a third of
all lines on one order.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from leasemill import registry  # noqa: E402
from leasemill.session import local_session  # noqa: E402

QUERIES = ["prop_kpi", "building_kpi", "kpi_windows", "scd2_lease", "forecast_wide", "quality_summary"]
SMALL = ["region", "nation", "customer", "part", "supplier"]


def replicate(spark, source: str, target: str, factor: int, skewed: bool) -> None:
    copies = spark.range(factor).withColumnRenamed("id", "copy")
    orders = spark.read.parquet(f"{source}/orders.parquet")
    lines = spark.read.parquet(f"{source}/lineitem.parquet")
    step = orders.agg(F.max("o_orderkey")).first()[0] + 1
    (orders.join(F.broadcast(copies)).withColumn("o_orderkey", F.col("o_orderkey") + F.col("copy") * step)
     .drop("copy").repartition(8).write.parquet(f"{target}/orders.parquet"))
    key = F.col("l_orderkey") + F.col("copy") * step
    if skewed:
        key = F.when(F.col("l_linenumber") % 3 == 0, F.lit(0).cast("bigint")).otherwise(key)
    (lines.join(F.broadcast(copies)).withColumn("l_orderkey", key).drop("copy")
     .repartition(8).write.parquet(f"{target}/lineitem.parquet"))
    for name in SMALL:
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"{target}/{name}.parquet")


def main(source: str, scratch: str, factors: list[str]) -> None:
    spark = local_session(8, "leasemill-growth")
    spark.sparkContext.setLogLevel("ERROR")
    # The joins must shuffle, as they would with tables too large to broadcast.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "4m")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
    queries = registry.queries()
    for factor in factors:
        skewed = factor == "skew"
        target = f"{scratch}/x{factor}"
        replicate(spark, source, target, 5 if skewed else int(factor), skewed)
        times = {}
        for name in QUERIES:
            taken = []
            for _ in range(3):
                start = time.perf_counter()
                queries[name](spark, target).write.format("noop").mode("overwrite").save()
                taken.append(time.perf_counter() - start)
            times[name] = round(min(taken[1:]), 2)
        print(factor, times, flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], sys.argv[3:] or ["1", "5", "10", "skew"])
