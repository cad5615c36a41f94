"""Tables that cut lineage: written below the session's shared checkpoint folder and read back."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from leasemill.session import shared_folder


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The frame, written once as Parquet where every executor can read it. A lost executor costs no recomputation."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows in a batch for Python, in place of Spark's 10,000: texts are long, and a task holds several copies of a batch.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """The session, ready for the operators.

    The package is sent to the executors once, for clusters where it isn't installed, and batches are made smaller where the
    session has not set their size itself.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="leasemill-")) / "leasemill_package.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for p in sorted(package.rglob("*.py")):
                out.write(p, p.relative_to(package.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return spark
