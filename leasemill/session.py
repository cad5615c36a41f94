"""Session settings and the shared folder for data that has to outlive a task."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, app: str = "leasemill") -> SparkSession:
    """Session for tests and the bench. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small local data would otherwise be merged into a single task after a shuffle.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # Call-site capture on every Column call costs more than building the plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.warehouse.dir", os.path.join(tempfile.gettempdir(), "leasemill-warehouse"))
        .getOrCreate()
    )


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the checkpoint location that every executor can reach.

    The session names the location in ``spark.checkpoint.dir``. Only a local session, where driver and
    executors are one process, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or _local_folders.get(context.applicationId)
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="leasemill-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
