"""Session settings and the shared folder that jobs may write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

# Runtime settings every job relies on. Hot keys are split by the adaptive skew join, also where
# the split costs one more exchange for the aggregation that follows.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows may be whole documents: a batch of them has to fit beside the others of an executor.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    # Of two field names that differ only in case the later one counts.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tune(spark: SparkSession) -> SparkSession:
    """Applies the runtime settings to a session that somebody else created."""
    import stowage

    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    # Worker functions travel with the task, so executors need no copy of this package.
    cloudpickle.register_pickle_by_value(stowage)
    return spark


def build_session(app: str = "stowage", master: str | None = None,
                  **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below the cluster's shared folder.

    ``spark.checkpoint.dir`` names the folder. Only a local session may fall back to a temporary
    one, because there driver and tasks share a disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
