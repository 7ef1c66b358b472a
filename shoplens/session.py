"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings every job relies on. Times are UTC instants; adaptive execution sizes
# the shuffles, splits skewed join partitions and picks broadcasts from measured sizes.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A tenant may hold a third of all rows. Where the tenant table is too big to broadcast,
    # its join partition is split even though the grouping above then needs a shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # A task's sorts and hash tables take some 25 times the shuffled bytes it reads, which are compressed:
    # tasks of 64 MB, the default, hold 1.6 GB in a join with a count of distinct keys on it.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "24m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "96m",
    # Streaming state lives on the executors' disks, not in their heaps.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that may have been built elsewhere."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session for scripts and tests; on a cluster ``master`` comes from spark-submit."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        # Recording the Python call site of every column costs more than small plans take to run.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


_local_root: list[str] = []


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, where every executor can reach it.

    Only a local session without that setting falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        if not _local_root:
            _local_root.append(tempfile.mkdtemp(prefix="shoplens-"))
        root = _local_root[0]
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
