"""Session settings, shuffle sizing, and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

SETTINGS: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even when that costs one more shuffle after it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

BROADCAST_LIMIT = 64 * 1024 * 1024

_local_dirs: dict[str, str] = {}


def build_session(
    app: str = "dayslice",
    master: str | None = None,
    conf: Mapping[str, str] | None = None,
) -> SparkSession:
    """A session with the settings every job here relies on; `conf` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_partitions(
    input_bytes: int, cores: int, target_bytes: int = 128 * 1024 * 1024
) -> int:
    """Initial shuffle partition count for a job of this input size.

    One partition per `target_bytes`, rounded up to a whole number of waves over
    the cores, so that the last wave is full. AQE still merges what turns out small.
    """
    wanted = max(1, -(-input_bytes // target_bytes))
    waves = -(-wanted // cores)
    return waves * cores


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of a plan, or None where the session cannot tell."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except (AttributeError, TypeError):
        return None


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT) -> bool:
    """True only when the size estimate is known and below the limit."""
    size = estimated_bytes(df)
    return size is not None and size <= limit


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, for checkpoints and written tables.

    Taken from `spark.checkpoint.dir`. Where that is unset a temporary folder is
    made, but only for a local master, where driver and executors share one disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(_local_dirs[app])
    return _local_dirs[app]


def new_dir(spark: SparkSession, label: str) -> str:
    """Path of a fresh, not yet existing folder below the shared one."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts lineage with data that outlives any executor, so a frame used by several
    branches is computed once and a lost executor costs no recomputation.
    """
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
