"""Spark session settings shared by tests, the bench and local runs.

On a cluster the session comes from the platform; the library only reads its
settings. ``checkpoint_dir`` returns the shared folder named in
``spark.checkpoint.dir``; a session without one is an error.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings that matter for the operators' plans:
# * AQE re-plans joins from real shuffle sizes, coalesces small partitions and
#   splits skewed join partitions (a hot user or a hot invoice).
# * Session time zone is pinned so any timestamp <-> epoch conversion is stable;
#   the operators themselves only use zone-free arithmetic on timestamp_ntz.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    master: str | None = None,
    app_name: str = "paylens",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the library's defaults.

    Without ``master`` none is set: on a cluster it comes from spark-submit.
    """
    builder = SparkSession.builder.appName(app_name)
    conf = dict(DEFAULT_CONF)
    if master is not None:
        builder = builder.master(master)
    if master is not None and master.startswith("local"):
        # local mode runs every task inside the driver JVM; 1 GB default is too small
        conf["spark.driver.memory"] = os.environ.get("PAYLENS_DRIVER_MEMORY", "8g")
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scale_settings(shuffle_bytes: int, cores: int, partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Session settings for a given shuffle volume (bytes moved by the largest
    exchange, after column pruning and partial aggregation) and total cores.

    Shuffle partitions target ``partition_bytes`` each (at least two waves of
    tasks), so a partition's sort and window buffers fit in executor memory;
    AQE then coalesces the small ones and splits skewed join partitions above
    the same size. Example: 20 TB shuffled on 8,000 cores -> 80,000 partitions.
    """
    partitions = max(2 * cores, -(-shuffle_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(min(partition_bytes, 512 * 1024 * 1024)),
    }


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables, from ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a folder all executors share")
    spark.sparkContext.setCheckpointDir(configured)
    return configured
