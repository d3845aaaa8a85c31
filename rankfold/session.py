"""Session construction and cluster-wide settings.

On a cluster the session already exists and carries its own configuration;
``get_session`` only fills in settings that are unset, so nothing here
overrides what the cluster operator chose.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults applied only when the running session has no value for the key.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "lz4",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "rankfold") -> SparkSession:
    """Return the active session, creating a local one if none exists."""
    active = SparkSession.getActiveSession()
    if active is not None:
        spark = active
    else:
        builder = SparkSession.builder.appName(app_name)
        if master:
            builder = builder.master(master)
        builder = builder.config("spark.ui.enabled", "false")
        # checkpointed intermediates are deleted once no longer referenced
        # (a context setting: clusters set it in their own configuration)
        builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        if master and master.startswith("local"):
            # one JVM holds driver and executors; only applies when this
            # process starts it (a running cluster keeps its own setting)
            builder = builder.config("spark.driver.memory", os.environ.get("RANKFOLD_DRIVER_MEMORY", "16g"))
        if shuffle_partitions is not None:
            builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        spark = builder.getOrCreate()
    for key, value in _DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    if spark.sparkContext.master.startswith("local"):
        checkpoint_dir(spark)
    # on a cluster the folder is resolved lazily by the operators that
    # checkpoint, which fail with a clear message if spark.checkpoint.dir is unset
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder for lineage cuts.

    Reads ``spark.checkpoint.dir`` from the session (the cluster names a shared
    folder there).  Only when it is unset -- local runs and tests -- a scratch
    folder is created and recorded, so ``DataFrame.checkpoint()`` and MLlib's
    ``checkpointInterval`` work the same way in both settings.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="rankfold-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder of intermediate rows deleted when the driver's JVM ends: later
    steps of the session may still read it, and no later session does."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def default_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

