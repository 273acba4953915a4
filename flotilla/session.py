"""Session settings the operators rely on, and where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Shuffled bytes that adaptive execution gives a task, where there are partitions enough.
PARTITION_BYTES = "8m"

_local_scratch: str | None = None


def prepare(spark: SparkSession) -> SparkSession:
    """Set the SQL options every operator assumes. Safe to call repeatedly."""
    options = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a skewed join even if what follows by the same key then needs a shuffle of its own.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # What a task sorts and sums after a shuffle is ten to twenty times this in memory, whatever the size of the tables.
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": PARTITION_BYTES,
    }
    for name, value in options.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder under the shared folder named by ``spark.checkpoint.dir``.

    Without that setting a machine-local folder is used, which is only right when the
    driver and the tasks are one process; on a cluster a missing setting is an error.
    """
    global _local_scratch
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if _local_scratch is None:
            _local_scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        base = _local_scratch
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    place, files = _files(spark, path)
    return files.exists(place)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, with all in it."""
    place, files = _files(spark, path)
    files.delete(place, True)
