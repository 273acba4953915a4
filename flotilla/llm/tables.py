"""Reading input tables, keeping input columns beside results, and the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def wrapped(docs: DataFrame, **columns) -> DataFrame:
    """``docs`` as one struct column ``row`` beside the named columns, so that no name can clash."""
    return docs.select(F.struct(*[docs[f"`{name}`"] for name in docs.columns]).alias("row"),
                       *[value.alias(name) for name, value in columns.items()])


def unwrapped(rows: DataFrame, results: dict) -> DataFrame:
    """The input's columns out of ``row``, then the results; a result replaces an input column of its name."""
    taken = {name.lower() for name in results}
    kept = [F.col(f"row.`{name}`").alias(name) for name in rows.schema["row"].dataType.names if name.lower() not in taken]
    return rows.select(*kept, *[value.alias(name) for name, value in results.items()])


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session may go without and gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def landed(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a new table in the shared folder and read again: its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What a Python worker keeps between tasks, see ``held``.
_HELD: dict = {}


def held(make: Callable, *args: Hashable):
    """``make(*args)``, kept by the worker for its next tasks; what it kept before goes, for a worker outlives the job it was started for."""
    key = (make, *args)
    if key not in _HELD:
        release()
        _HELD[key] = make(*args)
    return _HELD[key]


def release() -> None:
    """Let go of what an operator before this one left in the worker."""
    _HELD.clear()


#: For Python workers: freed memory goes back to the system and not into pools, of which a worker would keep its peak for good, and one thread.
FRUGAL = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "262144", "MALLOC_TRIM_THRESHOLD_": "262144", "ARROW_DEFAULT_MEMORY_POOL": "system",
          # the cores are Spark's: a thread for each of them in every worker waits for the others and for memory
          "TOKENIZERS_PARALLELISM": "false"}
#: For workers that make and drop arrays of a few MB all the time: the system would clear their pages anew for each.
KEEPING = {"MALLOC_MMAP_THRESHOLD_": str(8 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20)}
#: Bytes of an Arrow batch between Spark and a Python worker; both sides hold a few.
BATCH_BYTES = 8 << 20


@contextmanager
def workers_with(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Functions that are given to Spark inside run in workers with these environment variables, others don't."""
    own = spark.sparkContext.environment
    before = dict(own)
    own.update(settings)
    try:
        yield
    finally:
        own.clear()
        own.update(before)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it (elsewhere ship it with ``--py-files``), and bound what they hold."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    for name, value in FRUGAL.items():
        spark.sparkContext.environment.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark
