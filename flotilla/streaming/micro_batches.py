"""State between micro-batches, kept as tables.

The streaming operators run their batch form on every micro-batch, together with a small table
of what earlier batches left behind. State is written to two folders in turn: batch ``n`` reads
what ``n - 1`` wrote and replaces what ``n - 2`` wrote, and its output goes to a folder named after
``n``. Replaying a batch after a failure therefore reads the same state and overwrites the same
output, and no old state piles up.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

# How often the inventory is polled, and how often timeouts are checked.
POLL_INTERVAL = "5 seconds"
TIMEOUT_INTERVAL = "1 minute"



def seconds_of(interval: str) -> int:
    """``"5 seconds"`` is 5, ``"1 minute"`` 60."""
    number, unit = interval.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600}[unit.rstrip("s")]


Step = Callable[[DataFrame, DataFrame, int], tuple[DataFrame, DataFrame]]


class TableState:
    """Rows carried from one micro-batch to the next, under a shared folder."""

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path.rstrip("/"), schema

    def _slot(self, batch_id: int) -> str:
        return f"{self.path}/slot={batch_id % 2}"

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(self._slot(batch_id - 1))

    def save(self, rows: DataFrame, batch_id: int) -> None:
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(self._slot(batch_id))


def stepwise(stream: DataFrame, state: TableState, out_path: str, step: Step,
             written: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """A writer that maps each micro-batch and the state before it to output rows and the next state.

    ``written`` gets the output, read from where it was written, and the batch id, once the state is saved too.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            out, after = step(batch, state.before(spark, batch_id), batch_id)
            place = f"{out_path}/batch={batch_id}"
            out.write.mode("overwrite").parquet(place)
            state.save(after, batch_id)
            if written is not None:
                written(spark.read.schema(out.schema).parquet(place), batch_id)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(run)


def output(spark: SparkSession, out_path: str, schema: T.StructType) -> DataFrame:
    """All output written so far."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out_path)


Writers = DataStreamWriter | Sequence[DataStreamWriter]


def _each(writers: Writers, checkpoint: str) -> list[DataStreamWriter]:
    """The writers of a chain, each reading what the one before it writes, with a checkpoint folder of its own."""
    chain = [writers] if isinstance(writers, DataStreamWriter) else list(writers)
    return [writer.option("checkpointLocation", f"{checkpoint}/{i}") for i, writer in enumerate(chain)]


def run_to_end(writers: Writers, checkpoint: str) -> None:
    """Process everything available, then stop. Timers that only time sets off would keep a query going, so batches without data are left out."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    for writer in _each(writers, checkpoint):
        conf = SparkSession.active().conf
        before = conf.get(name)
        conf.set(name, "false")
        try:
            query = writer.trigger(availableNow=True).start()
        finally:
            conf.set(name, before)
        query.awaitTermination()


def run_every(writers: Writers, checkpoint: str, interval: str = POLL_INTERVAL) -> list[StreamingQuery]:
    """Keep processing what arrives, a micro-batch per interval."""
    return [writer.trigger(processingTime=interval).start() for writer in _each(writers, checkpoint)]
