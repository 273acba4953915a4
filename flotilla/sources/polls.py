"""Polls of an inventory as a source: each lands whole, then is announced, and a stream of announcements says which to read.

A stream over the files of polls may cut one between two micro-batches, and can't tell a poll that found nothing from one that did
not take place. An announcement is one row, written when its poll is: so a micro-batch has whole polls, however many files they have,
and an empty poll makes one too. The rows of a poll can be read again at any time, by its number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import path_exists


class PollLog:
    """Polls under a shared folder, by ``poll_col``, a number that grows with time."""

    def __init__(self, path: str, schema: T.StructType, poll_col: str = "poll_no"):
        self.path, self.poll_col = path.rstrip("/"), poll_col
        number = T.StructField(poll_col, T.LongType())
        self.schema = T.StructType([*[f for f in schema.fields if f.name != poll_col], number])
        self._announcement = T.StructType([number])

    def land(self, rows: DataFrame, poll: int) -> None:
        """Write one poll, which may be empty, and announce it. Landing it again before it is announced overwrites it."""
        data = [c for c in self.schema.fieldNames() if c != self.poll_col]
        rows.select(*data).write.mode("overwrite").parquet(self._place(poll))
        self._announce(rows.sparkSession.range(0, 1, 1, 1).select(F.lit(poll).cast("bigint").alias(self.poll_col)))

    def land_all(self, rows: DataFrame, key: str, announcements: int = 1) -> None:
        """Write the polls of a table in one go and announce them in order, in so many parts.

        A row with a null ``key`` says that its poll took place and is not written.
        """
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        rows.where(F.col(key).isNotNull()).write.mode("append").partitionBy(self.poll_col).parquet(f"{self.path}/data")
        # one row a poll
        numbers = rows.select(self.poll_col).distinct().persist()
        try:
            spans = numbers.agg(F.min(self.poll_col), F.max(self.poll_col)).first()
            if spans[0] is not None:
                low, width = spans[0], spans[1] + 1 - spans[0]
                for i in range(announcements):
                    start, end = low + width * i // announcements, low + width * (i + 1) // announcements
                    self._announce(numbers.where(F.col(self.poll_col).between(start, end - 1)).coalesce(1))
        finally:
            numbers.unpersist()

    def _place(self, poll: int) -> str:
        return f"{self.path}/data/{self.poll_col}={poll}"

    def _announce(self, numbers: DataFrame) -> None:
        numbers.write.mode("append").parquet(f"{self.path}/announced")

    def announced(self, spark: SparkSession, files: int = 1) -> DataFrame:
        """The stream of announcements, so many files of them a micro-batch."""
        return spark.readStream.schema(self._announcement).option("maxFilesPerTrigger", files).parquet(f"{self.path}/announced")

    def numbers(self, batch: DataFrame, after: int | None = None) -> list[int]:
        """The polls that a micro-batch announces, in order, without those that are not ``after`` a poll dealt with before."""
        found = sorted(row[0] for row in batch.select(self.poll_col).distinct().collect())
        return [n for n in found if after is None or n > after]

    def read(self, spark: SparkSession, polls: Sequence[int]) -> DataFrame:
        """The rows of polls, with their numbers; polls without a folder found nothing."""
        places = [place for place in map(self._place, polls) if path_exists(spark, place)]
        if not places:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).option("basePath", f"{self.path}/data").parquet(*places)
