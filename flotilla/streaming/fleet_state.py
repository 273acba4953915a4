"""The state of a fleet between polls: a table in buckets of its key, of which a poll rewrites only those in which a row changes.

A version of a bucket is a folder that is written once. A manifest for each micro-batch says which version of each bucket holds after it; the
rows of a batch that fails are in no manifest, and its replay writes them anew. Versions in neither of the last two manifests are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import delete_path, path_exists

_MANIFEST = "bucket int, version bigint"
NEVER = -1


class BucketedState:
    """Rows with one row a ``key`` in ``buckets`` parts under a shared folder; as many as the rows of a bucket should be few of the change."""

    def __init__(self, path: str, schema: T.StructType, key: str, buckets: int = 64):
        self.path, self.schema, self.key, self.buckets = path.rstrip("/"), schema, key, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _manifest(self, spark: SparkSession, batch: int) -> dict[int, int]:
        """Version of each bucket after a batch: at most ``buckets`` rows."""
        if batch < 0:
            return {}
        rows = spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/batch={batch}").collect()
        return {row.bucket: row.version for row in rows}

    def _folder(self, bucket: int, version: int) -> str:
        return f"{self.path}/data/version={version}/bucket={bucket}"

    def after(self, spark: SparkSession, batch: int) -> DataFrame:
        """The state after a batch; none before the first."""
        folders = [self._folder(b, v) for b, v in self._manifest(spark, batch).items() if v != NEVER]
        return spark.read.schema(self.schema).parquet(*folders) if folders else spark.createDataFrame([], self.schema)

    def save(self, before: DataFrame, rows: DataFrame, batch: int) -> int:
        """Make ``rows`` the state after ``batch``, where ``before`` is that after the batch before; the number of buckets written."""
        spark, cols = rows.sparkSession, self.schema.fieldNames()
        nothing = F.lit(None).cast(self.schema)
        both = before.select(F.col(self.key), F.struct(*cols).alias("old"), nothing.alias("new")).unionByName(
            rows.select(F.col(self.key), nothing.alias("old"), F.struct(*cols).alias("new")))
        both = both.groupBy(self.key).agg(F.max("old").alias("old"), F.max("new").alias("new")).withColumn("bucket", self._bucket()).persist()
        try:
            # one row a bucket
            touched = both.groupBy("bucket").agg(F.max(~F.col("old").eqNullSafe(F.col("new"))).alias("changed"), F.count("new").alias("n"))
            written = {row.bucket: row.n for row in touched.where("changed").collect()}
            if written:
                kept = both.where(F.col("bucket").isin(list(written)) & F.col("new").isNotNull()).select("new.*", "bucket")
                kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={batch}")
        finally:
            both.unpersist()
        old = self._manifest(spark, batch - 1)
        new = old | {bucket: batch if n else NEVER for bucket, n in written.items()}
        manifest = spark.createDataFrame(sorted(new.items()), _MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch}")
        self._forget(spark, [set(old.items()), set(new.items())], batch)
        return len(written)

    def latest(self, spark: SparkSession) -> DataFrame:
        """The state after the last batch there was."""
        last = spark.read.schema(f"{_MANIFEST}, batch bigint").parquet(f"{self.path}/manifest").agg(F.max("batch")).first()[0]
        return self.after(spark, -1 if last is None else last)

    def _forget(self, spark: SparkSession, held: list[set], batch: int) -> None:
        """Delete the versions that the manifest of two batches ago held and the last two don't, then that manifest."""
        manifest = f"{self.path}/manifest/batch={batch - 2}"
        if batch > 1 and path_exists(spark, manifest):
            stale = set(self._manifest(spark, batch - 2).items()) - held[0] - held[1]
            # the manifest goes last, so that a replay finds what is left to delete
            for folder in [*(self._folder(b, v) for b, v in sorted(stale) if v != NEVER), manifest]:
                delete_path(spark, folder)
