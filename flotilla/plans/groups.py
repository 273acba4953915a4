"""Nested groups in parts of a given size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hot_keys import hot_limit, split_join

def nested(df: DataFrame, key: str, spread_col: str, member: Column, part_size: int, min_hot_rows: int | None = None) -> DataFrame:
    """``key, n, part, parts, members``: each key's members as arrays of about ``part_size`` or fewer.

    A key with more members than that gets several parts, spread by a hash of ``spread_col``, so
    no row of the result and no task has to hold a whole large group; how many is for the caller to say. Rows
    whose ``member`` is null make sure that their key appears (in part 0) and count for nothing.
    """
    rows = df.select(key, member.alias("member"), F.xxhash64(spread_col).alias("spread"))
    counts = rows.groupBy(key).agg(F.count("member").alias("n"))
    parts = F.greatest(F.ceil(F.col("n") / F.lit(part_size)), F.lit(1)).cast("bigint")
    hot = counts.where(F.col("n") > hot_limit(counts, F.sum("n"), min_hot_rows)).select(key)
    sized = split_join(rows, counts.withColumn("parts", parts), key, "inner", hot)
    part = F.when(F.col("member").isNull(), F.lit(0)).otherwise(F.pmod("spread", "parts"))
    # Cut by part before grouping: rows clustered by key alone would do for the grouping below and
    # put a large key into one task.
    split = sized.withColumn("part", part.cast("bigint")).repartition(key, "part")
    return split.groupBy(key, "n", "parts", "part").agg(F.array_sort(F.collect_list("member")).alias("members"))
