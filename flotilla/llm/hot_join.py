"""A join whose large side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with more rows than this and than ``HOT_SHARE`` of all, so there are never more than ``1 / HOT_SHARE`` hot keys to broadcast.
HOT_ROWS = 2000
HOT_SHARE = 1 / 20_000


def salted_join(rows: DataFrame, unique: DataFrame, key: str, how: str, spread: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined to ``unique`` (one row a key) with ``how`` inner or left, hot keys dealt to several tasks.

    The rows of a hot key are dealt by a hash of the columns ``spread``, which tell them apart; its row of ``unique`` is copied to
    each share. ``rows`` is read twice, so it should be a landed table. Null keys meet nothing. The hot keys are broadcast: by
    construction at most 20,000.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    limit = counts.agg(F.greatest(F.sum("__n") * F.lit(HOT_SHARE), F.lit(float(hot_rows)))).scalar()
    hot = F.broadcast(counts.where(F.col("__n") > limit).select(key, F.ceil(F.col("__n") / limit).alias("__shares")))
    shares = F.coalesce(F.col("__shares"), F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*spread), shares)).drop("__shares")
    copied = unique.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), shares - 1))).drop("__shares")
    return dealt.join(copied, [key, "__salt"], how).drop("__salt")
