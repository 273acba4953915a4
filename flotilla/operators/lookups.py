"""Lookups by id.

No side is broadcast by hint: Spark broadcasts a catalogue while its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, splitting skewed keys at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.hot_keys import join_unique
from ..plans.rejects import split_rejects


def strict_lookup(fact: DataFrame, dim: DataFrame, key: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)``: every fact row must find its key in ``dim``."""
    joined = fact.join(dim.withColumn("__hit", F.lit(True)), key, "left")
    reason = F.when(F.col("__hit").isNull(), F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("(none)"))))
    rows, rejects = split_rejects(joined, reason, strict)
    return rows.drop("__hit"), rejects.select(*fact.columns, "reason")


def optional_lookup(fact: DataFrame, dim: DataFrame, key: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """As ``strict_lookup``, but a null key passes through with null columns."""
    joined = fact.join(dim.withColumn("__hit", F.lit(True)), key, "left")
    reason = F.when(F.col("__hit").isNull() & F.col(key).isNotNull(), F.concat(F.lit(f"unknown {key}: "), F.col(key).cast("string")))
    rows, rejects = split_rejects(joined, reason, strict)
    return rows.drop("__hit"), rejects.select(*fact.columns, "reason")


def ordered_lookup(ids: DataFrame, dim: DataFrame, key: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)``: ``dim`` rows for a list ``(pos, key)``, in list order; an unknown id is a reject."""
    rows, rejects = strict_lookup(ids.select("pos", key), dim, key, strict)
    return rows.orderBy("pos"), rejects


def owner_lookup(events: DataFrame, members: DataFrame, instance_col: str) -> tuple[DataFrame, DataFrame]:
    """``(rows with cluster_id, unknown)``: route events to the cluster that owns the instance."""
    owners = members.groupBy(F.col("instance_id").alias(instance_col)).agg(F.max("cluster_id").alias("cluster_id"))
    routed = join_unique(events, owners, instance_col, "left")
    return routed.where(F.col("cluster_id").isNotNull()), routed.where(F.col("cluster_id").isNull()).drop("cluster_id")


def member_semi(df: DataFrame, ids: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key is among ``ids``; all rows without such a set."""
    return df if ids is None else df.join(ids.select(key), key, "left_semi")


def completion_barrier(targets: DataFrame, invocations: DataFrame) -> DataFrame:
    """``command_id, instance_id`` of the successful targets of every finished command.

    A command is finished when as many invocations have ended as it has targets.
    """
    ended = F.col("status").isin("Success", "Cancelled", "Cancelling", "Failed", "TimedOut").cast("bigint")
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    counts = targets.select("command_id", one.alias("wanted"), zero.alias("ended")).unionByName(
        invocations.select("command_id", zero.alias("wanted"), ended.alias("ended")))
    finished = counts.groupBy("command_id").agg(F.sum("wanted").alias("wanted"), F.sum("ended").alias("ended")).where("wanted = ended")
    succeeded = targets.select("command_id", "instance_id", F.lit(True).alias("target"), F.lit(False).alias("ok")).unionByName(
        invocations.where(F.col("status") == "Success").select(
            "command_id", "instance_id", F.lit(False).alias("target"), F.lit(True).alias("ok")))
    per_target = succeeded.groupBy("command_id", "instance_id").agg(F.max("target").alias("target"), F.max("ok").alias("ok"))
    done = per_target.where("target and ok").select("command_id", "instance_id")
    return join_unique(done, finished.select("command_id"), "command_id", "left_semi")
