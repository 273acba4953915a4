"""Clusters from instances, and snapshots against snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.hot_keys import join_unique
from .tags import tag_pivot


def group_members(instances: DataFrame, key: str) -> DataFrame:
    """``key, n, instance_id``: each member of each group with the group's size, without rows that have no key.

    ``plans.groups.nested`` makes arrays of them, in parts of a size its caller gives.
    """
    rows = instances.where(F.col(key).isNotNull()).select(key, "instance_id")
    return join_unique(rows, rows.groupBy(key).agg(F.count("*").alias("n")), key, "inner").select(key, "n", "instance_id")


def assemble_clusters(instances: DataFrame, tag_rows: DataFrame, tag_prefix: str) -> tuple[DataFrame, DataFrame]:
    """``(clusters, members)``: clusters with a master and all four required tags.

    The first master by launch time leads; ``launched_at`` is its. Members are that master and
    the workers of the assembled clusters.
    """
    masters = instances.where(F.col("role") == "Master").groupBy("cluster_id").agg(
        F.min(F.struct("launched_at", "instance_id")).alias("m"))
    tags = tag_pivot(tag_rows, tag_prefix).select(
        "cluster_id", "name", F.col("cluster_image").alias("image"), "worker_type", "subnet_id", "placement_group",
        "ttl_hours", "idle_minutes", "bid_price")
    clusters = tags.dropna(subset=["name", "image", "worker_type", "subnet_id"]).join(masters, "cluster_id").select(
        *tags.columns, F.col("m.instance_id").alias("master_id"), F.col("m.launched_at").alias("launched_at"))
    workers = join_unique(
        instances.where(F.col("role") == "Worker"), clusters.select("cluster_id"), "cluster_id", "left_semi")
    members = clusters.select("cluster_id", F.col("master_id").alias("instance_id"), F.lit("Master").alias("role"))
    return clusters, members.unionByName(workers.select("cluster_id", "instance_id", "role"))


def snapshot_diff(prev: DataFrame, cur: DataFrame, key: str) -> DataFrame:
    """``key, change``: added, removed or retained."""
    side = lambda df, old: df.select(key, F.lit(old).alias("old"), F.lit(1 - old).alias("new"))
    seen = side(prev, 1).unionByName(side(cur, 0)).groupBy(key).agg(F.max("old").alias("old"), F.max("new").alias("new"))
    return seen.select(key, F.when(F.col("old") == 0, "added").when(F.col("new") == 0, "removed").otherwise("retained").alias("change"))


def poll_diff(polls: DataFrame, key: str, poll_col: str) -> DataFrame:
    """``poll, key, change``: the added and removed keys of every poll against the last one before it that took place.

    A failed poll is simply missing. A row with a null key says that its poll took place, so one that found nothing is such a row
    alone. The first poll is only compared against.
    """
    # one row a poll, so the order of all polls is a small matter
    follows = polls.select(poll_col).distinct().withColumn("__next", F.lead(poll_col).over(Window.orderBy(poll_col)))
    first = follows.agg(F.min(poll_col)).scalar()
    held = polls.where(F.col(key).isNotNull())
    now = held.where(F.col(poll_col) > first).select(key, poll_col, F.lit(0).alias("old"), F.lit(1).alias("new"))
    then = held.join(follows.where("__next is not null"), poll_col).select(
        key, F.col("__next").alias(poll_col), F.lit(1).alias("old"), F.lit(0).alias("new"))
    seen = now.unionByName(then).groupBy(poll_col, key).agg(F.max("old").alias("old"), F.max("new").alias("new"))
    return seen.where("old <> new").select(poll_col, key, F.when(F.col("old") == 0, "added").otherwise("removed").alias("change"))


def snapshot_apply(prev: DataFrame, cur: DataFrame, key: str, sticky_cols: list[str], overwrite_cols: list[str],
                   cluster_col: str | None = None, is_master: Column | None = None) -> DataFrame:
    """State after a poll: retained rows updated, new rows added, the rest removed.

    Overwrite columns take the new value even when null, sticky ones only when present; other
    columns stay as they were. With ``cluster_col``, a cluster that has rows but no master in
    ``cur`` keeps its old rows untouched.
    """
    frozen = None
    if cluster_col is not None:
        seen = cur.groupBy(cluster_col).agg(F.max(F.coalesce(is_master, F.lit(False))).alias("led"))
        led = lambda rows, test: join_unique(
            rows, seen.where(test).select(cluster_col), cluster_col, "left_semi").select(*prev.columns)
        frozen, cur = led(prev, ~F.col("led")), led(cur, F.col("led"))
    cols = [c for c in prev.columns if c != key]
    nothing = F.lit(None).cast(prev.select(F.struct(*cols).alias("r")).schema["r"].dataType)
    both = prev.select(key, F.struct(*cols).alias("old"), nothing.alias("new")).unionByName(
        cur.select(key, nothing.alias("old"), F.struct(*cols).alias("new")))
    rows = both.groupBy(key).agg(F.max("old").alias("old"), F.max("new").alias("new")).where("new is not null")

    def value(c: str) -> Column:
        if c in overwrite_cols:
            return F.col(f"new.{c}")
        if c in sticky_cols:
            return F.coalesce(f"new.{c}", f"old.{c}")
        return F.when(F.col("old").isNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))

    out = rows.select(key, *[value(c).alias(c) for c in cols]).select(*prev.columns)
    return out if frozen is None else out.unionByName(frozen)
