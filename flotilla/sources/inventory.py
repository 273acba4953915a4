"""Inventory polls, snapshots and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.states import effective_container_state
from ..functions.text import TAG_NAMES
from ..plans.groups import nested


def inventory_scan(reservations: DataFrame, tag_prefix: str) -> DataFrame:
    """``cluster_id`` and the columns of each instance that carries a cluster-id tag.

    ``reservations`` has ``instances``: an array of structs whose ``tags`` is an array of
    ``struct<key, value>``. Instances without the tag are dropped.
    """
    tag = F.filter("instance.tags", lambda t: t["key"] == tag_prefix + TAG_NAMES["cluster_id"])
    flat = reservations.select(F.explode("instances").alias("instance"))
    return flat.select(F.try_element_at(tag, F.lit(1))["value"].alias("cluster_id"), "instance.*").where(
        F.col("cluster_id").isNotNull())


def available_groups(groups: DataFrame, state_col: str, name_col: str, wanted: str = "available") -> DataFrame:
    return groups.where(F.col(state_col) == wanted).select(name_col)


def price_history_scan(prices: DataFrame, types_df: DataFrame, zone: str, product: str, since) -> DataFrame:
    """Prices of the wanted types in a zone from ``since`` on, by time. No types, no rows."""
    picked = prices.where(
        (F.col("zone") == zone) & (F.col("product") == product) & (F.col("ts") >= F.lit(since).cast(prices.schema["ts"].dataType)))
    return picked.join(types_df.select("instance_type"), "instance_type", "left_semi").orderBy("ts", *[c for c in prices.columns if c != "ts"])


APP_HISTORY = T.StructType([
    T.StructField("activeapps", T.ArrayType(T.StructType([T.StructField("id", T.StringType())]))),
    T.StructField("completedapps", T.ArrayType(T.StructType([
        T.StructField("starttime", T.LongType()), T.StructField("duration", T.LongType())]))),
])


def app_history_scan(history: DataFrame, json_col: str) -> DataFrame:
    """Other columns, ``start_at, end_at`` per completed application and the ``active`` count.

    A document without completed applications gives one row with null times.
    """
    others = [c for c in history.columns if c != json_col]
    doc = history.select(*others, F.from_json(json_col, APP_HISTORY).alias("d"))
    runs = doc.select(*others, F.size("d.activeapps").alias("active"), F.explode_outer("d.completedapps").alias("run"))
    return runs.select(
        *others,
        F.timestamp_millis("run.starttime").alias("start_at"),
        F.timestamp_millis(F.col("run.starttime") + F.col("run.duration")).alias("end_at"),
        "active")


def app_run_scan(history: DataFrame, json_col: str) -> tuple[DataFrame, DataFrame]:
    """``(runs, rejects)`` of application histories, as ``activity_count``, ``last_activity`` and ``timeout_verdict`` take them.

    ``runs`` has the other columns and ``start_at, duration_ms, active``: one row for each completed application and, without times, for each
    active one. A document without applications gives none. ``rejects`` has the documents that can't be read, with the
    ``reason``; they say nothing of a cluster, so it should not be judged (``available_col`` of ``timeout_verdict``).
    """
    others = [c for c in history.columns if c != json_col]
    schema = T.StructType([*APP_HISTORY.fields, T.StructField("_corrupt_record", T.StringType())])
    parse = F.from_json(F.col(json_col), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    # the one-element explode keeps the parse from being copied into every use of it
    doc = history.select(*history.columns, F.explode(F.array(parse)).alias("__d"))
    reason = F.when(F.col(json_col).isNull(), "no document").when(F.col("__d").isNull() | F.col("__d._corrupt_record").isNotNull(), "malformed JSON").when(
        F.col("__d.activeapps").isNull() | F.col("__d.completedapps").isNull(), "no applications listed")
    read = doc.withColumn("reason", reason)
    run = lambda start, duration, active: F.struct(start.alias("start_at"), duration.alias("duration_ms"), F.lit(active).alias("active"))
    nothing = F.lit(None)
    done = F.transform("__d.completedapps", lambda a: run(F.timestamp_millis(a["starttime"]), a["duration"], False))
    now = F.transform("__d.activeapps", lambda a: run(nothing.cast("timestamp"), nothing.cast("bigint"), True))
    runs = read.where("reason is null").select(*others, F.inline(F.concat(done, now)))
    return runs, read.where("reason is not null").select(*history.columns, "reason")


IMAGE_LISTING = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])


def image_tag_scan(listings: DataFrame, json_col: str) -> DataFrame:
    """``repo, tag`` per tag of each listing, with the listing's other columns."""
    others = [c for c in listings.columns if c != json_col]
    doc = listings.select(*others, F.from_json(json_col, IMAGE_LISTING).alias("d"))
    return doc.select(*others, F.col("d.name").alias("repo"), F.explode("d.tags").alias("tag"))


SNAPSHOT_COLUMNS = ["instance_id", "address", "subnet_id", "placement_group", "image", "state", "container_state",
                    "instance_type", "launched_at", "terminated_at"]


def _instance_struct(instances: DataFrame) -> Column:
    """The instance columns at hand, with the container state as limited by the instance state."""
    fields = [
        effective_container_state(F.col("state"), F.col("container_state")).alias(c) if c == "container_state" else F.col(c)
        for c in SNAPSHOT_COLUMNS if c in instances.columns
    ]
    return F.struct(*fields)


def cluster_snapshot(clusters: DataFrame, instances: DataFrame, part_size: int) -> DataFrame:
    """Each cluster with a ``master`` struct and a ``workers`` array, in rows of about ``part_size`` workers.

    Rows are numbered ``part`` of ``parts``, each repeating the cluster and its master; a cluster of up to that size is one row.
    """
    member = _instance_struct(instances)
    masters = instances.where(F.col("role") == "Master").groupBy("cluster_id").agg(
        F.min_by(member, F.struct("launched_at", "instance_id")).alias("master"))
    nobody = F.lit(None).cast(masters.schema["master"].dataType)
    workers = instances.where(F.col("role") == "Worker").select("cluster_id", "instance_id", member.alias("worker"))
    # One row without a worker per cluster, so that every cluster comes out of the grouping and the
    # join below can be an inner one, which Spark can split at a cluster with very many parts.
    seats = workers.unionByName(clusters.select("cluster_id", F.lit("").alias("instance_id"), nobody.alias("worker")))
    groups = nested(seats, "cluster_id", "instance_id", F.col("worker"), part_size)
    return groups.select("cluster_id", "part", "parts", F.col("members").alias("workers")).join(
        clusters.join(masters, "cluster_id", "left"), "cluster_id").select(
        *clusters.columns, "master", "workers", "part", "parts")


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    """Land nested snapshot rows as JSON lines."""
    snapshots.write.mode("overwrite").json(path)


def snapshot_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The inventory polls landing at ``path`` as a stream.

    How often it is read belongs to the query that writes it, see ``run_every``.
    """
    return spark.readStream.schema(schema).parquet(path)
