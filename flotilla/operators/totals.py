"""Capacity, cost, activity and timeouts per cluster.

Instances are reduced to one row per cluster before any join with clusters, so a cluster with a
very large number of instances costs a partial aggregate and not a skewed join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.states import effective_container_state
from ..functions.text import plus_seconds
from .lookups import strict_lookup

MONEY = "decimal(38,4)"


def cluster_capacity(clusters: DataFrame, instances: DataFrame, specs: DataFrame,
                     strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(totals, rejects)``: cores, memory and storage of the running workers, hourly price of the unterminated ones.

    Each worker counts with its own type; a cluster without workers shows zeros. Unterminated workers of a
    type that ``specs`` doesn't have are rejects, and count for nothing.
    """
    live = instances.where((F.col("role") == "Worker") & (F.col("state") != "Terminated"))
    running = F.col("state") == "Running"
    total = lambda amount: F.sum(F.when(running, amount).otherwise(0)).cast("bigint")
    known, rejects = strict_lookup(live.select("cluster_id", "instance_id", "instance_type", "state"), specs, "instance_type", strict)
    sums = known.groupBy("cluster_id").agg(
        total(F.col("cores")).alias("cores"),
        total(F.col("memory_bytes")).alias("memory_bytes"),
        total(F.col("devices") * F.col("bytes_per_device")).alias("storage_bytes"),
        F.sum("hourly_price").alias("hourly_price"))
    zero = lambda c, kind="bigint": F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    shown = clusters.select("cluster_id").join(sums, "cluster_id", "left").select(
        "cluster_id", zero("cores"), zero("memory_bytes"), zero("storage_bytes"), zero("hourly_price", MONEY))
    return shown, rejects.select("cluster_id", "instance_id", "instance_type", "reason")


def _reduce(instances: DataFrame, amounts: dict[str, Column], master: Column) -> DataFrame:
    """Per cluster: sums over its workers and ``master``, a struct of its first master."""
    worker = F.col("role") == "Worker"
    first = F.min_by(master, F.when(F.col("role") == "Master", F.struct("launched_at", "instance_id")))
    return instances.groupBy("cluster_id").agg(
        *[F.sum(F.when(worker, amount).otherwise(0)).alias(name) for name, amount in amounts.items()],
        first.alias("master"))


def _priced(clusters: DataFrame, reduced: DataFrame, specs: DataFrame, keep: list[str]) -> DataFrame:
    worker_spec = specs.select(*[F.col(c).alias("worker_type" if c == "instance_type" else f"w_{c}") for c in specs.columns])
    master_spec = specs.select(F.col("instance_type").alias("master_type"), F.col("hourly_price").alias("m_hourly_price"))
    return (
        clusters.select("cluster_id", "worker_type", *keep)
        .join(reduced, "cluster_id", "left")
        .withColumn("master_type", F.col("master.instance_type"))
        .join(worker_spec, "worker_type", "left")
        .join(master_spec, "master_type", "left"))


def dashboard_totals(clusters: DataFrame, instances: DataFrame, specs: DataFrame) -> DataFrame:
    """Totals as the dashboard shows them.

    A worker counts while its container runs, at the cluster's worker type. The master adds its
    price unless terminated. An unknown type gives null figures.
    """
    effective = effective_container_state(F.col("state"), F.col("container_state"))
    reduced = _reduce(
        instances, {"workers": (effective == "ContainerRunning").cast("int")}, F.struct("instance_type", "state"))
    wide = _priced(clusters, reduced, specs, [])
    workers = F.coalesce("workers", F.lit(0))
    masters = F.when(F.col("master.state") != "Terminated", 1).otherwise(0)
    gib = F.lit(2**30)
    cost = F.col("w_hourly_price") * workers.cast("decimal(12,0)") + F.when(
        masters > 0, F.col("m_hourly_price")).otherwise(F.lit(0).cast("decimal(18,4)"))
    return wide.select(
        "cluster_id", workers.cast("bigint").alias("workers"),
        (F.col("w_cores") * workers).cast("bigint").alias("cores"),
        (F.col("w_memory_bytes") * workers / gib).cast("double").alias("memory_gib"),
        (F.col("w_devices") * F.col("w_bytes_per_device") * workers / gib).cast("double").alias("storage_gib"),
        F.round(cost, 2).cast("decimal(38,2)").alias("cost_per_hour"))


def billable_hours(start: Column, end: Column) -> Column:
    """Whole hours between, cut off, plus one."""
    return F.timestamp_diff("HOUR", start, end) + 1


def accrued_cost(clusters: DataFrame, instances: DataFrame, specs: DataFrame, now) -> DataFrame:
    """``cluster_id, cost`` so far: the master at its own type, workers at the cluster's worker type.

    Spot clusters (``is_spot``) have no figure, nor has a cluster with an unknown type.
    """
    kind = instances.schema["launched_at"].dataType
    hours = billable_hours(F.col("launched_at"), F.coalesce("terminated_at", F.lit(now).cast(kind)))
    reduced = _reduce(instances, {"hours": hours}, F.struct("instance_type", hours.alias("hours")))
    wide = _priced(clusters, reduced, specs, ["is_spot"])
    part = lambda h, price: F.when(h == 0, F.lit(0).cast("decimal(38,4)")).otherwise(
        (F.col(price) * h.cast("decimal(18,0)")).cast("decimal(38,4)"))
    cost = part(F.coalesce("hours", F.lit(0)), "w_hourly_price") + part(F.coalesce("master.hours", F.lit(0)), "m_hourly_price")
    return wide.select("cluster_id", F.when(~F.col("is_spot"), F.round(cost, 2)).cast("decimal(38,2)").alias("cost"))


def activity_count(runs: DataFrame, key: str) -> DataFrame:
    """``key, active, idle``: running applications, and whether there are none."""
    counts = runs.groupBy(key).agg(F.sum(F.col("active").cast("bigint")).alias("active"))
    return counts.withColumn("idle", F.col("active") == 0)


def run_end() -> Column:
    """When an application ended, by its ``start_at`` and ``duration_ms``."""
    return plus_seconds(F.col("start_at"), F.col("duration_ms") / F.lit(1000).cast("decimal(4,0)"))


def _activity(runs: DataFrame) -> DataFrame:
    """Per cluster: running applications and the end of the last completed one."""
    return runs.groupBy("cluster_id").agg(
        F.sum(F.col("active").cast("bigint")).alias("active"), F.max(F.when(~F.col("active"), run_end())).alias("last_end"))


def last_activity(clusters: DataFrame, runs: DataFrame) -> DataFrame:
    """``cluster_id, last_activity``: end of the last completed application, else the launch."""
    return clusters.join(_activity(runs), "cluster_id", "left").select(
        "cluster_id", F.coalesce("last_end", "launched_at").alias("last_activity"))


def timeout_verdict(clusters: DataFrame, runs: DataFrame, now, available_col: str | None = None) -> DataFrame:
    """``cluster_id, verdict``: ``TTLExpired``, ``IdleTimeout`` or null.

    Only a reachable master with a running container is judged, and never a cluster with an
    active application. Lifetime goes before idleness. ``available_col`` marks clusters whose
    history could be read; the others get no verdict.
    """
    wide = clusters.join(_activity(runs), "cluster_id", "left")
    moment = F.lit(now).cast(clusters.schema["launched_at"].dataType)
    return wide.select("cluster_id", verdict(moment, F.col(available_col) if available_col else None).alias("verdict"))


def verdict(moment: Column, available: Column | None = None) -> Column:
    """The verdict on a row of a cluster's facts with ``active`` and ``last_end`` of its history."""
    running = effective_container_state(F.col("master_state"), F.col("master_container")) == "ContainerRunning"
    judged = F.col("master_address").isNotNull() & running & (F.coalesce("active", F.lit(0)) == 0)
    if available is not None:
        judged = judged & available
    ttl_end = plus_seconds(F.col("launched_at"), F.col("ttl_hours") * 3600)
    idle_end = plus_seconds(F.coalesce("last_end", "launched_at"), F.col("idle_minutes") * 60)
    return F.when(judged & (moment > ttl_end), "TTLExpired").when(judged & (moment > idle_end), "IdleTimeout")
