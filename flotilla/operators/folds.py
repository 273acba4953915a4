"""Clusters and their instances as a log of decoded messages leaves them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.hot_keys import join_unique, previous_row
from ..sources.kinds import column_name
from .logs import IMAGE_ATTEMPT, IMAGE_REQUEST

# Which message kind says what of an instance; the field has one name in the message and in the instance.
INSTANCE_SAYS = {
    "InstanceState": "state",
    "InstanceContainerState": "containerState",
    "InstanceIpAddress": "ipAddress",
    "InstanceSubnet": "subnet",
    "InstanceTerminatedAt": "terminatedAt",
}
#: Fields of a cluster, and of an instance, that come from its snapshot and nothing else.
CLUSTER_FIELDS = ["name", "ttl", "idleTimeout", "workerInstanceType", "subnet", "placementGroup", "workerBidPrice", "launchedAt"]
INSTANCE_FIELDS = ["placementGroup", "dockerImage", "instanceType", "launchedAt"]


def _latest(test: Column, at: Column, value: Column) -> Column:
    """The last value for which the test holds, with its place; null if there is none."""
    return F.max_by(F.when(test, F.struct(at.alias("at"), value.alias("value"))), F.when(test, at))


def _present(messages: DataFrame, order: list[str]) -> DataFrame:
    """One row for each cluster that is there: ``cluster_id, since, snapshot, image, changing``."""
    kind = F.col("kind")
    failed = F.col("error").isNotNull()
    named = F.when(kind == "ClustersAdded", F.transform("clusters", lambda c, i: F.struct(c["id"].alias("id"), i.alias("pos"), c.alias("snapshot"))))
    snapshot = messages.schema["clusters"].dataType.elementType
    gone = F.transform("cluster_ids", lambda c, i: F.struct(c.alias("id"), i.alias("pos"), F.lit(None).cast(snapshot).alias("snapshot")))
    about = F.transform(F.array("cluster_id"), lambda c, i: F.struct(c.alias("id"), i.alias("pos"), F.lit(None).cast(snapshot).alias("snapshot")))
    said = messages.where(kind.isin("ClustersAdded", "ClustersRemoved", IMAGE_REQUEST) | ((kind == IMAGE_ATTEMPT) & ~failed)).select(
        *order, "kind", "docker_image", F.inline(F.coalesce(named, F.when(kind == "ClustersRemoved", gone), about)))
    at, mark = F.struct(*order, "pos"), kind.isin("ClustersAdded", "ClustersRemoved")
    rows = said.groupBy(F.col("id").alias("cluster_id")).agg(
        _latest(mark, at, F.col("snapshot")).alias("mark"),
        _latest(kind == IMAGE_ATTEMPT, at, F.col("docker_image")).alias("image"),
        _latest(kind.isin(IMAGE_ATTEMPT, IMAGE_REQUEST), at, kind == IMAGE_REQUEST).alias("changing"))
    return rows.where(F.col("mark.value").isNotNull()).select("cluster_id", F.col("mark.at").alias("since"), F.col("mark.value").alias("snapshot"), "image", "changing")


def _workers(messages: DataFrame, present: DataFrame, order: list[str], min_hot_rows: int | None) -> DataFrame:
    """``cluster_id, instance_id, master_id, since, instance`` of the workers that are there; ``instance`` is what they were added as."""
    kind = F.col("kind")
    place = [*order, "pos"]
    held = present.select("cluster_id", "since", F.col("snapshot.master.id").alias("master_id"))
    first = present.select("cluster_id", "since", F.col("snapshot.master.id").alias("master_id"), F.inline(F.transform(
        "snapshot.workers", lambda w, i: F.struct(w["id"].alias("instance_id"), i.alias("pos"), w.alias("instance"), F.lit(True).alias("added"))))).select(
        "cluster_id", "master_id", *[F.col(f"since.{c}").alias(c) for c in order], "pos", "instance_id", "instance", "added")
    instance = messages.schema["workers"].dataType.elementType
    named = F.when(kind == "WorkersAdded", F.transform("workers", lambda w, i: F.struct(
        w["id"].alias("instance_id"), i.alias("pos"), w.alias("instance"), F.lit(True).alias("added")))).otherwise(F.transform("worker_ids", lambda w, i: F.struct(
            w.alias("instance_id"), i.alias("pos"), F.lit(None).cast(instance).alias("instance"), F.lit(False).alias("added"))))
    later = messages.where(kind.isin("WorkersAdded", "WorkersRemoved")).select("cluster_id", *order, F.inline(named))
    later = join_unique(later, held, "cluster_id", "inner", min_hot_rows).where(F.struct(*order) > F.struct(*[F.col(f"since.{c}") for c in order]))
    marks = first.unionByName(later.select(*first.columns))
    seen = previous_row(marks, ["cluster_id", "instance_id"], place, ["added"], "prev", min_hot_rows)
    starts = F.col("added") & ~F.coalesce("prev.added", F.lit(False))
    rows = seen.groupBy("cluster_id", "instance_id").agg(
        F.first("master_id").alias("master_id"), F.max_by("added", F.struct(*place)).alias("there"),
        F.max_by(F.struct(F.struct(*order).alias("since"), "instance"), F.when(starts, F.struct(*place))).alias("start"))
    return rows.where("there").select("cluster_id", "instance_id", "master_id", "start.since", "start.instance")


def fold_messages(messages: DataFrame, order_cols: Sequence[str], min_hot_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(clusters, members)`` that are there after ``messages``, as ``message_decode`` gives them, in order.

    A cluster is what its last ``ClustersAdded`` says of it, unless a ``ClustersRemoved`` came later; what was known of it before, its
    workers too, is forgotten. Its image is that of the last change since that did not fail, and a change is in progress from a
    request to the next such change. Members are its master and its workers: those of its snapshot and of each ``WorkersAdded`` since, without
    those that ``WorkersRemoved`` named last. A worker that is added again while it is there stays as it was. What messages
    say of an instance counts from when it became a member, a null too; of a worker with the master's id nothing does, since the
    master takes it. Messages about clusters or instances that aren't there, and all other kinds, change nothing.

    The log is read several times, so land what was decoded before it is folded.
    """
    order = list(order_cols)
    at = F.struct(*order)
    present = _present(messages, order)
    after = lambda c: F.col(f"{c}.at") > F.col("since")
    clusters = present.select(
        "cluster_id", *[F.col(f"snapshot.{f}").alias(column_name(f)) for f in CLUSTER_FIELDS], F.col("snapshot.master.id").alias("master_id"),
        F.when(after("image"), F.col("image.value")).otherwise(F.col("snapshot.dockerImage")).alias("docker_image"),
        F.coalesce(after("changing") & F.col("changing.value"), F.lit(False)).alias("image_change_in_progress"))

    masters = present.select("cluster_id", F.col("snapshot.master.id").alias("instance_id"), F.lit("Master").alias("role"), F.lit(True).alias("listens"),
                             F.struct(*[F.col(f"since.{c}").alias(c) for c in order]).alias("since"), F.col("snapshot.master").alias("instance"))
    workers = _workers(messages, present, order, min_hot_rows).select(
        "cluster_id", "instance_id", F.lit("Worker").alias("role"), (F.col("instance_id") != F.col("master_id")).alias("listens"), "since", "instance")
    said = messages.where(F.col("kind").isin(list(INSTANCE_SAYS))).groupBy("instance_id").agg(
        *[_latest(F.col("kind") == kind, at, F.col(column_name(field))).alias(f"said_{field}") for kind, field in INSTANCE_SAYS.items()])
    rows = masters.unionByName(workers).join(said, "instance_id", "left")
    members = rows.select(
        "cluster_id", "instance_id", "role", *[F.col(f"instance.{f}").alias(column_name(f)) for f in INSTANCE_FIELDS],
        *[F.when(F.col("listens") & after(f"said_{f}"), F.col(f"said_{f}.value")).otherwise(F.col(f"instance.{f}")).alias(column_name(f))
          for f in INSTANCE_SAYS.values()])
    return clusters, members
