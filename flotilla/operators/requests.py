"""Client requests against the current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_system_tag
from .states import guard

# What answers each request kind, and the texts of its failures.
ATTEMPTS = {
    "LaunchCluster": "ClusterLaunchAttempt",
    "LaunchSpotCluster": "ClusterLaunchAttempt",
    "AddWorkers": "WorkerAdditionAttempt",
    "ChangeDockerImage": "DockerImageChangeAttempt",
    "TerminateCluster": "ClusterTerminationAttempt",
    "TerminateWorker": "WorkerTerminationAttempt",
}
NOT_FOUND = {
    "AddWorkers": "Add workers: no cluster with id ",
    "ChangeDockerImage": "Change docker image: no cluster with id ",
    "TerminateCluster": "Terminate cluster: no cluster with id ",
    "TerminateWorker": "Terminate worker: no worker with instance id ",
}
FAILED = {
    "AddWorkers": "Failed to add workers to cluster with id ",
    "ChangeDockerImage": "Failed to change Docker image of cluster with id ",
    "TerminateCluster": "Failed to terminate cluster with id ",
    "TerminateWorker": "Failed to terminate worker with instance id ",
}
REQUIREMENT = "requirement failed: "
LAUNCH_FAILED = "Failed to launch cluster for spec "
SPOT_LAUNCH_FAILED = ("Failed to launch spot cluster with bid price ", " for spec ")
INVALID_TAGS = ": Invalid instance tags: "
INVALID_KEY = "Invalid tag key: "
LAUNCHES = ("LaunchCluster", "LaunchSpotCluster")


def _launch_error(requests: DataFrame, tag_prefix: str) -> Column:
    """Launches fail on system tags among the extra tags; keys are named in the order of the map."""
    if not {"spec", "bid_price", "extra_tags"} <= set(requests.columns):
        return F.lit(None).cast("string")
    bad = F.filter(F.map_keys("extra_tags"), lambda key: is_system_tag(key, tag_prefix))
    said = F.concat(F.lit(INVALID_TAGS), F.array_join(F.transform(bad, lambda key: F.concat(F.lit(INVALID_KEY), key)), ", "))
    spot, spec = SPOT_LAUNCH_FAILED, F.coalesce("spec", F.lit(""))
    start = F.when(F.col("kind") == "LaunchCluster", F.concat(F.lit(LAUNCH_FAILED), spec)).otherwise(
        F.concat(F.lit(spot[0]), F.coalesce(F.col("bid_price").cast("string"), F.lit("")), F.lit(spot[1]), spec))
    return F.when(F.size(bad) > 0, F.concat(start, said))


def request_outcome(requests: DataFrame, clusters: DataFrame, workers: DataFrame, tag_prefix: str = "x:") -> DataFrame:
    """``request_id, attempt, error``: the answer to each request; a null error is acceptance.

    ``requests`` has ``kind``, ``cluster_id``, ``worker_count`` and ``instance_id`` and, where launches are among
    them, ``spec`` (as text), ``bid_price`` and ``extra_tags`` (a map). ``clusters`` has ``master_state`` and may have
    ``termination_reason`` and ``image_changing`` (a change was requested and has not succeeded yet). Only unterminated workers are found. A request of no known kind has no attempt, and an error that says so.
    """
    told = lambda name, kind: (F.col(name) if name in clusters.columns else F.lit(None).cast(kind)).alias(name)
    known = clusters.select(
        "cluster_id", "master_state", told("termination_reason", "string"), told("image_changing", "boolean"))
    open_workers = workers.where(F.col("state") != "Terminated").select("instance_id", F.col("state").alias("worker_state"))
    # Each kind needs one lookup only. Joining all requests to both sides would also send every
    # request without an instance id to one task.
    about_worker = F.col("kind") == "TerminateWorker"
    other = requests.where(F.col("kind").isNull() | F.col("kind").isin(*LAUNCHES) | ~F.col("kind").isin(list(ATTEMPTS)))
    about_cluster = F.col("kind").isin([kind for kind in ATTEMPTS if kind not in (*LAUNCHES, "TerminateWorker")])
    wide = requests.where(about_cluster).join(known, "cluster_id", "left").unionByName(
        requests.where(about_worker).join(open_workers, "instance_id", "left"), allowMissingColumns=True).unionByName(
        other, allowMissingColumns=True)
    master, worker, underway = F.col("master_state"), F.col("worker_state"), F.col("termination_reason")

    def answer(kind: str, found: Column, target: str, broken: Column) -> Column:
        name = F.col(target).cast("string")
        return F.when(found.isNull(), F.concat(F.lit(NOT_FOUND[kind]), name)).when(
            broken.isNotNull(), F.concat(F.lit(FAILED[kind]), name, F.lit(": "), broken))

    required = lambda error: F.concat(F.lit(REQUIREMENT), error)
    errors = {
        "AddWorkers": answer("AddWorkers", master, "cluster_id",
                             required(guard("add_workers", master, count=F.col("worker_count")))),
        "ChangeDockerImage": answer("ChangeDockerImage", master, "cluster_id", required(
            guard("change_image", master, changing=F.col("image_changing")))),
        "TerminateCluster": answer("TerminateCluster", master, "cluster_id", F.when(
            underway.isNotNull(), guard("terminate_cluster", master, underway=underway)).otherwise(
            required(guard("terminate_cluster", master)))),
        "TerminateWorker": answer("TerminateWorker", worker, "instance_id", required(guard("terminate_instance", worker))),
    }
    errors |= dict.fromkeys(LAUNCHES, _launch_error(requests, tag_prefix))
    attempt = F.lit(None).cast("string")
    error = F.concat(F.lit("unknown request kind: "), F.coalesce("kind", F.lit("(none)")))
    for kind, text in errors.items():
        attempt = F.when(F.col("kind") == kind, ATTEMPTS[kind]).otherwise(attempt)
        error = F.when(F.col("kind") == kind, text).otherwise(error)
    return wide.select(
        "request_id", attempt.alias("attempt"), error.alias("error"))
