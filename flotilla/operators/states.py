"""States, guards and per-row checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import states, text
from ..plans.hot_keys import join_unique
from ..plans.rejects import split_rejects

# Guard messages.
INSTANCE_TERMINATING = "instance is already terminating"
INSTANCE_TERMINATED = "instance is already terminated"
CLUSTER_TERMINATING = "cluster is already terminating"
CLUSTER_TERMINATED = "cluster is already terminated"
TERMINATION_UNDERWAY = "cluster termination is already underway because of "
ADD_NEEDS_RUNNING = "cluster master must be running to add workers"
ADD_NEEDS_COUNT = "worker count must be positive"
IMAGE_NEEDS_RUNNING = "cluster master must be running to change docker image"
#: The state that forbids it is the dashboard's, which has no text for it.
IMAGE_CHANGING = "docker image change is in progress"

# Limits of a launch request, inclusive.
LIFETIME_HOURS = (1, 24)
WORKERS = (0, 100)
IDLE_MINUTES = (1, 180)
BID_RATIO = (0, 10)


def effective_state(df: DataFrame, state_col: str, container_col: str, strict: bool = False) -> DataFrame:
    """Add ``effective_state``; an unknown state name gives null, or fails with ``strict``."""
    out = states.effective_container_state(F.col(state_col), F.col(container_col))
    if strict:
        bad = F.concat(F.lit("unknown state "), F.concat_ws("/", state_col, container_col))
        out = F.coalesce(out, F.raise_error(bad).cast("string"))
    return df.withColumn("effective_state", out)


def normalise_state(df: DataFrame, provider_col: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(rows with state, rejects)``: provider state names to instance states."""
    out = df.withColumn("state", states.provider_state(F.col(provider_col)))
    name = F.coalesce(F.col(provider_col), F.lit("(none)"))
    reason = F.when(F.col("state").isNull(), F.concat(F.lit("unexpected instance state: "), name))
    rows, rejects = split_rejects(out, reason, strict)
    return rows, rejects.drop("state")


def lifecycle_filter(instances: DataFrame, which: str) -> DataFrame:
    """``running`` workers, ``unterminated`` workers, all ``members``, or ``running_clusters``.

    The last keeps the instances of every cluster whose master's effective container state is running.
    """
    worker = F.col("role") == "Worker"
    if which == "running":
        return instances.where(worker & (F.col("state") == "Running"))
    if which == "unterminated":
        return instances.where(worker & (F.col("state") != "Terminated"))
    if which == "members":
        return instances.where(F.col("role").isin(states.ROLES))
    if which == "running_clusters":
        effective = states.effective_container_state(F.col("state"), F.col("container_state"))
        live = instances.where((F.col("role") == "Master") & (effective == "ContainerRunning"))
        return join_unique(instances, live.select("cluster_id").distinct(), "cluster_id", "left_semi")
    raise ValueError(f"unknown filter {which}")


def guard(action: str, state: Column, container: Column | None = None, count: Column | None = None,
          underway: Column | None = None, changing: Column | None = None) -> Column:
    """Text of the first rule that forbids the action, null when it is allowed.

    ``container`` adds what the dashboard also asks of the container state. ``underway`` is
    the reason of a cluster termination that was already requested, ``changing`` says that an image
    change was requested and has not succeeded yet; null is no.
    """
    if action == "terminate_instance":
        error = F.when(state == "Terminating", INSTANCE_TERMINATING).when(state == "Terminated", INSTANCE_TERMINATED)
    elif action == "terminate_cluster":
        error = F.when(state == "Terminating", CLUSTER_TERMINATING).when(state == "Terminated", CLUSTER_TERMINATED)
        if underway is not None:
            error = F.when(underway.isNotNull(), F.concat(F.lit(TERMINATION_UNDERWAY), underway)).otherwise(error)
    elif action == "add_workers":
        error = F.when(~state.eqNullSafe("Running"), ADD_NEEDS_RUNNING)
        if count is not None:
            error = error.when(~F.coalesce(count > 0, F.lit(False)), ADD_NEEDS_COUNT)
    elif action == "change_image":
        error = F.when(~state.eqNullSafe("Running"), IMAGE_NEEDS_RUNNING)
        if changing is not None:
            error = error.when(changing, IMAGE_CHANGING)
    else:
        raise ValueError(f"unknown action {action}")
    if container is None:
        return error
    if action.startswith("terminate"):
        shown = F.when(container == "ContainerStopping", "container is stopping").when(
            container == "ContainerStopped", "container is stopped")
    else:
        shown = F.when(~container.eqNullSafe("ContainerRunning"), "master container is not running")
    return F.coalesce(error, shown)


def action_guard(df: DataFrame, action: str, state_col: str, container_col: str | None = None,
                 count_col: str | None = None, underway_col: str | None = None, changing_col: str | None = None) -> DataFrame:
    """Add ``error``: why the action is not allowed, or null."""
    pick = lambda name: None if name is None else F.col(name)
    return df.withColumn("error", guard(
        action, F.col(state_col), pick(container_col), pick(count_col), pick(underway_col), pick(changing_col)))


def display_status(df: DataFrame, state_col: str, container_col: str) -> DataFrame:
    return df.withColumn("bucket", states.status_bucket(F.col(state_col), F.col(container_col)))


def instance_facts(raw_instances: DataFrame) -> DataFrame:
    """Raw provider rows with defaults applied: empty group is null, no container state is pending."""
    return raw_instances.withColumns({
        "placement_group": F.nullif("placement_group", F.lit("")),
        "container_state": F.coalesce("container_state", F.lit("ContainerPending")),
        "is_spot": F.coalesce(F.col("lifecycle") == "spot", F.lit(False)),
    }).drop("lifecycle")


def uptime(instances: DataFrame, reason_col: str, now, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)``: rows get ``terminated_at``, ``started_at`` and ``ended_at``.

    Only a terminated instance has an end of its own, taken from the stamp in its reason text;
    one whose stamp cannot be read is a reject.
    """
    kind = instances.schema["launched_at"].dataType
    stamp = text.stamp_in_reason(F.col(reason_col)).cast(kind)
    out = instances.withColumn("terminated_at", F.when(F.col("state") == "Terminated", stamp))
    reason = F.when((F.col("state") == "Terminated") & F.col("terminated_at").isNull(),
                    F.concat(F.lit("no termination time in: "), F.coalesce(F.col(reason_col), F.lit("(none)"))))
    rows, rejects = split_rejects(out, reason, strict)
    ended = F.coalesce("terminated_at", F.lit(now).cast(kind))
    return rows.withColumns({"started_at": F.col("launched_at"), "ended_at": ended}), rejects


def ttl_expiry(clusters: DataFrame, ttl_col: str, now, seconds_per_unit: int = 3600) -> DataFrame:
    """Add ``expires_at`` and ``expired`` (strictly after); without a lifetime never."""
    kind = clusters.schema["launched_at"].dataType
    expires = text.plus_seconds(F.col("launched_at"), F.col(ttl_col) * seconds_per_unit)
    return clusters.withColumn("expires_at", expires).withColumn(
        "expired", F.coalesce(F.lit(now).cast(kind) > F.col("expires_at"), F.lit(False)))


def size_normalise(df: DataFrame, group_cols: list[str], bytes_col: str) -> DataFrame:
    """Sum of sizes per group as ``bytes`` and as ``size`` text."""
    total = df.groupBy(*group_cols).agg(F.sum(F.col(bytes_col).cast("decimal(38,0)")).alias("bytes"))
    return total.withColumn("size", text.size_text(F.col("bytes")))


def image_ref_parse(df: DataFrame, ref_col: str) -> DataFrame:
    """Add ``repo``, ``tag`` and ``short_tag`` (up to the first dash)."""
    tag = text.image_tag(F.col(ref_col))
    return df.withColumns({
        "repo": text.image_repo(F.col(ref_col)), "tag": tag, "short_tag": F.substring_index(tag, "-", 1)})


def launch_request_check(requests: DataFrame) -> DataFrame:
    """``request_id, rule``: one row per rule a request breaks."""
    def outside(col: str, limits: tuple[int, int], nullable: bool) -> Column:
        return ~F.coalesce(F.col(col).between(*limits), F.lit(nullable))

    rules = {
        "name": F.coalesce(F.col("name") == "", F.lit(True)),
        "lifetime_hours": outside("lifetime_hours", LIFETIME_HOURS, True),
        "num_workers": outside("num_workers", WORKERS, False),
        "idle_minutes": outside("idle_minutes", IDLE_MINUTES, True),
        "bid_ratio": outside("bid_ratio", BID_RATIO, True),
    }
    broken = F.array_compact(F.array(*[F.when(test, rule) for rule, test in rules.items()]))
    return requests.select("request_id", F.explode(broken).alias("rule"))
