"""The streaming operators run to the end of the generated tables.

Each result must equal the batch form, so each has the batch form's SQL.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import logs
from ..operators.sets import dedupe_last
from ..session import shared_dir
from ..sources.polls import PollLog
from ..streaming import micro_batches, streams
from ..streaming.fleet_state import BucketedState
from .batch_queries import (CHANGE_EVENTS, CHANGE_PROPS, COLLECT_FIRST, LATEST_STATE, POLL_DIFF, SEQUENCE_GAPS, TIMEOUT,
                            first_wanted, shown_history)
from .registry import query
from .views import NOW, SLICES, Inputs


def _finish(t: Inputs, label: str, start, schema: str) -> DataFrame:
    """Run ``start(state folder, output folder)`` over what is there and read its output."""
    base = shared_dir(t.spark, label)
    micro_batches.run_to_end(start(f"{base}/state", f"{base}/out"), f"{base}/checkpoint")
    return micro_batches.output(t.spark, f"{base}/out", T.StructType.fromDDL(schema))


@query("snapshot_stream", "select user_id as id, event_type as state, ts from events")
def snapshot_stream(t: Inputs) -> DataFrame:
    polls = t.stream().table("events").selectExpr("user_id as id", "event_type as state", "ts")
    sink = lambda state, out: polls.writeStream.format("parquet").option("path", out).outputMode("append")
    return _finish(t, "snapshots", sink, "id bigint, state string, ts timestamp_ntz")


@query("stream_change_events", CHANGE_EVENTS)
def stream_change_events(t: Inputs) -> DataFrame:
    history = shown_history(t.stream())
    return _finish(
        t, "changes",
        lambda state, out: streams.stream_change_events(
            history, "instance_id", CHANGE_PROPS, ["ts", "event_id"], state, out, set_only=["terminated_mark"]),
        "instance_id bigint, ts timestamp_ntz, event_id bigint, property string, value string")


@query("stream_latest_state", LATEST_STATE)
def stream_latest_state(t: Inputs) -> DataFrame:
    log = t.stream().view("fold_log").select("entity_id", "ts", "event_id", "kind", "val", "error")
    shown = _finish(
        t, "latest", lambda state, out: streams.stream_latest_state(log, "entity_id", ["ts", "event_id"], state, out),
        "entity_id bigint, present boolean, state string, container_state string, ip_address string, subnet string, "
        "terminated_at string, image string, image_change_in_progress boolean, batch_id bigint")
    return dedupe_last(shown, "entity_id", ["batch_id"]).drop("batch_id")


@query("stream_reloaded_state", LATEST_STATE.replace("fold_log", "received_log"))
def stream_reloaded_state(t: Inputs) -> DataFrame:
    """What is received has lost messages; the servers have their whole logs, and snapshots of halfway through."""
    order = ["ts", "event_id"]
    whole = t.landed("message_log", "event_id", "ts", "server_id", "message_no", "entity_id", "kind", "val")
    half = whole.groupBy("server_id").agg(F.floor(F.max("message_no") / 2).alias("as_of"))
    early = whole.join(half, "server_id").where("message_no <= as_of")
    snapshots = logs.folded_rows(early, "entity_id", order).withColumn("server_id", F.expr("concat('srv-', entity_id % 4)")).join(half, "server_id")
    path = shared_dir(t.spark, "snapshots")
    snapshots.write.parquet(path)
    snapshots = t.spark.read.parquet(path)
    reload = lambda servers: logs.reloaded(servers, snapshots, whole, "entity_id", order, "server_id", "message_no")
    received = t.arriving(whole.where("event_id % 97 <> 0"), "received")
    shown = _finish(
        t, "reloaded",
        lambda state, out: streams.stream_reloaded_state(received, "entity_id", order, "server_id", "message_no", reload, state, out),
        "entity_id bigint, present boolean, state string, container_state string, ip_address string, subnet string, "
        "terminated_at string, image string, image_change_in_progress boolean, batch_id bigint")
    return dedupe_last(shown, "entity_id", ["batch_id"]).drop("batch_id")


def _polls(t: Inputs, view: str, key: str) -> PollLog:
    rows = t.view(view)
    log = PollLog(shared_dir(t.spark, view), rows.schema)
    log.land_all(rows, key, SLICES)
    return log


@query("stream_snapshot_diff", POLL_DIFF)
def stream_snapshot_diff(t: Inputs) -> DataFrame:
    polls = _polls(t, "poll", "id")
    diff = _finish(
        t, "diff", lambda state, out: streams.stream_snapshot_diff(polls, t.spark, "id", state, out), "poll_no bigint, id bigint, change string")
    return diff.withColumn("poll_no", F.col("poll_no").cast("int"))


@query("stream_snapshot_apply", """
with gone as (
  select c.id, max(p.poll_no) as since
  from (select distinct id from fleet_poll where id is not null) c cross join (select distinct poll_no from fleet_poll) p
  left join fleet_poll f on f.id = c.id and f.poll_no = p.poll_no where f.id is null group by c.id),
held as (
  select f.* from fleet_poll f left join gone g on g.id = f.id where f.id is not null and f.poll_no > coalesce(g.since, -1))
select id, arg_max(state, poll_no) as state, arg_max(address, poll_no) filter (where address is not null) as address,
       arg_min(first_event, poll_no) as first_event
from held group by id""")
def stream_snapshot_apply(t: Inputs) -> DataFrame:
    polls = _polls(t, "fleet_poll", "id")
    fleet_now = BucketedState(shared_dir(t.spark, "fleet"), T.StructType.fromDDL("id bigint, state string, address double, first_event bigint"), "id")
    writer = streams.stream_snapshot_apply(polls, t.spark, "id", ["address"], ["state"], fleet_now)
    micro_batches.run_to_end(writer, shared_dir(t.spark, "fleet-checkpoint"))
    return fleet_now.latest(t.spark)


LAST_READING = TIMEOUT.replace("from app_run", """from (
  select * from app_reading r where seen_at = (select max(seen_at) from app_reading l where l.cluster_id = r.cluster_id)) app_run""")


@query("stream_timeout", f"select * from ({LAST_READING}) v where verdict is not null")
def stream_timeout(t: Inputs) -> DataFrame:
    clusters = t.opened(t.view("app_cluster").selectExpr("*", "launched_at as as_of", "false as gone"), "clusters")
    verdicts = _finish(
        t, "timeout",
        lambda state, out: streams.stream_timeout(t.stream().view("app_reading"), clusters, out, clock=lambda ms: datetime.datetime.fromisoformat(NOW)),
        "cluster_id bigint, judged_at bigint, verdict string")
    return dedupe_last(verdicts, "cluster_id", ["judged_at"]).where("verdict is not null").drop("judged_at")


@query("stream_sequence_gaps", SEQUENCE_GAPS)
def stream_sequence_gaps(t: Inputs) -> DataFrame:
    # Only a batch can number the log, so it is landed first.
    log = t.landed("gapped_log", "server_id", "message_no", stream=True)
    return _finish(
        t, "gaps",
        lambda state, out: streams.stream_sequence_gaps(log, "server_id", "message_no", state, out),
        "server_id string, message_no bigint, prev_no bigint, gap string")


@query("stream_collect_first", COLLECT_FIRST)
def stream_collect_first(t: Inputs) -> DataFrame:
    # The log's numbers are not needed here, and only a batch can number it.
    events = t.stream().table("events")
    log = events.selectExpr(
        "user_id as entity_id", "case event_type when 'click' then 'InstanceState' else 'other' end as kind",
        "concat('v', cast(floor(value) as int) % 5) as val", "ts", "event_id")
    return _finish(
        t, "first",
        lambda state, out: streams.stream_collect_first(log, "entity_id", *first_wanted(), ["ts", "event_id"], out),
        "entity_id bigint, value string, ts timestamp_ntz, event_id bigint")
