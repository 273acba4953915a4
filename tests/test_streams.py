"""Streams over several micro-batches must end where the batch operators do."""

from __future__ import annotations

import datetime
import hashlib
import tempfile
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flotilla.operators import fleet, logs, totals
from flotilla.operators.sets import dedupe_last
from flotilla.sources.inventory import snapshot_stream
from flotilla.sources.polls import PollLog
from flotilla.streaming import keyed, streams
from flotilla.streaming.fleet_state import BucketedState
from flotilla.streaming.micro_batches import output, run_every, run_to_end

ORDER = ["ts", "event_id"]


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each partition of a keyed state has a Python worker of its own."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture()
def land(spark, folder):
    """Land a table as one file per time slice, in order, and open it as a stream of one file a batch."""

    def landed(df, slices, where=None):
        path = f"{folder}/landing"
        cuts = [None, *slices, None]
        for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
            part = df
            if low is not None:
                part = part.where(where >= F.lit(low))
            if high is not None:
                part = part.where(where < F.lit(high))
            part.coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return landed


DAYS = [datetime.datetime(2024, 1, d) for d in (5, 11, 20)]


def finish(spark, folder, writer, schema):
    run_to_end(writer, f"{folder}/checkpoint")
    return output(spark, f"{folder}/out", T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def steps(df, slices, where):
    """The parts of a table, in the order of time."""
    cuts = [None, *slices, None]
    for low, high in zip(cuts, cuts[1:]):
        part = df if low is None else df.where(where >= F.lit(low))
        yield part if high is None else part.where(where < F.lit(high))


def test_change_events(spark, folder, inputs, hot=20):
    """The chain is started anew for each batch, so all that it knows comes from its state."""
    history = inputs.view("state_history")
    props = ["state", "container_state", "terminated_mark"]
    seen = None
    for part in steps(history, DAYS[1:2], F.col("ts")):
        part.repartition(3).write.mode("append").parquet(f"{folder}/landing")
        seen = part if seen is None else seen.unionByName(part)
        stream = spark.readStream.schema(history.schema).parquet(f"{folder}/landing")
        chain = streams.stream_change_events(stream, "instance_id", props, ORDER, f"{folder}/work", f"{folder}/out", ["terminated_mark"], hot)
        want = logs.change_events(seen, "instance_id", props, ORDER, ["terminated_mark"])
        assert rows(finish(spark, folder, chain, want.schema)) == rows(want)


def written_state(folder, batch):
    """Bytes of state that a micro-batch wrote: what changed, of each partition."""
    return sum(p.stat().st_size for p in Path(folder).rglob("state/**/*") if p.name.split(".")[0].split("_")[0] == str(batch + 1) and p.suffix in (".changelog", ".delta"))


def test_state_costs_what_changes(spark, folder):
    kind = "id long, ts timestamp, state string"
    at = lambda day: datetime.datetime(2024, 1, day)
    text = lambda i, day: hashlib.sha256(f"{i} {day}".encode()).hexdigest()
    batches = [[(i, at(day), text(i, day)) for i in range(n)] for day, n in ((1, 4000), (2, 3), (3, 3))]
    for batch in batches:
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(f"{folder}/landing")
        stream = spark.readStream.schema(kind).parquet(f"{folder}/landing")
        chain = streams.stream_change_events(stream, "id", ["state"], ["ts"], f"{folder}/work", f"{folder}/out")
        got = finish(spark, folder, chain, "id long, ts timestamp, property string, value string")
    assert got.count() == 4006
    whole, few, again = (written_state(f"{folder}/checkpoint/1", n) for n in range(3))
    assert whole > 30 * 4000 and few < whole / 20 and again < whole / 20


def test_latest_state(spark, folder, inputs, hot=20):
    log = inputs.view("fold_log").select("entity_id", *ORDER, "kind", "val", "error")
    seen = None
    for part in steps(log, DAYS[1:2], F.col("ts")):
        part.repartition(3).write.mode("append").parquet(f"{folder}/landing")
        seen = part if seen is None else seen.unionByName(part)
        stream = spark.readStream.schema(log.schema).parquet(f"{folder}/landing")
        chain = streams.stream_latest_state(stream, "entity_id", ORDER, f"{folder}/work", f"{folder}/out", hot)
        want = logs.latest_state(seen, "entity_id", ORDER)
        got = finish(spark, folder, chain, T.StructType([*want.schema.fields, T.StructField("batch_id", T.LongType())]))
        assert rows(dedupe_last(got, "entity_id", ["batch_id"]).drop("batch_id")) == rows(want)


def test_reloaded_state(spark, folder, inputs):
    """Messages of the second part are lost; the state is that of all messages up to the last that came."""
    order = ["message_no"]
    kept = lambda df, name: (df.write.parquet(f"{folder}/{name}"), spark.read.parquet(f"{folder}/{name}"))[1]
    log = kept(inputs.view("message_log").select("entity_id", "server_id", "message_no", "ts", "kind", "val"), "log")
    early = logs.folded_rows(log.where("message_no <= 20"), "entity_id", order).withColumn("server_id", F.expr("concat('srv-', entity_id % 4)"))
    # the newest version is too new for any gap and must not be taken
    wrong = early.withColumn("presence", F.lit(None).cast(early.schema["presence"].dataType)).withColumn("as_of", F.lit(10**9))
    snapshots = kept(early.withColumn("as_of", F.lit(20)).unionByName(wrong), "snapshots")
    calls = []

    def reload(servers):
        calls.append(sorted(tuple(r) for r in servers.collect()))
        return logs.reloaded(servers, snapshots, log, "entity_id", order, "server_id", "message_no")

    came = None
    for i, part in enumerate(steps(log, DAYS[1:2], F.col("ts"))):
        part = part.where("message_no % 7 <> 3 or server_id = 'srv-1'") if i == 1 else part
        part.repartition(2).write.mode("append").parquet(f"{folder}/landing")
        came = part if came is None else came.unionByName(part)
        stream = spark.readStream.schema(log.schema).parquet(f"{folder}/landing")
        chain = streams.stream_reloaded_state(stream, "entity_id", order, "server_id", "message_no", reload, f"{folder}/work", f"{folder}/out")
        upto = came.groupBy("server_id").agg(F.max("message_no").alias("upto"))
        want = logs.latest_state(log.join(upto, "server_id").where("message_no <= upto"), "entity_id", order)
        got = finish(spark, folder, chain, T.StructType([*want.schema.fields, T.StructField("batch_id", T.LongType())]))
        assert rows(dedupe_last(got, "entity_id", ["batch_id"]).drop("batch_id")) == rows(want)
    assert not calls[0] and calls[1] and not any(server == "srv-1" for call in calls for server, _ in call)


def test_merged_folds(inputs):
    log = inputs.view("fold_log").select("entity_id", *ORDER, "kind", "val", "error")
    for day in DAYS[1:2]:
        old, new = (logs.folded_rows(log.where(test), "entity_id", ORDER) for test in (F.col("ts") < day, F.col("ts") >= day))
        both = logs.merged_folds(old, new, "entity_id").where("presence is not null")
        assert rows(logs.shown(both, "entity_id")) == rows(logs.latest_state(log, "entity_id", ORDER))


def land_polls(spark, folder, polls, empty=()):
    """Each poll in several files, the empty ones too, and a log of them."""
    log = PollLog(f"{folder}/polls", polls.schema)
    for n in sorted({r.poll_no for r in polls.select("poll_no").distinct().collect()} | set(empty)):
        log.land(polls.where(F.col("poll_no") == n).where("id is not null").repartition(3), n)
    return log


def test_snapshot_diff(spark, folder, inputs):
    polls = inputs.view("poll").select("id", "poll_no").where("poll_no between 5 and 13")
    log = land_polls(spark, folder, polls)
    want = fleet.poll_diff(polls.withColumn("poll_no", F.col("poll_no").cast("long")), "id", "poll_no")
    writer = streams.stream_snapshot_diff(log, spark, "id", f"{folder}/state", f"{folder}/out")
    assert rows(finish(spark, folder, writer, want.schema)) == rows(want)


def test_polls_land_together(spark, folder):
    polls = spark.createDataFrame([(1, 1), (2, 1), (None, 3), (2, 4)], "id long, poll_no long")
    log = PollLog(f"{folder}/polls", polls.schema)
    log.land_all(polls, "id", 2)
    got = finish(spark, folder, streams.stream_snapshot_diff(log, spark, "id", f"{folder}/state", f"{folder}/out"), "poll_no long, id long, change string")
    assert sorted(map(tuple, got.collect())) == [(3, 1, "removed"), (3, 2, "removed"), (4, 2, "added")]


FLEET = "id long, cluster_id long, role string, state string, address string"


def test_snapshot_apply_over_polls(spark, folder):
    """A hole, an empty poll, a cluster that loses its master: the state is that of the batch operator, poll after poll."""
    m, w = "Master", "Worker"
    polls = {
        1: [(1, 1, m, "a", "x1"), (2, 1, w, "a", "x2"), (3, 2, m, "a", "x3"), (4, 2, w, "a", None)],
        2: [(1, 1, m, "b", None), (2, 1, w, "b", "y2"), (4, 2, w, "b", "z4")],
        4: [(1, 1, m, "b", None), (3, 2, m, "c", None), (4, 2, w, "c", None), (5, 2, w, "c", "x5")],
        5: [],
        6: [(1, 1, m, "d", None), (3, 2, m, "d", "w3")],
    }
    log = PollLog(f"{folder}/polls", T.StructType.fromDDL(FLEET))
    state = BucketedState(f"{folder}/fleet", T.StructType.fromDDL(FLEET), "id", 4)
    want = spark.createDataFrame([], FLEET)
    for n, found in polls.items():
        poll = spark.createDataFrame(found, FLEET)
        log.land(poll, n)
        want = spark.createDataFrame(fleet.snapshot_apply(want, poll, "id", ["address"], ["state"], "cluster_id", F.col("role") == m).collect(), FLEET)
        writer = streams.stream_snapshot_apply(log, spark, "id", ["address"], ["state"], state, "cluster_id", F.col("role") == m)
        run_to_end(writer, f"{folder}/checkpoint")
        assert rows(state.latest(spark)) == rows(want)
    assert rows(want) and {p.name for p in Path(folder, "fleet/manifest").iterdir()} == {"batch=3", "batch=4"}


def test_only_touched_buckets_are_written(spark, folder):
    state = BucketedState(f"{folder}/fleet", T.StructType.fromDDL("id long, v string"), "id", 16)
    now = spark.createDataFrame([(i, "a") for i in range(500)], "id long, v string")
    assert state.save(state.after(spark, -1), now, 0) == 16
    changed = now.withColumn("v", F.when(F.col("id") == 7, "b").otherwise(F.col("v"))).where("id <> 8")
    assert state.save(state.after(spark, 0), changed, 1) <= 2
    assert rows(state.after(spark, 1)) == rows(changed) and rows(state.after(spark, 0)) == rows(now)
    assert state.save(state.after(spark, 1), changed, 2) == 0
    # a replay of the last batch
    assert state.save(state.after(spark, 1), changed.limit(0), 2) == 16 and state.after(spark, 2).count() == 0
    assert state.save(state.after(spark, 2), now, 3) == 16 and rows(state.latest(spark)) == rows(now)


CLUSTER = ("cluster_id long, as_of timestamp, launched_at timestamp, ttl_hours long, idle_minutes long, master_address string, "
           "master_state string, master_container string, gone boolean")
VERDICTS = "cluster_id long, judged_at long, verdict string"


def verdicts_now(spark, folder):
    last = dedupe_last(output(spark, f"{folder}/out", T.StructType.fromDDL(VERDICTS)), "cluster_id", ["judged_at"])
    return {r.cluster_id: r.verdict for r in last.collect()}


def test_timeout(spark, folder, inputs):
    runs, clusters = inputs.view("app_reading"), inputs.view("app_cluster")
    clusters.selectExpr("*", "launched_at as as_of", "false as gone").write.parquet(f"{folder}/clusters")
    seen = None
    for batch, part in enumerate(steps(runs, DAYS[1:2], F.col("start_at"))):
        part.repartition(2).write.mode("append").parquet(f"{folder}/landing")
        seen = part if seen is None else seen.unionByName(part)
        now = datetime.datetime(2024, 1, 28 + batch % 3, 12)
        writer = streams.stream_timeout(
            spark.readStream.schema(runs.schema).parquet(f"{folder}/landing"),
            spark.readStream.schema(spark.read.parquet(f"{folder}/clusters").schema).parquet(f"{folder}/clusters"), f"{folder}/out", clock=lambda ms: now)
        run_to_end(writer, f"{folder}/checkpoint")
        latest = seen.groupBy("cluster_id").agg(F.max("seen_at").alias("seen_at"))
        want = {r.cluster_id: r.verdict for r in totals.timeout_verdict(clusters, seen.join(latest, ["cluster_id", "seen_at"]), now).collect()}
        told = {r.cluster_id for r in part.select("cluster_id").distinct().collect()} if batch else set(want)
        got = verdicts_now(spark, folder)
        assert {k: got[k] for k in told if k in want} == {k: want[k] for k in told if k in want}


def test_timers_judge_a_quiet_fleet(spark, folder):
    """Nothing comes after the first batch, an hour goes by each second: verdicts come by timers alone, batch after batch, and after a restart."""
    at = lambda day, hour=0: datetime.datetime(2024, 1, day, hour)
    fleet_now = [(1, at(1), at(1), 3, None, "a", "Running", "ContainerRunning", False), (2, at(1), at(1), None, 120, "a", "Running", "ContainerRunning", False),
                 (3, at(1), at(1), 1, None, "a", "Running", "ContainerRunning", True), (4, at(1), at(1), 1, 1, "a", "Running", "ContainerRunning", False),
                 (5, at(1), at(1), 1, None, None, "Running", "ContainerRunning", False)]
    readings = "cluster_id long, seen_at timestamp, start_at timestamp, duration_ms long, active boolean"
    spark.createDataFrame(fleet_now, CLUSTER).coalesce(1).write.parquet(f"{folder}/clusters")
    spark.createDataFrame([(4, at(1), at(1), 10, True), (4, at(1), at(1), 10, False), (2, at(1), None, None, None), (9, at(1), None, None, None), (None,) * 5], readings).write.parquet(f"{folder}/readings")
    began = int(time.time() * 1000)
    clock = lambda ms: at(1) + datetime.timedelta(hours=(ms - began) / 1000)

    def start():
        writer = streams.stream_timeout(spark.readStream.schema(readings).parquet(f"{folder}/readings"),
                                        spark.readStream.schema(CLUSTER).parquet(f"{folder}/clusters"), f"{folder}/out", "1 second", clock)
        return run_every(writer, f"{folder}/checkpoint", "1 second")[0]

    def wait(test):
        query = start()
        try:
            end = time.time() + 90
            while time.time() < end and not test():
                assert query.exception() is None
                time.sleep(1)
        finally:
            query.stop()
        assert test()

    batches = lambda: {p.name for p in Path(folder, "out").glob("batch=*")}
    wait(lambda: len(batches()) >= 3 and verdicts_now(spark, folder).get(1) == "TTLExpired" and verdicts_now(spark, folder).get(2) == "IdleTimeout")
    got = verdicts_now(spark, folder)
    assert got == {1: "TTLExpired", 2: "IdleTimeout", 4: None, 5: None}
    before = len(batches())
    wait(lambda: len(batches()) >= before + 3)
    # a later reading ends the active run, and cluster 1 is no more
    spark.createDataFrame([(4, at(2), at(1), 10, False)], readings).write.mode("append").parquet(f"{folder}/readings")
    spark.createDataFrame([(1, at(2), *[None] * 6, True)], CLUSTER).write.mode("append").parquet(f"{folder}/clusters")
    wait(lambda: verdicts_now(spark, folder).get(4) == "TTLExpired")


def test_readings_meet_the_state_once_a_cluster(spark):
    """of many readings in many files one row a cluster is left, the latest; an active run and the last end of it count."""
    at = lambda day: datetime.datetime(2024, 1, day)
    rows = [(c, at(day), (c + day + i) % 7 == 0, at(day + i)) for c in range(50) for day in range(1, 9) for i in range(3)] + [(99, None, False, at(1)), (99, at(1), None, None)]
    runs = spark.createDataFrame(rows, "cluster_id long, seen timestamp, active boolean, end timestamp").repartition(6)
    got = keyed.reduced_readings(runs.select("cluster_id", F.unix_micros("seen").alias("as_of"), "active", "end")).collect()
    last = runs.join(runs.groupBy("cluster_id").agg(F.max("seen").alias("seen")), ["cluster_id", "seen"])
    want = last.groupBy("cluster_id").agg(F.unix_micros(F.max("seen")).alias("as_of"), F.max(F.coalesce("active", F.lit(False)).cast("int")).alias("active"),
                                          F.max(F.when(~F.col("active"), F.col("end"))).alias("last_end")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


@pytest.mark.parametrize("per_client", [False, True])
def test_sequence_gaps(spark, folder, land, inputs, per_client):
    log = inputs.view("client_log")
    how = {"stream_cols": ["client_id"], "order_cols": ORDER} if per_client else {}
    reloads = []
    writer = streams.stream_sequence_gaps(
        land(log, DAYS, F.col("ts")), "server_id", "message_no", f"{folder}/state", f"{folder}/out",
        on_gap=lambda gaps, batch_id: reloads.append((batch_id, gaps.count())), **how)
    want = logs.sequence_gaps(log, "server_id", "message_no", **how)
    assert rows(finish(spark, folder, writer, want.schema).select(want.columns)) == rows(want)
    assert [b for b, _ in reloads] == [0, 1, 2, 3] and sum(n for _, n in reloads) == want.count()


def test_collect_first(spark, folder, inputs):
    log = inputs.view("message_log")
    wanted = (F.col("kind") == "InstanceState") & F.col("val").isin("v2", "v3")
    seen = None
    for part in steps(log, DAYS[1:2], F.col("ts")):
        part.repartition(3).write.mode("append").parquet(f"{folder}/landing")
        seen = part if seen is None else seen.unionByName(part)
        stream = spark.readStream.schema(log.schema).parquet(f"{folder}/landing")
        writer = streams.stream_collect_first(stream, "entity_id", wanted, F.col("val"), ORDER, f"{folder}/out")
        want = logs.collect_first(seen, "entity_id", wanted, F.col("val"), ORDER)
        assert rows(finish(spark, folder, writer, want.schema)) == rows(want)


def test_snapshot_stream(spark, folder, inputs):
    polls = inputs.view("poll")
    polls.write.parquet(f"{folder}/landing")
    stream = snapshot_stream(spark, f"{folder}/landing", polls.schema)
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/out")
    assert rows(finish(spark, folder, writer, polls.schema)) == rows(polls)


@pytest.mark.parametrize("broken", [0, 1])
def test_a_batch_that_fails_midway_is_replayed_without_trace(spark, folder, land, inputs, broken):
    """The first writer fails after it wrote its output, the second before its batch is done."""
    history = inputs.view("state_history")
    want = logs.change_events(history, "instance_id", ["state"], ORDER)
    stream = land(history, DAYS, F.col("ts"))
    left = [1]

    def start():
        chain = streams.stream_change_events(stream, "instance_id", ["state"], ORDER, f"{folder}/work", f"{folder}/out")
        if left[0]:
            def fail(batch, n):
                raise RuntimeError("executor lost")

            left[0] -= 1
            chain[broken] = chain[broken].foreachBatch(fail)
        return chain

    with pytest.raises(Exception):
        run_to_end(start(), f"{folder}/checkpoint")
    assert rows(finish(spark, folder, start(), want.schema)) == rows(want)


def test_a_summary_written_twice_counts_once(spark, folder):
    """What a replayed batch writes again, under other file names, changes nothing."""
    kind = T.StructType.fromDDL("id long, last struct<v: string>, batch_id long")
    for n, v in ((0, "a"), (1, "b"), (1, "b"), (2, "c"), (0, "a")):
        spark.createDataFrame([(1, (v,), n)], kind).write.mode("append").parquet(f"{folder}/edges")
        keyed.prepare_state(spark)
        seen = keyed.after_previous(spark.readStream.schema(kind).parquet(f"{folder}/edges"), ["id"])
        run_to_end(keyed.each_batch(seen, f"{folder}/out"), f"{folder}/checkpoint")
    got = output(spark, f"{folder}/out", T.StructType.fromDDL("id long, last struct<v: string>, batch_id long, prev struct<v: string>"))
    assert sorted((r.batch_id, r.last.v, r.prev and r.prev.v) for r in got.collect()) == [(0, "a", None), (1, "b", "a"), (2, "c", "b")]
