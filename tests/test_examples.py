"""Small literal examples of the value rules."""

from __future__ import annotations

import datetime
import decimal
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from flotilla.functions import states as state_fns
from flotilla.functions import text
from flotilla.operators import fleet, lookups, logs, prices, requests, sets, states, tags, totals
from flotilla.sources import inventory, messages
from flotilla.sources.kinds import KINDS


def one(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def table(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols or df.columns).collect()), key=repr)


def test_sizes(spark):
    cases = {0: "0b", 5: "5b", -5: "-5b", 5 << 10: "5k", -5 << 20: "-5m", 5 << 30: "5g", 5 << 40: "5t", 1 << 50: "1p",
             (1 << 50) + 1: "1125899906842625b", 1 << 60: "1024p", 1536: "1536b", 3 << 9: "1536b"}
    assert one(spark, list(cases), text.size_text, "bigint") == list(cases.values())


def test_tag_merge(spark):
    base = spark.createDataFrame(
        [(1, "foo", "bar"), (1, "biz", "baz"), (1, "something", "important")], "cluster_id int, tag_key string, tag_value string")
    over = spark.createDataFrame(
        [(1, "something", "unimportant"), (1, "answer", "42")], "cluster_id int, tag_key string, tag_value string")
    merged = {r["tag_key"]: r["tag_value"] for r in tags.merge_tags(base, over).collect()}
    assert merged == {"foo": "bar", "biz": "baz", "something": "unimportant", "answer": "42"}


def test_collect_first(spark):
    log = spark.createDataFrame(
        [("now", 0, 0), ("later", 0, 0), ("later", 1, 1), ("later", 2, 1), ("never", 0, 0)], "k string, seq int, v int")
    wants = F.col("v") == F.when(F.col("k") == "now", 0).otherwise(1)
    assert table(logs.collect_first(log, "k", wants, F.lit(True), ["seq"])) == [("later", True, 1), ("now", True, 0)]


def test_durations(spark):
    cases = {"PT10H": 36_000_000, "PT15M": 900_000, "PT1H30M5.5S": 5_405_500, "P1DT2H": 93_600_000, "PT0S": 0, "-PT1.5S": -1_500,
             "PT-1.5S": -1_500, "pt2m": 120_000, "P1D": 86_400_000, "PT": None, "P": None, "10h": None, "": None, "PT1H2X": None}
    assert one(spark, list(cases), text.duration_millis) == list(cases.values())
    back = {0: "PT0S", 36_000_000: "PT10H", 5_405_500: "PT1H30M5.5S", 100: "PT0.1S", -1_500: "PT-1.5S", 90_000: "PT1M30S",
            108_000_000: "PT30H", None: None}
    assert one(spark, list(back), text.duration_text, "bigint") == list(back.values())


def test_instants(spark):
    when = datetime.datetime
    cases = {"2024-01-02T03:04:05Z": when(2024, 1, 2, 3, 4, 5), "2024-01-02T03:04Z": when(2024, 1, 2, 3, 4),
             "2024-01-02T03:04:05.25+01:00": when(2024, 1, 2, 2, 4, 5, 250_000), "2024-01-02T03:04:05": None, "2024-01-02": None,
             "2024-13-02T03:04:05Z": None, "12": None}
    assert one(spark, list(cases), lambda c: text.instant(c).cast("timestamp_ntz")) == list(cases.values())
    back = {when(2024, 1, 2, 3, 4): "2024-01-02T03:04Z", when(2024, 1, 2, 3, 4, 5): "2024-01-02T03:04:05Z",
            when(2024, 1, 2, 3, 4, 0, 250_000): "2024-01-02T03:04:00.250Z", when(2024, 1, 2, 3, 4, 5, 7): "2024-01-02T03:04:05.000007Z"}
    assert one(spark, list(back), text.instant_text, "timestamp_ntz") == list(back.values())


def test_stamps_and_numbers(spark):
    when = datetime.datetime
    reasons = {"User initiated (2024-01-02 03:04:05 GMT)": when(2024, 1, 2, 3, 4, 5), "User initiated": None, "x (never)": None}
    assert one(spark, list(reasons), lambda c: text.stamp_in_reason(c).cast("timestamp_ntz")) == list(reasons.values())
    assert one(spark, ["10h", "7", "h", "x1h", "12h30m"], lambda c: text.tag_number(c, "h")) == [10, 7, None, None, 12]
    builds = {"1.0-45": 45, "1.0-45b": 45, "7": 7, "a-latest": None, "a-7-latest": None, "": None}
    assert one(spark, list(builds), text.build_number) == list(builds.values())
    assert [str(v) if v is not None else None for v in one(spark, ["12", "1.5", "x"], text.whole_bytes)] == ["12", None, None]


def test_image_refs(spark):
    refs = spark.createDataFrame([("lab/app:1.0-7",), ("host:5000/x:t",), ("plain",)], "r string")
    parsed = states.image_ref_parse(refs, "r")
    assert table(parsed, "repo", "tag", "short_tag") == [
        ("host", "5000/x:t", "5000/x:t"), ("lab/app", "1.0-7", "1.0"), ("plain", "", "")]


def test_effective_state_matrix(spark):
    df = spark.createDataFrame(state_fns.effective_matrix(), "c string, s string, want string")
    assert states.effective_state(df, "s", "c").where("not want <=> effective_state").count() == 0
    assert df.count() == 25
    odd = spark.createDataFrame([("Lost", "ContainerRunning"), ("Running", None)], "s string, c string")
    assert states.effective_state(odd, "s", "c").where("effective_state is not null").count() == 0
    with pytest.raises(PySparkException):
        states.effective_state(odd, "s", "c", strict=True).collect()


def test_rejects_are_errors_when_strict(spark):
    facts = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    dim = spark.createDataFrame([("a", 10)], "k string, v int")
    rows, rejects = lookups.strict_lookup(facts, dim, "k")
    assert table(rows, "id", "v") == [(1, 10)]
    assert table(rejects, "id", "reason") == [(2, "unknown k: b"), (3, "unknown k: (none)")]
    rows, rejects = lookups.optional_lookup(facts, dim, "k")
    assert table(rows, "id", "v") == [(1, 10), (3, None)]
    assert table(rejects, "id") == [(2,)]
    with pytest.raises(PySparkException):
        lookups.strict_lookup(facts, dim, "k", strict=True)[0].collect()
    with pytest.raises(PySparkException):
        states.normalise_state(spark.createDataFrame([("stopped",)], "p string"), "p", strict=True)[0].collect()


def test_uptime_rejects(spark):
    day = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(1, "Terminated", day, "gone"), (2, "Terminated", day, "x (2024-01-02 00:00:00 GMT)"), (3, "Running", day, None)],
        "instance_id int, state string, launched_at timestamp_ntz, reason string")
    rows, rejects = states.uptime(df, "reason", "2024-01-05 00:00:00")
    assert table(rows, "instance_id", "ended_at") == [(2, datetime.datetime(2024, 1, 2)), (3, datetime.datetime(2024, 1, 5))]
    assert table(rejects, "instance_id") == [(1,)]


def test_latest_state_forgets_what_was_before_a_remove(spark):
    log = spark.createDataFrame([
        ("a", 1, "WorkersAdded", None, None), ("a", 2, "InstanceState", "Running", None), ("a", 3, "WorkersRemoved", None, None),
        ("a", 4, "WorkersAdded", None, None), ("a", 5, "InstanceIpAddress", "ip", None),
        ("b", 1, "ClustersAdded", None, None), ("b", 2, "DockerImageChangeRequest", "i2", None),
        ("b", 3, "DockerImageChangeAttempt", "i2", "failed"),
        ("c", 1, "ClustersAdded", None, None), ("c", 2, "DockerImageChangeRequest", "i2", None),
        ("c", 3, "DockerImageChangeAttempt", "i2", None), ("c", 4, "InstanceDockerImage", "ignored", None),
        ("d", 1, "InstanceState", "Running", None), ("e", 1, "WorkersRemoved", None, None),
        ("f", 1, "InstanceState", "early", None), ("f", 2, "WorkersAdded", None, None),
        ("g", 1, "WorkersAdded", None, None), ("g", 2, "WorkersRemoved", None, None), ("g", 3, "InstanceState", "ghost", None),
        ("h", 1, "WorkersAdded", None, None), ("h", 2, "WorkersRemoved", None, None), ("h", 3, "InstanceState", "between", None),
        ("h", 4, "WorkersAdded", None, None),
    ], "id string, no int, kind string, val string, error string")
    got = table(logs.latest_state(log, "id", ["no"]), "id", "present", "state", "ip_address", "image", "image_change_in_progress")
    assert got == [("a", True, None, "ip", None, False), ("b", True, None, None, None, True),
                   ("c", True, None, None, "i2", False), ("e", False, None, None, None, False), ("f", True, None, None, None, False),
                   ("g", False, None, None, None, False), ("h", True, None, None, None, False)]


def test_snapshot_apply_columns(spark):
    kind = "id int, state string, address string, image string"
    prev = spark.createDataFrame([(1, "Running", "a1", "i1"), (2, "Running", "a2", "i2")], kind)
    cur = spark.createDataFrame([(1, None, None, "other"), (3, "Pending", None, "i3")], kind)
    out = fleet.snapshot_apply(prev, cur, "id", sticky_cols=["address"], overwrite_cols=["state"])
    assert table(out) == [(1, None, "a1", "i1"), (3, "Pending", None, "i3")]


def test_snapshot_diff_invariants(inputs):
    prev, cur = inputs.view("snapshot_prev"), inputs.view("snapshot_cur")
    diff = fleet.snapshot_diff(prev, cur, "id")
    ids = lambda df: {r["id"] for r in df.collect()}
    change = {c: ids(diff.where(F.col("change") == c)) for c in ("added", "removed", "retained")}
    assert ids(prev) - change["removed"] | change["added"] == ids(cur)
    assert change["retained"] == ids(prev) & ids(cur)


def test_folding_poll_diffs_gives_the_last_poll(inputs):
    polls = inputs.view("poll").where("poll_no <> 11")  # one that found nothing would be the end of all before it
    first, last = polls.agg(F.min("poll_no"), F.max("poll_no")).first()
    start = polls.where(F.col("poll_no") == first).select("id", F.lit(0).alias("no"), F.lit("WorkersAdded").alias("kind"))
    diffs = fleet.poll_diff(polls, "id", "poll_no").select(
        "id", F.col("poll_no").alias("no"), F.when(F.col("change") == "added", "WorkersAdded").otherwise("WorkersRemoved").alias("kind"))
    state = logs.latest_state(start.unionByName(diffs).withColumn("val", F.lit(None).cast("string")), "id", ["no"])
    want = polls.where(F.col("poll_no") == last).select("id")
    assert table(state.where("present").select("id")) == table(want)


def test_upsert_and_unions(spark):
    kind = "id int, x string, y string"
    a = spark.createDataFrame([(1, "a1", "b1"), (2, "a2", None)], kind)
    b = spark.createDataFrame([(2, None, "n2"), (3, "a3", "n3")], kind)
    assert table(sets.upsert(a, b, "id")) == [(1, "a1", "b1"), (2, None, "n2"), (3, "a3", "n3")]
    assert table(sets.upsert(a, b, "id", partial=True)) == [(1, "a1", "b1"), (2, "a2", "n2"), (3, "a3", "n3")]
    assert table(sets.upsert(a, b.select("id", "y"), "id", partial=True)) == [(1, "a1", "b1"), (2, "a2", "n2"), (3, None, "n3")]
    assert table(sets.union_keep_left(a, b, "id")) == [(1, "a1", "b1"), (2, "a2", None), (3, "a3", "n3")]
    assert table(sets.remove_ids(a, b, "id")) == [(1, "a1", "b1")]


def test_price_asof(spark):
    kind = "t string, ts bigint, price decimal(18,2)"
    quotes = spark.createDataFrame([("a", 10, 1), ("a", 20, 2), ("a", 20, 3), ("b", 5, 9)], "t string, ts bigint, price int").selectExpr(
        "t", "ts", "cast(price as decimal(18,2)) as price")
    probes = spark.createDataFrame([("a", 9), ("a", 10), ("a", 19), ("a", 20), ("a", 99), ("c", 1)], "t string, ts bigint")
    got = [(r["t"], r["ts"], float(r["price"])) for r in prices.price_asof(probes, quotes, ["t"], "ts").collect()]
    assert sorted(got) == [("a", 9, 0), ("a", 10, 1), ("a", 19, 1), ("a", 20, 3), ("a", 99, 3), ("c", 1, 0)]


def test_request_texts(spark):
    asked = spark.createDataFrame(
        [(1, "TerminateCluster", 7, None, None), (2, "TerminateCluster", 8, None, None), (3, "AddWorkers", 9, 0, None),
         (4, "TerminateWorker", None, None, "w1"), (5, "TerminateWorker", None, None, "w2"), (6, "ChangeDockerImage", 8, None, None)],
        "request_id int, kind string, cluster_id int, worker_count int, instance_id string")
    clusters = spark.createDataFrame([(7, "Running", "IdleTimeout"), (8, "Terminating", None), (9, "Running", None)],
                                     "cluster_id int, master_state string, termination_reason string")
    workers = spark.createDataFrame([("w1", "Terminated"), ("w2", "Running")], "instance_id string, state string")
    got = dict(requests.request_outcome(asked, clusters, workers).select("request_id", "error").collect())
    assert got == {
        1: "Failed to terminate cluster with id 7: cluster termination is already underway because of IdleTimeout",
        2: "Failed to terminate cluster with id 8: requirement failed: cluster is already terminating",
        3: "Failed to add workers to cluster with id 9: requirement failed: worker count must be positive",
        4: "Terminate worker: no worker with instance id w1",
        5: None,
        6: "Failed to change Docker image of cluster with id 8: requirement failed: cluster master must be running to change docker image",
    }


def test_billable_hours(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, 30), datetime.datetime(2024, 1, 1, 2, 10))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(totals.billable_hours(F.col("a"), F.col("b"))).first()[0] == 2


def test_price_history_without_types_is_empty(inputs):
    none = inputs.view("spec_dim").where("instance_type < 0")
    assert inventory.price_history_scan(inputs.view("price_history"), none, "zone-1", "Linux/UNIX", "2024-01-01 00:00:00").count() == 0


SNAPSHOT = {"id": "i1", "ipAddress": "10.0.0.1", "subnet": {"id": "s", "availabilityZone": "z"}, "placementGroup": "p",
            "dockerImage": {"repo": "r", "tag": "t"}, "state": "Terminated", "containerState": "ContainerStopped",
            "instanceType": "m", "launchedAt": "2024-01-02T03:04:05Z", "terminatedAt": "2024-01-02T04:04Z"}
UUID = "00000000-0000-4000-8000-0123456789ab"
SPEC = {"id": UUID, "name": "Sam's \"cluster\"", "dockerImage": {"repo": "r", "tag": "t"}, "ttl": "PT10H", "idleTimeout": "PT15M",
        "masterInstanceType": "m", "workerInstanceType": "w", "numWorkers": 4, "subnetId": "s", "placementGroup": "p g",
        "extraInstanceTags": {"tags": {"k": "v"}}}
VALUES = {
    "serverId": "srv", "messageNo": 3, "clusterId": UUID, "count": 2, "dockerImage": {"repo": "r", "tag": "t"}, "clusterSpec": SPEC,
    "bidPrice": 1.23, "reason": "ClientRequested", "clusterIds": [UUID, UUID], "instanceId": "i1", "containerState": "ContainerRunning",
    "ipAddress": "fe80::1", "state": "Running", "subnet": {"id": "s", "availabilityZone": "z"}, "terminatedAt": "2024-01-02T03:04:05.250Z",
    "workers": [SNAPSHOT, SNAPSHOT], "workerIds": ["i1", "i2"], "error": "it broke",
    "clusters": [{"id": UUID, "name": "n", "dockerImage": {"repo": "r", "tag": "t"}, "ttl": "PT1H", "master": SNAPSHOT, "workers": [],
                  "workerInstanceType": "w", "subnet": {"id": "s", "availabilityZone": "z"}, "workerBidPrice": 0.5,
                  "launchedAt": "2024-01-02T03:04:05Z"}],
}


def test_round_trip_of_every_kind(spark):
    texts = []
    for kind, (required, optional) in KINDS.items():
        for fields in (required, required + optional):
            texts.append({"$type": kind, **{f: VALUES[f] for f in fields}})
    assert len(KINDS) == 22
    lines = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(texts)], "event_id int, line string")
    decoded, rejects = messages.message_decode(lines, "line")
    assert rejects.collect() == []
    back = {r["event_id"]: json.loads(r["line"]) for r in messages.message_encode(decoded).collect()}
    assert back == dict(enumerate(texts))


def test_bad_texts_are_rejected_and_the_rest_goes_on(spark):
    texts = [
        '{"$type":"AddWorkers","clusterId":"%s","count":2}' % UUID, "", "not json", "[1]", '{"clusterId":"x"}', '{"$type":"Nothing"}',
        '{"$type":"AddWorkers","clusterId":"%s"}' % UUID, '{"$type":"AddWorkers","clusterId":"%s","count":"two"}' % UUID,
        '{"$type":"InstanceState","serverId":"s","messageNo":1,"instanceId":"i","state":"Lost"}',
        '{"$type":"InstanceTerminatedAt","serverId":"s","messageNo":1,"instanceId":"i","terminatedAt":"2024-01-02"}',
        json.dumps({"$type": "LaunchCluster", "clusterSpec": {**SPEC, "ttl": "10h"}}),
        json.dumps({"$type": "LaunchCluster", "clusterSpec": {k: v for k, v in SPEC.items() if k != "name"}}),
        json.dumps({"$type": "WorkersAdded", "serverId": "s", "messageNo": 1, "clusterId": UUID, "workers": [{**SNAPSHOT, "state": "x"}]}),
    ]
    lines = spark.createDataFrame(list(enumerate(texts)), "event_id int, line string")
    decoded, rejects = messages.message_decode(lines, "line")
    assert [r["event_id"] for r in decoded.collect()] == [0]
    assert dict(rejects.select("event_id", "reason").collect()) == {
        1: "malformed JSON", 2: "malformed JSON", 3: "malformed JSON", 4: "no $type", 5: "unknown $type Nothing", 6: "missing count",
        7: "malformed JSON", 8: "invalid state", 9: "invalid terminatedAt", 10: "invalid clusterSpec", 11: "invalid clusterSpec",
        12: "invalid workers"}


def test_conformance_at_every_level(spark):
    """Each fault is counted at its path, once for each place; odd texts are malformed and nothing else."""
    of = lambda kind, **fields: json.dumps({"$type": kind, "serverId": "s", "messageNo": 1, **fields})
    cluster = VALUES["clusters"][0]
    texts = [
        of("ClustersAdded", clusters=[{**cluster, "workers": [{**SNAPSHOT, "state": "x"}, {**SNAPSHOT, "state": "x"}, 7]}, {**cluster, "id": "no"}]),
        of("ClustersAdded", clusters=[{**cluster, "subnet": {"id": None}, "workerBidPrice": "0.5", "launchedAt": 5}]),
        of("ClustersAdded", clusters={"workers": []}), of("ClustersRemoved", clusterIds=["no", UUID, None, "no"]),
        of("WorkersAdded", clusterId=5, workers=[{"state": None, "subnet.id": 1}]), of("AddWorkers", clusterId=UUID, count=2.5, clusters="not its field"),
        json.dumps({"$type": "LaunchCluster", "clusterSpec": {**SPEC, "extraInstanceTags": {"tags": {"a.b": 1, "c": "d"}}, "ttl": None}}),
        of("InstanceState", instanceId="i", state=["Running"]), '{"$type":"Nothing"}', '{"$type":null}', "[1]", '"text"', "", "{", '{"a":1} {"b":2}', None]
    lines = spark.createDataFrame([(t,) for t in texts], "line string")
    found = {(r.kind, r.rule): r.n for r in messages.message_conformance(lines, "line").collect()}
    needed = ["containerState", "id", "instanceType", "launchedAt", "state"]
    assert found == {
        ("ClustersAdded", "enum clusters[].workers[].state"): 2, ("ClustersAdded", "type clusters[].workers[]"): 1, ("ClustersAdded", "pattern clusters[].id"): 1,
        ("ClustersAdded", "missing clusters[].subnet.id"): 1, ("ClustersAdded", "missing clusters[].subnet.availabilityZone"): 1,
        ("ClustersAdded", "type clusters[].workerBidPrice"): 1, ("ClustersAdded", "type clusters[].launchedAt"): 1, ("ClustersAdded", "type clusters"): 1,
        ("ClustersRemoved", "pattern clusterIds[]"): 2, ("ClustersRemoved", "type clusterIds[]"): 1, ("WorkersAdded", "type clusterId"): 1,
        **{("WorkersAdded", f"missing workers[].{name}"): 1 for name in needed}, ("AddWorkers", "type count"): 1,
        ("LaunchCluster", "type clusterSpec.extraInstanceTags.tags.*"): 1, ("InstanceState", "type state"): 1,
        ("Nothing", "unknown $type"): 1, ("?", "unknown $type"): 1, ("?", "malformed JSON"): 6}
    assert messages.message_conformance(lines.limit(0), "line").collect() == []


def test_decimals_are_exact_or_rejected(spark):
    """Nothing is rounded: a price comes back as it was, or its line is a reject."""
    prices = ["0.123456789", "1.5000", "12345678901234567890.123456789012345678", "0.000000000000000001", "7", "-0.1"]
    bad = ["0.1234567890123456789", "123456789012345678901", "1e400", '"cheap"']
    spec = ('{"id":"00000000-0000-4000-8000-000000000001","name":"a","dockerImage":{"repo":"r","tag":"t"},"masterInstanceType":"m",'
            '"workerInstanceType":"w","numWorkers":1,"subnetId":"\\"bidPrice\\":\\"5\\""}')
    lines = [(i, '{"$type":"LaunchSpotCluster","clusterSpec":' + spec + f',"bidPrice":{price}}}') for i, price in enumerate(prices + bad)]
    rows = messages.message_parse(spark.createDataFrame(lines, "event_id long, line string").coalesce(1), "line").collect()
    decoded = {r.event_id: r.bid_price for r in rows if r.reject is None}
    assert decoded == {i: decimal.Decimal(price) for i, price in enumerate(prices)}
    good = spark.createDataFrame([(r.event_id, r.kind, r.cluster_spec.name, r.bid_price) for r in rows if r.reject is None],
                                 "event_id long, kind string, error string, bid_price decimal(38,18)").withColumn("error", F.lit('"bidPrice":"5"'))
    back = {r.event_id: json.loads(r.line, parse_float=decimal.Decimal, parse_int=decimal.Decimal) for r in messages.message_encode(good).collect()}
    assert {i: m["bidPrice"] for i, m in back.items()} == decoded
    assert all(m["error"] == '"bidPrice":"5"' for m in back.values())


def test_histories_as_runs_and_rejects(spark):
    docs = [(1, '{"activeapps":[{"id":"a"}],"completedapps":[{"starttime":1000,"duration":500}]}'), (2, '{"activeapps":[],"completedapps":[]}'), (3, '{"activeapps":['),
            (4, None), (5, "{}")]
    runs, rejects = inventory.app_run_scan(spark.createDataFrame(docs, "cluster_id long, doc string"), "doc")
    stamp = datetime.datetime(1970, 1, 1, 0, 0, 1)
    assert sorted(map(tuple, runs.collect()), key=lambda r: r[3]) == [(1, stamp, 500, False), (1, None, None, True)]
    assert {r.cluster_id: r.reason for r in rejects.collect()} == {3: "malformed JSON", 4: "no document", 5: "no applications listed"}


def test_workers_of_types_that_no_catalogue_has(spark):
    clusters = spark.createDataFrame([(1,), (2,)], "cluster_id int")
    instances = spark.createDataFrame(
        [(1, "a", 5, "Worker", "Running"), (1, "b", 6, "Worker", "Running"), (1, "c", 6, "Worker", "Terminated"), (2, "d", 5, "Master", "Running")],
        "cluster_id int, instance_id string, instance_type int, role string, state string")
    specs = spark.createDataFrame([(5, 4, 8, 1, 2, decimal.Decimal("0.5"))], "instance_type int, cores int, memory_bytes long, devices int, bytes_per_device long, hourly_price decimal(18,4)")
    shown, rejects = totals.cluster_capacity(clusters, instances, specs)
    assert {r.cluster_id: r.cores for r in shown.collect()} == {1: 4, 2: 0}
    assert [(r.instance_id, r.instance_type) for r in rejects.collect()] == [("b", 6)]


def test_shuffled_partitions_stay_small(spark):
    """after a shuffle a task gets 8 MB of rows or so, however many there are."""
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        hashes = [f"h{i}" for i in range(5)]
        rows = spark.range(6_000_000).select(*[F.xxhash64("id", F.lit(i)).alias(h) for i, h in enumerate(hashes)]).repartition("h0")
        counts = rows.groupBy(F.spark_partition_id()).agg(*[F.max(h) for h in hashes]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert len(counts) >= 24  # of 240 MB


def test_messages_are_dealt_before_they_are_made(spark, inputs):
    """a table in one file is worked on by as many tasks as there are shuffle partitions."""
    tasks = inputs.view("wire_text").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(r["count"] for r in tasks) == inputs.table("events").count()


def test_conformance_of_names_like_paths_and_odd_items(spark):
    """a name with a mark of paths in it is none of the schema's; items of a wrong type break a rule each, in whatever order."""
    of = lambda kind, **fields: json.dumps({"$type": kind, "serverId": "s", "messageNo": 1, **fields})
    tags = {**SPEC, "extraInstanceTags": {"tags": {"": "x", "a]": 2, "b*": [], "c": None}}}
    texts = [of("WorkersAdded", clusterId=UUID, workers=[None, [], [SNAPSHOT], {**SNAPSHOT, "state]": 1, "subnet.id": 1, "state": "x"}]),
             json.dumps({"$type": "LaunchCluster", "clusterSpec": tags, "clusterSpec.id": 1})]
    found = {(r.kind, r.rule): r.n for r in messages.message_conformance(spark.createDataFrame([(t,) for t in texts], "line string"), "line").collect()}
    assert found == {("WorkersAdded", "type workers[]"): 3, ("WorkersAdded", "enum workers[].state"): 1, ("LaunchCluster", "type clusterSpec.extraInstanceTags.tags.*"): 2}
