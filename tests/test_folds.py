"""Decoded messages folded into clusters and their instances."""

from __future__ import annotations

import json
import tempfile

from flotilla.operators.folds import fold_messages
from flotilla.sources.messages import message_decode

STAMP = "2024-01-01T10:00:00Z"
IMAGE = {"repo": "lab/app", "tag": "1"}
ids = {n: f"00000000-0000-4000-8000-{n:012d}" for n in (1, 2)}


def instance(name, state="Pending", image="1"):
    return {"id": name, "subnet": {"id": "s1", "availabilityZone": "z"}, "dockerImage": {"repo": "lab/app", "tag": image}, "state": state,
            "containerState": "ContainerPending", "instanceType": "t", "launchedAt": STAMP}


def cluster(n, master, *workers, name="c"):
    return {"id": ids[n], "name": name, "dockerImage": IMAGE, "master": instance(master), "workers": [instance(*([w] if isinstance(w, str) else w)) for w in workers],
            "workerInstanceType": "t", "subnet": {"id": "s1", "availabilityZone": "z"}, "launchedAt": STAMP}


def folded(spark, *said):
    lines = [(i, json.dumps({"$type": kind, "serverId": "s", "messageNo": i, **rest})) for i, (kind, rest) in enumerate(said)]
    messages, _ = message_decode(spark.createDataFrame(lines, "event_id long, line string"), "line")
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/decoded"
    messages.coalesce(1).write.parquet(path)
    clusters, members = fold_messages(spark.read.schema(messages.schema).parquet(path), ["event_id"])
    return ({r.cluster_id[-1]: r for r in clusters.collect()}, {(r.cluster_id[-1], r.role[0], r.instance_id): r for r in members.collect()})


def test_members_come_and_go(spark):
    clusters, members = folded(
        spark,
        ("InstanceState", {"instanceId": "m1", "state": "Terminated"}),
        ("ClustersAdded", {"clusters": [cluster(1, "m1", "w1", "w2", "w1"), cluster(2, "m2", "w9")]}),
        ("WorkersAdded", {"clusterId": ids[1], "workers": [instance("w2", "Running"), instance("w3", "Running"), instance("w3", "Starting")]}),
        ("InstanceState", {"instanceId": "w1", "state": "Running"}),
        ("InstanceSubnet", {"instanceId": "w2"}),
        ("InstanceState", {"instanceId": "w9", "state": "Running"}),
        ("WorkersRemoved", {"clusterId": ids[2], "workerIds": ["w9", "nobody"]}),
        ("WorkersAdded", {"clusterId": ids[2], "workers": [instance("w9")]}),
        ("WorkersRemoved", {"clusterId": ids[1], "workerIds": ["w1"]}),
        ("InstanceState", {"instanceId": "nobody", "state": "Running"}),
        ("WorkersAdded", {"clusterId": "00000000-0000-4000-8000-000000000007", "workers": [instance("w7")]}))
    assert set(clusters) == {"1", "2"}
    assert set(members) == {("1", "M", "m1"), ("1", "W", "w2"), ("1", "W", "w3"), ("2", "M", "m2"), ("2", "W", "w9")}
    # what was said before an instance was a member, or before it came again, doesn't count; a worker already there stays as it was
    assert {k[2]: r.state for k, r in members.items()} == {"m1": "Pending", "w2": "Pending", "w3": "Running", "m2": "Pending", "w9": "Pending"}
    assert members["1", "W", "w2"].subnet is None and members["1", "W", "w3"].subnet.id == "s1"


def test_clusters_end_and_are_replaced(spark):
    clusters, members = folded(
        spark,
        ("ClustersAdded", {"clusters": [cluster(1, "m1", "w1", "m1"), cluster(2, "m2", "w2")]}),
        ("InstanceState", {"instanceId": "m1", "state": "Running"}),
        ("DockerImageChangeRequest", {"clusterId": ids[1], "dockerImage": {"repo": "r", "tag": "2"}}),
        ("DockerImageChangeRequest", {"clusterId": ids[2], "dockerImage": {"repo": "r", "tag": "2"}}),
        ("DockerImageChangeAttempt", {"clusterId": ids[1], "dockerImage": {"repo": "r", "tag": "2"}}),
        ("DockerImageChangeAttempt", {"clusterId": ids[2], "dockerImage": {"repo": "r", "tag": "2"}, "error": "no"}))
    assert [(clusters[k].docker_image.tag, clusters[k].image_change_in_progress) for k in "12"] == [("2", False), ("1", True)]
    # a worker with the master's id takes nothing
    assert members["1", "M", "m1"].state == "Running" and members["1", "W", "m1"].state == "Pending"
    clusters, members = folded(
        spark,
        ("ClustersAdded", {"clusters": [cluster(1, "m1", "w1"), cluster(2, "m2", "w2")]}),
        ("WorkersAdded", {"clusterId": ids[1], "workers": [instance("w3")]}),
        ("InstanceState", {"instanceId": "w1", "state": "Running"}),
        ("DockerImageChangeRequest", {"clusterId": ids[1], "dockerImage": {"repo": "r", "tag": "2"}}),
        ("ClustersRemoved", {"clusterIds": [ids[2], "00000000-0000-4000-8000-000000000009"]}),
        ("ClustersAdded", {"clusters": [cluster(1, "m5", "w1", name="again")]}),
        ("WorkersAdded", {"clusterId": ids[2], "workers": [instance("w4")]}))
    assert set(clusters) == {"1"} and clusters["1"].name == "again" and not clusters["1"].image_change_in_progress
    assert {k: r.state for k, r in members.items()} == {("1", "M", "m5"): "Pending", ("1", "W", "w1"): "Pending"}


def test_nothing_said(spark):
    clusters, members = folded(spark, ("TerminateCluster", {"clusterId": ids[1]}), ("WorkersRemoved", {"clusterId": ids[1], "workerIds": []}))
    assert not clusters and not members
