"""Splitting a hot key must not change any result."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flotilla.functions.states import allowed_transitions
from flotilla.operators import fleet, logs, prices
from flotilla.plans import hot_keys
from flotilla.plans.groups import nested
from flotilla.sources.inventory import cluster_snapshot

MIN_ROWS = 20


@pytest.fixture(scope="module")
def skewed(inputs):
    """Event history with one instance holding a third of the rows, and one without a key."""
    key = F.expr("case when event_id % 3 = 0 then 999 when event_id % 5 <> 0 then instance_id end")
    return inputs.view("state_history").withColumn("instance_id", key).cache()


def rows(df):
    return sorted(map(repr, df.collect()))


def test_hot_key_is_cut_into_bounded_ranges(skewed):
    cut = hot_keys.RangeCut(skewed, ["instance_id"], ["ts", "event_id"], 100)
    sizes = cut.hot.groupBy("instance_id", "__range1", "__range2").count().collect()
    assert {r["instance_id"] for r in sizes} == {999, None}
    assert max(r["count"] for r in sizes) <= 100
    assert cut.rows.count() == skewed.count()
    assert cut.rows.where("instance_id <> 999 and __range1 <> 0").count() == 0


def test_previous_row(skewed):
    w = Window.partitionBy("instance_id").orderBy("ts", "event_id")
    plain = skewed.withColumn("prev", F.lag(F.struct("state", "terminated_mark")).over(w))
    split = hot_keys.previous_row(skewed, ["instance_id"], ["ts", "event_id"], ["state", "terminated_mark"], "prev", MIN_ROWS)
    assert rows(split.select(plain.columns)) == rows(plain)


def test_last_known(skewed):
    w = Window.partitionBy("instance_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    plain = skewed.withColumn("known", F.last("terminated_mark", ignorenulls=True).over(w))
    split = hot_keys.last_known(skewed, ["instance_id"], ["ts", "event_id"], "terminated_mark", "known", MIN_ROWS)
    assert rows(split.select(plain.columns)) == rows(plain)


def test_row_numbers(skewed):
    w = Window.partitionBy("instance_id").orderBy("ts", "event_id")
    plain = skewed.withColumn("no", F.row_number().over(w).cast("bigint"))
    split = hot_keys.row_numbers(skewed, ["instance_id"], ["ts", "event_id"], "no", MIN_ROWS)
    assert rows(split.select(plain.columns)) == rows(plain)


def test_already_clustered_input_is_still_cut(spark, skewed):
    clustered = skewed.repartition("instance_id")
    split = hot_keys.row_numbers(clustered, ["instance_id"], ["ts", "event_id"], "no", MIN_ROWS)
    assert rows(split) == rows(hot_keys.row_numbers(skewed, ["instance_id"], ["ts", "event_id"], "no"))
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(instance_id" in plan and "__range1" in plan


def test_operators_agree_with_and_without_splitting(spark, skewed, inputs):
    order = ["ts", "event_id"]
    known = skewed.where("instance_id is not null")
    moves = allowed_transitions(spark)
    for run in (
        lambda n: logs.change_events(known, "instance_id", ["state", "container_state"], order, min_hot_rows=n),
        lambda n: logs.message_number(known.withColumn("s", F.lit("one")), "s", order, min_hot_rows=n),
        lambda n: logs.sequence_gaps(inputs.view("gapped_log"), "server_id", "message_no", min_hot_rows=n),
        lambda n: logs.validate_transitions(known, "instance_id", ["state", "container_state"], moves, order, min_hot_rows=n),
        lambda n: prices.price_asof(
            inputs.view("price_probe"), inputs.view("price_history"), ["instance_type", "zone"], "ts", min_hot_rows=n),
    ):
        assert rows(run(MIN_ROWS)) == rows(run(None))


def test_a_burst_is_cut_again(spark):
    """Most rows of the key fall into a thousandth of its span, and many share one moment."""
    df = spark.range(2000).selectExpr(
        "1 as k", "case when id < 3 then id * 1000000000 when id < 1000 then 500 + id else 77 end as at", "id")
    cut = hot_keys.RangeCut(df, ["k"], ["at", "id"], 50)
    sizes = [r["count"] for r in cut.hot.groupBy("__range1", "__range2").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 1500 and len(sizes) > 20
    w = Window.partitionBy("k").orderBy("at", "id")
    want = df.withColumn("no", F.row_number().over(w).cast("bigint"))
    assert rows(hot_keys.row_numbers(df, ["k"], ["at", "id"], "no", 50)) == rows(want)
    want = df.withColumn("prev", F.lag(F.struct("at", "id")).over(w))
    assert rows(hot_keys.previous_row(df, ["k"], ["at", "id"], ["at", "id"], "prev", 50)) == rows(want)


def test_one_moment_is_cut_by_the_next_column(spark):
    df = spark.range(1000).selectExpr("1 as k", "5 as at", "id")
    cut = hot_keys.RangeCut(df, ["k"], ["at", "id"], 50)
    assert cut.hot.groupBy("__range1", "__range2").count().agg(F.max("count")).first()[0] <= 50


def test_ties_copies_and_nulls_are_alike_hot_and_cold(spark):
    """Rows of a key at one moment, copies among them, give the same changes whatever counts as hot."""
    pattern = ["a", "b", "a", "a", "b", None]
    rows_in = spark.createDataFrame(
        [(1, 5, pattern[i % 6]) for i in range(120)] + [(1, 6, "b"), (1, None, "c"), (2, 1, "a"), (2, 1, "a"), (None, 3, "z")], "k bigint, at bigint, v string")
    cold = logs.change_events(rows_in, "k", ["v"], ["at"], min_hot_rows=10**9)
    hot = logs.change_events(rows_in, "k", ["v"], ["at"], min_hot_rows=1)
    assert rows(cold) == rows(hot)
    assert cold.where("k = 1").count() == 4  # c, then null, a and b at moment 5; b goes on at 6
    numbered = logs.message_number(rows_in, "k", ["at"], min_hot_rows=1).where("k = 1")
    assert sorted(r["message_no"] for r in numbered.collect()) == list(range(1, 123))


def test_groups_have_bounded_parts(inputs):
    instances = inputs.view("instance_fact").withColumn("cluster_id", F.expr("case when cluster_id % 3 = 0 then 3 else cluster_id end"))
    members = fleet.group_members(instances, "cluster_id")
    assert rows(members.select("cluster_id", "instance_id")) == rows(instances.select("cluster_id", "instance_id"))
    groups = nested(members, "cluster_id", "instance_id", F.col("instance_id"), 50).cache()
    assert groups.where("parts > 1").count() > 1
    assert groups.agg(F.max(F.size("members"))).first()[0] < 200
    assert rows(groups.select("cluster_id", F.explode("members").alias("instance_id"))) == rows(members.select("cluster_id", "instance_id"))
    assert groups.groupBy("cluster_id").agg(F.sum(F.size("members")).alias("s"), F.max("n").alias("n")).where("s <> n").count() == 0


def test_large_cluster_snapshot_comes_in_parts(inputs):
    instances = inputs.view("instance_fact").withColumn("cluster_id", F.expr("case when cluster_id % 3 = 0 then 3 else cluster_id end"))
    clusters = inputs.view("cluster_dim")
    shown = cluster_snapshot(clusters, instances, part_size=50).cache()
    assert shown.select("cluster_id").distinct().count() == clusters.count()
    assert shown.where("cluster_id = 3").count() > 1
    workers = shown.select("cluster_id", F.explode("workers.instance_id").alias("instance_id"))
    assert rows(workers) == rows(instances.where("role = 'Worker'").select("cluster_id", "instance_id"))


def test_order_columns_over_the_whole_bigint_range(spark):
    df = spark.range(400).selectExpr("1 as k", "(id - 200) * 46000000000000000 as at")
    w = Window.partitionBy("k").orderBy("at")
    want = df.withColumn("no", F.row_number().over(w).cast("bigint"))
    cut = hot_keys.RangeCut(df, ["k"], ["at"], 50)
    assert cut.hot.groupBy("__range1").count().agg(F.max("count")).first()[0] <= 50
    assert rows(hot_keys.row_numbers(df, ["k"], ["at"], "no", 50)) == rows(want)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_unique(spark, how):
    left = spark.range(600).selectExpr("case when id % 3 = 0 then 7 else id % 50 end as k", "id")
    right = spark.range(0, 40).selectExpr("id as k", "id * 10 as v")
    assert rows(hot_keys.join_unique(left, right, "k", how, 50)) == rows(left.join(right, "k", how))
    assert rows(hot_keys.join_unique(left, right, "k", how)) == rows(left.join(right, "k", how))
