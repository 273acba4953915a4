"""Streaming forms of the batch operators. Results equal the batch form over the rows seen so far."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..operators import fleet, logs, totals
from ..plans.hot_keys import previous_row
from ..sources.polls import PollLog
from .fleet_state import BucketedState
from .keyed import Chain, after_previous, each_batch, first_ever, folded_into, prepare_state, reduced_readings, summaries, wall_clock, watched
from .micro_batches import TIMEOUT_INTERVAL, TableState, seconds_of, stepwise


def _with_carry(batch: DataFrame, state: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Batch rows after the last row of each key from earlier batches, marked ``old``."""
    return state.select(*cols, F.lit(True).alias("old")).unionByName(batch.select(*cols, F.lit(False).alias("old")))


def _last_rows(rows: DataFrame, keys: Sequence[str], cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    last = F.max_by(F.struct(*cols), F.struct(*order_cols))
    return rows.groupBy(*keys).agg(last.alias("__last")).select("__last.*")


def _part(schema: T.StructType, cols: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, schema[c].dataType) for c in dict.fromkeys(cols)])


def stream_change_events(stream: DataFrame, key: str, prop_cols: Sequence[str], order_cols: Sequence[str],
                         work_path: str, out_path: str, set_only: Sequence[str] = (),
                         min_hot_rows: int | None = None) -> Chain:
    """``change_events`` on a stream whose order does not go back between batches.

    The first writer finds the changes within each micro-batch, hot keys cut into ranges, and leaves the first and the last row of
    each key; the second compares each first row with the key's last one before, which is its state.
    """
    cols = list(dict.fromkeys([key, *order_cols, *prop_cols]))
    rest = [c for c in cols if c != key]
    schema = T.StructType([stream.schema[key], T.StructField("first", _part(stream.schema, rest)), T.StructField("last", _part(stream.schema, rest))])

    def changes(seen: DataFrame) -> DataFrame:
        return seen.select(key, *order_cols, F.inline(logs._changes(prop_cols, set_only)))

    def edges(batch: DataFrame, n: int) -> DataFrame:
        seen = previous_row(batch, [key], order_cols, prop_cols, "prev", min_hot_rows)
        changes(seen.where("prev is not null")).write.mode("overwrite").parquet(f"{out_path}/inside/batch={n}")
        # a struct of the columns in their order: rows alike in all order columns come in the order of their values
        return batch.groupBy(key).agg(F.min(F.struct(*rest)).alias("first"), F.max(F.struct(*rest)).alias("last"))

    prepare_state(stream.sparkSession)
    first, written = summaries(stream.select(*cols), schema, f"{work_path}/edges", edges)
    seen = after_previous(written, [key]).select(key, "first.*", "prev")
    return [first, each_batch(changes(seen), f"{out_path}/across")]


def stream_latest_state(stream: DataFrame, key: str, order_cols: Sequence[str], work_path: str, out_path: str,
                        min_hot_rows: int | None = None) -> Chain:
    """``latest_state`` of the entities that a micro-batch names, with its ``batch_id``; an entity's last row counts.

    The first writer folds each micro-batch by itself, to one row an entity; the second folds that into the state of the entity,
    which is what ``latest_state`` asks of the log: the add it is known from and the last value of everything, with their places.
    """
    cols = list(dict.fromkeys([key, *order_cols, "kind", "val", *(["error"] if "error" in stream.columns else [])]))
    nothing = stream.sparkSession.createDataFrame([], _part(stream.schema, cols))
    schema = logs.folded_rows(nothing, key, order_cols).schema
    prepare_state(stream.sparkSession)
    first, written = summaries(stream.select(*cols), schema, f"{work_path}/folds", lambda batch, _: logs.folded_rows(batch, key, order_cols, min_hot_rows))
    whole = folded_into(written, key, logs.FOLDED_PROPS)
    return [first, each_batch(logs.shown(whole, key, "batch_id"), out_path)]


def stream_snapshot_diff(polls: PollLog, spark: SparkSession, key: str, state_path: str, out_path: str) -> DataStreamWriter:
    """Added and removed keys of each poll against the last one before it, which may have been empty, see ``poll_diff``.

    The state is the number of the last poll: its rows are read again where they landed.
    """
    number = polls.poll_col

    def step(batch: DataFrame, state: DataFrame, _batch_id: int):
        last = [row[0] for row in state.collect()]
        found = polls.numbers(batch, last[0] if last else None)
        every = last + found
        rows = polls.read(spark, every).select(key, number)
        # a row with a null key says that its poll took place
        marks = rows.limit(0).unionByName(spark.createDataFrame([(None, n) for n in every], rows.schema))
        return fleet.poll_diff(rows.unionByName(marks), key, number), spark.createDataFrame([(n,) for n in every[-1:]], _part(polls.schema, [number]))

    return stepwise(polls.announced(spark), TableState(state_path, _part(polls.schema, [number])), out_path, step)


def stream_snapshot_apply(polls: PollLog, spark: SparkSession, key: str, sticky_cols: list[str], overwrite_cols: list[str], state: BucketedState,
                          cluster_col: str | None = None, is_master: Column | None = None) -> DataStreamWriter:
    """The fleet kept between polls: ``snapshot_apply`` of each poll, in order, to the state before it.

    A poll that did not take place changes nothing, an empty one removes everything. Only buckets of ``state`` in which a row changes are
    rewritten. A replayed micro-batch starts from the state before it.
    """
    def run(batch: DataFrame, n: int) -> None:
        before = now = state.after(spark, n - 1)
        for poll in polls.numbers(batch):
            now = fleet.snapshot_apply(now, polls.read(spark, [poll]), key, sticky_cols, overwrite_cols, cluster_col, is_master)
        state.save(before, now, n)

    return polls.announced(spark).writeStream.foreachBatch(run)


def stream_timeout(readings: DataFrame, clusters: DataFrame, out_path: str, every: str = TIMEOUT_INTERVAL,
                   clock: Callable[[int], object] = wall_clock) -> DataStreamWriter:
    """``cluster_id, judged_at, verdict``: ``timeout_verdict`` of a cluster at every news of it and, by a timer of its own, each ``every`` without any.

    ``readings`` is a stream of application histories: rows of one ``cluster_id`` and ``seen_at`` are one reading of a cluster's
    history, a row with null ``start_at`` being one without runs, and the last reading alone counts. ``clusters`` is a stream of the
    clusters as they become: ``cluster_id, as_of``, the columns of ``timeout_verdict`` and ``gone``, true once a cluster is no more; the last
    row of a cluster counts. ``judged_at`` is the machine's time in milliseconds, and ``clock`` makes of it the moment that is judged at. The
    state is, of each cluster, its facts and its last reading. A null verdict takes an earlier one back. Rows with a null
    ``cluster_id`` are left out.
    """
    facts = ["launched_at", "ttl_hours", "idle_minutes", "master_address", "master_state", "master_container"]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("as_of")
    latest = reduced_readings(readings.where("cluster_id is not null").select(
        "cluster_id", micros("seen_at"), F.col("active").alias("active"), totals.run_end().alias("end")))
    known = clusters.where("cluster_id is not null").select(
        F.col("cluster_id").cast(latest.schema["cluster_id"].dataType), F.lit("cluster").alias("kind"), micros("as_of"),
        F.when(~F.coalesce(F.col("gone"), F.lit(False)), F.struct(*facts)).alias("cluster"))
    read = latest.select("cluster_id", F.lit("reading").alias("kind"), "as_of", F.struct("active", "last_end").alias("reading"))
    news = known.unionByName(read, allowMissingColumns=True)
    moment = clusters.schema["launched_at"].dataType
    seen = watched(news, seconds_of(every) * 1000, clock, moment).select("cluster_id", "judged_at", "now", "cluster.*", "reading.*")
    return each_batch(seen.select("cluster_id", "judged_at", totals.verdict(F.col("now")).alias("verdict")), out_path)


def stream_sequence_gaps(stream: DataFrame, server_col: str, no_col: str, state_path: str, out_path: str,
                         stream_cols: Sequence[str] | None = None, order_cols: Sequence[str] | None = None,
                         on_gap: Callable[[DataFrame, int], None] | None = None,
                         min_hot_rows: int | None = None) -> DataStreamWriter:
    """``sequence_gaps`` on a stream; ``on_gap`` gets each batch's gaps as written, to reload a snapshot.

    It is called after the batch's output and state are saved, with the batch id: a replay calls it again with that id
    and the same rows, so what it does should be keyed on the id.
    """
    keys = list(stream_cols) if stream_cols else [server_col]
    order = list(order_cols) if order_cols else [no_col]
    cols = list(dict.fromkeys([*keys, *order, server_col, no_col]))

    def step(batch: DataFrame, state: DataFrame, batch_id: int):
        rows = _with_carry(batch, state, cols)
        seen = previous_row(rows, keys, order, [server_col, no_col], "prev", min_hot_rows)
        gaps = logs.flag_gaps(seen.where(~F.col("old")), server_col, no_col).drop("old")
        return gaps, _last_rows(rows, keys, cols, order)

    return stepwise(stream, TableState(state_path, _part(stream.schema, cols)), out_path, step, on_gap)


def stream_reloaded_state(stream: DataFrame, key: str, order_cols: Sequence[str], server_col: str, no_col: str,
                          reload: Callable[[DataFrame], DataFrame], work_path: str, out_path: str, min_hot_rows: int | None = None) -> Chain:
    """``stream_latest_state`` of a log with losses: where a server's numbers have a gap, its entities are loaded anew.

    Each server's numbers go on from its last one in an earlier micro-batch. ``reload`` gets the servers with a gap in the batch, as ``server_col``
    and ``upto``, their last number in it, and gives ``folded_rows`` of all their entities up to there, see ``logs.reloaded``; these replace what was
    known. The servers without a gap are folded as they came. Numbers go on from the batch's last ones. An entity has one server.
    """
    spark = stream.sparkSession
    said = [key, *order_cols, "kind", "val", *(["error"] if "error" in stream.columns else [])]
    cols = list(dict.fromkeys([*said, server_col, no_col]))
    numbers = TableState(f"{work_path}/numbers", _part(stream.schema, [server_col, no_col]))
    schema = logs.folded_rows(spark.createDataFrame([], _part(stream.schema, said)), key, order_cols).schema.add("reloaded", "boolean")

    def fold(batch: DataFrame, n: int) -> DataFrame:
        rows = _with_carry(batch, numbers.before(spark, n), [server_col, no_col])
        seen = previous_row(rows, [server_col], [no_col], [server_col, no_col], "prev", min_hot_rows)
        gaps = logs.flag_gaps(seen.where(~F.col("old")), server_col, no_col).select(server_col).distinct()
        numbers.save(rows.groupBy(server_col).agg(F.max(no_col).alias(no_col)), n)
        # one row a server, written since it is joined to the batch and to the log several times
        place = f"{work_path}/broken/batch={n}"
        numbers.before(spark, n + 1).join(gaps, server_col).select(server_col, F.col(no_col).alias("upto")).write.mode("overwrite").parquet(place)
        broken = spark.read.parquet(place)
        whole = reload(broken)
        own = logs.folded_rows(batch.join(broken.select(server_col), server_col, "left_anti").select(*said), key, order_cols, min_hot_rows)
        return own.withColumn("reloaded", F.lit(False)).unionByName(whole.withColumn("reloaded", F.lit(True)))

    prepare_state(spark)
    first, written = summaries(stream.select(*cols), schema, f"{work_path}/folds", fold)
    whole = folded_into(written, key, logs.FOLDED_PROPS)
    return [first, each_batch(logs.shown(whole, key, "batch_id"), out_path)]


def stream_collect_first(stream: DataFrame, key: str, predicate: Column, value: Column, order_cols: Sequence[str], out_path: str) -> DataStreamWriter:
    """``collect_first`` on a stream in order: one output row per key; the state is the keys done."""
    wanted = stream.where(predicate).select(key, value.alias("value"), *order_cols)
    return each_batch(first_ever(wanted, key, order_cols), out_path)
