"""Ordered per-key computations over histories and message logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.hot_keys import previous_row, row_numbers

# Which message kind sets which property of an instance.
PROPERTY_KINDS = {
    "state": "InstanceState",
    "container_state": "InstanceContainerState",
    "ip_address": "InstanceIpAddress",
    "subnet": "InstanceSubnet",
    "terminated_at": "InstanceTerminatedAt",
}
ADDED_KINDS = ["ClustersAdded", "WorkersAdded"]
REMOVED_KINDS = ["ClustersRemoved", "WorkersRemoved"]
IMAGE_REQUEST = "DockerImageChangeRequest"
IMAGE_ATTEMPT = "DockerImageChangeAttempt"
#: What ``folded_rows`` keeps of an entity besides its presence.
FOLDED_PROPS = ["image", "changing", *PROPERTY_KINDS]


def change_events(df: DataFrame, key: str, prop_cols: Sequence[str], order_cols: Sequence[str],
                  set_only: Sequence[str] = (), min_hot_rows: int | None = None) -> DataFrame:
    """``key, order columns, property, value`` whenever a property's value differs from the row before.

    The first row of a key gives every property; those in ``set_only`` only when not null. Rows alike in all
    order columns come in the order of their values.
    """
    cols = [key, *order_cols, *prop_cols]
    seen = previous_row(df.select(*dict.fromkeys(cols)), [key], order_cols, prop_cols, "prev", min_hot_rows)
    return seen.select(key, *order_cols, F.inline(_changes(prop_cols, set_only)))


def _changes(prop_cols: Sequence[str], set_only: Sequence[str]) -> Column:
    """Array of the ``property, value`` structs that differ from the struct column ``prev``."""
    def change(prop: str) -> str:
        differs = f"prev is null or not (`{prop}` <=> prev.`{prop}`)"
        if prop in set_only:
            differs = f"({differs}) and `{prop}` is not null"
        return f"if({differs}, named_struct('property', '{prop}', 'value', cast(`{prop}` as string)), null)"

    return F.expr(f"array_compact(array({', '.join(change(p) for p in prop_cols)}))")


def message_number(df: DataFrame, server_col: str, order_cols: Sequence[str], min_hot_rows: int | None = None) -> DataFrame:
    """Add ``message_no``: dense from 1 per server."""
    return row_numbers(df, [server_col], order_cols, "message_no", min_hot_rows)


def sequence_gaps(log: DataFrame, server_col: str, no_col: str, stream_cols: Sequence[str] | None = None,
                  order_cols: Sequence[str] | None = None, min_hot_rows: int | None = None) -> DataFrame:
    """Rows that do not continue the row before: another server, or not the next number.

    A stream is what one client receives, in ``order_cols``; without ``stream_cols`` each
    server's numbers are checked on their own. The first row of a stream starts its sequence.
    """
    keys = list(stream_cols) if stream_cols else [server_col]
    order = list(order_cols) if order_cols else [no_col]
    cols = dict.fromkeys([*keys, *order, server_col, no_col])
    seen = previous_row(log.select(*cols), keys, order, [server_col, no_col], "prev", min_hot_rows)
    return flag_gaps(seen, server_col, no_col)


def flag_gaps(seen: DataFrame, server_col: str, no_col: str) -> DataFrame:
    """The rows of ``seen`` that do not follow their ``prev`` struct, with both sides and the reason."""
    other = F.col(f"prev.{server_col}") != F.col(server_col)
    gap = F.when(other, "server changed").when(F.col(no_col) != F.col(f"prev.{no_col}") + 1, "out of sequence")
    return seen.withColumns({
        "prev_server": F.col(f"prev.{server_col}"), "prev_no": F.col(f"prev.{no_col}"), "gap": gap,
    }).where(F.col("prev").isNotNull() & F.col("gap").isNotNull()).drop("prev")


def latest_state(log: DataFrame, key: str, order_cols: Sequence[str], min_hot_rows: int | None = None) -> DataFrame:
    """Current state per entity from a log of ``kind, val`` and, where there is one, ``error``.

    ``present`` follows the last add or remove. An entity is known from the add that made it present, the
    first one after its last remove; each property has its last value from then on, and what came
    before is ignored, as is everything about an absent entity. An image change request raises
    ``image_change_in_progress``; only an attempt without error lowers it and sets ``image``.
    Entities never added or removed, and kinds not named here, leave no trace.
    """
    return shown(folded_rows(log, key, order_cols, min_hot_rows).where("presence is not null"), key)


def folded_rows(log: DataFrame, key: str, order_cols: Sequence[str], min_hot_rows: int | None = None) -> DataFrame:
    """Per entity: ``presence``, ``gone``, ``since`` and, per property, the last value; ``at`` is a row's order.

    ``since`` is the last add that follows no add: the first one after the last remove.
    """
    order = F.struct(*order_cols)
    kind = F.col("kind")
    failed = F.col("error").isNotNull() if "error" in log.columns else F.lit(False)
    marks = log.where(kind.isin(ADDED_KINDS + REMOVED_KINDS)).select(key, *order_cols, kind.isin(ADDED_KINDS).alias("added"))
    starts = previous_row(marks, [key], order_cols, ["added"], "prev", min_hot_rows).select(
        key, *order_cols, "added", (F.col("added") & ~F.coalesce("prev.added", F.lit(False))).alias("starts"))
    said = log.where(kind.isin(IMAGE_ATTEMPT, IMAGE_REQUEST, *PROPERTY_KINDS.values())).select(key, *order_cols, "kind", "val", failed.alias("failed"))
    done = (kind == IMAGE_ATTEMPT) & ~F.col("failed")

    def latest(test: Column, value: Column) -> Column:
        return F.max(F.when(test, F.struct(order.alias("at"), value.alias("value"))))

    return said.unionByName(starts, allowMissingColumns=True).groupBy(key).agg(
        latest(F.col("added").isNotNull(), F.col("added")).alias("presence"),
        F.max(F.when(~F.col("added"), order)).alias("gone"),
        F.max(F.when(F.col("starts"), order)).alias("since"),
        latest(done, F.col("val")).alias("image"),
        latest(done | (kind == IMAGE_REQUEST), kind == IMAGE_REQUEST).alias("changing"),
        *[latest(kind == name, F.col("val")).alias(prop) for prop, name in PROPERTY_KINDS.items()])


def merged_folds(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``folded_rows`` of one log and of what comes after it, as those of both."""
    a, b = (df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name)) for df, name in ((old, "old"), (new, "new")))
    both = a.join(b, key, "full_outer")
    later = lambda c: F.coalesce(f"new.{c}", f"old.{c}")
    kept = F.col("new.presence").isNull() | (F.coalesce(F.col("old.presence.value"), F.lit(False)) & F.col("new.gone").isNull())
    since = F.when(kept, F.col("old.since")).otherwise(F.col("new.since"))
    return both.select(key, later("presence").alias("presence"), later("gone").alias("gone"), since.alias("since"),
                       *[later(c).alias(c) for c in FOLDED_PROPS])


def reloaded(servers: DataFrame, snapshots: DataFrame, log: DataFrame, key: str, order_cols: Sequence[str], server_col: str, no_col: str,
             min_hot_rows: int | None = None) -> DataFrame:
    """``folded_rows`` of all entities of ``servers`` after the message of number ``upto`` of each.

    ``snapshots`` holds versions: ``folded_rows`` of a server's entities after its message of number ``as_of``. Of each server the newest one
    that is not too new counts, and what ``log``, the server's own, has from there on is replayed. Without one the whole log is.
    """
    versions = snapshots.groupBy(server_col).agg(F.collect_set("as_of").alias("versions"))
    wanted = servers.join(versions, server_col, "left").select(
        server_col, "upto", F.coalesce(F.array_max(F.filter("versions", lambda v: v <= F.col("upto"))), F.lit(0)).alias("from"))
    base = snapshots.join(wanted, server_col).where(F.col("as_of") == F.col("from")).select(key, "presence", "gone", "since", *FOLDED_PROPS)
    # one row a server: a side that Spark measures and, small as it is, sends to the log
    newer = log.join(wanted, server_col).where((F.col(no_col) > F.col("from")) & (F.col(no_col) <= F.col("upto")))
    said = newer.select(key, *order_cols, "kind", "val", *(["error"] if "error" in log.columns else []))
    return merged_folds(base, folded_rows(said, key, order_cols, min_hot_rows), key)


def shown(folded: DataFrame, key: str, *others: str) -> DataFrame:
    """The state that ``folded_rows`` come to, with further columns."""
    def alive(prop: str) -> Column:
        return F.when(F.col("presence.value") & (F.col(f"{prop}.at") > F.col("since")), F.col(f"{prop}.value"))

    return folded.select(
        key, F.col("presence.value").alias("present"),
        *[alive(prop).alias(prop) for prop in PROPERTY_KINDS],
        alive("image").alias("image"),
        F.coalesce(alive("changing"), F.lit(False)).alias("image_change_in_progress"), *others)


def collect_first(log: DataFrame, key: str, predicate: Column, value: Column, order_cols: Sequence[str]) -> DataFrame:
    """``key, value, order columns`` of the first row per key for which the predicate holds."""
    order = F.struct(*order_cols)
    first = log.where(predicate).groupBy(key).agg(
        F.min_by(F.struct(value.alias("value"), *order_cols), order).alias("first"))
    return first.select(key, "first.*")


def validate_transitions(history: DataFrame, key: str, state_cols: Sequence[str], allowed: DataFrame,
                         order_cols: Sequence[str], min_hot_rows: int | None = None) -> DataFrame:
    """Rows whose state pair changed in a way ``allowed`` does not list, with the pair before.

    ``allowed`` has ``from_state, from_container, to_state, to_container``.
    """
    state, container = state_cols
    rows = history.select(key, *order_cols, state, container)
    seen = previous_row(rows, [key], order_cols, state_cols, "prev", min_hot_rows)
    moved = seen.where(
        F.col("prev").isNotNull()
        & ~(F.col(f"prev.{state}").eqNullSafe(F.col(state)) & F.col(f"prev.{container}").eqNullSafe(F.col(container))))
    pairs = moved.select(
        key, *order_cols, F.col(f"prev.{state}").alias("from_state"), F.col(f"prev.{container}").alias("from_container"),
        F.col(state).alias("to_state"), F.col(container).alias("to_container"))
    return pairs.join(allowed, ["from_state", "from_container", "to_state", "to_container"], "left_anti").select(
        key, *order_cols, "from_state", "from_container", "to_state", "to_container")
