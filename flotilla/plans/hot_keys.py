"""Ordered per-key computations that survive a key holding a large share of the rows.

A window partitioned by a key puts each key into one task. Here a key that holds more than
``HOT_SHARE`` of all rows is cut into consecutive ranges of its order columns, the window runs
per (key, range), and what crosses a range border is carried over by a small per-range aggregate.
All other keys keep one range.

Ranges are of equal width in the first order column that is not constant. Where that leaves one with
too many rows (a burst), it is cut once more within its own bounds, by the first column that is not
constant there. So a range holds at most a few times the limit if two cuts in numbers or times can tell its rows
apart; rows alike in those columns, nulls in them among others, stay together in one task.

Results don't depend on what is hot: the window's order is the order columns and then the values, and no row is dropped.

The broadcast tables are bounded by construction: at most ``1 / HOT_SHARE`` keys, or ranges of the
first cut, can each hold more than ``HOT_SHARE`` of the rows, and together they are cut into at
most ``2 * OVERSPLIT / HOT_SHARE`` ranges, whatever the data size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_SHARE = 1 / 20_000
MIN_HOT_ROWS = 1_000_000
OVERSPLIT = 4

_RANGES = ["__range1", "__range2"]


def _position(col: str, kind: T.DataType) -> str | None:
    """SQL for the column as a bigint that sorts the same way, None for types that have none."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return f"unix_micros(cast(`{col}` as timestamp))"
    if isinstance(kind, T.IntegralType):
        return f"cast(`{col}` as bigint)"
    return None


def _positions(df: DataFrame, order_cols: Sequence[str]) -> list[str]:
    """Positions of the leading order columns, up to the first that has none."""
    schema = df.schema
    out = [_position(col, schema[col].dataType) for col in order_cols]
    count = next((i for i, pos in enumerate(out) if pos is None), len(out))
    if count == 0:
        raise TypeError(f"order column {order_cols[0]} must be a timestamp, date or integer")
    return out[:count]


def _spans(df: DataFrame, keys: Sequence[str], positions: list[str]) -> DataFrame:
    """Per group: its rows and the span of each order column."""
    spans = ", ".join(f"struct(min({p}) as lo, max({p}) as hi)" for p in positions)
    return df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(
        F.count("*").alias("__rows"), F.expr(f"array({spans})").alias("__spans"))


def _hot(groups: DataFrame, keys: int, limit: Column) -> DataFrame:
    """Per group of more than ``limit`` rows: how many ranges to cut, and of which column's span.

    That is the first order column that is not constant in the group.
    """
    return groups.where(F.col("__rows") > limit).select(
        *[f"__k{i}" for i in range(keys)], "__spans",
        F.expr("cast(greatest(array_position(transform(__spans, s -> s.lo < s.hi), true), 1) as int)").alias("__by"),
        (F.ceil(F.col("__rows") / limit) * OVERSPLIT).cast("double").alias("__n"))


def _on(keys: Sequence[str], prefix: str) -> Column:
    return F.expr(" and ".join(f"`{k}` <=> {prefix}{i}" for i, k in enumerate(keys)))


def _cut(df: DataFrame, keys: Sequence[str], positions: list[str], spans: DataFrame, name: str, how: str) -> DataFrame:
    """Add the range number of each row; 0 for a group that is not cut (``how`` left) or no row (inner)."""
    at, lo, hi = f"element_at(array({', '.join(positions)}), __by)", "element_at(__spans, __by).lo", "element_at(__spans, __by).hi"
    exact = f"cast({at} - {lo} as double) / (cast({hi} - {lo} as double) + 1)"
    halves = f"cast({at} div 2 - {lo} div 2 as double) / (cast({hi} div 2 - {lo} div 2 as double) + 1)"
    share = f"if(try_subtract({hi}, {lo}) is null, {halves}, {exact})"  # halves for a span beyond a bigint
    number = F.expr(f"coalesce(floor({share} * __n), 0)").cast("bigint")
    return df.join(F.broadcast(spans), _on(keys, "__k"), how).withColumn(name, number).drop(
        "__spans", "__by", "__n", *[f"__k{i}" for i in range(len(keys))])


def hot_limit(df: DataFrame, rows: Column, min_rows: int | None) -> Column:
    """Rows above which a key is hot, where ``rows`` aggregates ``df`` to the number of all rows."""
    least = F.lit(float(MIN_HOT_ROWS if min_rows is None else min_rows))
    return df.agg(F.greatest(rows * F.lit(HOT_SHARE), least).alias("limit")).scalar()


def split_join(rows: DataFrame, unique: DataFrame, key: str, how: str, hot: DataFrame) -> DataFrame:
    """``rows`` joined to ``unique``, which has one row per key, with the ``hot`` keys of ``rows`` apart.

    Hot keys' rows stay where they are and get their side of ``unique`` by broadcast; the others
    are shuffled. (Spark splits a skewed join by itself only when both sides are plain exchanges,
    not when one comes out of an aggregate.)
    """
    few = F.broadcast(hot)
    warm = rows.join(few, key, "left_semi").join(F.broadcast(unique.join(few, key, "left_semi")), key, how)
    return warm.unionByName(rows.join(few, key, "left_anti").join(unique, key, how))


def join_unique(rows: DataFrame, unique: DataFrame, key: str, how: str, min_rows: int | None = None) -> DataFrame:
    """Join of ``rows``, where a key may be hot, to ``unique``, which has one row per key."""
    counts = rows.groupBy(key).agg(F.count("*").alias("__rows"))
    hot = counts.where(F.col("__rows") > hot_limit(counts, F.sum("__rows"), min_rows)).select(key)
    return split_join(rows, unique, key, how, hot)


class RangeCut:
    """``df`` cut into ordered ranges; ``rows`` is all of it, ``hot`` the hot keys' rows.

    The input is read once for the counts and spans of all keys, once for the bursts of hot keys, and once for ``rows``;
    what is carried over is summed from the exchanged ``rows``.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], min_rows: int | None,
                 value_cols: Sequence[str] = ()):
        self.keys, self.order_cols = list(keys), list(dict.fromkeys([*order_cols, *value_cols]))
        self.groups = [*self.keys, *_RANGES]
        positions = _positions(df, order_cols)
        counts = _spans(df, self.keys, positions)
        limit = hot_limit(counts, F.sum("__rows"), min_rows)
        first = _hot(counts, len(self.keys), limit)
        hot = _cut(df, self.keys, positions, first, _RANGES[0], "inner")
        second = _hot(_spans(hot, [*self.keys, _RANGES[0]], positions), len(self.keys) + 1, limit)
        rows = _cut(_cut(df, self.keys, positions, first, _RANGES[0], "left"), [*self.keys, _RANGES[0]], positions, second, _RANGES[1], "left")
        # An explicit exchange by key and range: were the rows already clustered by key, Spark would
        # take that as good enough for the window and leave a hot key in one task.
        self.rows = rows.repartition(*self.groups)
        hot_keys = first.select(*[f"__k{i}" for i in range(len(self.keys))])
        self.hot = self.rows.join(F.broadcast(hot_keys), _on(self.keys, "__k"), "left_semi")

    def window(self):
        return Window.partitionBy(*self.groups).orderBy(*self.order_cols)

    def carried(self, partial: Column, carry) -> DataFrame:
        """Per range of each hot key: ``__carry`` computed from ``partial`` of the ranges before it."""
        per_range = self.hot.groupBy(*self.groups).agg(partial.alias("__partial"))
        over = Window.partitionBy(*self.keys).orderBy(*_RANGES)
        return per_range.select(
            *[F.col(c).alias(f"__g{i}") for i, c in enumerate(self.groups)],
            carry(F.col("__partial"), over).alias("__carry"))

    def attach(self, rows: DataFrame, carried: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(carried), _on(self.groups, "__g"), "left").drop(
            *_RANGES, *[f"__g{i}" for i in range(len(self.groups))])


def previous_row(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], value_cols: Sequence[str],
                 name: str, min_rows: int | None = None) -> DataFrame:
    """Add ``name``: a struct of the previous row's ``value_cols`` in key order, null on the first row.

    Rows alike in all order columns come in the order of their values.
    """
    cut = RangeCut(df, keys, order_cols, min_rows, value_cols)
    values = F.struct(*value_cols)
    rows = cut.rows.withColumn(name, F.lag(values).over(cut.window()))
    carried = cut.carried(F.max_by(values, F.struct(*cut.order_cols)), lambda p, w: F.lag(p).over(w))
    out = cut.attach(rows, carried)
    return out.withColumn(name, F.coalesce(name, "__carry")).drop("__carry")


def last_known(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], value_col: str,
               name: str, min_rows: int | None = None) -> DataFrame:
    """Add ``name``: the last non-null ``value_col`` at or before each row in key order."""
    cut = RangeCut(df, keys, order_cols, min_rows)
    rows = cut.rows.withColumn(name, F.last(value_col, ignorenulls=True).over(
        cut.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = F.max_by(value_col, F.when(F.col(value_col).isNotNull(), F.struct(*order_cols)))
    carried = cut.carried(last, lambda p, w: F.last(p, ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, -1)))
    out = cut.attach(rows, carried)
    return out.withColumn(name, F.coalesce(name, "__carry")).drop("__carry")


def row_numbers(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
                name: str, min_rows: int | None = None) -> DataFrame:
    """Add ``name``: a dense 1-based number per key in order."""
    cut = RangeCut(df, keys, order_cols, min_rows)
    rows = cut.rows.withColumn(name, F.row_number().over(cut.window()))
    carried = cut.carried(F.count("*"), lambda p, w: F.sum(p).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    out = cut.attach(rows, carried)
    return out.withColumn(name, F.col(name).cast("bigint") + F.coalesce("__carry", F.lit(0))).drop("__carry")
