"""Set operations by id. One shuffle each, with the copies of an id collapsed before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def _ranked_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """``key, row``: the row of ``first`` where it has the key, else that of ``second``."""
    cols = [c for c in first.columns if c != key]
    side = lambda df, rank: df.select(key, F.struct(F.lit(rank).alias("__rank"), *cols).alias("__row"))
    both = side(first, 1).unionByName(side(second, 0))
    return both.groupBy(key).agg(F.max("__row").alias("__row")).select(key, *[F.col("__row")[c].alias(c) for c in cols])


def union_keep_left(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Union by id; the row of ``a`` wins."""
    return _ranked_union(a, b, key).select(*a.columns)


def upsert(a: DataFrame, b: DataFrame, key: str, partial: bool = False) -> DataFrame:
    """Union by id; the row of ``b`` wins, or only its non-null columns with ``partial``."""
    if not partial:
        return _ranked_union(b.select(*a.columns), a, key).select(*a.columns)
    cols = [c for c in a.columns if c != key]
    side = lambda df, tag: df.select(key, F.lit(tag).alias("__new"), *[
        F.col(c) if c in df.columns else F.lit(None).cast(a.schema[c].dataType).alias(c) for c in cols])
    both = side(a, False).unionByName(side(b, True))
    pick = lambda c: F.coalesce(F.max(F.when(F.col("__new"), F.col(c))), F.max(F.when(~F.col("__new"), F.col(c))))
    return both.groupBy(key).agg(*[pick(c).alias(c) for c in cols]).select(*a.columns)


def remove_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def distinct_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def dedupe_last(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """The last row of each key."""
    return _pick(df, key, F.max_by(F.struct(*df.columns), F.struct(*order_cols)))


def find_first(df: DataFrame, key: str, order_cols: list[str], predicate: Column | None = None) -> DataFrame:
    """The first row of each key, among those the predicate holds for."""
    rows = df if predicate is None else df.where(predicate)
    return _pick(rows, key, F.min_by(F.struct(*df.columns), F.struct(*order_cols)))


def _pick(df: DataFrame, key: str, row: Column) -> DataFrame:
    return df.groupBy(key).agg(row.alias("__row")).select("__row.*")
