"""Prices, default choices and image ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import build_number
from ..plans.hot_keys import last_known

PRICE = "decimal(18,4)"


def bid_price(requests: DataFrame, specs: DataFrame, ratio_col: str) -> DataFrame:
    """Add ``hourly_price`` and ``bid_price`` to the requests for spot-eligible types; others are left out."""
    eligible = specs.where("is_spot_eligible").select("instance_type", "hourly_price")
    bid = (F.col(ratio_col) * F.col("hourly_price")).cast("decimal(38,6)")
    return requests.join(eligible, "instance_type").withColumn("bid_price", bid)


def price_asof(probes: DataFrame, prices: DataFrame, key_cols: Sequence[str], ts_col: str, default: float = 0,
               min_hot_rows: int | None = None) -> DataFrame:
    """Probes with the ``price`` in effect at their time: the last at or before it, else ``default``.

    Both sides go into one ordering per key and the last price is carried forward, so the work
    is linear in the rows of a key. Of several prices at one moment the highest counts.
    """
    extra = [c for c in probes.columns if c not in (*key_cols, ts_col)]
    kind = prices.schema["price"].dataType
    nothing = lambda c: F.lit(None).cast(probes.schema[c].dataType).alias(c)
    quotes = prices.select(
        *key_cols, ts_col, F.lit(0).alias("__side"), F.col("price").alias("__price"), *[nothing(c) for c in extra])
    asked = probes.select(*key_cols, ts_col, F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__price"), *extra)
    filled = last_known(
        quotes.unionByName(asked), key_cols, [ts_col, "__side", "__price"], "__price", "price", min_hot_rows)
    return filled.where("__side = 1").select(
        *probes.columns, F.coalesce("price", F.lit(default)).cast(kind).alias("price"))


def current_price(prices: DataFrame, key_cols: Sequence[str], default: float = 0, keys: DataFrame | None = None) -> DataFrame:
    """``key columns, price``: the earliest row of each key; ``default`` for a key of ``keys`` without any."""
    first = prices.groupBy(*key_cols).agg(F.min(F.struct("ts", "price")).alias("first")).select(
        *key_cols, F.col("first.price").alias("price"))
    if keys is None:
        return first
    kind = prices.schema["price"].dataType
    return keys.select(*key_cols).distinct().join(first, list(key_cols), "left").withColumn(
        "price", F.coalesce("price", F.lit(default)).cast(kind))


def rank_images(images: DataFrame, tag_col: str, limit: int | None = None) -> DataFrame:
    """Images by build number, highest first; tags without a number come last."""
    rest = [c for c in images.columns if c != tag_col]
    out = images.withColumn("build", build_number(F.col(tag_col))).orderBy(F.desc_nulls_last("build"), tag_col, *rest)
    return out if limit is None else out.limit(limit)


def default_choice(specs: DataFrame, order_cols: Sequence[str], subnets: DataFrame | None = None,
                   subnet_order: Sequence[str] = ()) -> DataFrame:
    """One row: the first type for the master, the first spot-eligible one for workers, the first subnet."""
    first = lambda test: F.min_by("instance_type", F.when(test, F.struct(*order_cols)))
    choice = specs.agg(
        first(F.lit(True)).alias("master_type"), first(F.col("is_spot_eligible")).alias("worker_type"))
    if subnets is None:
        return choice
    subnet = subnets.agg(F.min_by("subnet_id", F.struct(*subnet_order)).alias("subnet_id"))
    return choice.withColumn("subnet_id", subnet.scalar())
