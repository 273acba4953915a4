"""Tags in long form: one row per (entity, key, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NAME_TAG, TAG_NAMES, is_system_tag, tag_number
from ..plans.hot_keys import join_unique

ENTITY = "cluster_id"


def tag_pivot(tag_rows: DataFrame, tag_prefix: str, strict: bool = False) -> DataFrame:
    """One typed row per entity; a missing tag is null.

    A malformed number leaves its column null and names the tag in ``error`` (or fails the job
    with ``strict``).
    """
    wanted = [tag_prefix + name for name in TAG_NAMES.values()]
    texts = tag_rows.where(F.col("tag_key").isin(wanted)).groupBy(ENTITY).agg(*[
        F.max(F.when(F.col("tag_key") == tag_prefix + name, F.col("tag_value"))).alias(alias)
        for alias, name in TAG_NAMES.items() if alias != ENTITY])
    numbers = {
        "ttl": tag_number(F.col("ttl"), "h"),
        "idle_timeout": tag_number(F.col("idle_timeout"), "m"),
        "bid_price": F.col("bid_price").try_cast("decimal(18,4)"),
    }
    error = F.lit(None).cast("string")
    for alias in reversed(numbers):
        broken = F.col(alias).isNotNull() & numbers[alias].isNull()
        error = F.when(broken, F.concat(F.lit(f"Malformed tag {tag_prefix}{TAG_NAMES[alias]}: "), F.col(alias))).otherwise(error)
    if strict:
        error = F.when(error.isNotNull(), F.raise_error(error).cast("string"))
    return texts.select(
        ENTITY, "name", "cluster_image", "image", "worker_type", "subnet_id", "placement_group", "role",
        numbers["ttl"].alias("ttl_hours"), numbers["idle_timeout"].alias("idle_minutes"),
        numbers["bid_price"].alias("bid_price"), "container_state", error.alias("error"))


def extra_tags(tag_rows: DataFrame, tag_prefix: str) -> DataFrame:
    return tag_rows.where(~is_system_tag(F.col("tag_key"), tag_prefix))


def validate_tags(tag_rows: DataFrame, tag_prefix: str) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejects)``: an entity with any system tag among its tags is rejected whole.

    Rejects are its offending rows, each with the message as ``reason``.
    """
    rejects = tag_rows.where(is_system_tag(F.col("tag_key"), tag_prefix)).withColumn(
        "reason", F.concat(F.lit("Invalid tag key: "), F.col("tag_key")))
    return join_unique(tag_rows, rejects.select(ENTITY).distinct(), ENTITY, "left_anti"), rejects


def merge_tags(base_rows: DataFrame, override_rows: DataFrame) -> DataFrame:
    """Union of the keys of both sides; the override's value wins."""
    side = lambda df, rank: df.select(ENTITY, "tag_key", F.struct(F.lit(rank).alias("rank"), "tag_value").alias("v"))
    both = side(base_rows, 0).unionByName(side(override_rows, 1))
    return both.groupBy(ENTITY, "tag_key").agg(F.max("v").alias("v")).select(ENTITY, "tag_key", "v.tag_value")


def _rows(clusters: DataFrame, pairs: list[tuple[str, Column]]) -> DataFrame:
    tags = F.array(*[F.struct(F.lit(k).alias("tag_key"), v.cast("string").alias("tag_value")) for k, v in pairs])
    rows = clusters.select(ENTITY, F.inline(tags))
    return rows.where(F.col("tag_value").isNotNull())


def build_tags(clusters: DataFrame, extra_rows: DataFrame, tag_prefix: str, role: str, label: str = "Spark") -> DataFrame:
    """Tag rows for launching a cluster's ``Master``, its ``Worker`` machines or a ``SpotRequest``.

    The four resource tags always come as they are. A master also gets the cluster's attributes,
    where present; extra tags win over those. Workers get the extra tags, spot requests none.
    """
    if role not in ("Master", "Worker", "SpotRequest"):
        raise ValueError(f"unknown role {role}")
    key = lambda alias: tag_prefix + TAG_NAMES[alias]
    shown = "Master" if role == "Master" else "Worker"
    resource = _rows(clusters, [
        (NAME_TAG, F.concat(F.lit(f"{label} {shown} : "), F.col("name"))),
        (key("cluster_id"), F.col(ENTITY)),
        (key("name"), F.col("name")),
        (key("role"), F.lit(shown)),
    ])
    extra = extra_rows.select(ENTITY, "tag_key", "tag_value").join(clusters.select(ENTITY), ENTITY, "left_semi")
    if role == "SpotRequest":
        return resource
    if role == "Worker":
        return resource.unionByName(extra)
    hours, minutes = F.floor(F.col("ttl_seconds") / 3600), F.floor(F.col("idle_seconds") / 60)
    attributes = _rows(clusters, [
        (key("cluster_image"), F.col("image")),
        (key("worker_type"), F.col("worker_type")),
        (key("subnet_id"), F.col("subnet_id")),
        (key("placement_group"), F.col("placement_group")),
        (key("ttl"), F.concat(hours.cast("string"), F.lit("h"))),
        (key("idle_timeout"), F.concat(minutes.cast("string"), F.lit("m"))),
        (key("bid_price"), F.col("bid_price")),
    ])
    return resource.unionByName(merge_tags(attributes, extra))
