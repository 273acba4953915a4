"""Splitting rows from rejects: errors are data, unless the caller asks for strictness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_rejects(df: DataFrame, reason: Column, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)``: rejects are the rows whose ``reason`` is not null, with that reason.

    With ``strict`` the first reject met while computing ``rows`` fails the job instead.
    """
    rejects = df.withColumn("reason", reason).where(F.col("reason").isNotNull())
    if strict:
        keep = F.when(reason.isNull(), F.lit(True)).otherwise(F.raise_error(reason).cast("boolean"))
        return df.where(keep), rejects
    return df.where(reason.isNull()), rejects
