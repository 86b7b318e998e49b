"""Merge-on-read tables: what FINAL shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replacing(df: DataFrame, keys: list[str], version: str, arrival: str, deleted: str | None = None) -> DataFrame:
    """The row of the highest version of each key (the last to arrive among equals), unless it marks a deletion.

    max_by combines before the shuffle, so a hot key costs one row a task.
    """
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, arrival)).alias("_r"))
    out = last.select(*keys, *(F.col("_r").getField(c).alias(c) for c in rest)).select(*df.columns)
    return out.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else out


def summing(df: DataFrame, keys: list[str], sums: list[str], firsts: list[str], arrival: str) -> DataFrame:
    """One row for each key: sums of the numeric columns, the first to arrive of the others."""
    return df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), *(F.min_by(c, arrival).alias(c) for c in firsts))
