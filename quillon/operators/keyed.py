"""Sorted sets as tables of (member, score)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import ranking

def zrank(zset: DataFrame) -> DataFrame:
    """Members with their place (from 0) by score, then member; equal scores are split by member, so no task sorts them all."""
    return ranking.numbered(zset, ["score", "member"], "zrank")


def _all(zsets: list[tuple[DataFrame, float]]) -> DataFrame:
    return reduce(DataFrame.unionByName, (z.select("member", (F.col("score") * w).alias("score"), F.lit(i).alias("_z")) for i, (z, w) in enumerate(zsets)))


def zunion(zsets: list[tuple[DataFrame, float]], combine: Callable[[str], Column]) -> DataFrame:
    return _all(zsets).groupBy("member").agg(combine("score").alias("score"))


def zinter(zsets: list[tuple[DataFrame, float]], combine: Callable[[str], Column]) -> DataFrame:
    found = _all(zsets).groupBy("member").agg(combine("score").alias("score"), F.count_distinct("_z").alias("_n"))
    return found.where(F.col("_n") == len(zsets)).drop("_n")
