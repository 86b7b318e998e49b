"""Relational operators that Spark has no word for, as compositions of DataFrame operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.sources.shared import stored

#: Rounds of a recursion after which what was found is written as one table, so that plans stay short.
COMPACT = 8

#: Bytes of files for each partition of spread(); a table of fewer than SPREAD_FROM is left to Spark.
SPREAD_BYTES = 2 << 20
SPREAD_FROM = 16 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out by a key to a number of partitions that grows with the files read.

    Spark's own number is fixed, and small partitions are put together up to an advised size, which sorts and
    hash tables of a whole row for each row exceed in memory many times.
    """
    size = int(df._jdf.queryExecution().analyzed().collectLeaves().apply(0).stats().sizeInBytes())
    if size < SPREAD_FROM:
        return df
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SPREAD_BYTES)), key)


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """DISTINCT ON: the first row of each key in the given order. Spark turns `= 1` into a group limit before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def with_ties(df: DataFrame, by: str, n: int) -> DataFrame:
    """FETCH FIRST n ROWS WITH TIES, in descending order, nulls last: the n-th value by a top-n, then all rows that reach it (all rows if that is a null)."""
    edge = df.select(by).orderBy(F.col(by).desc_nulls_last()).limit(n).agg(F.min(by).alias("_edge"), F.count(by).alias("_n"))
    return df.join(F.broadcast(edge), (F.col(by) >= F.col("_edge")) | (F.col("_n") < n)).drop("_edge", "_n")


def recursive_union(base: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = 100_000) -> DataFrame:
    """WITH RECURSIVE ... UNION: rounds on the new rows alone, until none is new. Each round is a stored table, put together every COMPACT rounds."""
    seen = stored(base.distinct())
    new = seen
    for i in range(1, rounds + 1):
        new = stored(step(new).distinct().exceptAll(seen))
        if new.isEmpty():
            return seen
        seen = seen.unionAll(new) if i % COMPACT else stored(seen.unionAll(new))
    raise RuntimeError(f"the recursion did not end in {rounds} rounds")


def parallel_lists(df: DataFrame, lists: dict[str, Column]) -> DataFrame:
    """Set-returning functions side by side: as many rows as the longest list, shorter ones padded with null."""
    named = [c.alias(n) for n, c in lists.items()]
    held = df.select("*", F.arrays_zip(*named).alias("_z"))
    return held.select(*df.columns, F.explode_outer("_z").alias("_e")).select(*df.columns, *(F.col("_e").getField(n).alias(n) for n in lists))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """INSERT ... ON CONFLICT DO UPDATE: rows of new replace those of old with the same key."""
    return old.join(new, keys, "left_anti").select(*old.columns).unionByName(new.toDF(*old.columns))
