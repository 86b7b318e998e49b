"""A log topic as a table (part, off, k, v, ts, ...), and block-wise materialized views of streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import ranking
from quillon.sources.shared import shared_dir


def offsets(df: DataFrame, part: str, order: str) -> DataFrame:
    """Give rows their offsets within their partition, from 0. A partition of any size is numbered by ranges, and the numbered topic is stored once."""
    return ranking.numbered(df, [order], "off", [part])


def fetch(log: DataFrame, start: int, count: int) -> DataFrame:
    return log.where((F.col("off") >= start) & (F.col("off") < start + count))


def compact(log: DataFrame) -> DataFrame:
    """The last record of each key in its partition; keys whose last is a tombstone (null value) go."""
    rest = [c for c in log.columns if c not in ("part", "k")]
    last = log.groupBy("part", "k").agg(F.max_by(F.struct(*rest), "off").alias("r")).select("part", "k", "r.*")
    return last.where("v is not null")


def retain(log: DataFrame, keep: str) -> DataFrame:
    newest = log.agg(F.max("ts").alias("_last"))
    return log.crossJoin(F.broadcast(newest)).where(F.col("ts") >= F.col("_last") - F.expr(f"INTERVAL {keep}")).drop("_last")


def read_committed(log: DataFrame, open_: DataFrame, aborted: Column) -> DataFrame:
    """Records below the first one of an open transaction (the last stable offset) that were not aborted."""
    lso = open_.groupBy("part").agg(F.min("off").alias("_lso"))
    joined = log.join(lso, "part", "left")  # broadcast by its measured size, if at all
    return joined.where(~aborted & (F.col("_lso").isNull() | (F.col("off") < F.col("_lso")))).drop("_lso")


def blocks(df: DataFrame, n: int) -> str:
    """Write a table as n files, the blocks of a stream."""
    at = shared_dir(df.sparkSession)
    df.repartition(n).write.parquet(at)
    return at


def materialize(source: DataFrame, view: Callable[[DataFrame], DataFrame], at: str) -> None:
    """Run a view over each new block alone and append its rows. A batch that is tried again overwrites its own folder."""

    def block(df: DataFrame, batch: int) -> None:
        view(df).write.mode("overwrite").parquet(f"{at}/rows/batch={batch}")

    stream = source.writeStream.foreachBatch(block).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()


def drained(updates: DataFrame, keys: list[str]) -> DataFrame:
    """What a stateful stream has said last of each key when its input ends. Each batch's updates are a folder of their own."""
    at = shared_dir(updates.sparkSession)

    def sink(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/rows/batch={batch}")

    stream = updates.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    said = updates.sparkSession.read.schema(f"{_schema(updates)}, batch long").parquet(f"{at}/rows")
    rest = [c for c in updates.columns if c not in keys]
    return said.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
