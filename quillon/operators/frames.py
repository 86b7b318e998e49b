"""Window frames that Spark cannot parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def groups_frame(df: DataFrame, keys: list[str], order: Column, start: int, end: int, out: dict[str, Column]) -> DataFrame:
    """GROUPS BETWEEN start AND end: peers are numbered by dense_rank, and a RANGE over that number is the frame."""
    numbered = df.withColumn("_g", F.dense_rank().over(Window.partitionBy(*keys).orderBy(order)))
    w = Window.partitionBy(*keys).orderBy("_g").rangeBetween(start, end)
    return numbered.select("*", *(c.over(w).alias(n) for n, c in out.items())).drop("_g")
