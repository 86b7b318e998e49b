"""Tables in the cluster's shared folder, to cut a lineage so that any executor may be lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; a local one stands in only where that is not set."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root:
        root = getattr(context, "_quillon_dir", None)
        if root is None:
            root = context._quillon_dir = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return f"{root.rstrip('/')}/quillon-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    at = shared_dir(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
