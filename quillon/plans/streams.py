"""Log topics (offsets, retention, compaction, isolation) and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.plans.registry import query, sql, table
from quillon.sources.shared import shared_dir
from quillon.streaming import topics

# a topic over events: partition = user_id % 4, offset within it by event_id, key = user_id, a value of under 3 is a tombstone
_LOG = "(SELECT user_id % 4 AS part, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS off, user_id AS k, CASE WHEN value < 3 THEN NULL ELSE value END AS v, ts, event_id % 10 AS txn FROM events)"


def log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return topics.offsets(e.select((F.col("user_id") % 4).alias("part"), "event_id", F.col("user_id").alias("k"), F.when(F.col("value") >= 3, F.col("value")).alias("v"), "ts", (F.col("event_id") % 10).alias("txn")), "part", "event_id")


sql("log_high_watermark", "SELECT user_id % 4 AS part, count(*) AS hw, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")


@query("log_fetch", f"SELECT part, cast(off as bigint) AS off, k FROM {_LOG} WHERE off >= 100 AND off < 150")
def fetch(spark, sf_dir):
    return topics.fetch(log(spark, sf_dir), 100, 50).select("part", "off", "k")


@query("log_compaction", f"SELECT part, cast(max(off) as bigint) AS off, k, arg_max(CASE WHEN v IS NULL THEN -1 ELSE v END, off) AS v FROM {_LOG} GROUP BY part, k HAVING arg_max(CASE WHEN v IS NULL THEN -1 ELSE v END, off) >= 0")
def compaction(spark, sf_dir):
    return topics.compact(log(spark, sf_dir)).select("part", "off", "k", "v")


@query("log_retention", f"SELECT part, cast(off as bigint) AS off FROM {_LOG} WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def retention(spark, sf_dir):
    return topics.retain(log(spark, sf_dir), "3 days").select("part", "off")


@query("log_read_committed", f"WITH l AS {_LOG}, lso AS (SELECT part, min(off) AS lso FROM l WHERE txn = 7 AND off > 500 GROUP BY part) SELECT l.part, cast(off as bigint) AS off FROM l LEFT JOIN lso USING (part) WHERE txn <> 3 AND off < coalesce(lso, 1000000000)")
def committed(spark, sf_dir):
    """Transaction 3 is aborted, 7 is open from offset 500 on."""
    l = log(spark, sf_dir)
    return topics.read_committed(l, l.where("txn = 7 and off > 500"), F.col("txn") == 3).select("part", "off")


@query("log_consumer_lag", f"SELECT part, count(*) - 200 AS lag FROM {_LOG} GROUP BY part")
def lag(spark, sf_dir):
    """The next offset of a partition is its number of records, so nothing is numbered."""
    ends = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 4).alias("part")).agg(F.count("*").alias("n"))
    return ends.select("part", (F.col("n") - 200).alias("lag"))


@query("matview_incremental", "SELECT event_type, count(*) AS n, cast(sum(cast(value as decimal(18,6))) as double) AS total FROM events GROUP BY event_type")
def matview(spark, sf_dir):
    """A materialized view fed block by block from a stream of files, then merged on read."""
    at = shared_dir(spark)
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(topics.blocks(table(spark, sf_dir, "events"), 3))
    topics.materialize(source, lambda block: block.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).alias("total")), at)
    return spark.read.parquet(f"{at}/rows").groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"))


@query("stream_windowed_counts", "SELECT time_bucket(INTERVAL 6 HOUR, ts, timestamp '2024-01-01') AS w, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed(spark, sf_dir):
    """Event-time windows of a stream of files, counted with state under a watermark; each batch replaces the sink's table."""
    e = table(spark, sf_dir, "events")
    at = topics.blocks(e, 3)
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).option("pathGlobFilter", "*.parquet").parquet(at)
    timed = source.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "60 days")  # files are not in the order of time
    counts = timed.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return topics.drained(counts.select(F.col("w.start").cast("timestamp_ntz").alias("w"), "event_type", "n"), ["w", "event_type"])
