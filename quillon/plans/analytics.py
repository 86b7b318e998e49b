"""Time series, JSON, merge tables, document pipelines, conversations and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import merge, pipeline
from quillon.plans.registry import query, sql, table

sql("date_trunc_counts", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
sql("date_parts", """
    SELECT o_orderkey, cast(extract(year FROM o_orderdate) as bigint) AS y, cast(extract(quarter FROM o_orderdate) as bigint) AS q, cast(extract(month FROM o_orderdate) as bigint) AS m,
           cast(extract(day FROM o_orderdate) as bigint) AS d, cast(dayofweek(o_orderdate) - 1 as bigint) AS dow, cast(dayofyear(o_orderdate) as bigint) AS doy FROM orders""",
    """SELECT o_orderkey, extract(year FROM o_orderdate) AS y, extract(quarter FROM o_orderdate) AS q, extract(month FROM o_orderdate) AS m,
           extract(day FROM o_orderdate) AS d, extract(dow FROM o_orderdate) AS dow, extract(doy FROM o_orderdate) AS doy FROM orders""")
sql("interval_arithmetic", """
    SELECT o_orderkey, o_orderdate + INTERVAL '1' MONTH AS m1, o_orderdate - INTERVAL '10' DAY AS d10, cast(datediff(timestamp '2002-01-01', o_orderdate) as bigint) AS days FROM orders""",
    "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS m1, o_orderdate - INTERVAL 10 DAY AS d10, date_diff('day', o_orderdate, timestamp '2002-01-01') AS days FROM orders")
sql("date_bin", """
    SELECT timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, 900 * cast(floor(cast(unix_micros(cast(ts as timestamp)) - unix_micros(timestamp '2024-01-01 00:00:00+00:00') as double) / 900e6) as decimal(18,6))) AS b,
           count(*) AS n FROM events GROUP BY 1""", "SELECT time_bucket(INTERVAL 15 MINUTE, ts, timestamp '2024-01-01') AS b, count(*) AS n FROM events GROUP BY 1")
sql("gap_fill_hours", """
    WITH b AS (SELECT min(date_trunc('hour', ts)) AS a, max(date_trunc('hour', ts)) AS z FROM events),
         h AS (SELECT explode(sequence(a, z, INTERVAL '1' HOUR)) AS hour FROM b),
         n AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1)
    SELECT h.hour, coalesce(n.n, 0) AS n FROM h LEFT JOIN n ON h.hour = n.hour""",
    """WITH b AS (SELECT min(date_trunc('hour', ts)) AS a, max(date_trunc('hour', ts)) AS z FROM events),
         h AS (SELECT unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS hour FROM b),
         n AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1)
    SELECT h.hour, coalesce(n.n, 0) AS n FROM h LEFT JOIN n ON h.hour = n.hour""")
sql("sessions_by_gap", """
    WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
         s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM e)
    SELECT user_id, cast(sid as bigint) AS sid, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n FROM s GROUP BY user_id, sid""")
sql("overlaps_periods", """
    SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
    AND a.o_orderdate < b.o_orderdate + INTERVAL '5' DAY AND b.o_orderdate < a.o_orderdate + INTERVAL '5' DAY""")
sql("json_extract", "SELECT event_type, count(*) AS n, cast(sum(cast(get_json_object(props, '$.k') as bigint)) as bigint) AS k FROM events GROUP BY event_type",
    "SELECT event_type, count(*) AS n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) AS k FROM events GROUP BY event_type")
sql("json_typed", "SELECT event_id, cast(from_json(props, 'k int').k as bigint) AS k, json_array_length('[1,2,3]') AS n FROM events WHERE from_json(props, 'k int').k > 50",
    "SELECT event_id, cast(json_extract(props, '$.k') as bigint) AS k, 3 AS n FROM events WHERE cast(json_extract(props, '$.k') as bigint) > 50")
sql("json_variant_path", "SELECT event_id, variant_get(parse_json(props), '$.k', 'int') % 7 AS m FROM events", "SELECT event_id, cast(json_extract(props, '$.k') as int) % 7 AS m FROM events")
sql("json_aggregate", "SELECT n_regionkey, to_json(map_from_entries(array_sort(collect_list(struct(n_name, n_nationkey))))) AS j FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS j FROM nation GROUP BY n_regionkey")
sql("turn_analytics", """
    SELECT role, count(*) AS n, count(DISTINCT conv_id) AS convs, count(*) FILTER (WHERE prev = role) AS repeats, cast(max(length(text)) as bigint) AS longest
    FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) x GROUP BY role""")
sql("conversation_ends", "SELECT conv_id, min_by(role, turn) AS first_role, max_by(role, turn) AS last_role, count(*) AS turns FROM conversations GROUP BY conv_id",
    "SELECT conv_id, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, count(*) AS turns FROM conversations GROUP BY conv_id")
sql("label_quality", "SELECT lang, quality, toxic, count(*) AS n, cast(sum(n_chars) as bigint) AS chars FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality, toxic")


@query("replacing_final", """
    SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND value >= 5""")
def replacing_final(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("gone", F.col("value") < 5)
    return merge.replacing(events, ["user_id", "event_type"], "ts", "event_id", "gone").select("user_id", "event_type", "event_id", "value")


@query("summing_final", """
    SELECT user_id, cast(sum(cast(value as decimal(18,6))) as double) AS value, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id""")
def summing_final(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.col("value").cast("decimal(18,6)").alias("value"))
    return merge.summing(events, ["user_id"], ["value"], ["event_type"], "event_id").withColumn("value", F.col("value").cast("double"))


@query("pipeline_match_group", """
    SELECT event_type AS _id, count(*) AS n, max(value) AS top, cast(sum(user_id) as double) AS users, cast(0 as double) AS words FROM events WHERE value >= 10 AND event_type <> 'view' GROUP BY event_type""")
def pipeline_match_group(spark, sf_dir):
    stages = [{"$match": {"value": {"$gte": 10}, "event_type": {"$ne": "view"}}}, {"$group": {"_id": "$event_type", "n": {"$count": {}}, "top": {"$max": "$value"}, "users": {"$sum": "$user_id"}, "words": {"$sum": "$props"}}}]
    return pipeline.run(table(spark, sf_dir, "events"), stages)


@query("pipeline_unwind_project", """
    SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM benchmark) WHERE w <> '' GROUP BY w ORDER BY n DESC, word LIMIT 25""")
def pipeline_unwind_project(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.split(F.lower("text"), " ").alias("words"))
    stages = [
        {"$unwind": "$words"}, {"$match": {"words": {"$ne": ""}}}, {"$group": {"_id": "$words", "n": {"$count": {}}}},
        {"$project": {"_id": 0, "word": "$_id", "n": 1}}, {"$sort": {"n": -1, "word": 1}}, {"$limit": 25},
    ]
    return pipeline.run(words, stages)


@query("pipeline_filters", """
    SELECT o_orderkey FROM orders WHERE (o_orderstatus IN ('F', 'P') OR o_totalprice > 350000) AND NOT (o_orderpriority = '1-URGENT') AND o_orderkey NOT IN (1, 2, 3)""")
def pipeline_filters(spark, sf_dir):
    match = {"$or": [{"o_orderstatus": {"$in": ["F", "P"]}}, {"o_totalprice": {"$gt": 350000}}], "o_orderpriority": {"$not": {"$eq": "1-URGENT"}}, "o_orderkey": {"$nin": [1, 2, 3]}}
    return pipeline.run(table(spark, sf_dir, "orders"), [{"$match": match}, {"$project": {"o_orderkey": 1}}])


@query("pipeline_unwind_index", """
    SELECT item_id, w AS words, i - 1 AS at FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM benchmark)""")
def pipeline_unwind_index(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", "text", F.split("text", " ").alias("words"))
    return pipeline.run(words, [{"$project": {"text": 0}}, {"$unwind": {"path": "$words", "includeArrayIndex": "at", "preserveNullAndEmptyArrays": True}}])


@query("pipeline_skip_count", "SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100)")
def pipeline_skip_count(spark, sf_dir):
    return pipeline.run(table(spark, sf_dir, "orders"), [{"$sort": {"o_orderkey": 1}}, {"$skip": 100}, {"$count": "n"}])
