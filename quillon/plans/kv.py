"""Set, sorted-set, sketch, geo and bitmap algebra over long tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import keyed, ranking
from quillon.plans.registry import query, sql, table

SCORES = "SELECT user_id AS member, sum(cast(value as decimal(18,6))) AS score FROM events WHERE event_type = '{}' GROUP BY user_id"


def scores(spark, sf_dir, kind):
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.groupBy(F.col("user_id").alias("member")).agg(F.sum(F.col("value").cast("decimal(18,6)")).alias("score"))


for name, op in (("sunion", "UNION"), ("sinter", "INTERSECT"), ("sdiff", "EXCEPT")):
    sql(f"kv_{name}", f"SELECT user_id AS member FROM events WHERE event_type = 'click' {op} SELECT user_id AS member FROM events WHERE event_type = 'purchase'")


@query("kv_zrank", f"SELECT member, cast(row_number() OVER (ORDER BY score, member) - 1 as bigint) AS zrank FROM ({SCORES.format('click')})")
def zrank(spark, sf_dir):
    return keyed.zrank(scores(spark, sf_dir, "click")).select("member", "zrank")


@query("kv_zunion_weighted", f"SELECT member, cast(sum(score) as double) AS score FROM (SELECT member, score * 2 AS score FROM ({SCORES.format('click')}) UNION ALL SELECT member, score * 3 AS score FROM ({SCORES.format('purchase')})) GROUP BY member")
def zunion(spark, sf_dir):
    out = keyed.zunion([(scores(spark, sf_dir, "click"), 2), (scores(spark, sf_dir, "purchase"), 3)], F.sum)
    return out.withColumn("score", F.col("score").cast("double"))


@query("kv_zinter_max", f"SELECT a.member, cast(greatest(a.score, b.score) as double) AS score FROM ({SCORES.format('click')}) a JOIN ({SCORES.format('view')}) b USING (member)")
def zinter(spark, sf_dir):
    out = keyed.zinter([(scores(spark, sf_dir, "click"), 1), (scores(spark, sf_dir, "view"), 1)], F.max)
    return out.withColumn("score", F.col("score").cast("double"))


@query("kv_zrange_by_score", f"SELECT member, cast(score as double) AS score FROM ({SCORES.format('view')}) WHERE score > 50 AND score <= 500 ORDER BY score, member LIMIT 30")
def zrange(spark, sf_dir):
    s = scores(spark, sf_dir, "view")
    return s.where("score > 50 AND score <= 500").orderBy("score", "member").limit(30).select("member", F.col("score").cast("double").alias("score"))


@query("kv_hll_count", "SELECT event_type, true AS near FROM events GROUP BY event_type")
def hll(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_sketch_agg("user_id", 14)).alias("est"), F.count_distinct("user_id").alias("n"))
    return e.select("event_type", (F.abs(F.col("est") - F.col("n")) <= 0.03 * F.col("n") + 1).alias("near"))


@query("kv_hll_merge", "SELECT true AS near")
def hll_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    parts = e.groupBy("event_type").agg(F.hll_sketch_agg("user_id", 14).alias("s"))
    merged = parts.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("est"))
    return merged.crossJoin(e.agg(F.count_distinct("user_id").alias("n"))).select((F.abs(F.col("est") - F.col("n")) <= 0.03 * F.col("n") + 1).alias("near"))


sql("kv_bitcount", "SELECT event_type, cast(sum(bit_count(user_id)) as bigint) AS bits, bit_or(user_id) AS any_bits FROM events GROUP BY event_type")


@query("kv_bitmap_count", "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def bitmap(spark, sf_dir):
    """Bitmaps in buckets: each bucket is a fixed 4 KB, merged by OR before the shuffle."""
    e = table(spark, sf_dir, "events")
    b = e.groupBy("event_type", F.bitmap_bucket_number("user_id").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("m"))
    return b.groupBy("event_type").agg(F.sum(F.bitmap_count("m")).alias("n"))


GEO = "(SELECT s_suppkey AS id, (s_suppkey * 37 % 360) - 180 + 0.5 AS lon, (s_suppkey * 17 % 170) - 85 + 0.25 AS lat FROM supplier)"
_DIST = "round(2 * 6372797.560856 * asin(sqrt(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2))), 2)"
sql("kv_geo_search", f"SELECT b.id, {_DIST.format(a='a', b='b')} AS dist FROM {GEO} a JOIN {GEO} b ON a.id = 1 AND b.id <> 1 WHERE {_DIST.format(a='a', b='b')} <= 4000000")
sql("kv_stream_range", "SELECT event_id, user_id FROM events WHERE ts >= timestamp '2024-01-05' AND ts < timestamp '2024-01-06'")
sql("kv_list_range", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn BETWEEN 2 AND 4")


@query("kv_sort_by_get", "SELECT s_suppkey, n_name, cast(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) as bigint) AS pos FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def sort_by_get(spark, sf_dir):
    ranked = ranking.numbered(table(spark, sf_dir, "supplier"), [F.desc("s_acctbal"), "s_suppkey"], "pos")
    named = ranked.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return named.select("s_suppkey", "n_name", (F.col("pos") + 1).alias("pos"))
