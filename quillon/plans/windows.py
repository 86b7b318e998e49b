"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators import frames
from quillon.plans.registry import query, sql, table

sql("win_rank_family", """
    SELECT s_suppkey, cast(row_number() OVER w AS bigint) AS rn, cast(rank() OVER w AS bigint) AS rk, cast(dense_rank() OVER w AS bigint) AS dr,
           round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd, cast(ntile(4) OVER w AS bigint) AS nt
    FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)""")
sql("win_lag_lead", """
    SELECT o_orderkey, lag(o_totalprice, 1) OVER w AS prev, lead(o_totalprice, 2, -1.0) OVER w AS nxt, first_value(o_orderkey) OVER w AS f
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
sql("win_last_nth", """
    SELECT o_orderkey, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n2 FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
sql("win_rows_frame", """
    SELECT o_orderkey, cast(sum(cast(o_totalprice as decimal(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) as double) AS s3,
           count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n3 FROM orders""")
sql("win_range_days", """
    SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '90' DAY PRECEDING AND CURRENT ROW) AS n90 FROM orders""")
sql("win_default_peers", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS upto, cast(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) as bigint) AS s FROM part")
sql("win_over_groups", """
    SELECT o_orderstatus, o_orderpriority, count(*) AS n, cast(rank() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC) AS bigint) AS rk FROM orders GROUP BY o_orderstatus, o_orderpriority""")
sql("win_share", "SELECT n_nationkey, c, round(c / sum(c) OVER (), 9) AS share FROM (SELECT c_nationkey AS n_nationkey, cast(count(*) as double) AS c FROM customer GROUP BY c_nationkey) x")


@query("win_groups_frame", """
    SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n,
           cast(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS bigint) AS s FROM part""")
def win_groups_frame(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return frames.groups_frame(part, ["p_brand"], F.col("p_size"), -1, 1, {"n": F.count("*"), "s": F.sum("p_size")}).select("p_partkey", "n", "s")


@query("win_distinct_agg", "SELECT o_orderkey, x.n FROM orders JOIN (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey) x USING (o_custkey)")
def win_distinct_agg(spark, sf_dir):
    w = Window.partitionBy("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(F.collect_set("o_orderpriority").over(w)).cast("long").alias("n"))
