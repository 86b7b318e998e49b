"""Relational queries: filters, joins, aggregation, set operations, subqueries, recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import ranking
from quillon.operators import relational as op
from quillon.plans.registry import query, sql, table

MONEY = "cast(sum(cast({} as decimal(18,4))) as double)"


def money(x: str) -> str:
    return f"cast(sum(cast({x} as decimal(18,4))) as double)"


sql("pricing_summary", f"""
    SELECT l_returnflag, l_linestatus, {money('l_quantity')} AS sum_qty, {money('l_extendedprice')} AS sum_base_price,
           {money('l_extendedprice * (1 - l_discount)')} AS sum_disc_price, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= timestamp '1998-09-02' GROUP BY l_returnflag, l_linestatus""")

@query("brand_revenue", f"""
    SELECT p_brand, {money('l_extendedprice * (1 - l_discount)')} AS revenue, count(DISTINCT o_orderkey) AS n_orders
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY p_brand""")
def brand_revenue(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.expr("cast(l_extendedprice * (1 - l_discount) as decimal(18,4))").alias("r"))
    branded = items.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand", "r")
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    rows = op.spread(branded, "l_orderkey").join(done, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("p_brand").agg(F.sum("r").cast("double").alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders"))


sql("filter_predicates", """
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus IN ('F', 'O') AND o_orderpriority LIKE '1%' AND NOT (o_orderkey % 3 = 0) AND o_custkey IS NOT NULL""")
sql("case_coalesce", """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS tier,
           coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, greatest(c_acctbal, 0.0) AS pos, least(c_acctbal, 0.0) AS neg FROM customer""")
sql("join_inner_agg", f"""
    SELECT c_mktsegment, {money('l_extendedprice * (1 - l_discount)')} AS revenue, count(*) AS n
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_mktsegment""")
sql("join_left", """
    SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON c_custkey = o_custkey GROUP BY c_custkey""")
sql("join_right", """
    SELECT c_custkey, count(o_orderkey) AS n_orders FROM (SELECT * FROM orders WHERE o_totalprice > 300000) o RIGHT JOIN customer ON c_custkey = o_custkey GROUP BY c_custkey""")
sql("join_full", """
    SELECT c.k AS ck, o.k AS ok FROM (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) c
    FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 100000) o ON c.k = o.k""")
sql("join_cross", "SELECT a.r_name AS a_name, b.r_name AS b_name FROM region a CROSS JOIN region b WHERE a.r_regionkey < b.r_regionkey")
sql("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
sql("join_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sql("not_in_null_aware", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
sql("join_theta", "SELECT n_nationkey, count(*) AS n FROM nation JOIN supplier ON s_acctbal > n_nationkey * 300 GROUP BY n_nationkey")
sql("join_using", "SELECT r_name, count(*) AS n FROM (SELECT n_regionkey AS r_regionkey, n_name FROM nation) x JOIN region USING (r_regionkey) GROUP BY r_name")
sql("join_lateral_topn", """
    SELECT c_custkey, t.o_orderkey, t.o_totalprice FROM customer, LATERAL (
        SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t""",
    """SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT o_custkey AS c_custkey, o_orderkey, o_totalprice,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders JOIN customer ON c_custkey = o_custkey) WHERE rn <= 2""")
sql("self_join_hierarchy", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
for kind in ("UNION", "UNION ALL", "INTERSECT", "INTERSECT ALL", "EXCEPT", "EXCEPT ALL"):
    sql("setop_" + kind.lower().replace(" ", "_"), f"SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 1000 {kind} SELECT s_nationkey AS k FROM supplier")
sql("grouping_sets", f"""
    SELECT l_returnflag, l_linestatus, {money('l_quantity')} AS q, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
sql("rollup", f"SELECT o_orderstatus, o_orderpriority, {money('o_totalprice')} AS t FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql("cube", f"SELECT o_orderstatus, o_orderpriority, {money('o_totalprice')} AS t FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("agg_filter_having", """
    SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(DISTINCT o_orderpriority) AS n_p,
           min(o_orderdate) AS first_at, max(o_orderdate) AS last_at FROM orders GROUP BY o_custkey HAVING count(*) > 5""")
sql("agg_empty_group", "SELECT count(*) AS n, max(o_totalprice) AS m FROM orders WHERE o_totalprice < 0")


@query("agg_ordered_set", """
    SELECT l_returnflag, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS p50, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity) AS p90
    FROM lineitem GROUP BY l_returnflag""")
def ordered_set(spark, sf_dir):
    return ranking.percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", {"p50": ("cont", 0.5), "p90": ("disc", 0.9)})


sql("agg_mode", """
    SELECT o_orderstatus, o_orderpriority AS mode_p FROM (SELECT o_orderstatus, o_orderpriority,
        row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS rn FROM orders GROUP BY o_orderstatus, o_orderpriority) x WHERE rn = 1""")
sql("agg_string_ordered", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("agg_array_ordered", "SELECT n_regionkey, array_join(transform(array_sort(collect_list(struct(n_name, n_nationkey))), x -> cast(x.n_nationkey as string)), ',') AS ks FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(cast(n_nationkey as varchar), ',' ORDER BY n_name, n_nationkey) AS ks FROM nation GROUP BY n_regionkey")
sql("agg_stats", """
    SELECT l_linestatus, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(stddev_pop(l_discount), 8) AS sp,
           round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cv, round(regr_slope(l_extendedprice, l_quantity), 4) AS sl FROM lineitem GROUP BY l_linestatus""")
sql("agg_bool_bit", """
    SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS all_big, bool_or(o_totalprice > 400000) AS some_big,
           bit_and(o_orderkey) AS ba, bit_or(o_orderkey) AS bo, bit_xor(o_orderkey) AS bx FROM orders GROUP BY o_orderstatus""")
sql("agg_distinct_values", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n, cast(sum(DISTINCT o_custkey) as bigint) AS s FROM orders GROUP BY o_orderpriority")
sql("subquery_scalar", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
sql("subquery_correlated", "SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
sql("quantified_all", """
    SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = p.p_brand AND b.p_partkey <> p.p_partkey AND b.p_retailprice >= p.p_retailprice)""",
    "SELECT p_partkey FROM part p WHERE p_retailprice > ALL (SELECT b.p_retailprice FROM part b WHERE b.p_brand = p.p_brand AND b.p_partkey <> p.p_partkey)")
sql("cte_chain", """
    WITH spend AS (SELECT o_custkey, sum(cast(o_totalprice as decimal(18,2))) AS total FROM orders GROUP BY o_custkey),
         ranked AS (SELECT o_custkey, total, rank() OVER (ORDER BY total DESC) AS rk FROM spend)
    SELECT o_custkey, cast(total as double) AS total, cast(rk as bigint) AS rk FROM ranked WHERE rk <= 10""")
sql("recursive_union_all", "WITH RECURSIVE t(n, f) AS (SELECT 1, cast(1 as bigint) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
sql("values_rows", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(a, b)")
sql("sort_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5")
sql("distinct_rows", "SELECT DISTINCT p_brand, p_size FROM part")
sql("row_comparison", "SELECT o_orderkey FROM orders WHERE struct(o_orderstatus, o_orderpriority) < struct('O', '3')", "SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_orderpriority) < ('O', '3')")
sql("null_semantics", """
    SELECT c_custkey, (nullif(c_nationkey, 3) IS DISTINCT FROM 4) AS d, (nullif(c_nationkey, 3) IS NULL) AS n, (nullif(c_nationkey, 3) > 5) IS TRUE AS t FROM customer""")
sql("tpch_q3", f"""
    SELECT l_orderkey, {money('l_extendedprice * (1 - l_discount)')} AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < timestamp '1998-03-15' AND l_shipdate > timestamp '1996-03-15' GROUP BY l_orderkey, o_orderdate""")
sql("tpch_q6", f"SELECT {money('l_extendedprice * l_discount')} AS revenue FROM lineitem WHERE l_shipdate >= timestamp '1996-01-01' AND l_shipdate < timestamp '1997-01-01' AND l_discount BETWEEN 0.02 AND 0.09 AND l_quantity < 24")


@query("distinct_on", """SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def distinct_on(spark, sf_dir):
    return op.distinct_on(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("fetch_with_ties", "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS rk FROM part) WHERE rk <= 10")
def fetch_with_ties(spark, sf_dir):
    return op.with_ties(table(spark, sf_dir, "part"), "p_size", 10).select("p_partkey", "p_size")


@query("recursive_union_distinct", """
    WITH RECURSIVE t(a, b) AS (SELECT n_nationkey, (n_nationkey * 7 + 3) % 25 FROM nation UNION SELECT t.a, (t.b * 7 + 3) % 25 FROM t) SELECT a, b FROM t""")
def recursive_union_distinct(spark, sf_dir):
    base = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("b"))
    return op.recursive_union(base, lambda new: new.select("a", ((F.col("b") * 7 + 3) % 25).alias("b")))


@query("srf_lists", "SELECT n_nationkey, unnest([1, 2, 3]) AS a, unnest(['x', 'y']) AS b FROM nation")
def srf_lists(spark, sf_dir):
    lists = {"a": F.array(*(F.lit(i) for i in (1, 2, 3))), "b": F.array(F.lit("x"), F.lit("y"))}
    return op.parallel_lists(table(spark, sf_dir, "nation").select("n_nationkey"), lists)


@query("upsert_on_conflict", """
    SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN upper(n_name) || '!' ELSE n_name END AS n_name, n_regionkey FROM nation
    UNION ALL SELECT 100, 'NEW', 1""")
def upsert_on_conflict(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    new = nation.where("n_nationkey < 5").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!")))
    return op.upsert(nation, new.union(spark.sql("SELECT 100, 'NEW', 1")), ["n_nationkey"])


@query("update_from_first_match", """
    SELECT c_custkey, coalesce(t, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, o_totalprice AS t,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) o ON o_custkey = c_custkey AND rn = 1""")
def update_from_first_match(spark, sf_dir):
    first = op.distinct_on(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderkey")])
    return table(spark, sf_dir, "customer").join(first, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("o_totalprice", "c_acctbal").alias("c_acctbal"))
