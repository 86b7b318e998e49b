"""Scalar functions of the SQL dialects, over the driver's tables."""

from __future__ import annotations

from quillon.functions import ranges  # noqa: F401
from quillon.plans.registry import query, sql, table

sql("str_basic", """
    SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l, cast(length(n_name) as bigint) AS len, substring(n_name, 2, 3) AS sub, replace(n_name, 'A', '_') AS rep, trim('  ' || n_name || ' ') AS tr,
           lpad(n_name, 12, '*') AS lp, rpad(n_name, 12, '*') AS rp, reverse(n_name) AS rev, repeat(substring(n_name, 1, 1), 3) AS rpt, left(n_name, 2) AS lf, right(n_name, 2) AS rt,
           concat(n_name, '-', n_nationkey) AS cc, concat_ws('/', n_name, cast(n_regionkey as string)) AS cw, cast(ascii(n_name) as bigint) AS a, translate(n_name, 'AEI', 'aei') AS tl FROM nation""",
    """SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l, length(n_name) AS len, substring(n_name, 2, 3) AS sub, replace(n_name, 'A', '_') AS rep, trim('  ' || n_name || ' ') AS tr,
           lpad(n_name, 12, '*') AS lp, rpad(n_name, 12, '*') AS rp, reverse(n_name) AS rev, repeat(substring(n_name, 1, 1), 3) AS rpt, left(n_name, 2) AS lf, right(n_name, 2) AS rt,
           concat(n_name, '-', n_nationkey) AS cc, concat_ws('/', n_name, cast(n_regionkey as varchar)) AS cw, ascii(n_name) AS a, translate(n_name, 'AEI', 'aei') AS tl FROM nation""")
sql("str_search", """
    SELECT p_partkey, cast(position('e' IN p_name) as bigint) AS pos, split_part(p_name, ' ', 2) AS w2, startswith(p_type, 'ST') AS st, cast(levenshtein(p_brand, 'Brand#23') as bigint) AS lev,
           p_type LIKE '%BRASS%' AS li, p_name ILIKE '%A%' AS il, regexp_like(p_type, '^[A-Z]+ ') AS rl FROM part""",
    """SELECT p_partkey, position('e' IN p_name) AS pos, split_part(p_name, ' ', 2) AS w2, starts_with(p_type, 'ST') AS st, levenshtein(p_brand, 'Brand#23') AS lev,
           p_type LIKE '%BRASS%' AS li, p_name ILIKE '%A%' AS il, regexp_matches(p_type, '^[A-Z]+ ') AS rl FROM part""".replace("starts_with(p_type, 'ST')", "(p_type LIKE 'ST%')"))
sql("str_regexp", "SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '#') AS r, regexp_extract(c_name, '([0-9]+)', 1) AS x, cast(regexp_count(c_name, '0') as bigint) AS n FROM customer",
    "SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '#') AS r, regexp_extract(c_name, '([0-9]+)', 1) AS x, length(c_name) - length(replace(c_name, '0', '')) AS n FROM customer")
sql("str_hash", "SELECT n_name, md5(n_name) AS m, sha2(n_name, 256) AS s, hex(n_name) AS h, base64(cast(n_name as binary)) AS b FROM nation",
    "SELECT n_name, md5(n_name) AS m, sha256(n_name) AS s, hex(n_name) AS h, base64(encode(n_name)) AS b FROM nation")
sql("str_initcap_words", "SELECT p_partkey, initcap(lower(p_type)) AS i, cast(size(split(p_type, ' ')) as bigint) AS n FROM part",
    "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS i, len(string_split(p_type, ' ')) AS n FROM part")
sql("num_basic", """
    SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS a, ceil(l_extendedprice / 7) AS c, floor(l_extendedprice / 7) AS f, round(l_extendedprice / 7, 2) AS r, sign(l_quantity - 25) AS s,
           round(sqrt(l_quantity), 9) AS sq, round(ln(l_quantity), 9) AS ln, round(exp(l_discount), 9) AS ex, power(l_quantity, 2) AS p, l_orderkey % 7 AS m, round(log10(l_extendedprice), 9) AS lg FROM lineitem""")
sql("num_trig", "SELECT n_nationkey, round(sin(n_nationkey), 9) AS s, round(cos(n_nationkey), 9) AS c, round(tan(n_nationkey), 9) AS t, round(atan2(n_nationkey, 3), 9) AS a, round(radians(n_nationkey), 9) AS r, round(degrees(n_nationkey), 6) AS d, round(cbrt(n_nationkey), 9) AS cb, pi() AS pi FROM nation")
sql("num_integer_division", "SELECT o_orderkey, o_custkey DIV 7 AS q, o_custkey % 7 AS m, o_orderkey & 255 AS b, o_orderkey | 1 AS o, o_orderkey ^ 3 AS x, shiftleft(o_custkey, 2) AS sl FROM orders",
    "SELECT o_orderkey, o_custkey // 7 AS q, o_custkey % 7 AS m, o_orderkey & 255 AS b, o_orderkey | 1 AS o, xor(o_orderkey, 3) AS x, o_custkey << 2 AS sl FROM orders")
sql("num_width_bucket", "SELECT p_partkey, cast(width_bucket(p_retailprice, 900, 2100, 12) as bigint) AS b FROM part",
    "SELECT p_partkey, cast(CASE WHEN p_retailprice < 900 THEN 0 WHEN p_retailprice >= 2100 THEN 13 ELSE floor((p_retailprice - 900) / 100) + 1 END as bigint) AS b FROM part")
sql("safe_division", "SELECT l_orderkey, l_linenumber, try_divide(l_extendedprice, l_quantity - 10) AS d, try_mod(l_orderkey, l_linenumber - 1) AS m FROM lineitem",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 10 THEN NULL ELSE l_extendedprice / (l_quantity - 10) END AS d, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_orderkey % (l_linenumber - 1) END AS m FROM lineitem")
sql("mysql_group_concat", "SELECT o_custkey, listagg(DISTINCT o_orderpriority, ';') WITHIN GROUP (ORDER BY o_orderpriority) AS p FROM orders GROUP BY o_custkey",
    "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS p FROM orders GROUP BY o_custkey")
sql("mysql_text_to_number", "SELECT o_orderkey, coalesce(try_cast(nullif(regexp_extract(o_orderpriority, '^\\\\s*[-+]?[0-9]*\\\\.?[0-9]*', 0), '') as double), 0.0) + 1 AS v FROM orders",
    "SELECT o_orderkey, coalesce(try_cast(nullif(regexp_extract(o_orderpriority, '^\\s*[-+]?[0-9]*\\.?[0-9]*', 0), '') as double), 0.0) + 1 AS v FROM orders")
sql("mysql_field_elt", "SELECT c_custkey, cast(array_position(array('BUILDING', 'MACHINERY', 'AUTOMOBILE'), c_mktsegment) as bigint) AS f, elt(c_nationkey % 3 + 1, 'a', 'b', 'c') AS e, if(c_acctbal > 0, 'y', 'n') AS i FROM customer",
    "SELECT c_custkey, coalesce(list_position(['BUILDING', 'MACHINERY', 'AUTOMOBILE'], c_mktsegment), 0) AS f, ['a', 'b', 'c'][c_nationkey % 3 + 1] AS e, CASE WHEN c_acctbal > 0 THEN 'y' ELSE 'n' END AS i FROM customer")
sql("mysql_date_format", "SELECT o_orderkey, date_format(o_orderdate, 'yyyy/MM/dd') AS d, cast(unix_timestamp(cast(o_orderdate as timestamp)) as bigint) AS u, last_day(o_orderdate) AS l FROM orders",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS d, cast(epoch(o_orderdate) as bigint) AS u, last_day(o_orderdate) AS l FROM orders")
sql("ch_aggregates", "SELECT event_type, count(*) AS c, cast(sum(cast(value as decimal(18,6))) as double) AS s, min(value) AS mn, max(value) AS mx, count(DISTINCT user_id) AS u FROM events GROUP BY event_type")
sql("ch_numbers", "SELECT id AS number, id * id AS sq FROM range(100)", "SELECT range AS number, range * range AS sq FROM range(100)")
sql("array_functions", """
    SELECT n_regionkey, cast(size(a) as bigint) AS n, a[0] AS first_k, array_contains(a, 7) AS has7, array_join(slice(a, 2, 2), '-') AS sl, array_join(array_distinct(transform(a, x -> x % 3)), ',') AS d,
           cast(aggregate(a, 0, (acc, x) -> acc + x) as bigint) AS s, cast(array_position(a, 3) as bigint) AS p FROM (SELECT n_regionkey, array_sort(collect_list(n_nationkey)) AS a FROM nation GROUP BY n_regionkey)""",
    """SELECT n_regionkey, len(a) AS n, a[1] AS first_k, list_contains(a, 7) AS has7, array_to_string(a[2:3], '-') AS sl, d, cast(list_sum(a) as bigint) AS s, coalesce(list_position(a, 3), 0) AS p
       FROM (SELECT n_regionkey, list_sort(list(n_nationkey)) AS a FROM nation GROUP BY n_regionkey) JOIN
            (SELECT n_regionkey, string_agg(cast(m as varchar), ',' ORDER BY k) AS d FROM (SELECT n_regionkey, n_nationkey % 3 AS m, min(n_nationkey) AS k FROM nation GROUP BY 1, 2) GROUP BY 1) USING (n_regionkey)""")
sql("array_any_all", "SELECT p_partkey, exists(array(10, 20, 30), x -> p_size < x) AS any_lt, forall(array(10, 20, 30), x -> p_size > x) AS all_gt FROM part",
    "SELECT p_partkey, p_size < 30 AS any_lt, p_size > 30 AS all_gt FROM part")
sql("array_set_semantics", "SELECT a.n_regionkey AS a, b.n_regionkey AS b, arrays_overlap(a.k, b.k) AS o, size(array_except(b.k, a.k)) = 0 AS c FROM (SELECT n_regionkey, collect_set(n_nationkey % 4) AS k FROM nation GROUP BY 1) a CROSS JOIN (SELECT n_regionkey, collect_set(n_nationkey % 3) AS k FROM nation GROUP BY 1) b",
    "SELECT a.n_regionkey AS a, b.n_regionkey AS b, list_has_any(a.k, b.k) AS o, list_has_all(a.k, b.k) AS c FROM (SELECT n_regionkey, list(DISTINCT n_nationkey % 4) AS k FROM nation GROUP BY 1) a CROSS JOIN (SELECT n_regionkey, list(DISTINCT n_nationkey % 3) AS k FROM nation GROUP BY 1) b")
sql("try_casts", "SELECT event_id, try_cast(substring(event_type, 1, 1) as int) AS i, cast(value as bigint) AS b, cast(cast(value as decimal(10,2)) as string) AS d FROM events",
    "SELECT event_id, try_cast(substring(event_type, 1, 1) as int) AS i, cast(trunc(value) as bigint) AS b, cast(cast(value as decimal(10,2)) as varchar) AS d FROM events")
sql("generate_series", "SELECT explode(sequence(date '2024-01-01', date '2024-03-01', INTERVAL '7' DAY)) AS d", "SELECT cast(unnest(generate_series(date '2024-01-01', date '2024-03-01', INTERVAL 7 DAY)) as date) AS d")
sql("collate_ci", "SELECT count(*) AS n FROM nation WHERE n_name COLLATE UTF8_LCASE = 'germany' OR n_name COLLATE UTF8_LCASE < 'c'", "SELECT count(*) AS n FROM nation WHERE lower(n_name) = 'germany' OR lower(n_name) < 'c'")


@query("range_types", """
    SELECT a.o_orderkey AS a, (a.k <= b.k + 40 AND b.k <= a.k + 25) AS overlap, (a.k <= b.k AND b.k + 40 <= a.k + 25) AS holds, greatest(a.k, b.k) AS lo
    FROM (SELECT o_orderkey, o_custkey AS k FROM orders) a JOIN (SELECT o_orderkey + 1 AS o_orderkey, o_custkey AS k FROM orders) b USING (o_orderkey)""")
def range_types(spark, sf_dir):
    from pyspark.sql import functions as F

    o = table(spark, sf_dir, "orders")
    a = o.select(F.col("o_orderkey").alias("a"), ranges.make(F.col("o_custkey"), F.col("o_custkey") + 25, "[]").alias("ra"))
    b = o.select((F.col("o_orderkey") + 1).alias("a"), ranges.make(F.col("o_custkey"), F.col("o_custkey") + 40, "[]").alias("rb"))
    ra, rb = F.col("ra"), F.col("rb")
    return a.join(b, "a").select("a", ranges.overlaps(ra, rb).alias("overlap"), ranges.contains(ra, rb).alias("holds"), F.greatest(ra["lo"], rb["lo"]).alias("lo"))
