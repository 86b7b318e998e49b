"""Full-text and vector search, aggregations of search, ingest processors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import analysis, ranking, search, vectors
from quillon.plans.registry import query, sql, table
from quillon.sources.shared import stored

_TOKENS = "(SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS t FROM documents)"
_BM25 = """
    WITH tok AS {tok}, tf AS (SELECT doc_id, t, count(*) AS tf FROM tok GROUP BY 1, 2), len AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY 1),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1)
    SELECT tf.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
    FROM tf JOIN len USING (doc_id) JOIN df USING (t) CROSS JOIN st WHERE t IN ({terms}) GROUP BY tf.doc_id"""


def bm25_sql(terms: tuple[str, ...]) -> str:
    return _BM25.format(tok=_TOKENS, terms=", ".join(f"'{t}'" for t in terms))


def docs(spark, sf_dir):
    return search.tokens(table(spark, sf_dir, "documents"), "text")


@query("search_bm25", bm25_sql(("idiot", "password", "rights")))
def bm25(spark, sf_dir):
    return search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", ["idiot", "password", "rights"])


@query("search_bool", f"WITH tok AS {_TOKENS} SELECT doc_id FROM tok GROUP BY doc_id HAVING bool_or(t = 'the') AND bool_or(t = 'of') AND NOT bool_or(t = 'idiot')")
def bool_(spark, sf_dir):
    return docs(spark, sf_dir).where(search.has("the") & search.has("of") & ~search.has("idiot")).select("doc_id")


@query("search_phrase", """SELECT doc_id FROM documents WHERE regexp_matches(' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' ', ' all rights reserved ')""")
def phrase(spark, sf_dir):
    return docs(spark, sf_dir).where(search.phrase(["all", "rights", "reserved"])).select("doc_id")


@query("search_fuzzy", "WITH tok AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS t FROM benchmark) SELECT DISTINCT item_id, t FROM tok WHERE levenshtein(t, 'therble') <= 2")
def fuzzy(spark, sf_dir):
    t = search.tokens(table(spark, sf_dir, "benchmark"), "text").select("item_id", F.explode("tokens").alias("t")).distinct()
    return t.where(F.levenshtein("t", F.lit("therble"), 2).between(0, 2))


@query("search_prefix_wildcard", f"WITH tok AS {_TOKENS} SELECT t, count(DISTINCT doc_id) AS n FROM tok WHERE t LIKE 'pass%' OR t LIKE 'w_rthless' GROUP BY t")
def prefix(spark, sf_dir):
    t = docs(spark, sf_dir).select("doc_id", F.explode(F.array_distinct("tokens")).alias("t"))
    return t.where(F.col("t").startswith("pass") | F.col("t").like("w_rthless")).groupBy("t").agg(F.count("*").alias("n"))


@query("search_significant_terms", f"""
    WITH tok AS {_TOKENS}, d AS (SELECT DISTINCT tok.doc_id, t, toxic FROM tok JOIN labels USING (doc_id)), n AS (SELECT toxic, count(*) AS n FROM labels WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY toxic),
    c AS (SELECT t, count(*) FILTER (WHERE toxic = 1) AS fg, count(*) AS bg FROM d GROUP BY t)
    SELECT t, fg, bg FROM c WHERE fg >= 5 AND cast(fg as double) / (SELECT n FROM n WHERE toxic = 1) > 4.0 * bg / (SELECT sum(n) FROM n)""")
def significant(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    d = docs(spark, sf_dir).join(labels, "doc_id").select("toxic", F.explode(F.array_distinct("tokens")).alias("t"))
    n = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id").agg(F.count_if(F.col("toxic") == 1).alias("n1"), F.count("*").alias("n"))
    c = d.groupBy("t").agg(F.count_if(F.col("toxic") == 1).alias("fg"), F.count("*").alias("bg")).where("fg >= 5")
    return c.crossJoin(F.broadcast(n)).where("fg / n1 > 4.0 * bg / n").select("t", "fg", "bg")


sql("search_terms_agg", "SELECT lang, count(*) AS doc_count, min(n_chars) AS mn, max(n_chars) AS mx, round(avg(n_chars), 6) AS av FROM documents GROUP BY lang")
sql("search_date_histogram", "SELECT date_trunc('week', ts) AS k, count(*) AS doc_count, cast(sum(cast(value as decimal(18,6))) as double) AS total FROM events GROUP BY 1")
sql("search_histogram_ranges", "SELECT cast(floor(value / 10) * 10 as bigint) AS k, CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'mid' ELSE 'high' END AS r, count(*) AS n FROM events GROUP BY 1, 2")
sql("search_top_hits", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) x WHERE rn <= 3")
sql("search_collapse", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) x WHERE rn = 1")
sql("search_after", "SELECT doc_id, n_chars FROM documents WHERE n_chars < 2000 OR (n_chars = 2000 AND doc_id > 10) ORDER BY n_chars DESC, doc_id LIMIT 15")
sql("search_composite_agg", "SELECT lang, source, count(*) AS n FROM documents WHERE lang > 'en' GROUP BY lang, source ORDER BY lang, source LIMIT 40")


@query("search_cardinality_percentiles", "SELECT event_type, count(DISTINCT user_id) AS card, percentile_cont(0.25) WITHIN GROUP (ORDER BY value) AS p25, percentile_cont(0.99) WITHIN GROUP (ORDER BY value) AS p99 FROM events GROUP BY event_type")
def cardinality_percentiles(spark, sf_dir):
    """Distinct counts and exact percentiles, both counted before they are shuffled."""
    e = table(spark, sf_dir, "events")
    shares = ranking.percentiles(e, ["event_type"], "value", {"p25": ("cont", 0.25), "p99": ("cont", 0.99)})
    named = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("card")).withColumnRenamed("event_type", "_type")
    return shares.join(named, F.col("event_type").eqNullSafe(F.col("_type"))).select("event_type", "card", "p25", "p99")


sql("search_missing_exists", "SELECT count(*) AS n, count(toxic) AS with_label, count(*) - count(toxic) AS missing FROM documents LEFT JOIN labels USING (doc_id)")
_EACH = """
    SELECT query_id, vec_id, score FROM (SELECT q.vec_id AS query_id, e.vec_id, round({score}, 6) AS score
        FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) x
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""


@query("knn_cosine", _EACH.format(score="(1 + list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[]))) / 2"))
def knn_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vectors.knn_each(e, e.where("vec_id % 50 = 0"), "cosine", 10)


@query("knn_l2", _EACH.format(score="1 / (1 + pow(list_distance(cast(e.embedding as double[]), cast(q.embedding as double[])), 2))"))
def knn_l2(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vectors.knn_each(e, e.where("vec_id % 50 = 0"), "l2", 10)


@query("knn_dot", _EACH.format(score="(1 + list_inner_product(cast(e.embedding as double[]), cast(q.embedding as double[]))) / 2"))
def knn_dot(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vectors.knn_each(e, e.where("vec_id % 50 = 0"), "dot", 10)


@query("rrf_fusion", f"""
    WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({bm25_sql(('idiot', 'password'))})),
         b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents)
    SELECT id, round(sum(1.0 / (60 + r)), 9) AS score FROM (SELECT * FROM a WHERE r <= 20 UNION ALL SELECT * FROM b WHERE r <= 20) GROUP BY id""")
def rrf(spark, sf_dir):
    a = search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", ["idiot", "password"]).select(F.col("doc_id").alias("id"), "score")
    b = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("score"))
    return vectors.rrf([a, b], window=20, k=60)


sql("ingest_url_parts", "SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '://([^/:?#]+)', 1) AS domain, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM pages")
sql("ingest_html_strip", "SELECT page_id, cast(length(regexp_replace(html, '<[^>]*>', '')) as bigint) AS n FROM pages", "SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS n FROM pages")
sql("ingest_gsub_split_set", "SELECT event_id, upper(event_type) AS kind, regexp_replace(props, '[{}\"]', '') AS flat, 'v1' AS version FROM events", "SELECT event_id, upper(event_type) AS kind, regexp_replace(props, '[{}\"]', '', 'g') AS flat, 'v1' AS version FROM events")
sql("ingest_kv", "SELECT event_id, element_at(str_to_map(regexp_replace(props, '[{}\" ]', ''), ',', ':'), 'k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")


_SCORED = bm25_sql(("idiot", "password", "rights"))
_TERMS = ["idiot", "password", "rights"]


@query("search_phrase_prefix", """SELECT doc_id FROM documents WHERE regexp_matches(' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' '), ' all rights res')""")
def phrase_prefix(spark, sf_dir):
    return docs(spark, sf_dir).where(search.phrase_prefix(["all", "rights", "res"])).select("doc_id")


@query("search_constant_score", f"SELECT doc_id, 2.5::double AS score FROM ({_SCORED})")
def constant_score(spark, sf_dir):
    return search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", _TERMS).select("doc_id", F.lit(2.5).alias("score"))


@query("search_dis_max", f"""
    SELECT doc_id, round(greatest(coalesce(a.score, 0), coalesce(b.score, 0)) + 0.3 * least(coalesce(a.score, 0), coalesce(b.score, 0)), 5) AS score
    FROM ({bm25_sql(('idiot',))}) a FULL JOIN ({bm25_sql(('password', 'rights'))}) b USING (doc_id)""")
def dis_max(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a, b = (search.bm25(d, "doc_id", "text", terms).withColumnRenamed("score", name) for name, terms in (("a", _TERMS[:1]), ("b", _TERMS[1:])))
    x, y = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return a.join(b, "doc_id", "full").select("doc_id", F.round(F.greatest(x, y) + 0.3 * F.least(x, y), 5).alias("score"))


def weighted(spark, sf_dir, factor):
    d = table(spark, sf_dir, "documents")
    return search.bm25(d, "doc_id", "text", _TERMS).join(d, "doc_id").select("doc_id", F.round(F.col("score") * factor, 4).alias("score"))


@query("search_function_score", f"SELECT doc_id, round(score * (ln(2 + n_chars) * CASE WHEN lang = 'en' THEN 2 ELSE 1 END), 4) AS score FROM ({_SCORED}) JOIN documents USING (doc_id)")
def function_score(spark, sf_dir):
    return weighted(spark, sf_dir, F.log(2 + F.col("n_chars")) * F.when(F.col("lang") == "en", 2).otherwise(1))


@query("search_boosting", f"SELECT doc_id, round(score * CASE WHEN lang = 'en' THEN 0.2::double ELSE 1 END, 4) AS score FROM ({_SCORED}) JOIN documents USING (doc_id)")
def boosting(spark, sf_dir):
    return weighted(spark, sf_dir, F.when(F.col("lang") == "en", 0.2).otherwise(1.0))


@query("search_rescore", f"SELECT doc_id, round(score + CASE WHEN r <= 20 THEN 0.5::double * ln(1 + n_chars) ELSE 0 END, 4) AS score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({_SCORED})) JOIN documents USING (doc_id)")
def rescore(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    scored = stored(search.bm25(d, "doc_id", "text", _TERMS))
    top = scored.orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", F.lit(0.5).alias("w"))
    again = scored.join(F.broadcast(top), "doc_id", "left").join(d, "doc_id")
    return again.select("doc_id", F.round(F.col("score") + F.coalesce("w", F.lit(0.0)) * F.log(1 + F.col("n_chars")), 4).alias("score"))


@query("search_distance_feature", "SELECT event_id, round(2.0::double * 864000 / (864000 + abs(epoch(timestamp '2024-01-15') - epoch(ts))), 6) AS score FROM events")
def distance_feature(spark, sf_dir):
    away = F.abs(F.lit(1705276800) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return table(spark, sf_dir, "events").select("event_id", F.round(2.0 * 864000 / (864000 + away), 6).alias("score"))


@query("search_match_all_none", "SELECT (SELECT count(*) FROM documents) AS every, 0::bigint AS nothing")
def match_all_none(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("every"), F.count_if(F.lit(False)).alias("nothing"))


def analyzed(spark, sf_dir, *chain):
    """item_id, pos and t of the benchmark's tokens after an analysis chain."""
    return analysis.analyze(table(spark, sf_dir, "benchmark"), "item_id", "text", *chain)


def _words(pattern: str, text: str = "text") -> str:
    return f"(SELECT item_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT item_id, list_filter(string_split_regex({text}, '{pattern}'), lambda x: x <> '') AS w FROM benchmark))"


_STANDARD, _SPACES, _LETTERS = (_words(p) for p in (r"[^\p{L}\p{N}]+", r"\s+", r"[^\p{L}]+"))
_STOPPED = ", ".join(f"'{x}'" for x in analysis.STOP)


@query("analysis_standard", f"SELECT item_id, pos, lower(t) AS t FROM {_STANDARD}")
def analysis_standard(spark, sf_dir):
    return analyzed(spark, sf_dir, "standard", "lowercase")


@query("analysis_keyword", "SELECT item_id, 0::bigint AS pos, text AS t FROM benchmark")
def analysis_keyword(spark, sf_dir):
    return analyzed(spark, sf_dir, "keyword")


@query("analysis_whitespace", f"SELECT item_id, pos, t FROM {_SPACES}")
def analysis_whitespace(spark, sf_dir):
    return analyzed(spark, sf_dir, "whitespace")


@query("analysis_letter_upper_trim", f"SELECT item_id, pos, upper(replace(trim(t), 'ß', 'ss')) AS t FROM {_LETTERS}")
def analysis_letter(spark, sf_dir):
    return analyzed(spark, sf_dir, "letter", "trim", "uppercase")


@query("analysis_stop_length_truncate", f"SELECT item_id, pos, left(lower(t), 6) AS t FROM {_STANDARD} WHERE lower(t) NOT IN ({_STOPPED}) AND length(t) BETWEEN 3 AND 12")
def analysis_stop(spark, sf_dir):
    return analyzed(spark, sf_dir, "standard", "lowercase", "stop", ("length", 3, 12), ("truncate", 6))


@query("analysis_reverse_fold", f"SELECT item_id, pos, reverse(strip_accents(lower(t))) AS t FROM {_STANDARD}")
def analysis_reverse(spark, sf_dir):
    return analyzed(spark, sf_dir, "standard", "lowercase", "asciifolding", "reverse")


@query("analysis_ngram", f"SELECT item_id, pos, substr(lower(t), k, 3) AS t FROM (SELECT *, unnest(range(1, length(t) - 1)) AS k FROM {_STANDARD} WHERE length(t) >= 3)")
def analysis_ngram(spark, sf_dir):
    return analyzed(spark, sf_dir, "standard", "lowercase", ("ngram", 3))


@query("analysis_edge_ngram", f"SELECT item_id, pos, left(lower(t), k) AS t FROM (SELECT *, unnest(range(1, least(length(t), 4) + 1)) AS k FROM {_STANDARD})")
def analysis_edge_ngram(spark, sf_dir):
    return analyzed(spark, sf_dir, "standard", "lowercase", ("edge_ngram", 1, 4))


@query("analysis_fingerprint", f"SELECT item_id, string_agg(DISTINCT lower(strip_accents(t)), ' ' ORDER BY lower(strip_accents(t))) AS t FROM {_STANDARD} GROUP BY item_id")
def analysis_fingerprint(spark, sf_dir):
    return analysis.fingerprint(analyzed(spark, sf_dir, "standard", "lowercase", "asciifolding"), "item_id")


@query("analysis_unique", f"SELECT item_id, min(pos) AS pos, lower(t) AS t FROM {_STANDARD} GROUP BY item_id, lower(t)")
def analysis_unique(spark, sf_dir):
    return analyzed(spark, sf_dir, "standard", "lowercase", "unique")


@query("analysis_shingle", f"SELECT item_id, pos, t || ' ' || n AS t FROM (SELECT item_id, pos, lower(t) AS t, lead(lower(t)) OVER (PARTITION BY item_id ORDER BY pos) AS n FROM {_STANDARD}) WHERE n IS NOT NULL")
def analysis_shingle(spark, sf_dir):
    return analysis.shingles(table(spark, sf_dir, "benchmark"), "item_id", "text", 2)


@query("analysis_limit_elision", f"SELECT item_id, pos, regexp_replace(lower(t), '^[ldjmtnsc]' || chr(39), '') AS t FROM {_SPACES} WHERE pos < 5")
def analysis_limit(spark, sf_dir):
    return analyzed(spark, sf_dir, "whitespace", ("limit", 5), "lowercase", "elision")


@query("analysis_mapping_pattern", f"SELECT item_id, pos, regexp_replace(lower(t), '([aeiou])', '*', 'g') AS t FROM {_words(r'[^\p{L}\p{N}]+', 'replace(text, chr(116) || chr(104), chr(122))')}")
def analysis_mapping(spark, sf_dir):
    mapped = analysis.mapping(table(spark, sf_dir, "benchmark"), "text", {"th": "z"})
    return analysis.analyze(mapped, "item_id", "text", "standard", "lowercase", ("pattern_replace", "([aeiou])", "*"))


@query("analysis_keep_synonym", f"SELECT item_id, pos, CASE lower(t) WHEN 'of' THEN 'from' ELSE lower(t) END AS t FROM {_STANDARD} WHERE lower(t) IN ('the', 'of', 'and')")
def analysis_keep(spark, sf_dir):
    return analyzed(spark, sf_dir, "standard", "lowercase", ("keep", ["the", "of", "and"]), ("synonym", {"of": "from"}))


@query("analysis_path_hierarchy", "SELECT page_id, array_to_string(p[:k], '/') AS t FROM (SELECT page_id, string_split(regexp_extract(url, '://([^?#]*)', 1), '/') AS p, unnest(range(1, len(string_split(regexp_extract(url, '://([^?#]*)', 1), '/')) + 1)) AS k FROM pages)")
def analysis_path(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    return analysis.path_hierarchy(pages, "page_id", "path", "/")
