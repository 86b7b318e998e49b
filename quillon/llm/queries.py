"""The training-data queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import math
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common, decontam, html, jaccard, packing, quality, sufdedup, tokenfiles, toxicity, urls

WORD_BPE = "word_bpe_49k.json"
#: The end-of-text token of that tokenizer; no text gets it.
END_OF_TEXT = 49407

# The url rules (host, path, verdict), and what the list of unwanted hosts and pages is made of.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_ZONES = ("example.com", "example.net", "example.org")
PAGE_STEMS = ("th", "the", "ther", "tion", "thth", "tiont")
PAGE_ENDS = ("er", "es", "ing", "or")
PAGE_LANGS = ("de", "en", "es", "fr")
PAGE_NUMBERS = 350


def listed(spark: SparkSession) -> DataFrame:
    """The list: unwanted hosts, and 100,800 unwanted pages by rule (stem and end, zone, language, number)."""

    def pick(of: tuple[str, ...], number: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, of)), (number % len(of) + 1).cast("int"))

    i = F.col("id")
    by = [len(PAGE_STEMS), len(PAGE_ENDS), len(LISTED_ZONES), len(PAGE_LANGS)]
    n = [i, *(F.floor(i / math.prod(by[: k + 1])) for k in range(len(by)))]
    url = F.concat(F.lit("http://"), pick(PAGE_STEMS, n[0]), pick(PAGE_ENDS, n[1]), F.lit("."), pick(LISTED_ZONES, n[2]), F.lit("/"), pick(PAGE_LANGS, n[3]), F.lit("/"), n[4].cast("string"))
    hosts = spark.createDataFrame([(f"{name}.{zone}/",) for name in LISTED_NAMES for zone in LISTED_ZONES], "entry string")
    return hosts.union(spark.range(math.prod(by) * PAGE_NUMBERS).select(url.alias("entry")))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(common.table(spark, sf_dir, "documents"), threshold=0.8)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=END_OF_TEXT)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(common.table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(common.table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=0, capacity=2048)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sufdedup.report(common.table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(common.table(spark, sf_dir, "pages"), listed(spark), RULES)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfiles.write_pfor(common.table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=1)
    return tokenfiles.read_back(files)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(common.table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_token_counts": op2_token_counts,
    "op3_html_extraction": op3_html_extraction,
    "op4_decontamination": op4_decontamination,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_url_filters": op7_url_filters,
    "op8_token_files": op8_token_files,
    "op9_quality_rules": op9_quality_rules,
    "op10_toxicity": op10_toxicity,
}
_HOST = r"lower(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''))"
_PATH = r"coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"
_FITS = "(('.' || host) LIKE '%.{0}' AND path LIKE '{1}%')"
_LONGEST = " ".join(f"WHEN {_FITS.format(h, p)} THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
_BLOCKED = ", ".join(f"'{h}{p}'" for h, p, v in RULES if v == "block")
_NAMES, _STEMS, _ENDS, _ZONES, _LANGS = (", ".join(f"('{x}')" for x in xs) for xs in (LISTED_NAMES, PAGE_STEMS, PAGE_ENDS, LISTED_ZONES, PAGE_LANGS))
ORACLE_SQL: dict[str, str] = {
    "op7_url_filters": f"""
        WITH split AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
        ruled AS (SELECT *, CASE {_LONGEST} END AS rule FROM split),
        z(z) AS (VALUES {_ZONES}),
        hosts AS (SELECT n || '.' || z AS h FROM (VALUES {_NAMES}) t(n), z),
        listed AS (SELECT s || e || '.' || z || '/' || l || '/' || k AS u FROM (VALUES {_STEMS}) s(s), (VALUES {_ENDS}) e(e), z, (VALUES {_LANGS}) l(l), range({PAGE_NUMBERS}) k(k)),
        labels AS (SELECT *, string_split(host, '.') AS p, string_split(path, '/') AS q FROM ruled),
        suffixes AS (SELECT page_id, path, q, unnest(list_transform(range(1, len(p) + 1), lambda k: array_to_string(p[k:], '.'))) AS h FROM labels),
        keys AS (SELECT page_id, h, unnest(list_transform(range(2, len(q) + 1), lambda k: h || array_to_string(q[:k], '/'))) AS u FROM suffixes),
        hit AS (SELECT page_id FROM suffixes JOIN hosts USING (h) UNION SELECT page_id FROM keys JOIN listed USING (u))
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ({_BLOCKED}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                    WHEN page_id IN (SELECT page_id FROM hit) THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled
    """,
}
