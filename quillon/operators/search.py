"""Search on token arrays: matching, phrases and BM25, all in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.sources.shared import stored

K1, B = 1.2, 0.75
#: What parts tokens, in all scripts.
PATTERN = r"[^\p{L}\p{N}]+"


def tokens(df: DataFrame, text: str) -> DataFrame:
    """Lower-cased runs of letters and digits, in order."""
    return df.withColumn("tokens", F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), PATTERN), lambda x: x != ""))


def has(term: str) -> Column:
    return F.array_contains("tokens", term)


def phrase(terms: list[str]) -> Column:
    """The terms stand side by side. Tokens hold no blank, so that is a substring of the joined tokens."""
    return F.contains(F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" ")), F.lit(f" {' '.join(terms)} "))


def counts(df: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """key, dl (tokens) and f0, f1, ... (how often each term occurs) of each document, stored.

    Texts are cut once; tokens are counted as they are exploded, before anything is shuffled.
    """
    t = df.select(key, F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), PATTERN)).alias("t")).where("t <> ''")
    return stored(t.groupBy(key).agg(F.count("*").alias("dl"), *(F.count_if(F.col("t") == F.lit(x)).alias(f"f{i}") for i, x in enumerate(terms))))


def bm25(df: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """Scores of documents that hold a term. One pass counts the query's terms and lengths; no postings are made for others."""
    base = counts(df, key, text, terms)
    has_any = " or ".join(f"f{i} > 0" for i in range(len(terms)))
    stats = base.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(terms))))
    joined = base.where(has_any).crossJoin(F.broadcast(stats))  # one row of statistics
    score = F.lit(0.0)
    for i in range(len(terms)):
        score = score + F.when(F.col(f"f{i}") > 0, term_score(F.col(f"f{i}"), F.col(f"d{i}"))).otherwise(0.0)
    return joined.select(key, F.round(score, 6).alias("score"))


def term_score(f: Column, d: Column) -> Column:
    """What a term that occurs f times, in d of n documents, adds to a score."""
    idf = F.log(1 + (F.col("n") - d + 0.5) / (d + 0.5))
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def phrase_prefix(terms: list[str]) -> Column:
    """The terms stand side by side, the last one as the beginning of a token."""
    return F.contains(F.concat(F.lit(" "), F.array_join("tokens", " ")), F.lit(f" {' '.join(terms)}"))
