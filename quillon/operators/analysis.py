"""Analysis chains of a search engine: a tokenizer and token filters, as built-in functions on token arrays.

Tokens keep the position that the tokenizer gave them. A null text has no tokens.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The English stop words of the default list, and what folding replaces.
STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
FOLDED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED_TO = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"

#: Tokenizers: what stands between tokens.
TOKENIZERS = {"standard": r"[^\p{L}\p{N}]+", "whitespace": r"\s+", "letter": r"[^\p{L}]+"}


def _each(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A filter that changes each token."""
    return lambda tokens: F.transform(tokens, lambda x: F.struct(x["pos"].alias("pos"), f(x["t"]).alias("t")))


def _some(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A filter that keeps some tokens."""
    return lambda tokens: F.filter(tokens, lambda x: f(x["t"]))


def _many(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A filter that makes several tokens of one, at its position."""
    return lambda tokens: F.flatten(F.transform(tokens, lambda x: F.transform(f(x["t"]), lambda y: F.struct(x["pos"].alias("pos"), y.alias("t")))))


def _none() -> Column:
    return F.array().cast("array<string>")


def _grams(t: Column, n: int) -> Column:
    return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda k: F.substring(t, k, F.lit(n)))).otherwise(_none())


def _edges(t: Column, least: int, most: int) -> Column:
    ends = F.sequence(F.lit(least), F.least(F.length(t), F.lit(most)))
    return F.when(F.length(t) >= least, F.transform(ends, lambda k: F.substring(t, F.lit(1), k))).otherwise(_none())


def _synonym(t: Column, words: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in words.items() for x in pair))[t], t)


def _unique(tokens: Column) -> Column:
    words = F.transform(tokens, lambda y: y["t"])
    return F.filter(tokens, lambda x, i: F.array_position(words, x["t"]) == i + 1)


#: Token filters by name; those with parameters are given as (name, parameter, ...).
FILTERS: dict[str, Callable[..., Callable[[Column], Column]]] = {
    "lowercase": lambda: _each(F.lower),
    "uppercase": lambda: _each(F.upper),
    "trim": lambda: _each(F.trim),
    "reverse": lambda: _each(F.reverse),
    "asciifolding": lambda: _each(lambda t: F.translate(t, FOLDED, FOLDED_TO)),
    "elision": lambda: _each(lambda t: F.regexp_replace(t, "^[ldjmtnsc]'", "")),
    "apostrophe": lambda: _each(lambda t: F.regexp_replace(t, "['’].*$", "")),
    "classic": lambda: _each(lambda t: F.regexp_replace(t, "['’]s$", "")),
    "pattern_replace": lambda pattern, to: _each(lambda t: F.regexp_replace(t, pattern, to)),
    "truncate": lambda n: _each(lambda t: F.substring(t, 1, n)),
    "synonym": lambda words: _each(lambda t: _synonym(t, words)),
    "stop": lambda words=STOP: _some(lambda t: ~t.isin(words)),
    "keep": lambda words: _some(lambda t: t.isin(words)),
    "length": lambda least, most: _some(lambda t: F.length(t).between(least, most)),
    "limit": lambda n: lambda tokens: F.slice(tokens, 1, n),
    "unique": lambda: _unique,
    "ngram": lambda n: _many(lambda t: _grams(t, n)),
    "edge_ngram": lambda least, most: _many(lambda t: _edges(t, least, most)),
    "keyword_repeat": lambda: _many(lambda t: F.array(t, t)),
}


def tokens(text: Column, tokenizer: str) -> Column:
    """The tokens of a text with their positions; `keyword` takes it whole."""
    parts = F.array(text) if tokenizer == "keyword" else F.filter(F.split(text, TOKENIZERS[tokenizer]), lambda x: x != "")
    return F.transform(parts, lambda t, i: F.struct(i.cast("long").alias("pos"), t.alias("t")))


def analyze(df: DataFrame, key: str, text: str, tokenizer: str, *filters: str | tuple) -> DataFrame:
    """key, pos and t of each token of a tokenizer and filters, in their order."""
    chain = (FILTERS[f]() if isinstance(f, str) else FILTERS[f[0]](*f[1:]) for f in filters)
    return df.select(key, F.inline(reduce(lambda held, f: f(held), chain, tokens(F.col(text), tokenizer))))


def fingerprint(analyzed: DataFrame, key: str) -> DataFrame:
    """One token for each key: its different tokens in order."""
    return analyzed.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("t")), " ").alias("t"))


def shingles(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """key, pos and t of each run of n lower-case standard tokens."""
    cut = df.select(key, F.transform(tokens(F.lower(F.col(text)), "standard"), lambda x: x["t"]).alias("w"))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda k: F.array_join(F.slice("w", k, F.lit(n)), " "))
    return cut.where(F.size("w") >= n).select(key, F.posexplode(runs).alias("pos", "t")).withColumn("pos", F.col("pos").cast("long"))


def mapping(df: DataFrame, text: str, words: dict[str, str]) -> DataFrame:
    """A character filter: replace strings before the tokenizer."""
    return df.withColumn(text, reduce(lambda c, w: F.replace(c, F.lit(w[0]), F.lit(w[1])), words.items(), F.col(text)))


def path_hierarchy(df: DataFrame, key: str, path: str, sep: str) -> DataFrame:
    """key and t: each leading part of a path."""
    parts = F.split(F.col(path), f"\\Q{sep}\\E")
    return df.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), sep))).alias("t"))
