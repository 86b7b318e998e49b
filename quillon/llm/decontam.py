"""Benchmark decontamination: test items found in documents within an error budget.

Texts are compared in lower case with each run of white space as one blank, trimmed. An item of m
characters has a budget of k = floor(rate * m) edits (insertions, deletions, replacements). It is split
into k + 1 pieces: whatever k edits do, one piece stays whole, so an automaton over all items' pieces
finds every place at which a match can be. Each such place is verified with Myers' bit-parallel
distance, first on the piece and its neighbour, then on twice as many pieces and so on up to the whole
item: n pieces that lie in a match of the right kind have at most n - 1 edits, so chance hits end early.

Short items (under min_chars characters, which would be met by chance within a budget or inside words)
have a budget of 0 and need a word border at both ends. Null and empty items are left out; a null or
empty document matches nothing. Repeated doc_ids or items are judged each on its own.
Items are sent to the executors in groups of at most MOST_ITEM_CHARS characters, a scan for each group.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common

RATE = 0.1
MIN_CHARS = 25
MOST_ITEM_CHARS = 8_000_000

SCHEMA = "doc_id long, item_id long, distance int, end_at int"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def bordered(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] neither begins nor ends inside a word; characters of full width are words of their own."""
    return all(
        not (0 < i < len(text)) or any(not (c.isalnum() or unicodedata.combining(c)) or unicodedata.east_asian_width(c) in "WF" for c in text[i - 1 : i + 1]) for i in (a, b)
    )


def split(m: int, k: int) -> list[tuple[int, int]]:
    """k + 1 pieces of nearly equal length that cover m characters: (start, end)."""
    return [(i * m // (k + 1), (i + 1) * m // (k + 1)) for i in range(k + 1)]


def ladder(n: int) -> list[list[tuple[int, int]]]:
    """For each of n pieces the ranges of pieces, from pairs up to but without the whole, that are to hold it.

    If n pieces have at most n - 1 edits, one of two halves of n1 + n2 = n pieces has at most n1 - 1 or
    n2 - 1; so a match has a whole piece all of whose ranges keep to their budget.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if 1 < b - a < n:
            for i in range(a, b):
                out[i].insert(0, (a, b))
        if b - a > 1:
            todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
    return out


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def closest(peq: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """The least edit distance, if at most `most`, of a pattern to any part of text, and the first end of such a part."""
    every, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = every, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(xh | up), up & xh
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = plus << 1, minus << 1  # a match may begin anywhere: the row above is all 0
        up, down = (minus | ~(xv | plus)) & every, plus & xv & every
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Matcher:
    """Finds all items (id, normalised text) in a text; those under min_chars characters as whole words without edits."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int = 0):
        import ahocorasick

        self.min_chars = min_chars
        self.items = [(i, t, int(rate * len(t)) if len(t) >= min_chars else 0, masks(t)) for i, t in items]
        pieces: dict[str, list[tuple[int, int, list]]] = {}
        for n, (_, t, k, _) in enumerate(self.items):
            cut = split(len(t), k)
            made: dict[tuple[int, int], tuple[int, int, int, dict[str, int]]] = {}
            for (a, b), ranges in zip(cut, ladder(k + 1), strict=True):
                for i, j in ranges:
                    if (i, j) not in made:
                        first, last = cut[i][0], cut[j - 1][1]
                        made[i, j] = (first, last - first, j - i - 1, masks(t[first:last]))
                pieces.setdefault(t[a:b], []).append((n, a, [made[r] for r in ranges]))
        self.found = ahocorasick.Automaton()
        for piece, at in pieces.items():
            self.found.add_word(piece, (len(piece), at))
        if pieces:
            self.found.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item id, distance, end in the normalised text) of each item found, with its best match."""
        text = normal(text)
        if not self.items or not text:
            return
        places: dict[int, set[int]] = {}
        for last, (size, at) in self.found.iter(text):
            begin = last + 1 - size
            for n, a, steps in at:
                d = begin - a
                if d in places.get(n, ()):
                    continue
                for first, m, budget, peq in steps:
                    if closest(peq, m, text[max(0, d + first - budget) : max(0, d + first + m + budget)], budget) is None:
                        break
                else:
                    places.setdefault(n, set()).add(d)
        for n, diagonals in places.items():
            item, t, k, peq = self.items[n]
            short = len(t) < self.min_chars
            exact = min((d for d in diagonals if d >= 0 and text.startswith(t, d) and (not short or bordered(text, d, d + len(t)))), default=None)
            if exact is not None:
                yield item, 0, exact + len(t)
            if exact is not None or short:
                continue
            best, reach = None, None
            windows: list[list[int]] = []
            for d in sorted(diagonals):
                a, b = max(0, d - k), min(len(text), d + len(t) + k)
                if reach is not None and a <= reach:
                    windows[-1][1] = b
                else:
                    windows.append([a, b])
                reach = b
            for a, b in windows:
                got = closest(peq, len(t), text[a:b], k if best is None else best[0] - 1)
                if got is not None:
                    best = (got[0], a + got[1])
            if best is not None:
                yield item, *best


def _groups(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(1, -(-size // MOST_ITEM_CHARS))
    own = benchmark.select("item_id", "text", F.pmod(F.xxhash64("item_id"), F.lit(groups)).alias("g"))
    out = []
    for g in range(groups):
        items = [(r["item_id"], normal(r["text"])) for r in own.where(F.col("g") == g).collect()]
        out.append([x for x in items if x[1]])
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each item (item_id, text) that a document (doc_id, text) holds within the item's budget."""
    spark, out = docs.sparkSession, None
    for items in _groups(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Matcher(shared.value, rate, min_chars)
            for batch in batches:
                rows = [(doc, *m) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in own.matches(text or "")]
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "distance", "end_at"])

        found = common.mapped(docs.select("doc_id", "text"), scan, SCHEMA)
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents that hold no item, with all their columns; no shuffle."""
    spark = docs.sparkSession
    for items in _groups(benchmark):
        shared, at = spark.sparkContext.broadcast(items), docs.columns.index("text")

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            own = Matcher(shared.value, rate, min_chars)
            for batch in batches:
                yield batch.filter(pa.array([next(own.matches(t or ""), None) is None for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = common.mapped(docs, scan, docs.schema)
    return docs
