"""Quality rules: how much of a text lies inside repeated n-grams and lines.

Words are runs without ASCII white space, lines are cut at \\n. For n = 5 to 10 the characters of words
inside n-grams that occur earlier in the same text are measured (each character once), for n = 2 to 4
those of the commonest n-gram, and the characters of lines that are equal to an earlier line. N-grams
are told apart by rolling 64-bit hashes of their words' 64-bit hashes (so is n_repeat_words), repeated
lines by their bytes. The thresholds let pass what clean prose with a repeated line or passage shows.

A null text has no words and fails; so do empty ones. Rows are judged one by one, so repeated rows and
doc_ids keep their place; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm import common

SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
#: Shares of a text's word characters above which it is dropped: inside repeated lines, in the commonest
#: 2- to 4-gram, in repeated 5- to 10-grams.
LINE_SHARE = 0.30
TOP_SHARE = {2: 0.30, 3: 0.28, 4: 0.26}
REPEAT_SHARE = {5: 0.30, 6: 0.29, 7: 0.28, 8: 0.27, 9: 0.26, 10: 0.25}

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_share double, top_share double, repeat_share double"


def _per_row(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, value, rows).astype(np.int64)


def measure(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """All figures of SCHEMA but doc_id for the texts data[bounds[i]:bounds[i + 1]] (UTF-8)."""
    rows = len(bounds) - 1
    hashes, start, end, row = common.word_hashes(data, bounds)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
    chars = points[end] - points[start]
    n_words, word_chars = np.bincount(row, minlength=rows), _per_row(row, chars, rows)
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    signs = np.concatenate(([0], np.cumsum(table[data])))
    n_symbols = signs[bounds[1:]] - signs[bounds[:-1]]

    # lines with a word, equal to an earlier one of the same text
    cut = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate((bounds[:-1], cut + 1)))
    line_row = np.concatenate((np.arange(rows), np.searchsorted(bounds, cut, "right") - 1))[np.argsort(np.concatenate((bounds[:-1], cut + 1)), kind="stable")]
    line_end = np.append(line_start[1:], len(data))
    last = np.append(line_row[1:] != line_row[:-1], True)
    line_end = np.where(last, bounds[line_row + 1], line_end - 1)
    first_word, next_word = np.searchsorted(start, line_start), np.searchsorted(start, line_end)
    live = np.flatnonzero(next_word > first_word)
    whole_text = data.tobytes()
    seen: set[tuple[int, bytes]] = set()
    dup = np.zeros(len(live), bool)
    for k, (r, a, b) in enumerate(zip(line_row[live].tolist(), line_start[live].tolist(), line_end[live].tolist(), strict=True)):
        key = (r, whole_text[a:b])
        dup[k] = key in seen
        seen.add(key)
    sums = np.concatenate(([0], np.cumsum(chars)))
    dup_chars = _per_row(line_row[live], np.where(dup, sums[next_word[live]] - sums[first_word[live]], 0), rows)
    n_dup_lines = _per_row(line_row[live], dup, rows)

    # Rolling hashes; a text's number goes in, so that equal n-grams of different texts differ. An n-gram
    # can occur twice only if both (n - 1)-grams in it do, so few windows are left after the first round.
    base = np.uint64(0xD6E8FEB86659FD93)
    bad, top_most, most = np.zeros(rows, bool), np.zeros(rows), np.zeros(rows)
    repeated = np.zeros(len(row), bool)
    total = np.maximum(word_chars, 1)
    salt = common.mix64(row.astype(np.uint64) + np.uint64(1))
    rolled, twice = hashes, np.ones(len(row), bool)
    for n in range(2, 11):
        if len(rolled) < 2:
            break
        rolled = rolled[:-1] * base + hashes[n - 1 :]
        live = np.flatnonzero(twice[:-1] & twice[1:] & (row[: len(rolled)] == row[n - 1 :]))
        twice = np.zeros(len(rolled), bool)
        if not len(live):
            continue
        codes, uniques = pd.factorize(common.mix64(rolled[live]) ^ salt[live])
        size = np.bincount(codes, minlength=len(uniques))
        twice[live] = size[codes] > 1
        live, codes = live[size[codes] > 1], codes[size[codes] > 1]
        if not len(live):
            continue
        if n == 3:
            for k in range(3):
                repeated[live + k] = True
        if n in TOP_SHARE:
            share = size[codes] * (sums[live + n] - sums[live]) / total[row[live]]
            top = np.zeros(rows)
            np.maximum.at(top, row[live], share)
            top_most = np.maximum(top_most, top)
            bad |= top > TOP_SHARE[n]
        else:
            first = np.zeros(len(codes), bool)
            first[np.unique(codes, return_index=True)[1]] = True
            step = np.zeros(len(row) + 1, np.int64)
            again = live[~first]
            np.add.at(step, again, 1)
            np.add.at(step, again + n, -1)
            share = _per_row(row, np.where(np.cumsum(step[:-1]) > 0, chars, 0), rows) / total
            most = np.maximum(most, share)
            bad |= share > REPEAT_SHARE[n]
    n_repeat = _per_row(row, repeated, rows)
    line_share = dup_chars / total
    base_failed = (n_words < LEAST_WORDS) | (100 * n_repeat > 50 * n_words)
    kept = ~(base_failed | (line_share > LINE_SHARE) | bad)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat,
        "base_failed": base_failed, "kept": kept, "line_share": line_share, "top_share": top_most, "repeat_share": most,
    }


def judge(docs: DataFrame) -> DataFrame:
    """A row of SCHEMA for each document (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices_by_bytes(whole, "text", 1_000_000):
                found = measure(*common.text_bytes(batch.column(1)))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {k: pa.array(v if v.dtype != np.intp else v.astype(np.int64)) for k, v in found.items()})

    return common.mapped(docs.select("doc_id", "text"), run, SCHEMA)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns; no shuffle."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices_by_bytes(whole, "text", 1_000_000):
                yield batch.filter(pa.array(measure(*common.text_bytes(batch.column(columns.index("text"))))["kept"]))

    return common.mapped(docs, run, docs.schema)
