"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Features are the 3-, 5- and 8-grams of the lower-cased text's characters (with a blank at both ends),
each present or not, hashed to 2**BITS buckets: a word made of common syllables shows in long n-grams
only, and in those that cross its start. For each bucket the log ratio of the shares of toxic and
other training texts that hold it scales the feature; a logistic regression with an L2 penalty learns
the rest, in which a row of the rarer label weighs as much more as the root of how much rarer it is. Used
are at most KEEP_FEATURES buckets, those whose shares differ most in standard errors.

Only labels.toxic is learnt from, on at most MAX_TRAIN labelled rows (drawn by a hash of doc_id), and
only rows that `train_on` lets through. A null text is empty and gets a score too. Labels that are null
or have no document are left out; of several labels of a document the highest counts. If all training
labels are alike (or there are none), every score is the smoothed share of toxic ones. Null and repeated
doc_ids and repeated rows keep a row each (no null doc_id has a label). An empty table gives no rows.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import common

SIZES = (3, 5, 8)  # chosen by cross-validation within the training rows
BITS = 22
MAX_TRAIN = 8_000
KEEP_FEATURES = 30_000
LEAST_DOCS = 3
LEAST_ERRORS = 5.0
ROUNDS = 100
PENALTY = 1.0


def buckets(text: str) -> np.ndarray:
    """The bucket of each n-gram of a text, in order, with repeats."""
    x = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out, h = [], np.zeros(len(x), np.uint64)
    for n in range(1, max(SIZES) + 1):
        if len(x) < n:
            break
        h = h[: len(x) - n + 1] * np.uint64(0x100000001B3) + x[n - 1 :]
        if n in SIZES:
            out.append(((h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


class Model:
    """slot: the place of each bucket among the used features, or -1; weight: of each; bias."""

    def __init__(self, slot: np.ndarray, weight: np.ndarray, bias: float):
        self.slot, self.weight, self.bias = slot, weight, bias

    def score(self, text: str) -> float:
        slots = self.slot[buckets(text)]
        seen = np.zeros(len(self.weight), bool)
        seen[slots[slots >= 0]] = True
        z = self.bias + float(self.weight[seen].sum())
        return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))


def fit(rows, least: int = LEAST_DOCS) -> Model:
    """rows(): an iterator over (label, sorted distinct buckets) of the training texts; it is read twice."""
    held, n = np.zeros((2, 1 << BITS)), np.zeros(2)
    for label, own in rows():
        held[label, own] += 1
        n[label] += 1
    nothing = Model(np.full(1 << BITS, -1, np.int32), np.zeros(0), float(np.log((n[1] + 1) / (n[0] + 1))))
    if not n.all():
        return nothing
    ratio = np.log((held[1] + 1) / (n[1] + 2)) - np.log((held[0] + 1) / (n[0] + 2))
    docs = held.sum(axis=0)
    # how far the shares differ, in standard errors of their difference: chance does not pass for a sign
    share = docs / n.sum()
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n[0] + 1 / n[1]))
    stands_out = np.where(docs >= least, np.abs(held[1] / n[1] - held[0] / n[0]) / error, 0)
    stands_out[stands_out < LEAST_ERRORS] = 0
    used = np.argsort(-stands_out, kind="stable")[:KEEP_FEATURES]
    used = used[stands_out[used] > 0]
    if not len(used):
        return nothing
    slot = np.full(1 << BITS, -1, np.int32)
    slot[used] = np.arange(len(used))
    column, size, y = [], [], []
    for label, own in rows():
        s = slot[own]
        column.append(s[s >= 0])
        size.append(len(column[-1]))
        y.append(label)
    column, y = np.concatenate(column), np.array(y, float)
    order = np.repeat(np.arange(len(y)), size)
    scale, heavier = ratio[used], np.where(y > 0, np.sqrt(n[0] / n[1]), 1.0)
    w, bias, first, second = np.zeros(len(used)), float(np.log(n[1] / n[0])), np.zeros(len(used)), np.zeros(len(used))
    for t in range(1, ROUNDS + 1):  # Adam on the whole sample
        z = np.bincount(order, (scale * w)[column], len(y)) + bias
        error = heavier * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        slope = scale * np.bincount(column, error[order], len(used)) / len(y) + PENALTY * w / len(y)
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        w -= 0.05 * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        bias -= 0.5 * float(error.mean())
    return Model(slot, scale * w, bias)


def train(docs: DataFrame, labels: DataFrame, train_on: Column, max_train: int = MAX_TRAIN) -> Model:
    """Fit on labelled documents (doc_id, text; doc_id, toxic) for which train_on, of doc_id, is true."""
    marked = labels.where(train_on & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    share = min(1.0, max_train / max(n, 1))
    drawn = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(buckets(t or "")).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["toxic", "own"])

    # at most about max_train rows: small enough to send to every task that reads documents
    found = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select(F.col("toxic").cast("int"), "text")
    rows = common.stored(common.mapped(found, features, "toxic int, own binary"))
    return fit(lambda: ((int(r["toxic"] > 0), np.frombuffer(r["own"], np.int32)) for r in rows.toLocalIterator()))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of each document, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.slot, model.weight, model.bias))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            scores = np.array([own.score(t or "") for t in batch.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return common.mapped(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int")


def held_out() -> Column:
    """crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels, ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
