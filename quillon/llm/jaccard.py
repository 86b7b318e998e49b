"""N-gram Jaccard join: all links of similarity >= threshold between texts' sets of five-word shingles.

1. Each document gets a hash of its shingle set and PERMUTATIONS MinHash values of 16 bits. Documents
   with one set form a class (copies, whatever their number); the least doc_id represents it.
2. Representatives meet in buckets: BANDS bands of ROWS values each. A pair at the threshold 0.8 is in
   none with a chance of 5e-8. Buckets larger than BLOCK are cut into blocks, and each pair of blocks is
   a task of its own, so no task grows with a bucket.
3. In a task, pairs compare their MinHash values STEP at a time. A pair is dropped as soon as the
   posterior probability (uniform prior) that its similarity reaches the threshold falls below
   TOLERANCE. A pair that meets in several bands belongs to the first. Nothing is emitted per pair: a
   task names the members that still have a partner.
4. These members' texts are fetched and the remaining pairs verified exactly on whole shingle sets
   (products of presence matrices). A task returns for each member its number of links and an edge to
   the root of its component in the task, never a row for each pair.
5. Components of these edges come from min-label rounds on DataFrames, each cut by a stored table.

Words are runs without ASCII white space. A text of 1 to 4 words has one shingle, all its words. Texts
without words (null, empty) have the empty set and form one class without links. Rows with a null
doc_id are left out. Rows that share a doc_id are one document; of its texts that with the least digest
counts. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common

SHINGLE = 5
THRESHOLD = 0.8
PERMUTATIONS, BANDS, ROWS = 128, 32, 4
STEP, TOLERANCE = 16, 1e-7
BLOCK = 256
#: Words of shingles that are worked on together (more if one text has more).
CHUNK_WORDS = 1 << 16

_MULTIPLIERS = common.mix64(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts data[bounds[i]:bounds[i + 1]], and the bounds of each text's."""
    words, _, _, row = common.word_hashes(data, bounds)
    n = np.bincount(row, minlength=len(bounds) - 1)
    first = np.concatenate(([0], np.cumsum(n)))
    rolled = np.zeros(len(words) + SHINGLE, np.uint64)
    padded = np.concatenate((words, np.zeros(SHINGLE, np.uint64)))
    row_end = first[1:][row] if len(row) else row
    for k in range(SHINGLE):  # a short text's only shingle holds fewer words
        inside = np.arange(len(words)) + k < row_end
        rolled[: len(words)] = np.where(inside, rolled[: len(words)] * np.uint64(0xD6E8FEB86659FD93) + padded[k : k + len(words)], rolled[: len(words)])
    size = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    keep = np.arange(len(words)) - first[:-1][row] < size[row] if len(row) else np.zeros(0, bool)
    return common.mix64(rolled[: len(words)][keep]), np.concatenate(([0], np.cumsum(size)))


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """PERMUTATIONS 16-bit MinHash values of each set; sets without shingles get zeros."""
    out = np.zeros((len(bounds) - 1, PERMUTATIONS), np.uint64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        at, turned = bounds[:-1][full], np.empty_like(h)
        for k in range(PERMUTATIONS):
            np.multiply(h, _MULTIPLIERS[k], out=turned)
            out[full, k] = np.minimum.reduceat(turned, at)
    return (common.mix64(out) & np.uint64(0xFFFF)).astype("<u2")


def prune_table(threshold: float, tolerance: float) -> np.ndarray:
    """For each number of compared values the least number of equal ones with which a pair goes on.

    With a uniform prior the posterior after m of n equal values is Beta(m + 1, n - m + 1); it exceeds t
    with the probability that a binomial of n + 1 trials with chance t is at most m.
    """
    least = []
    for n in range(STEP, PERMUTATIONS + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        least.append(m)
    return np.array(least)


def _survivors(sig: np.ndarray, i: np.ndarray, j: np.ndarray, band: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that are not pruned and did not meet in an earlier band."""
    keys = sig.view("<u8")
    earlier = (keys[i] == keys[j]) & (np.arange(BANDS) < band[:, None])
    fresh = ~earlier.any(axis=1)
    i, j = i[fresh], j[fresh]
    equal = np.zeros(len(i), np.int64)
    for step, need in enumerate(least):
        at = slice(step * STEP, (step + 1) * STEP)
        equal += (sig[i, at] == sig[j, at]).sum(axis=1)
        on = equal >= need
        i, j, equal = i[on], j[on], equal[on]
    return i, j


def _pairs(start: int, end: int, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a task's rows, in chunks: side 0 within itself, or side 0 against side 1."""
    n = end - start
    if side[start:end].any():
        left, right = start + np.flatnonzero(side[start:end] == 0), start + np.flatnonzero(side[start:end] == 1)
        yield np.repeat(left, len(right)), np.tile(right, len(left))
    else:
        i, j = np.triu_indices(n, 1)
        yield start + i, start + j


def _groups(key: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(key[1:] != key[:-1]) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True))


def _whole_tasks(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted batches, cut anew so that a key's rows stay together. A key has at most 2 * BLOCK rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        column = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        last = int(np.argmax(column == column[-1]))  # where the last key begins
        if last == 0 and held and held[-1].column(batch.schema.get_field_index(key))[-1].as_py() == column[-1]:
            held.append(batch)
            continue
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            if held:
                yield pa.Table.from_batches(held)
            held = [batch]
    if held:
        yield pa.Table.from_batches(held)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, the hash of its shingle set, its number of shingles (capped by long) and MinHash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices_by_bytes(whole, "text", 1_000_000):
                h, bounds = shingles(*common.text_bytes(batch.column(1)))
                digests, sigs = [], []
                start = 0
                while start < len(batch):
                    end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + CHUNK_WORDS, "right")) - 1)
                    own = h[bounds[start] : bounds[end]]
                    sigs.append(signatures(own, bounds[start : end + 1] - bounds[start]))
                    for a, b in zip(bounds[start:end].tolist(), bounds[start + 1 : end + 1].tolist(), strict=True):
                        digests.append(hashlib.blake2b(np.unique(h[a:b]).tobytes(), digest_size=16).digest())
                    start = end
                flat = np.concatenate(sigs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(digests, pa.binary()), pa.array(np.diff(bounds)), pa.array([x.tobytes() for x in flat], pa.binary())],
                    ["doc_id", "digest", "n_shingles", "sig"],
                )

    return common.mapped(docs.where("doc_id is not null").select("doc_id", "text"), run, "doc_id long, digest binary, n_shingles long, sig binary")


def _tasks(reps: DataFrame) -> DataFrame:
    """Rows (task, band, side, rep) of all buckets with two representatives or more."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, BANDS)
                mixed = common.mix64(keys ^ common.mix64(np.arange(1, BANDS + 1, dtype=np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(batch))), pa.array(mixed.ravel().view(np.int64))], ["rep", "band", "bucket"]
                )

    rows = common.mapped(reps.where("n_shingles > 0").select("rep", "sig"), bands, "rep long, band int, bucket long")
    sizes = rows.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK)
    members = rows.join(sizes, ["band", "bucket"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    # block b meets each block: as side 0 the later ones and itself, as side 1 the earlier ones
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return met.select(
        F.xxhash64("band", "bucket", F.least("block", "other"), F.greatest("block", "other")).alias("task"), "band", F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "rep"
    )


def _open_members(tasks: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The rows of tasks whose member has a partner left after pruning."""
    least = prune_table(threshold, TOLERANCE)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_tasks(batches, "task"):
            task, band, side, rep = (t.column(x).to_numpy() for x in ("task", "band", "side", "rep"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(-1, PERMUTATIONS)
            left = np.zeros(len(task), bool)
            for i, j in _all_pairs(task, side):
                i, j = _survivors(sig, i, j, band[i].astype(np.int64), least)
                left[i] = left[j] = True
            keep = np.flatnonzero(left)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[keep]) for x in (task, band, side, rep)), t.column("sig").combine_chunks().take(pa.array(keep))], ["task", "band", "side", "rep", "sig"])

    joined = tasks.join(reps.select("rep", "sig"), "rep").select("task", "band", "side", "rep", "sig")
    dealt = joined.repartition(common.shuffle_parts(tasks.sparkSession), "task").sortWithinPartitions("task")
    return common.mapped(dealt, go, "task long, band int, side int, rep long, sig binary")


def _all_pairs(task: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of all tasks in sorted rows, some 100,000 at a time."""
    held_i, held_j, size = [], [], 0
    for a, b in _groups(task):
        if b - a == 2:
            held_i.append(np.array([a]))
            held_j.append(np.array([a + 1]))
            size += 1
        else:
            for i, j in _pairs(a, b, side):
                held_i.append(i)
                held_j.append(j)
                size += len(i)
        if size > 100_000:
            yield np.concatenate(held_i), np.concatenate(held_j)
            held_i, held_j, size = [], [], 0
    if size:
        yield np.concatenate(held_i), np.concatenate(held_j)


def _common_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many shingles the sets of each pair share."""
    if len(i) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, code, size = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    live = size[code] > 1
    renumbered = np.cumsum(size > 1) - 1
    owner, code = owner[live], renumbered[code[live]]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for at in range(0, int((size > 1).sum()), 8192):
        a, b = np.searchsorted(code, [at, at + 8192])
        present = np.zeros((len(sets), 8192), np.float32)
        present[owner[a:b], code[a:b] - at] = 1
        shared += present @ present.T
    return shared[i, j].astype(np.int64)


def _signed_rows(rep: np.ndarray, sig: np.ndarray, text: pa.ChunkedArray, a: int, b: int) -> np.ndarray:
    """One row for each member of a task, with the text that its signature was made of."""
    h, bounds = shingles(*common.text_bytes(text.slice(a, b - a).combine_chunks()))
    same = np.flatnonzero((signatures(h, bounds) == sig[a:b]).all(axis=1)) + a
    return same[np.unique(rep[same], return_index=True)[1]]


def _links(open_: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """rep, n links and root: for each task and member with a link its links and the least member linked to it through the task."""
    least = prune_table(threshold, TOLERANCE)
    parts = common.shuffle_parts(docs.sparkSession)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_tasks(batches, "task"):
            task, band, side, rep = (t.column(x).to_numpy() for x in ("task", "band", "side", "rep"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(-1, PERMUTATIONS)
            text = t.column("text")
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in _groups(task):
                if len(np.unique(rep[a:b])) < b - a:  # a doc_id with several texts: the one that was signed counts
                    rows = _signed_rows(rep, sig, text, a, b)
                    pairs = ((rows[i], rows[j]) for i, j in _pairs(0, len(rows), side[rows]))
                else:
                    pairs = _pairs(a, b, side)
                for i, j in pairs:
                    i, j = _survivors(sig, i, j, band[i].astype(np.int64), least)
                    if not len(i):
                        continue
                    used = np.unique(np.concatenate((i, j)))
                    h, bounds = shingles(*common.text_bytes(text.take(pa.array(used)).combine_chunks()))
                    sets = [np.unique(h[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                    size = np.array([len(x) for x in sets])
                    i, j = np.searchsorted(used, i), np.searchsorted(used, j)
                    both = _common_counts(sets, i, j)
                    # |A and B| >= t |A or B|, in whole numbers: (den + num) both >= num (|A| + |B|)
                    num, den = round(threshold * 1_000_000), 1_000_000
                    on = (den + num) * both >= num * (size[i] + size[j])
                    i, j = i[on], j[on]
                    n = np.bincount(i, minlength=len(used)) + np.bincount(j, minlength=len(used))
                    root = rep[used].copy()
                    while len(i):
                        before = root.copy()
                        np.minimum.at(root, i, root[j])
                        np.minimum.at(root, j, root[i])
                        if (before == root).all():
                            break
                    own = n > 0
                    out.append((rep[used][own], n[own], root[own]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["rep", "n", "root"])

    texts = open_.select("task", "band", "side", "rep", "sig").join(docs, F.col("rep") == docs["key"]).select("task", "band", "side", "rep", "sig", "text")
    return common.mapped(texts.repartition(parts, "task").sortWithinPartitions("task"), go, "rep long, n long, root long")


def components(edges: DataFrame, low: str = "root", high: str = "rep") -> DataFrame:
    """node, component (its least node) of an undirected graph of edges.

    Rounds of large-star and small-star steps: each node's neighbours move to its least neighbour, until
    nothing changes. Rounds grow with the logarithm of the longest path; each ends in a stored table.
    """
    edges = common.stored(edges.where(F.col(low) != F.col(high)).select(F.greatest(low, high).alias("u"), F.least(low, high).alias("v")).distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = common.stored(small)
        now = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(after.select("v", "v").distinct())
        seen = now
        edges = after


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, rep_id, n_links and n_copies of each document (doc_id, text).

    rep_id: the least doc_id with the same shingle set; n_copies: documents with that set; n_links: other
    sets with a link to it; class_id: the least doc_id reached through copies and links.
    """
    one = sign(docs).groupBy("doc_id").agg(F.min(F.struct("digest", "n_shingles", "sig")).alias("x"))
    signed = common.stored(one.select("doc_id", "x.*"))
    # one signature for each class (all of its members have the same)
    classes = signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.min("sig").alias("sig"), F.min("n_shingles").alias("n_shingles"))
    reps = common.stored(classes)
    keyed = docs.where("doc_id is not null").select(F.col("doc_id").alias("key"), "text")
    open_ = common.stored(_open_members(_tasks(reps), reps, threshold))
    found = common.stored(_links(open_, keyed, threshold))
    links = found.groupBy("rep").agg(F.sum("n").alias("n_links"))
    comps = components(found)
    member = signed.select("doc_id", "digest").join(reps.select("digest", "rep", "n_copies"), "digest").select("doc_id", F.col("rep").alias("rep_id"), "n_copies")
    out = member.join(links.withColumnRenamed("rep", "rep_id"), "rep_id", "left").join(comps.withColumnRenamed("node", "rep_id"), "rep_id", "left")
    return out.select("doc_id", F.coalesce("component", "rep_id").alias("class_id"), "rep_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, that of the least doc_id, with all columns of docs.

    Unlike in join(), each distinct text of a doc_id is judged on its own, and a null doc_id takes part as
    the largest. So a row's key is a hash of doc_id and text; of exact repeats of both one row stays.
    """
    key = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text")
    judged = join(docs.select(key.alias("doc_id"), "text"), threshold).select(F.col("doc_id").alias("key"), "class_id")
    rows = docs.groupBy(key.alias("key"), "doc_id").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", "n")).alias("x")
    kept = common.stored(rows.join(judged, "key").groupBy("class_id").agg(first).select(F.col("x.key").alias("_key"), F.col("x.n").alias("_n")))
    keyed = docs.withColumn("_key", key)
    # one plan for all sizes: texts are dealt by key, whether or not the kept keys would fit a broadcast
    out = keyed.join(kept.where("_n = 1").hint("shuffle_hash"), "_key", "left_semi")
    repeated = kept.where("_n > 1").select("_key")
    if not repeated.isEmpty():
        out = out.union(keyed.join(repeated.hint("shuffle_hash"), "_key", "left_semi").select(out.columns).dropDuplicates(["_key"]))
    return out.select(docs.columns)
