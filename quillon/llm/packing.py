"""Best-fit packing of token pieces into fixed sequences, by large-item matching.

What a packing looks like depends on the pieces' lengths alone, and there are at most `capacity` of
these. So the driver packs a histogram (bounded by the capacity, whatever the corpus holds) into runs
of equal bins, and the executors place each piece by its length and its rank among pieces of that
length.

* Pieces above a third of the capacity pair at most twice a bin: from the longest down, each is
  matched with the longest piece that still fits beside it.
* Smaller pieces, from the longest down, go to the bin with the least room that holds them.

Nulls and empty texts are documents of one token (the end id). Repeated doc_ids are packed each on its
own, and so are rows with a null doc_id, which stay null. An empty table gives no rows. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm import common
from quillon.llm.encoding import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of one (length, salt) group that are ranked together, on average.
RANKED_TOGETHER = 50_000


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """A row for each piece of at most capacity tokens of each document's ids and end_id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for whole in batches:
            for batch in common.slices_by_bytes(whole, "text", 2_000_000):
                ids, lengths = enc.ended(*common.text_bytes(batch.column(1)), end_id)
                ids = ids.astype("<u4")
                n = -(-lengths // capacity)
                row = np.repeat(np.arange(len(batch)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(lengths[row] - start, capacity)
                end = np.cumsum(length)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((end - length).tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return common.mapped(docs.select("doc_id", "text"), cut, PIECES)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Pack histogram[length] pieces of each length into bins.

    Returns runs (length, first rank, count, first bin, pieces of the run in each bin, offset in the
    bin): the piece of rank first + j lies in bin first_bin + j // each, at offset + (j % each) * length.
    The number of runs is bounded by a few times the capacity.
    """
    left = {k: n for k, n in histogram.items() if n}
    ranks: dict[int, int] = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first bin, bins) that have it
    order: list[int] = []  # rooms in ascending order
    bins = 0

    def put(length: int, first_bin: int, count: int, each: int, offset: int) -> None:
        runs.append((length, ranks[length], count, first_bin, each, offset))
        ranks[length] += count
        left[length] -= count

    def leave(room: int, first_bin: int, count: int) -> None:
        if room and count:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(order, room)
            rooms[room].append((first_bin, count))

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        mate = bisect.bisect_right(large, capacity - a) - 1
        if mate < 0:
            count = left[a]
            put(a, bins, count, 1, 0)
            leave(capacity - a, bins, count)
        else:
            b = large[mate]
            count = min(left[a], left[b]) if a != b else left[a] // 2
            if count:
                put(a, bins, count, 1, 0)
                put(b, bins, count, 1, a)
                leave(capacity - a - b, bins, count)
            else:  # one piece of this length is left and only its own length would fit beside it
                b = large[mate - 1] if mate else 0
                count = 1
                put(a, bins, 1, 1, 0)
                if b:
                    put(b, bins, 1, 1, a)
                leave(capacity - a - b, bins, 1)
        bins += count
        large = [k for k in large if left[k]]
    for s in sorted((k for k in left if left[k]), reverse=True):
        while left[s]:
            at = bisect.bisect_left(order, s)
            if at == len(order):
                each = capacity // s
                count = left[s] // each
                if count:
                    put(s, bins, count * each, each, 0)
                    leave(capacity - each * s, bins, count)
                    bins += count
                if left[s]:
                    rest = left[s]
                    put(s, bins, rest, rest, 0)
                    leave(capacity - rest * s, bins, 1)
                    bins += 1
                continue
            room = order[at]
            first_bin, count = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            each = room // s
            full = min(count, left[s] // each)
            if full:
                put(s, first_bin, full * each, each, capacity - room)
                leave(room - each * s, first_bin, full)
            if full < count:
                rest = left[s]
                if rest and rest < each:
                    put(s, first_bin + full, rest, rest, capacity - room)
                    leave(room - rest * s, first_bin + full, 1)
                    full += 1
                leave(room, first_bin + full, count - full)
    return runs


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to stored pieces (doc_id, piece, length, ...)."""
    spark = cut.sparkSession
    total = cut.count()
    salts = max(1, -(-total // RANKED_TOGETHER))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # lengths are at most capacity, so the histogram is small; ranks go on from salt to salt
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = (
        salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
        .join(before.select("length", "salt", F.coalesce("before", F.lit(0)).alias("before")), ["length", "salt"])
        .withColumn("rank", F.col("own") + F.col("before"))
        .drop("own", "before", "salt")
    )
    runs = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(runs)  # a few times the capacity
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    held = cut.columns
    names = [*held, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            if not len(batch):
                continue
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            run = table[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            j = rank - run[:, 1]
            sequence, offset = run[:, 3] + j // run[:, 4], run[:, 5] + j % run[:, 4] * length
            own = [batch.column(batch.schema.get_field_index(x)) for x in held]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(offset)], names)

    return common.mapped(ranked.select(*cut.columns, "rank"), place, schema)


def best_fit(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Pack all documents (doc_id, text); see the module's text."""
    return pack(common.stored(pieces(docs, tokenizer, end_id, capacity)), capacity)
