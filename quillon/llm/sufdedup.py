"""Removal of byte strings that also start in a document with a smaller doc_id, by suffix arrays.

Every byte covered by a string of MATCH bytes that starts in a smaller document, too, goes; strings
are judged on the input. Documents are UTF-8 bytes, a null text is empty, matches never cross documents.

A suffix array of all the text would have to live in one place, and what makes text repeat is mostly
whole copies, which need no sorting. So:

1. Chunks of documents are staged in the shared folder (later steps read them there; texts are never
   shuffled). In each chunk, content-chosen anchors cut a text's windows of MATCH bytes into units
   (see anchors). Equal windows have equal anchors, so only units with one anchor need to meet.
2. Per chunk each distinct unit goes once, with its least document, as packed numbers, to the anchor's
   bucket: however often a passage occurs, it arrives once for a chunk. There a unit that a smaller
   document has, too, is dropped whole. Of the others, those whose context beside the anchor (half of
   what a window must hold) agrees with a different unit's may share some windows with it: they are open.
3. Open units send their bytes, cut to that context, to its hash. A task builds the suffix array (linear
   grouping construction) of each such group's strings, finds the windows that several share and marks
   those of larger documents. Groups beyond GROUP rows are solved window by window in a grouped
   minimum instead, so no group has to fit a task.
4. Chunks are read once more and cut.

Rows with one doc_id are judged each on its own (equal ids are not smaller). A null doc_id takes part as
the largest. Empty tables give no rows; further columns stay with their rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import anchors, common
from quillon.llm.suffixes import equal_windows

MATCH, SIDE = anchors.MATCH, anchors.SIDE
#: Bytes of text in a chunk, about (a longer document is a chunk of its own), and documents at most.
CHUNK_BYTES, CHUNK_DOCS = 4_000_000, 60_000
#: A bucket of units is held by one task: it gets the units of about so many chunks, however large the corpus is.
CHUNKS_PER_BUCKET = 4
#: Rows of a context group that one task sorts, and bytes of rows whose groups are sorted together, about.
GROUP = 256
SORTED_BYTES = 3_000_000
LAST = np.iinfo(np.int64).max


def stage(docs: DataFrame, at: str) -> DataFrame:
    """Write the documents' chunks; a stored row (k, uri) for each."""
    text = docs.columns.index("text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held, size, rows = TaskContext.get().partitionId(), 0, [], 0, 0

        def flush() -> pa.RecordBatch:
            k = part << 24 | n
            uri = f"{at}/chunk-{part:06d}-{n:07d}.parquet"
            fs, path = pafs.FileSystem.from_uri(uri)
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            temporary = f"{path}.{uuid.uuid4().hex}.tmp"
            pq.write_table(pa.Table.from_batches(held), temporary, filesystem=fs, compression="zstd")
            fs.move(temporary, path)
            return pa.RecordBatch.from_pydict({"k": [k], "uri": [uri]})

        for whole in batches:
            for few in (whole.slice(i, CHUNK_DOCS) for i in range(0, len(whole), CHUNK_DOCS)):
                for batch in common.slices_by_bytes(few, "text", CHUNK_BYTES // 4):
                    held.append(batch)
                    size += batch.column(text).nbytes
                    rows += len(batch)
                    if size >= CHUNK_BYTES or rows >= CHUNK_DOCS // 2:
                        yield flush()
                        held, size, rows, n = [], 0, 0, n + 1
        if rows:
            yield flush()

    return common.stored(common.mapped(docs, write, "k long, uri string"), f"{at}/chunks")


class Chunk:
    """A staged chunk with its units. slot: the number of each unit among the chunk's distinct ones."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.table = pq.read_table(path, filesystem=fs).combine_chunks()
        self.data, self.bounds = common.text_bytes(_one(self.table.column("text")))
        ids = _one(self.table.column("doc_id")).cast(pa.int64()).fill_null(LAST)
        self.units = anchors.units(self.data, self.bounds)
        self.doc = ids.to_numpy()[self.units.row]
        self.unit, self.example, self.slot = np.unique(self.units.hash, return_index=True, return_inverse=True)
        self.least = np.full(len(self.unit), LAST, np.int64)
        np.minimum.at(self.least, self.slot, self.doc)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _arrays(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def _meet(chunks: DataFrame, buckets: int) -> DataFrame:
    """k, dropped (slots to drop whole) and open (slots that may share windows), u32 arrays as bytes; several rows a chunk."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = Chunk(uri)
                if not len(c.unit):
                    continue
                left, right = c.units.left[c.example], c.units.right[c.example]
                bucket = (c.units.gram[c.example] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cut)).tolist():
                    own = order[cut[b] : cut[b + 1]]
                    docs, nth = np.unique(c.least[own], return_inverse=True)
                    yield _arrays({
                        "bucket": ([b], pa.int64()), "k": ([k], pa.int64()), "docs": ([docs.astype("<i8").tobytes()], pa.binary()), "nth": ([nth.astype("<u2").tobytes()], pa.binary()),
                        "unit": ([c.unit[own].astype("<u8").tobytes()], pa.binary()), "left": ([(left[own] >> np.uint64(32)).astype("<u4").tobytes()], pa.binary()),
                        "right": ([(right[own] >> np.uint64(32)).astype("<u4").tobytes()], pa.binary()), "slot": ([own.astype("<u4").tobytes()], pa.binary()),
                    })

    def shared(side: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Which rows' side stands at two different units or more."""
        order = np.lexsort((unit, side))
        s, u = side[order], unit[order]
        begins = np.concatenate(([True], s[1:] != s[:-1]))
        group = np.cumsum(begins) - 1
        more = np.zeros(group[-1] + 1, bool)
        more[group[1:][(s[1:] == s[:-1]) & (u[1:] != u[:-1])]] = True
        out = np.zeros(len(side), bool)
        out[order] = more[group] & (s != 0)
        return out

    def solve(held: list[dict]) -> Iterator[pa.RecordBatch]:
        unit, left, right = (np.concatenate([np.frombuffer(x[n], t) for x in held]) for n, t in (("unit", "<u8"), ("left", "<u4"), ("right", "<u4")))
        doc = np.concatenate([np.frombuffer(x["docs"], "<i8")[np.frombuffer(x["nth"], "<u2")] for x in held])
        values, code = np.unique(unit, return_inverse=True)
        least = np.full(len(values), LAST, np.int64)
        np.minimum.at(least, code, doc)
        dropped = doc > least[code]
        live = np.flatnonzero(~dropped)
        open_ = np.zeros(len(doc), bool)
        open_[live] = shared(left[live], unit[live]) | shared(right[live], unit[live])
        at = 0
        for x in held:
            slot = np.frombuffer(x["slot"], "<u4")
            d, o = dropped[at : at + len(slot)], open_[at : at + len(slot)]
            at += len(slot)
            if d.any() or o.any():
                yield _arrays({"k": ([x["k"]], pa.int64()), "dropped": ([slot[d].tobytes()], pa.binary()), "open": ([slot[o].tobytes()], pa.binary())})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for x in batch.to_pylist():
                if held and held[0]["bucket"] != x["bucket"]:
                    yield from solve(held)
                    held = []
                held.append(x)
        if held:
            yield from solve(held)

    spark = chunks.sparkSession
    sent = common.mapped(_spread(chunks), send, "bucket long, k long, docs binary, nth binary, unit binary, left binary, right binary, slot binary")
    dealt = sent.repartition(common.shuffle_parts(spark), "bucket").sortWithinPartitions("bucket")
    return common.stored(common.mapped(dealt, meet, "k long, dropped binary, open binary"))


def _spread(df: DataFrame) -> DataFrame:
    return df.repartition(4 * common.shuffle_parts(df.sparkSession), "k")


def _contexts(chunks: DataFrame, met: DataFrame) -> DataFrame:
    """Strings of open units: key (context), s, doc, k, slot and shift (the unit's window at which s begins)."""
    todo = chunks.join(met.where("length(open) > 0").groupBy("k").agg(F.collect_list("open").alias("open")), "k")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                c = Chunk(x["uri"])
                slots = np.frombuffer(b"".join(x["open"]), "<u4").astype(np.int64)
                units = c.example[slots]
                text = c.data.tobytes()
                first, last, place, doc = c.units.first[units], c.units.last[units], c.units.place[units], c.least[slots]
                for side, hashes in enumerate((c.units.left[units], c.units.right[units])):
                    # windows with SIDE bytes or more left of the anchor end by GRAM + SIDE bytes from it; the others begin after that
                    start = first if side == 0 else np.maximum(first, place - SIDE + 1)
                    end = np.minimum(last + MATCH, place + MATCH - SIDE) if side == 0 else last + MATCH
                    own = np.flatnonzero((hashes != 0) & (end - start >= MATCH))
                    if len(own):
                        strings = [text[a:b] for a, b in zip(start[own].tolist(), end[own].tolist(), strict=True)]
                        keys = common.mix64(hashes[own] + np.uint64(side)).view(np.int64)
                        n = len(own)
                        yield _arrays({
                            "key": (keys, pa.int64()), "s": (strings, pa.binary()), "doc": (doc[own], pa.int64()), "k": (np.full(n, x["k"]), pa.int64()),
                            "slot": (slots[own].astype(np.int32), pa.int32()), "shift": ((start - first)[own].astype(np.int32), pa.int32()),
                        })

    return common.stored(common.mapped(todo, cut, "key long, s binary, doc long, k long, slot int, shift int"))


def _by_suffixes(rows: DataFrame) -> DataFrame:
    """k, slot, mask: the windows of each open unit that a smaller document of its context group has."""

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        key = t.column("key").to_numpy()
        group = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
        more = np.flatnonzero(np.bincount(group)[group] > 1)
        t, group = t.take(pa.array(more)), group[more]
        doc, k, slot, shift = (t.column(x).to_numpy() for x in ("doc", "k", "slot", "shift"))
        data, bounds = common.binary_bytes(_one(t.column("s")))
        mask = np.zeros(len(doc), np.int64)
        place, number = equal_windows(data, bounds, group, MATCH)
        if len(place):
            row = np.searchsorted(bounds, place, "right") - 1
            heads = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
            least = np.repeat(np.minimum.reduceat(doc[row], heads), np.diff(np.append(heads, len(place))))
            hit = doc[row] > least
            np.bitwise_or.at(mask, row[hit], np.int64(1) << (shift[row] + place - bounds[row])[hit])
        own = mask != 0
        return _arrays({"k": (k[own], pa.int64()), "slot": (slot[own], pa.int32()), "mask": (mask[own], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if size >= SORTED_BYTES:  # up to the last key, of which more may come
                key = batch.column(0).to_numpy()
                same = int(np.searchsorted(key, held[-1].column(0)[-1].as_py(), "right"))
                held.append(batch.slice(0, same))
                if same < len(batch):
                    yield solve(held)
                    held, size, batch = [], 0, batch.slice(same)
                else:
                    continue
            if len(batch):
                held.append(batch)
                size += batch.nbytes
        if held:
            yield solve(held)

    dealt = rows.select("key", "s", "doc", "k", "slot", "shift").repartition(4 * common.shuffle_parts(rows.sparkSession), "key").sortWithinPartitions("key")
    return common.mapped(dealt, run, "k long, slot int, mask long")


def _by_windows(rows: DataFrame) -> DataFrame:
    """The same for groups too large for a task: the least document of each window, by a grouped minimum."""
    windows = rows.select("key", "s", "doc", "k", "slot", "shift", F.explode(F.sequence(F.lit(0), F.length("s") - MATCH)).alias("i")).withColumn("w", F.expr(f"substring(s, i + 1, {MATCH})"))
    least = windows.groupBy("key", "w").agg(F.min("doc").alias("least"))
    hit = windows.join(least, ["key", "w"]).where("least < doc")
    return hit.groupBy("k", "slot").agg(F.bit_or(F.expr("shiftleft(1L, i + shift)")).alias("mask"))


def spans(chunk: Chunk, dropped: np.ndarray, masks: dict[int, int]) -> np.ndarray:
    """Which bytes of a chunk go."""
    whole = np.zeros(len(chunk.unit), bool)
    whole[dropped] = True
    # a unit that a smaller document of the chunk has, or of another chunk
    gone = (chunk.doc > chunk.least[chunk.slot]) | whole[chunk.slot]
    step = np.zeros(len(chunk.data) + 1, np.int64)
    np.add.at(step, chunk.units.first[gone], 1)
    np.add.at(step, chunk.units.last[gone] + MATCH, -1)
    if masks:
        marked = np.zeros(len(chunk.unit), bool)
        marked[list(masks)] = True
        for u in np.flatnonzero(marked[chunk.slot] & ~gone).tolist():
            mask, first = masks[int(chunk.slot[u])], int(chunk.units.first[u])
            for i in range(int(chunk.units.last[u]) - first + 1):
                if mask >> i & 1:
                    step[first + i] += 1
                    step[first + i + MATCH] -= 1
    return np.cumsum(step[:-1]) > 0


def _solved(docs: DataFrame) -> DataFrame:
    """A row for each chunk: uri, dropped slots, and masks of the rest."""
    spark = docs.sparkSession
    chunks = stage(docs, common.shared_dir(spark))
    met = _meet(chunks, max(4 * common.shuffle_parts(spark), chunks.count() // CHUNKS_PER_BUCKET))
    rows = _contexts(chunks, met)
    large = rows.groupBy("key").count().where(F.col("count") > GROUP).select("key")
    masks = common.stored(_by_suffixes(rows.join(large, "key", "left_anti")).union(_by_windows(rows.join(large, "key", "left_semi"))))
    each = masks.groupBy("k", "slot").agg(F.bit_or("mask").alias("mask")).groupBy("k").agg(F.collect_list(F.struct("slot", "mask")).alias("masks"))
    gone = met.where("length(dropped) > 0").groupBy("k").agg(F.collect_list("dropped").alias("dropped"))
    return common.stored(chunks.join(gone, "k", "left").join(each, "k", "left"))


def _removed(x: dict) -> tuple[Chunk, np.ndarray]:
    chunk = Chunk(x["uri"])
    slots = np.frombuffer(b"".join(x["dropped"] or ()), "<u4")
    return chunk, spans(chunk, slots, {m["slot"]: m["mask"] for m in x["masks"] or ()})


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                c, gone = _removed(x)
                sums = np.concatenate(([0], np.cumsum(gone)))
                begins = gone & ~np.concatenate(([False], gone[:-1]))
                begins[c.bounds[:-1][c.bounds[:-1] < len(gone)]] |= gone[c.bounds[:-1][c.bounds[:-1] < len(gone)]]
                starts = np.concatenate(([0], np.cumsum(begins)))
                a, b = c.bounds[:-1], c.bounds[1:]
                kept = c.data[~gone].tobytes()
                left = np.concatenate(([0], np.cumsum(~gone)))
                digests = [hashlib.sha256(kept[i:j]).hexdigest() for i, j in zip(left[a].tolist(), left[b].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [_one(c.table.column("doc_id")).cast(pa.int64()), pa.array(b - a), pa.array(sums[b] - sums[a]), pa.array(starts[b] - starts[a]), pa.array(digests, pa.string())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return common.mapped(_spread(_solved(docs.select("doc_id", "text"))), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, without the removed bytes; n_chars, if there, is counted anew.

    Here only characters all of whose bytes are to go are removed, so that a text stays valid UTF-8.
    """
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                c, gone = _removed(x)
                lead = (c.data & 0xC0) != 0x80
                if len(gone):
                    whole = np.logical_and.reduceat(gone, np.flatnonzero(lead))
                    gone = whole[np.cumsum(lead) - 1]
                kept = c.data[~gone].tobytes()
                left = np.concatenate(([0], np.cumsum(~gone)))[c.bounds]
                texts = [kept[i:j].decode("utf-8") for i, j in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
                null = _one(c.table.column("text")).is_null().to_pylist()
                texts = [None if n else t for n, t in zip(null, texts, strict=True)]
                columns = {n: _one(c.table.column(n)) for n in names}
                columns["text"] = pa.array(texts, pa.string())
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return common.mapped(_spread(_solved(docs)), run, schema)
