"""Token files: patched frame-of-reference blocks, and flat files that are scanned for separators.

Files are written by executors straight into a shared folder through pyarrow's file systems, under a
temporary name that a rename replaces, so a task that runs twice leaves one whole file.

Patched frame-of-reference file (little-endian):
  magic "PFOR1\\0", then block data, then a footer, then the footer's length as u32 and the magic again.
  Block of up to BLOCK ids: base u32 | width u8 | exceptions u16 | packed (id - base) of `width` bits |
  exception places u16 each | exception excesses u32 each (the bits above `width`).
  The width is the least that holds the share KEEP of the block's values; the rest are exceptions.
  Footer: n_blocks u64, n_ids u64, n_docs u64, block starts u64 each, doc ids i64 each (0 for null),
  lengths u64 each, and a byte each that is 1 where the doc id is not null.

Null and empty texts are documents of the end id alone. Null doc_ids stay null and come first, rows that
share a doc_id stand one after the other in the order of a hash of their texts. An empty table writes no
file and gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm import common
from quillon.llm.encoding import encoder

MAGIC = b"PFOR1\0"
BLOCK = 256
KEEP = 0.9
#: Bytes of one PFOR file's worth of text, about; and tokens in a block of a flat file's scan.
FILE_TEXT_BYTES = 8_000_000
SCAN_TOKENS = 1 << 20
#: What the name of a flat file's list of doc_ids ends with: i64 each, then a byte each that is 1 where it is not null.
NAMES = ".names"


def write_file(uri: str, parts: list[bytes]) -> None:
    """Write through a temporary name; the last of several attempts wins, with the same bytes."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary) as out:
        for x in parts:
            out.write(x)
    fs.move(temporary, path)


def read_file(uri: str) -> memoryview:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        return memoryview(f.read_buffer())


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that hold each value (0 for 0)."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values, each of `width` bits, as rows of u64 words."""
    words = np.zeros((BLOCK * width // 64, len(values)), np.uint64)
    columns = np.ascontiguousarray(values.T).astype(np.uint64)
    for i in range(BLOCK):
        at, shift = divmod(i * width, 64)
        words[at] |= columns[i] << np.uint64(shift)
        if shift + width > 64:
            words[at + 1] |= columns[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T)


def unpack_bits(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((BLOCK, len(words)), np.uint64)
    columns, mask = np.ascontiguousarray(words.T), np.uint64((1 << width) - 1)
    for i in range(BLOCK if width else 0):
        at, shift = divmod(i * width, 64)
        out[i] = columns[at] >> np.uint64(shift)
        if shift + width > 64:
            out[i] |= columns[at + 1] << np.uint64(64 - shift)
        out[i] &= mask
    return np.ascontiguousarray(out.T)


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """PFOR data of u32 ids and the start of each block in it. The last block is filled up with its base."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return b"", np.zeros(0, np.uint64)
    filled = np.empty(blocks * BLOCK, np.uint32)
    filled[:n] = ids
    filled[n:] = ids[(blocks - 1) * BLOCK :].min()
    rows = filled.reshape(blocks, BLOCK)
    base = rows.min(axis=1)
    delta = rows - base[:, None]
    # the value at the chosen percentile, rounded up to the most that its bits can hold
    width = _bits(np.partition(delta, int(BLOCK * KEEP) - 1, axis=1)[:, int(BLOCK * KEEP) - 1])
    over = delta >> width[:, None].astype(np.uint32)
    over[width >= 32] = 0
    odd_row, odd_at = np.nonzero(over)
    odd = np.bincount(odd_row, minlength=blocks)
    sizes = 7 + BLOCK * width // 8 + 6 * odd
    starts = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(starts[-1], np.uint8)

    def scatter(at: np.ndarray, data: np.ndarray) -> None:
        out[at[:, None] + np.arange(data.shape[1])] = data

    scatter(starts[:-1], base.astype("<u4").view(np.uint8).reshape(blocks, 4))
    out[starts[:-1] + 4] = width
    scatter(starts[:-1] + 5, odd.astype("<u2").view(np.uint8).reshape(blocks, 2))
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        packed = pack_bits(delta[own] & np.uint32((1 << w) - 1), w)
        scatter(starts[own] + 7, packed.astype("<u8").view(np.uint8).reshape(len(own), -1))
    first = np.concatenate(([0], np.cumsum(odd)))[:-1]
    nth = np.arange(len(odd_row)) - first[odd_row]
    tail = starts[odd_row] + 7 + BLOCK * width[odd_row] // 8
    scatter(tail + 2 * nth, odd_at.astype("<u2").view(np.uint8).reshape(-1, 2))
    scatter(tail + 2 * odd[odd_row] + 4 * nth, over[odd_row, odd_at].astype("<u4").view(np.uint8).reshape(-1, 4))
    return out.tobytes(), starts[:-1].astype(np.uint64)


def decode_blocks(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The ids of all blocks whose starts are given; n of them in all."""
    blocks, starts = len(starts), starts.astype(np.int64)
    if not blocks:
        return np.zeros(0, np.uint32)

    def gather(at: np.ndarray, size: int) -> np.ndarray:
        return np.ascontiguousarray(data[at[:, None] + np.arange(size)])

    base = gather(starts, 4).view("<u4").ravel()
    width = data[starts + 4].astype(np.int64)
    odd = gather(starts + 5, 2).view("<u2").ravel().astype(np.int64)
    out = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        out[own] = unpack_bits(gather(starts[own] + 7, BLOCK * w // 8).view("<u8"), w).astype(np.uint32)
    row = np.repeat(np.arange(blocks), odd)
    nth = np.arange(len(row)) - np.concatenate(([0], np.cumsum(odd)))[:-1][row]
    tail = starts[row] + 7 + BLOCK * width[row] // 8
    place = gather(tail + 2 * nth, 2).view("<u2").ravel()
    out[row, place] |= gather(tail + 2 * odd[row] + 4 * nth, 4).view("<u4").ravel() << width[row].astype(np.uint32)
    return (out + base[:, None]).ravel()[:n]


def pfor_file(doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> list[bytes]:
    data, starts = encode_blocks(ids)
    names, valid = _names(doc_ids)
    footer = struct.pack("<QQQ", len(starts), len(ids), len(doc_ids)) + starts.astype("<u8").tobytes() + names + lengths.astype("<u8").tobytes() + valid
    return [MAGIC, data, footer, struct.pack("<I", len(footer)), MAGIC]


def _names(doc_ids: pa.Array) -> tuple[bytes, bytes]:
    """doc ids as i64 each, and a byte each that tells whether it is one."""
    held = doc_ids.cast(pa.int64())
    return held.fill_null(0).to_numpy().astype("<i8").tobytes(), held.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()


def _named(names: bytes, valid: bytes) -> pa.Array:
    return pa.array(np.frombuffer(names, "<i8"), mask=np.frombuffer(valid, np.uint8) == 0)


def read_pfor(raw: memoryview) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """doc ids, lengths and ids of a file."""
    raw = np.frombuffer(raw, np.uint8)
    if raw[: len(MAGIC)].tobytes() != MAGIC or raw[-len(MAGIC) :].tobytes() != MAGIC:
        raise ValueError("not a whole PFOR file")
    end = len(raw) - len(MAGIC) - 4
    size = int(raw[end : end + 4].view("<u4")[0])
    footer = raw[end - size : end].tobytes()
    blocks, n, docs = struct.unpack_from("<QQQ", footer)
    at = 24
    starts = np.frombuffer(footer, "<u8", blocks, at)
    at += 8 * blocks
    doc_ids = _named(footer[at : at + 8 * docs], footer[at + 16 * docs : at + 17 * docs])
    lengths = np.frombuffer(footer, "<u8", docs, at + 8 * docs)
    return doc_ids, lengths, decode_blocks(raw[len(MAGIC) : end - size], starts, n)


def write_pfor(docs: DataFrame, tokenizer: str, end_id: int = 1, at: str | None = None) -> DataFrame:
    """Write all documents (doc_id, text) in ascending doc_id order; a stored row for each file.

    Files hold disjoint ranges of (doc_id, hash of the text) and are cut at about FILE_TEXT_BYTES of text.
    """
    spark = docs.sparkSession
    at = at or common.shared_dir(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        enc = encoder(tokenizer)

        def flush() -> pa.RecordBatch:
            named, *rest = zip(*held, strict=True)
            doc_ids, (lengths, ids) = pa.concat_arrays(named), (np.concatenate(x) for x in rest)
            uri = f"{at}/part-{part:06d}-{k:06d}.pfor"
            write_file(uri, pfor_file(doc_ids, lengths, ids))
            return pa.RecordBatch.from_pydict({"uri": [uri], "part": [part], "k": [k], "n_docs": [len(doc_ids)], "n_ids": [len(ids)]})

        for whole in batches:
            for batch in common.slices_by_bytes(whole, "text", 2_000_000):
                ids, lengths = enc.ended(*common.text_bytes(batch.column(1)), end_id)
                held.append((batch.column(0).cast(pa.int64()), lengths, ids.astype(np.uint32)))
                size += batch.column(1).nbytes
                if size >= FILE_TEXT_BYTES:
                    yield flush()
                    held, k, size = [], k + 1, 0
        if held:
            yield flush()

    parts = common.shuffle_parts(spark)
    keys = "doc_id", F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    files = common.mapped(ordered, write, "uri string, part long, k long, n_docs long, n_ids long")
    return common.stored(files, f"{at}/files")


def read_back(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that write_pfor listed."""
    spark = files.sparkSession
    # ids before each file: a running sum over the parts (a row each), and one within each part
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier(Window.orderBy("part"))), F.lit(0)).alias("first"))
    own = F.coalesce(F.sum("n_ids").over(earlier(Window.partitionBy("part").orderBy("k"))), F.lit(0))
    first = files.withColumn("own", own).join(parts, "part").select("uri", (F.col("first") + F.col("own")).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids, lengths, ids = read_pfor(read_file(uri))
                lengths = lengths.astype(np.int64)
                ends = np.cumsum(lengths)
                starts, flat = ends - lengths, ids.astype("<u4")
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts + before), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = first.repartition(common.shuffle_parts(spark), "uri")
    return common.mapped(spread, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_flat(docs: DataFrame, tokenizer: str, end_id: int, at: str | None = None) -> DataFrame:
    """Flat unindexed token files (u16 or u32 ids, end_id after each document), one for each input partition.

    Returns a stored row for each file: uri, width in bytes, n_ids and n_docs. Beside it lies a list of the
    doc_ids in the order in which they were written (no boundaries: finding these is the scan's work).
    end_id must be an id that no text gets, such as the tokenizer's end-of-text token, whose string is
    taken as ordinary text here.
    """
    at = at or common.shared_dir(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uri = f"{at}/flat-{TaskContext.get().partitionId():06d}.ids"
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        enc = encoder(tokenizer, ordinary=True)
        temporary, n, names, valid = f"{path}.{uuid.uuid4().hex}.tmp", 0, [], []
        with fs.open_output_stream(temporary) as out:
            for whole in batches:
                for batch in common.slices_by_bytes(whole, "text", 2_000_000):
                    ids, _ = enc.ended(*common.text_bytes(batch.column(1)), end_id)
                    out.write(ids.tobytes())
                    n += len(ids)
                    own = _names(batch.column(0))
                    names.append(own[0])
                    valid.append(own[1])
        if not n:
            fs.delete_file(temporary)
            return
        write_file(uri + NAMES, names + valid)
        fs.move(temporary, path)
        yield pa.RecordBatch.from_pydict({"uri": [uri], "width": [enc.dtype.itemsize], "n_ids": [n], "n_docs": [sum(map(len, valid))]})

    return common.stored(common.mapped(docs.select("doc_id", "text"), write, "uri string, width long, n_ids long, n_docs long"), f"{at}/files")


def scan_flat(files: DataFrame, end_id: int, block: int = SCAN_TOKENS) -> DataFrame:
    """The documents' ends in flat files, a row for each block: uri, n_docs, block, ends, open and n_before.

    Each block is searched on its own; what a document began in earlier blocks is stitched by a prefix
    maximum over the blocks' last separators (open: where the block's first document begins), and its
    number by a prefix sum over their counts (n_before). Tokens after a file's last separator belong to no
    document and are left out.
    """
    last = ((F.col("n_ids") - 1) / block).cast("long")
    blocks = files.where("n_ids > 0").select("uri", "width", "n_ids", "n_docs", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = pafs.FileSystem.from_uri(row["uri"])
                first = row["block"] * block
                with fs.open_input_file(path) as f:
                    f.seek(first * row["width"])
                    ids = np.frombuffer(f.read(min(block, row["n_ids"] - first) * row["width"]), f"<u{row['width']}")
                ends = np.flatnonzero(ids == end_id) + first + 1
                yield pa.RecordBatch.from_arrays([pa.array([row["uri"]]), pa.array([row["n_docs"]]), pa.array([row["block"]]), pa.array([ends], pa.list_(pa.int64()))], ["uri", "n_docs", "block", "ends"])

    found = common.mapped(blocks.repartition(common.shuffle_parts(files.sparkSession), "uri", "block"), scan, "uri string, n_docs long, block long, ends array<long>")
    before = Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return found.select(
        "*",
        F.coalesce(F.max(F.expr("try_element_at(ends, -1)")).over(before), F.lit(0)).alias("open"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("n_before"),
    )


def token_counts(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write flat files, scan them, and name the documents by their place in them.

    doc_id, n_tokens (with the end id), file, ordinal and start of each document. Each block reads its own
    part of its file's list of doc_ids; nothing is joined.
    """

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = pafs.FileSystem.from_uri(row["uri"] + NAMES)
                n, first = len(row["ends"]), row["n_before"]
                with fs.open_input_file(path) as f:
                    f.seek(8 * first)
                    names = f.read(8 * n)
                    f.seek(8 * row["n_docs"] + first)
                    valid = f.read(n)
                ends = np.array(row["ends"], np.int64)
                starts = np.concatenate(([row["open"]], ends))[:-1]
                file = pa.array([row["uri"].rsplit("/", 1)[-1]] * n, pa.string())
                yield pa.RecordBatch.from_arrays([_named(names, valid), pa.array(ends - starts), file, pa.array(np.arange(first, first + n)), pa.array(starts)], ["doc_id", "n_tokens", "file", "ordinal", "start"])

    scanned = scan_flat(write_flat(docs, tokenizer, end_id), end_id).select("uri", "n_docs", "ends", "open", "n_before")
    return common.mapped(scanned, named, "doc_id long, n_tokens long, file string, ordinal long, start long")
