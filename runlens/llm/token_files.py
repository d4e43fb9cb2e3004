"""Token ids in files of patched frame-of-reference blocks.

A file is a table of segments in ascending doc_id order, each a byte string of
whole documents, written by Spark's own committed Parquet writer, so that a
lost executor or a repeated task leaves no half file and any store will do.
All numbers in a segment are little-endian:

    "PFB1"                 magic
    u32 documents, ids, blocks; u64 ids of this shard before the segment
    i64 x documents        doc_ids
    u8  x documents        1 where the doc_id is null; padded to 4 bytes
    u32 x documents        ids of each document
    u32 x blocks           index: where each block starts, in words from here on
    blocks of 128 ids, the last filled up with its minimum:
        u32 minimum
        u32 width + 256 * number of exceptions
        u32 x 4 * width    residuals' low bits: lane i % 4, from the low end
        u32 x exceptions   their places
        u32 x exceptions   their residuals

The width is the bits that PERCENTILE of a block's residuals fit in; larger ones are exceptions.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe, common

BLOCK, LANES, PERCENTILE = 128, 4, 90
#: A segment is closed at so many ids.
SEGMENT = 1 << 18
MAGIC = b"PFB1"
#: Words, and runs of letters or signs, that a worker keeps the ids of.
ROOM = 1_000_000

#: How many bits each number of up to 16 bits has.
_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)

SEGMENTS = "shard int, segment int, n_ids bigint, data binary"


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, words) of ids (uint32)."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    tail = ids[(n - 1) * BLOCK :]
    full = np.concatenate((ids, np.full(n * BLOCK - len(ids), tail.min(), np.uint32))).reshape(n, BLOCK)
    least = full.min(axis=1)
    rest = full - least[:, None]
    bits = _BITS[rest] if rest.max() < len(_BITS) else np.frexp(rest.astype(np.float64))[1].astype(np.uint8)
    at = math.ceil(BLOCK * PERCENTILE / 100) - 1
    width = np.partition(bits, at, axis=1)[:, at].astype(np.int64)
    over = bits > width[:, None]
    n_over = over.sum(axis=1)
    sizes = 2 + LANES * width + 2 * n_over
    start = np.cumsum(sizes) - sizes
    out = np.zeros(sizes.sum(), np.uint32)
    out[start] = least
    out[start + 1] = width + 256 * n_over
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        low = (rest[rows] & np.uint32((1 << w) - 1)).reshape(len(rows), BLOCK // LANES, LANES)
        packed = np.zeros((len(rows), w, LANES), np.uint32)
        for i in range(BLOCK // LANES):
            word, shift = divmod(i * w, 32)
            packed[:, word] |= low[:, i] << np.uint32(shift)
            if shift + w > 32:
                packed[:, word + 1] |= low[:, i] >> np.uint32(32 - shift)
        out[(start[rows] + 2)[:, None] + np.arange(LANES * w)] = packed.reshape(len(rows), -1)
    row, place = np.nonzero(over)
    if len(row):
        nth = np.arange(len(row)) - (np.cumsum(n_over) - n_over)[row]
        where = (start + 2 + LANES * width)[row] + nth
        out[where] = place
        out[where + n_over[row]] = rest[row, place]
    return start.astype(np.uint32), out


def unpack_blocks(index: np.ndarray, words: np.ndarray, n_ids: int, first: int = 0) -> np.ndarray:
    """The n_ids ids from block `first` of the index on."""
    n = -(-n_ids // BLOCK)
    start = index[first : first + n].astype(np.int64)
    head = words[start + 1]
    width, n_over = (head & np.uint32(255)).astype(np.int64), (head >> np.uint32(8)).astype(np.int64)
    rest = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        packed = words[(start[rows] + 2)[:, None] + np.arange(LANES * w)].reshape(len(rows), w, LANES)
        low = np.empty((len(rows), BLOCK // LANES, LANES), np.uint32)
        mask = np.uint32((1 << w) - 1)
        for i in range(BLOCK // LANES):
            word, shift = divmod(i * w, 32)
            low[:, i] = packed[:, word] >> np.uint32(shift)
            if shift + w > 32:
                low[:, i] |= packed[:, word + 1] << np.uint32(32 - shift)
            low[:, i] &= mask
        rest[rows] = low.reshape(len(rows), BLOCK)
    if n_over.sum():
        row = np.repeat(np.arange(n), n_over)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        where = (start + 2 + LANES * width)[row] + nth
        rest[row, words[where]] = words[where + n_over[row]]
    return (rest + words[start][:, None]).reshape(-1)[:n_ids]


def pack_segment(doc_ids: list[int | None], ids: list[bytes], before: int) -> bytes:
    flat = np.frombuffer(b"".join(ids), "<u4")
    index, words = pack_blocks(flat)
    null = bytes(d is None for d in doc_ids)
    parts = [MAGIC, struct.pack("<IIIQ", len(doc_ids), len(flat), len(index), before), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null + bytes(-len(null) % 4)]
    parts += [np.array([len(x) // 4 for x in ids], "<u4").tobytes(), index.astype("<u4").tobytes(), words.astype("<u4").tobytes()]
    return b"".join(parts)


def unpack_segment(data: bytes) -> tuple[int, list[int | None], np.ndarray, np.ndarray]:
    """(ids before it, doc_ids, ids of each document, all ids)."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    n_docs, n_ids, n_blocks, before = struct.unpack_from("<IIIQ", data, 4)
    at = 24
    doc_ids = np.frombuffer(data, "<i8", n_docs, at).tolist()
    null = data[at + 8 * n_docs : at + 9 * n_docs]
    at += 9 * n_docs + -n_docs % 4
    sizes = np.frombuffer(data, "<u4", n_docs, at)
    index = np.frombuffer(data, "<u4", n_blocks, at + 4 * n_docs)
    ids = unpack_blocks(index, np.frombuffer(data, "<u4", offset=at + 4 * (n_docs + n_blocks)), n_ids)
    return before, [None if x else d for d, x in zip(doc_ids, null, strict=True)], sizes, ids


class _Runs(bpe._RunIds):
    def __missing__(self, run: str) -> bytes:
        if len(self) >= ROOM:
            self.clear()
        self[run] = ids = np.array([t.id for t in self.model.tokenize(run.encode().decode("latin-1").translate(self.signs))], "<u4").tobytes()
        return ids


class _Words(bpe.WordIds):
    """WordIds with room for ROOM words and runs: a task here holds little else."""

    def __init__(self, spec: bytes):
        super().__init__(spec)
        self.runs = None if self.runs is None else _Runs(self.tokenizer)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= ROOM:
            self.clear()
        self[word] = ids = self.encoded(word)
        return ids


@lru_cache(maxsize=1)
def _words(spec: bytes) -> _Words:
    """This worker's table."""
    return _Words(spec)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Encodes every whole text, with end_id behind it, into token files at path.

    A null or empty text has end_id alone. Repeated doc_ids stay, in the order of their texts; a null doc_id
    comes first. Texts of any length are written whole. An empty table gives
    a file of no segments. Other columns are not read.
    """
    spec = common.file_bytes(tokenizer_path)
    bpe.check_splits(spec)
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    end = struct.pack("<I", end_id)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        table = _words(shared.value)
        doc_ids, ids, n, before, number = [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            row = ([shard], [number], [n], [pack_segment(doc_ids, ids, before)])
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                for doc_id, x in zip(part.column(0).to_pylist(), [b"".join(map(table.__getitem__, t.split())) for t in common.bytes_of(part)], strict=True):
                    doc_ids.append(doc_id)
                    ids.append(x + end)
                    n += len(x) // 4 + 1
                    if n >= SEGMENT:
                        yield closed()
                        doc_ids, ids, n, before, number = [], [], 0, before + n, number + 1
        if doc_ids:
            yield closed()

    schema = common.arrow_schema(SEGMENTS)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(segments, SEGMENTS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the token files at path."""
    files = spark.read.schema(SEGMENTS).parquet(path)

    def work(batch):
        out = {"shard": [], "doc_id": [], "inside": [], "n_tokens": [], "ids_crc32": []}
        for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            before, doc_ids, sizes, ids = unpack_segment(data)
            ends = np.cumsum(sizes, dtype=np.int64)
            raw = memoryview(ids.astype("<u4").tobytes())
            out["shard"] += [shard] * len(doc_ids)
            out["doc_id"] += doc_ids
            out["inside"] += (before + ends - sizes).tolist()
            out["n_tokens"] += sizes.tolist()
            out["ids_crc32"] += [zlib.crc32(raw[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
        return out

    rows = common.per_batch(files.select("shard", "data"), "shard int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint", work, rows=1)
    # A row for each shard, which is a task of the writer: few enough for one window.
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    offsets = shards.select("shard", F.coalesce(base, F.lit(0)).alias("base"))
    return rows.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """write() to the shared folder and read(): see there."""
    path = f"{common.shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer_path, end_id)
    return read(docs.sparkSession, path)
