"""BPE encoding and decoding by a table of distinct words.

Words are the runs between ASCII white space. The tokenizer drops white space
and never joins signs across it, so a text's ids are its words' ids in
order. Texts become positions: a word's number in a table. The HOT most frequent words of a bounded
sample have their numbers from a broadcast table; any other word gets one in its block of
documents. Spark shuffles these words with their blocks and numbers, so that each distinct word is
encoded once, and deals the ids back to their blocks, where they are joined with the positions. Words and
positions come from two readings of the documents, so that the positions are shuffled once.
A hot word that the sample misses has a row a block, not one an occurrence. The sample
decides how many rows are shuffled, never a result.

Decoding joins the ids with the id-to-piece table, whose size is the vocabulary's.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words in the broadcast table, and about how many documents are sampled to find them.
HOT, SAMPLED = 524_288, 50_000
#: Words, and words that aren't hot, that end a block.
BLOCK_WORDS, BLOCK_NEW = 4_000_000, 250_000
#: Words in a worker's own table before it starts anew, and in its counts before it hands them on.
CACHED, COUNTED = 250_000, 250_000

#: A word of a block, later its ids, or (slot CHUNK and up) some of its documents as positions.
PARTS = "block bigint, slot int, body binary"
CHUNK = 1 << 30


@lru_cache(maxsize=2)
def _tokenizer(spec: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec.decode())
    t.no_truncation()
    t.no_padding()
    return t


def check_splits(spec: bytes) -> None:
    """Raises unless the tokenizer's texts may be cut at ASCII white space."""
    t = _tokenizer(spec)
    for sep in (" ", "\t", "\n", "\v", "\f", "\r", " \n\n "):
        for a, b in (("Don't", "'s"), ("e", "́x"), ("Σ", "a"), ("<|endoftext|>", "x!")):
            whole, parts = (sum((t.encode(x, add_special_tokens=False).ids for x in xs), []) for xs in ([a + sep + b], [a, b]))
            if whole != parts:
                raise ValueError("the tokenizer joins signs across white space")


#: Words of Latin-1 letters, digits and ASCII signs but ' and <: for these
#: the pre-tokenizer's runs are plain to see and NFC changes nothing.
_PLAIN = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ!-&(-;=-~]+").fullmatch
_RUNS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall


def _byte_signs() -> dict[int, str]:
    """The sign that byte-level BPE has for each byte: itself if it is printable, else the next sign from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _runs_apply(spec: bytes) -> bool:
    """Whether the file's normalizer and pre-tokenizer are those that _RUNS stands for."""
    j = json.loads(spec)
    kinds = [n.get("type") for n in (j.get("normalizer") or {}).get("normalizers", [])]
    pattern = [(p.get("pattern") or {}).get("Regex") for p in (j.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    return kinds == ["NFC", "Replace", "Lowercase"] and pattern == [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", None] and not j["model"].get("dropout") and not any(_PLAIN(t["content"]) for t in j["added_tokens"])


class _RunIds(dict):
    """run of letters or signs -> ids, by the tokenizer's own model."""

    def __init__(self, tokenizer):
        self.model, self.signs = tokenizer.model, _byte_signs()

    def __missing__(self, run: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        self[run] = ids = np.array([t.id for t in self.model.tokenize(run.encode().decode("latin-1").translate(self.signs))], "<u4").tobytes()
        return ids


class WordIds(dict):
    """word (UTF-8) -> its ids as little-endian unsigned 32-bit integers. A
    plain word's ids are its runs' ids; others are encoded by the library whole."""

    def __init__(self, spec: bytes):
        self.tokenizer = _tokenizer(spec)
        self.runs = _RunIds(self.tokenizer) if _runs_apply(spec) else None

    def encoded(self, word: bytes) -> bytes:
        text = word.decode()
        if self.runs is not None and _PLAIN(text):
            return b"".join(map(self.runs.__getitem__, _RUNS(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        self[word] = ids = self.encoded(word)
        return ids


_tables: dict[bytes, WordIds] = {}


def word_ids(spec: bytes) -> WordIds:
    """This worker's table."""
    got = _tables.get(spec)
    if got is None:
        _tables.clear()
        got = _tables[spec] = WordIds(spec)
    return got


def encode_texts(table: WordIds, texts: list[str]) -> list[bytes]:
    return [b"".join(map(table.__getitem__, t.encode().split())) for t in texts]


def distinct_words(docs: DataFrame) -> DataFrame:
    """(word binary, n): every distinct word of all texts, counted in the tasks
    before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for t in common.texts_of(batch.slice(at, 256)):
                    counts.update(t.encode().split())
                if len(counts) >= COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
                    counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    return common.pick(docs, text="text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def hot_words(docs: DataFrame, spec: bytes, hot: int = HOT, sampled: int = SAMPLED) -> list[tuple[bytes, bytes]]:
    """(word, ids) of the most frequent words of about `sampled` documents, `hot` at most, each encoded once."""
    rows = docs.count()
    some = docs.sample(sampled / rows, seed=1) if rows > sampled else docs
    most = distinct_words(some).orderBy(F.desc("n"), "word").limit(hot).select("word")
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def work(batch):
        words = batch.column(0).to_pylist()
        table = word_ids(shared.value)
        return {"word": batch.column(0), "ids": [table[w] for w in words]}

    found = common.per_batch(most, "word binary, ids binary", work, rows=4096).toArrow()
    return list(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))


class _Positions(dict):
    """word -> its number, of the words met so far: the hot words' places, then new words in the order in which they come."""

    def __init__(self, hot: dict[bytes, int]):
        super().__init__()
        self.hot, self.new = hot, []

    def __missing__(self, word: bytes) -> int:
        n = self.hot.get(word)
        if n is None:
            n = len(self.hot) + len(self.new)
            self.new.append(word)
        self[word] = n
        return n


def _packed(doc_ids: list, slots: list[np.ndarray]) -> bytes:
    """Documents' ids, sizes and positions, the last as planes of their four bytes, which pack well."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    sizes = np.array([len(x) for x in slots], np.int64)
    planes = np.concatenate([np.empty(0, np.int32), *slots]).view(np.uint8).reshape(-1, 4).T
    head = np.array([len(doc_ids), sizes.sum()], np.int64), np.array([d or 0 for d in doc_ids], np.int64), sizes
    return zstandard.ZstdCompressor(1).compress(b"".join(x.tobytes() for x in (*head, known, planes)))


def _unpacked(body: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(doc_ids, sizes, positions) of _packed()."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    docs, words = raw[:16].view(np.int64).tolist()
    ids, sizes = raw[16 : 16 + 16 * docs].view(np.int64).reshape(2, docs)
    known = raw[16 + 16 * docs : 16 + 17 * docs]
    planes = raw[16 + 17 * docs :].reshape(4, words)
    return pa.array(ids, mask=known == 0), sizes, np.ascontiguousarray(planes.T).view(np.int32).reshape(-1)


def _blocks(hot: dict[bytes, int], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """(number, new words, packed documents) of blocks of (doc_id, text). The number is a hash of all
    that is in the block, so that words never meet the positions of another order of documents; blocks
    that are the same in all share their words."""
    table, chunks, words = _Positions(hot), [], 0

    def block():
        h = xxhash.xxh3_64()
        for x in chunks:
            h.update(x)
        for w in table.new:
            h.update(w)
        return np.uint64(h.intdigest()).view(np.int64), table.new, chunks

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            slots = []
            for t in common.texts_of(part):
                w = t.encode().split()
                slots.append(np.fromiter(map(table.__getitem__, w), np.int32, len(w)))
                words += len(w)
            chunks.append(_packed(part.column(0).to_pylist(), slots))
            if words >= BLOCK_WORDS or len(table.new) >= BLOCK_NEW:
                yield block()
                table, chunks, words = _Positions(hot), [], 0
    if chunks:
        yield block()


def _rows(block: int, slot: int, bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
    """PARTS of one block, in batches of some MB."""
    for at in range(0, len(bodies), 16_384):
        some = bodies[at : at + 16_384]
        cols = [pa.array(np.full(len(some), block)), pa.array(np.arange(slot + at, slot + at + len(some), dtype=np.int32)), pa.array(some, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, schema=common.arrow_schema(PARTS))


def _encoded(encode, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From words in the order of body: their ids in place of them. encode()
    is called once a distinct word, as its rows follow each other."""
    last, ids = None, b""
    for batch in batches:
        bodies = batch.column(2).to_pylist()
        for i, word in enumerate(bodies):
            if word != last:
                last, ids = word, encode(word)
            bodies[i] = ids
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bodies, pa.binary())], schema=common.arrow_schema(PARTS))


class _Ids:
    """The ids of positions: flat[begin[p] : begin[p] + size[p]]."""

    def __init__(self, hot: tuple[np.ndarray, np.ndarray], new: list[bytes]):
        self.flat = np.concatenate((hot[0], np.frombuffer(b"".join(new), "<u4")))
        self.size = np.concatenate((hot[1], np.fromiter(map(len, new), np.int64, len(new)) // 4))
        self.begin = np.cumsum(self.size) - self.size

    def of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all slots, one after the other, and how many each has."""
        size = self.size[slots]
        return self.flat[np.repeat(self.begin[slots] - np.cumsum(size) + size, size) + np.arange(size.sum())], size


def _chunks(hot: tuple[np.ndarray, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, ids, ends) of each chunk of documents, from PARTS with encoded words in the order of (block, slot).
    hot: the hot words' ids, one word after the other, and how many each has."""
    block, new, table = None, [], None
    known = len(hot[1])
    for batch in batches:
        blocks, slots, bodies = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        for i in range(batch.num_rows):
            if blocks[i] != block:
                block, new, table = blocks[i], [], None
            if slots[i] < CHUNK:
                if slots[i] == known + len(new):  # else it came before, from an equal block
                    new.append(bodies[i].as_py())
                continue
            doc_ids, sizes, positions = _unpacked(bodies[i].as_py())
            if table is None:
                table = _Ids(hot, new)
            if len(positions) and positions.max() >= known + len(new):
                raise RuntimeError("a block lacks words: its documents came in another order when they were read again")
            ids, size = table.of(positions)
            yield doc_ids, ids, np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(sizes)))]


def pieces(spec: bytes) -> list[str]:
    """The id-to-piece table: special tokens included, gaps empty."""
    t = _tokenizer(spec)
    out = [""] * (max(t.get_vocab(with_added_tokens=True).values(), default=-1) + 1)
    for piece, i in t.get_vocab(with_added_tokens=True).items():
        out[i] = piece
    return out


def _texts(docs: DataFrame, tokenizer_path: str, schema: str, work) -> DataFrame:
    """work(doc_ids, ids, ends, pieces) on chunks of encoded documents."""
    spec = common.file_bytes(tokenizer_path)
    check_splits(spec)
    need = common.pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    hot = hot_words(need, spec)
    context = docs.sparkSession.sparkContext
    # Words have no white space, so one text of them is a table; tasks make a dictionary of it and drop it at their end.
    words, file = context.broadcast(b" ".join(w for w, _ in hot)), context.broadcast(spec)
    ids = np.frombuffer(b"".join(x for _, x in hot), "<u4"), np.array([len(x) // 4 for _, x in hot], np.int64)
    tables = context.broadcast((ids, pieces(spec)))
    target = common.arrow_schema(schema)

    def new_words(batches):
        known = {w: i for i, w in enumerate(words.value.split())}
        for block, new, _ in _blocks(known, batches):
            yield from _rows(block, len(known), new)

    def chunks(batches):
        known = {w: i for i, w in enumerate(words.value.split())}
        for block, _, packed in _blocks(known, batches):
            yield from _rows(block, CHUNK, packed)

    def encoded(batches):
        return _encoded(WordIds(file.value).encoded, batches)

    def ended(batches):
        hot_ids, names = tables.value
        names = pa.array(names, pa.string())
        for chunk in _chunks(hot_ids, batches):
            yield pa.RecordBatch.from_arrays(work(*chunk, names), schema=target)

    once = need.mapInArrow(new_words, PARTS).repartition("body").sortWithinPartitions("body").mapInArrow(encoded, PARTS)
    both = once.unionByName(need.mapInArrow(chunks, PARTS))
    return both.repartition("block").sortWithinPartitions("block", "slot").mapInArrow(ended, schema)


def decode_ids(pieces: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Ids joined with their pieces, and those between two ends with each other by spaces."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pieces.take(pa.array(ids, pa.uint32()))), " ")


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids binary): little-endian unsigned 32-bit ids of every text.

    A null or empty text has no ids. Texts of any length are encoded whole. Repeated rows
    each get a row, a null doc_id stays null, an empty table gives an
    empty result, other columns are not read. docs must come in the same order each time it is
    read, as a table does; otherwise the job fails rather than mix up words.
    """

    def work(doc_ids, ids, ends, _):
        return [doc_ids, pa.array([ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())]

    return _texts(docs, tokenizer_path, "doc_id bigint, ids binary", work)


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text) of encoded(doc_id, ids): the pieces of the ids joined by spaces, as
    decode(ids, skip_special_tokens=False) gives for a tokenizer without a
    decoder. Null or no ids give the empty text."""
    spec = common.file_bytes(tokenizer_path)
    check_decoder(spec)
    shared = encoded.sparkSession.sparkContext.broadcast(pieces(spec))

    def work(batch):
        ids = [x or b"" for x in batch.column(1).to_pylist()]
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
        return {"doc_id": batch.column(0), "text": decode_ids(pa.array(shared.value, pa.string()), np.frombuffer(b"".join(ids), "<u4"), ends)}

    return common.per_batch(common.pick(encoded, doc_id="doc_id", ids="ids"), "doc_id bigint, text string", work)


def check_decoder(spec: bytes) -> None:
    if json.loads(spec).get("decoder"):
        raise ValueError("the tokenizer has a decoder of its own")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode() and decode() of
    every row in one pass, so that ids and texts stay in their task. For
    the edge cases see there."""
    check_decoder(common.file_bytes(tokenizer_path))

    def work(doc_ids, ids, ends, names):
        spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        texts = decode_ids(names, ids, ends)
        return [
            doc_ids,
            pa.array(np.diff(ends)),
            pa.array([sha256(ids[a:b]).hexdigest() for a, b in spans], pa.string()),
            pa.array([sha256(t.as_buffer() or b"").hexdigest() for t in texts], pa.string()),
        ]

    return _texts(docs, tokenizer_path, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", work)
