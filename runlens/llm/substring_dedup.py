"""Removal of word sequences that another document has had before.

Level-wise doubling. A window is `min_words` consecutive words. The levels are that
length and its halves down to LEAST words or more: 6 and 13; 6, 12, 25 and 50. A level below the last
looks at one window of its length in each full
window, the one with the smallest hash: equal full windows choose equal ones. These are
shuffled and counted; full windows whose choice occurs in one document alone are done
with, and the others alone are extended to the next, doubled length. At the last level their
full windows are hashed and shuffled, and every one that a smaller doc_id has is found.
When no candidates survive, the levels after have no rows.

Before level one, whole texts that a smaller doc_id has are told by 128 bits of hash: all
their windows repeat, so they send none.

Each task first settles what its own batch of documents repeats; of equal
windows it sends on only those of the batch's smallest doc_id. A chosen window that
several of the batch's documents have is sent as one mark, and its runs
pass on uncounted under spread keys. So the rows of a phrase that a third of all
documents share are as many as there are batches, and so are those of a full window. Full windows
are dealt by their own hashes, so those around one phrase spread over all tasks. All
levels read their sorted rows as a stream and keep no table of them.
Two full windows are equal if 96 bits of two hashes are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Distinct words whose hashes a worker keeps.
CACHED = 200_000
#: Bytes of text that a task settles at once.
BATCH = 6 << 20
#: Makes other word hashes for a window's second hash.
OTHER = np.uint64(0xA0761D6478BD642F)

#: The fewest words that a level looks at.
LEAST = 6

#: What a row of RUNS is: a chosen window that one document of its batch has; windows of which a smaller
#: doc_id of the batch has an equal one; windows whose choices are repeated in the batch; a mark of such a choice.
ALONE, SETTLED, SHARED, MARK = range(4)
RUNS = "key bigint, doc_id bigint, tag bigint, at int, n int"  # n: 4 * windows + kind
WINDOWS = "a bigint, b int, doc_id bigint, tag bigint, at int, n int"  # n: the windows of a settled run, else 0
RANGES = "doc_id bigint, tag bigint, at int, n int"  # n: 2 * windows + whether they are settled


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """The hash of the `length` words from each position on, by doubling."""
    acc, done, power, size = None, 0, words, 1
    while size <= length:
        if length & size:  # lengths are put together from their binary digits
            if acc is None:
                acc, done = power, size
            else:
                n = len(words) - done - size + 1
                acc, done = _mix(acc[:n] * np.uint64(0x9E3779B97F4A7C15) + power[done : done + n] + np.uint64(done)), done + size
        n = len(power) - size
        power, size = _mix(power[: max(n, 0)] * np.uint64(0xD6E8FEB86659FD93) + power[size:]), size * 2
    return acc


def _rolling_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def _cuts(*cols: np.ndarray) -> np.ndarray:
    """Where a run begins: True unless each column goes on as before."""
    out = np.ones(len(cols[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return out


def _emit(schema: str, *cols: np.ndarray) -> pa.RecordBatch:
    target = common.arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, target, strict=True)], schema=target)


def _joined(parts: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def levels(length: int) -> list[int]:
    """`length` and its halves of LEAST words or more, the shortest first; at least one below `length`."""
    out = [length, length // 2]
    while out[-1] // 2 >= LEAST:
        out.append(out[-1] // 2)
    return out[::-1]


def _places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each run, run after run."""
    return np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


class _Texts:
    """The words' hashes of some documents, and their candidate windows in the order of doc_id."""

    def __init__(self, rows: dict[str, list], length: int):
        ids, spans = rows["doc_id"], rows.get("starts")
        order = sorted((i for i in range(len(ids)) if ids[i] is not None and (spans[i] if spans else not rows["copy"][i])), key=ids.__getitem__)
        parts, who = [], []
        for i in order:
            words = (rows["text"][i] or "").encode().split()
            if len(words) >= length:
                parts.append(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))
                who.append(i)
        self.empty = not parts
        if self.empty:
            return
        sizes = np.array([len(p) for p in parts])
        self.words, begin = np.concatenate(parts), np.cumsum(sizes) - sizes
        self.ids, self.tags = (np.array([rows[c][i] for i in who], np.int64) for c in ("doc_id", "tag"))
        if spans:  # what the level before left
            runs = np.array([len(spans[i]) for i in who])
            at, n = (np.concatenate([rows[c][i] for i in who]).astype(np.int64) for c in ("starts", "sizes"))
            doc, done = np.repeat(np.arange(len(who)), runs), (n & 1).astype(bool)
            self.passed = doc[done], at[done], n[done] >> 1
            self.doc, self.start = np.repeat(doc[~done], n[~done] >> 1), _places(at[~done], n[~done] >> 1)
        else:
            per = sizes - length + 1
            self.passed = tuple(np.empty(0, np.int64) for _ in range(3))
            self.doc, self.start = np.repeat(np.arange(len(who)), per), _places(np.zeros(len(who), np.int64), per)
        self.where = begin[self.doc] + self.start

    def key(self, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A key that spreads rows that need not meet others."""
        return _mix(self.ids[doc].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64)).view(np.int64)


def _level_runs(texts: _Texts, length: int, level: int, first: bool) -> pa.RecordBatch:
    """Rows of RUNS for the candidate windows of a batch."""
    doc, at, n = texts.passed
    out = [(texts.key(doc, at), texts.ids[doc], texts.tags[doc], at, 4 * n + SETTLED)]
    doc, start = texts.doc, texts.start
    if len(doc):
        by = texts.ids[doc]
        least = _rolling_min(window_hashes(texts.words, level), length - level + 1)[texts.where]
        settled = np.zeros(len(doc), bool)
        if first:  # an equal window of a smaller doc_id is in this batch
            full = window_hashes(texts.words, length)[texts.where]
            rank = np.argsort(full, kind="stable")
            head = np.maximum.accumulate(np.where(_cuts(full[rank]), np.arange(len(rank)), 0))
            settled[rank] = by[rank[head]] < by[rank]
        # Repeated at this level here: `by` goes up, so a choice's first and last rows tell.
        rank = np.argsort(least, kind="stable")
        edge = np.flatnonzero(_cuts(least[rank]))
        last = np.append(edge[1:], len(rank)) - 1
        many = by[rank[edge]] != by[rank[last]]
        shared = np.empty(len(rank), bool)
        shared[rank] = np.repeat(many, last - edge + 1)
        marks = rank[edge[many]]
        kind = np.where(settled, SETTLED, np.where(shared, SHARED, ALONE))
        follows = np.zeros(len(doc), bool)
        follows[1:] = start[1:] == start[:-1] + 1
        head = np.flatnonzero(_cuts(doc, np.where(kind == ALONE, least, 0), kind) | ~follows)
        size = np.diff(np.append(head, len(kind)))
        key = np.where(kind[head] == ALONE, least[head].view(np.int64), texts.key(doc[head], start[head]))
        out.append((key, by[head], texts.tags[doc[head]], start[head], 4 * size + kind[head]))
        out.append((least[marks].view(np.int64), by[marks], texts.tags[doc[marks]], start[marks], np.full(len(marks), MARK)))
    return _emit(RUNS, *_joined(out))


def _full_windows(texts: _Texts, length: int) -> pa.RecordBatch:
    """Rows of WINDOWS for the candidate windows of a batch."""
    doc, at, n = texts.passed
    out = [(texts.key(doc, at), np.zeros(len(doc), np.int32), texts.ids[doc], texts.tags[doc], at, n)]
    doc = texts.doc
    if len(doc):
        a, b = (window_hashes(w, length)[texts.where] for w in (texts.words, _mix(texts.words ^ OTHER)))
        out.append((a.view(np.int64), (b >> np.uint64(32)).astype(np.uint32).view(np.int32), texts.ids[doc], texts.tags[doc], texts.start, np.zeros(len(doc), np.int64)))
    return _emit(WINDOWS, *_joined(out))


def _by_batch(work, length: int):
    """work() on the _Texts of batches of about BATCH bytes, in a mapInArrow."""
    names = ("doc_id", "tag", "text", "copy", "starts", "sizes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.table({n: batch.column(n) for n in names if n in batch.schema.names})
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
            lot = (np.cumsum(sizes) - sizes) // BATCH
            for at in np.flatnonzero(_cuts(lot)) if len(lot) else ():
                texts = _Texts(part.slice(at, np.count_nonzero(lot == lot[at])).to_pydict(), length)
                if not texts.empty:
                    yield work(texts)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From RUNS in the order of (key, doc_id): RANGES of the windows whose choices several documents
    have. What is held of a choice that a batch's end cuts is one document's rows."""
    held, open_key, open_alive = None, None, False
    for batch in batches:
        rows = [batch.column(i).to_numpy() for i in range(5)]
        kind = rows[4] & 3
        known = (kind == SETTLED) | (kind == SHARED)
        out = [tuple(x[known] for x in (*rows[1:], kind))]
        rows = [x[~known] for x in rows]
        if held:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if len(rows[0]):
            key, doc, tag, at, n = rows
            kind = n & 3
            first = np.flatnonzero(_cuts(key))
            last = np.append(first[1:], len(key)) - 1
            alive = (doc[first] != doc[last]) | np.logical_or.reduceat(kind == MARK, first)
            alive[0] |= open_alive and key[0] == open_key
            open_key, open_alive = key[-1], alive[-1]
            held = None if open_alive else [x[first[-1] :] for x in rows]
            go = np.repeat(alive, last - first + 1) & (kind == ALONE)
            out.append((doc[go], tag[go], at[go], n[go], kind[go]))
        doc, tag, at, n, kind = _joined(out)
        if len(doc):
            yield _emit(RANGES, doc, tag, at, 2 * (n >> 2) + (kind == SETTLED))


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From WINDOWS in the order of (a, b, doc_id): RANGES of windows whose sequence a smaller doc_id has."""
    open_key, open_doc = None, None
    for batch in batches:
        a, b, doc, tag, at, n = (batch.column(i).to_numpy() for i in range(6))
        settled = n > 0
        out = [(doc[settled], tag[settled], at[settled], n[settled])]
        if not settled.all():
            a, b, doc, tag, at = (x[~settled] for x in (a, b, doc, tag, at))
            first = np.flatnonzero(_cuts(a, b))
            origin = doc[first]
            if (a[0], b[0]) == open_key:
                origin[0] = open_doc
            open_key, open_doc = (a[-1], b[-1]), origin[-1]
            hit = np.repeat(origin, np.diff(np.append(first, len(a)))) < doc
            out.append((doc[hit], tag[hit], at[hit], np.ones(np.count_nonzero(hit), np.int32)))
        doc, tag, at, n = _joined(out)
        if len(doc):
            yield _emit(RANGES, doc, tag, at, 2 * n + 1)


def _spans(ranges: DataFrame) -> DataFrame:
    """(doc_id, tag, starts, sizes) of RANGES, each range once."""
    grouped = ranges.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("at", "n")).alias("spans"))
    return grouped.select("doc_id", "tag", F.col("spans.at").alias("starts"), F.col("spans.n").alias("sizes"))


def _copies(tagged: DataFrame) -> DataFrame:
    """(doc_id, tag, copy) of every text that a smaller doc_id has whole."""
    each = tagged.where("doc_id IS NOT NULL").select("doc_id", "tag", F.xxhash64("text", F.lit("second")).alias("other"))
    least = each.groupBy("tag", "other").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    found = common.spread_join(each, common.stored(least, "copies"), ["tag", "other"], "n")
    return common.stored(found.where("doc_id > least").select("doc_id", "tag", F.lit(True).alias("copy")).distinct(), "later")


def repeated_ranges(tagged: DataFrame, min_words: int = 13) -> DataFrame:
    """tagged(doc_id, tag, text, ...) with copy, starts and sizes: from each of a document's words `starts`
    on, `sizes` // 2 windows begin whose sequence starts in a smaller doc_id too; copy: all do.
    Each level joins all columns of tagged with what the level before left, so that all of them and
    the result can read one exchange of the texts."""
    if min_words < 2:
        raise ValueError("min_words must be 2 or more")
    key = ["doc_id", "tag"]
    texts = tagged.join(_copies(tagged), key, "left")
    left = texts
    for i, level in enumerate(levels(min_words)[:-1]):
        runs = left.mapInArrow(_by_batch(lambda t, level=level, i=i: _level_runs(t, min_words, level, not i), min_words), RUNS)
        counted = runs.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_repeated, RANGES)
        left = texts.join(_spans(counted), key, "left")
    windows = left.mapInArrow(_by_batch(lambda t: _full_windows(t, min_words), min_words), WINDOWS)
    return texts.join(_spans(windows.repartition("a").sortWithinPartitions("a", "b", "doc_id").mapInArrow(_later, RANGES)), key, "left")


def _gone(n_words: int, copy: bool | None, starts: list[int] | None, sizes: list[int] | None, length: int) -> np.ndarray | None:
    """Which words go; None: none does."""
    if copy and n_words >= length:
        return np.ones(n_words, bool)
    if not starts:
        return None
    edges = np.zeros(n_words + 1, np.int32)
    begin = np.array(starts)
    np.add.at(edges, begin, 1)
    np.add.at(edges, begin + np.array(sizes) // 2 + length - 1, -1)
    return np.cumsum(edges[:-1]) > 0


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _without(text: str, gone: np.ndarray) -> str:
    """text without the words that are gone: what stays between two of them is unchanged."""
    raw = text.encode()
    spans = [m.span() for m in _WORD.finditer(raw)]
    cut = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True])).astype(np.int8)))
    return b"\n".join(raw[spans[a][0] : spans[b - 1][1]] for a, b in cut.reshape(-1, 2).tolist()).decode()


def _tag():
    """Tells different texts of one doc_id from each other."""
    return F.xxhash64("text").alias("tag")


def kept_digests(docs: DataFrame, min_words: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of docs.

    A null text has no words; texts of any length are taken whole; words are
    compared unchanged. Rows with a null doc_id neither remove nor lose
    anything, and rows with equal doc_ids don't remove each other's words. An empty table gives an
    empty result; other columns are not read.
    """
    found = repeated_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _tag(), "text"), min_words)

    def work(b):
        ids, texts, *rest = (b.column(i).to_pylist() for i in range(5))
        n, removed, digests = [], [], []
        for text, copy, starts, sizes in zip(texts, *rest, strict=True):
            words = (text or "").encode().split()
            gone = _gone(len(words), copy, starts, sizes, min_words)
            n.append(len(words))
            removed.append(0 if gone is None else int(gone.sum()))
            kept = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return {"doc_id": ids, "n_words": n, "n_removed": removed, "kept_sha256": digests}

    return common.per_batch(found.select("doc_id", "text", "copy", "starts", "sizes"), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string", work)


def remove_repeats(docs: DataFrame, min_words: int = 13) -> DataFrame:
    """docs with every text without its repeated words. Texts
    that lose nothing are unchanged, null included; kept stretches are
    joined by line feeds. Other columns stay as they are. See kept_digests for the edge cases."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _tag(), "text")
    names = ["text", "copy", "starts", "sizes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for text, *found in zip(*(part.column(n).to_pylist() for n in names), strict=True):
                    gone = _gone(len((text or "").encode().split()), *found, min_words)
                    out.append(text if gone is None else _without(text, gone))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(out, pa.string())], names=["row", "text"])

    schema = T.StructType([row.schema["row"], T.StructField("text", T.StringType())])
    kept = repeated_ranges(row, min_words).select("row", *names).mapInArrow(run, schema)
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
