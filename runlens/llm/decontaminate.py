"""Benchmark passages in documents.

The items of a benchmark are a stated query set; they are taken in blocks of a
bounded size, one after the other, against all documents. A document's windows of an item's length
that can be similar enough are those that share enough shingles with items of that length: at similarity
SIMILARITY two equally long windows have at least 2 * SIMILARITY / (1 + SIMILARITY) of their shingles
in common. Those windows get SimHash fingerprints of their shingles. Multi-index Hamming search
finds all items within RADIUS bits of a window: of 4 blocks of 16 bits one
differs in RADIUS // 4 bits at most, so the block values that near are looked up in sorted tables of the items' blocks. The similarity of weighted shingles, each weighing
as often as it occurs, then decides exactly.

A document of fewer words than an item is one window.

At similarity 0.8 fingerprints differ in 10 bits
on average with a deviation of 3, so that RADIUS leaves three deviations; recall() measures it.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .simhash_dedup import vote
from .substring_dedup import _hashes, window_hashes

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 19
#: Items' text in one block, in bytes; it is broadcast and indexed.
BLOCK_BYTES = 16 << 20

_WORDS = re.compile(r"\w+").findall


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and underscores."""
    return [w.encode() for w in _WORDS((text or "").lower())]


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


#: All differences of two blocks of 16 bits that a fingerprint within RADIUS has in one block at least.
_NEAR = np.array([sum(1 << i for i in bits) for n in range(RADIUS // 4 + 1) for bits in combinations(range(16), n)], np.uint64)


class _Size:
    """The items of one number of words: their shingles, fingerprints and the sorted blocks of those."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.weights = [Counter(s.tolist()) for _, s in items]
        self.known = np.unique(np.concatenate([s for _, s in items]))
        self.fps = vote([s for _, s in items])
        self.tables = []
        for b in range(4):
            value = self.fps >> np.uint64(16 * b) & np.uint64(0xFFFF)
            order = np.argsort(value, kind="stable")
            self.tables.append((value[order], order))

    def near(self, fp: np.uint64) -> list[int]:
        """The items whose fingerprints are within RADIUS bits."""
        found = []
        for b, (values, order) in enumerate(self.tables):
            probes = (fp >> np.uint64(16 * b) & np.uint64(0xFFFF)) ^ _NEAR
            low, high = np.searchsorted(values, probes), np.searchsorted(values, probes, side="right")
            found += [order[a:z] for a, z in zip(low[high > low].tolist(), high[high > low].tolist(), strict=True)]
        at = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return at[np.bitwise_count(self.fps[at] ^ fp) <= RADIUS].tolist()


class _Index:
    """Items by their number of words."""

    def __init__(self, items: list[tuple[int, str]]):
        groups = defaultdict(list)
        for item_id, text in items:
            if words := words_of(text):
                groups[len(words)].append((item_id, window_hashes(_hashed(words), min(SHINGLE, len(words)))))
        self.by_size = {size: _Size(group) for size, group in sorted(groups.items())}
        every = {k: [g.known for size, g in self.by_size.items() if min(SHINGLE, size) == k] for k in range(1, SHINGLE + 1)}
        self.known = {k: np.unique(np.concatenate(x)) for k, x in every.items() if x}

    def matches(self, docs: list[np.ndarray]) -> dict[int, list[tuple[int, int, int, float]]]:
        """document's place -> (item_id, first word, words, similarity), the best for each item."""
        out: dict[int, dict] = defaultdict(dict)
        lengths = np.array([len(d) for d in docs], np.int64)
        ends = np.cumsum(lengths)
        words = np.concatenate(docs) if len(docs) else np.empty(0, np.uint64)
        seen: dict[int, tuple] = {}  # a shingle's length -> all shingles, places of those that any item has, their documents
        for k, known in self.known.items():
            if len(words) >= k:
                shingles = window_hashes(words, k)
                hits = np.flatnonzero(known[np.minimum(np.searchsorted(known, shingles), len(known) - 1)] == shingles)
                doc = np.searchsorted(ends, hits, side="right")
                inside = hits + k <= ends[doc]
                seen[k] = shingles, hits[inside], doc[inside]
        for size, group in self.by_size.items():
            k = min(SHINGLE, size)
            if k not in seen:
                continue
            shingles, hits, doc = seen[k]
            here = group.known[np.minimum(np.searchsorted(group.known, shingles[hits]), len(group.known) - 1)] == shingles[hits]
            hits, doc = hits[here], doc[here]
            for d in np.unique(doc).tolist():
                begin, end, n = int(ends[d] - lengths[d]), int(ends[d]), size - k + 1
                mine = hits[doc == d]
                length = min(size, end - begin)
                m = length - k + 1
                least = math.ceil(SIMILARITY * (n + m) / (1 + SIMILARITY) - 1e-9)  # shingles in common
                if least <= min(m, n):
                    starts = self._starts(mine, least, m, begin, end - length)
                    self._verify(out[d], shingles, starts, group, n, m, begin, length)
        return {d: [(i, s, n, sim) for i, (sim, s, n) in sorted(best.items(), key=str)] for d, best in out.items() if best}

    @staticmethod
    def _starts(hits: np.ndarray, least: int, m: int, begin: int, last: int) -> np.ndarray:
        """The windows of m shingles, from begin to last, that `least` of the hits are in."""
        if len(hits) < least:
            return np.empty(0, np.int64)
        low = np.maximum(hits[least - 1 :] - m + 1, begin)
        high = np.minimum(hits[: len(hits) - least + 1], last)
        spans = [np.arange(a, b + 1) for a, b in zip(low.tolist(), high.tolist(), strict=True) if a <= b]
        return np.unique(np.concatenate(spans)) if spans else np.empty(0, np.int64)

    @staticmethod
    def _verify(best: dict, shingles: np.ndarray, starts: np.ndarray, group: _Size, n: int, m: int, begin: int, length: int) -> None:
        """Windows of `length` words, m shingles, against the items of n shingles."""
        for at in range(0, len(starts), 1024):
            part = starts[at : at + 1024]
            windows = shingles[part[:, None] + np.arange(m)]
            for row, fp in enumerate(vote(list(windows))):
                have = None
                for i in group.near(fp):
                    have = have or Counter(windows[row].tolist())
                    shared = sum(min(c, have[h]) for h, c in group.weights[i].items() if h in have)
                    similarity, start, item_id = shared / (m + n - shared), int(part[row]) - begin, group.ids[i]
                    if similarity >= SIMILARITY and (item_id not in best or (similarity, -start) > (best[item_id][0], -best[item_id][1])):
                        best[item_id] = (similarity, start, length)


def recall(pairs: list[tuple[list[bytes], list[bytes]]]) -> float:
    """The part of the pairs of equally long word lists with SIMILARITY or more whose fingerprints are within RADIUS bits."""
    shingles = [tuple(window_hashes(_hashed(w), min(SHINGLE, len(w))) for w in pair) for pair in pairs]
    near = []
    for a, b in shingles:
        shared = sum((Counter(a.tolist()) & Counter(b.tolist())).values())
        if shared >= SIMILARITY * (len(a) + len(b) - shared):
            x, y = vote([a, b])
            near.append((int(x) ^ int(y)).bit_count() <= RADIUS)
    return sum(near) / len(near) if near else 1.0


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of at most about BLOCK_BYTES of text, of which the driver holds one at a time."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = total // BLOCK_BYTES + 1
    key = F.pmod(F.xxhash64("text"), F.lit(n))
    for b in range(n):
        yield [tuple(r) for r in rows.where(key == b).distinct().collect()]


_indexes: dict[int, tuple[list, _Index]] = {}


def _index(items: list) -> _Index:
    """This worker's index of a broadcast block."""
    if id(items) not in _indexes:
        _indexes.clear()
        _indexes[id(items)] = items, _Index(items)
    return _indexes[id(items)][1]


MATCHES = "doc_id bigint, item_id bigint, start bigint, n_words bigint, similarity double"


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): for each document and each
    item that it contains, the most similar window of the item's length, the
    first of equals. A document of fewer words is one window itself.

    Null or empty texts and items without words match nothing. An item of
    fewer words than a shingle is one shingle. Texts of any length are
    searched whole; repeated rows of docs give repeated matches, repeated items
    one. A null doc_id stays null. Empty tables give an empty result; other
    columns are not read.
    """
    names = [c.split()[0] for c in MATCHES.split(", ")]

    def search(block: list) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def work(batch):
            ids = batch.column(0).to_pylist()
            found = _index(shared.value).matches([_hashed(words_of(t)) for t in batch.column(1).to_pylist()])
            rows = [(ids[d], *m) for d in sorted(found) for m in found[d]]
            return dict(zip(names, map(list, zip(*rows)), strict=True)) if rows else None

        return common.per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), MATCHES, work)

    blocks = _blocks(items)
    out, more = search(next(blocks)), next(blocks, None)
    if more is not None:  # each block is searched and stored before the next one is read
        out = common.stored(out, "matches")
    while more is not None:
        out = out.unionByName(common.stored(search(more), "matches"))
        more = next(blocks, None)
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, with docs' columns, that contain no item. Edge cases as in find()."""
    for block in _blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        place = docs.columns.index("text")

        def run(batches, shared=shared):
            import pyarrow as pa

            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    found = _index(shared.value).matches([_hashed(words_of(t)) for t in part.column(place).to_pylist()])
                    yield part.filter(pa.array([d not in found for d in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
