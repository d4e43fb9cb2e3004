"""SimHash fingerprints and their near-duplicate components.

Texts that share a fingerprint are one leaf of a binary trie over the 64
bits. The trie is joined with itself: pairs of nodes go down together, the
bits in which they differ are added up, and a pair is pruned when its error
budget is spent. Two fingerprints within 3 bits have a half with one
differing bit at most, so the trie is built twice, with either half first,
and the budget is 1 for the first 32 levels and 3 below.

Spark deals out pairs of subtrees: each fingerprint goes to its own subtree and to the
pairs with those subtrees whose prefix differs in one bit. Subtrees start at a depth
that leaves about LEAVES fingerprints in each; pairs with an overfull subtree
start at level 32 instead, so that no task gets a crowded one whole. A task
keeps a spanning forest of the links it finds, not all pairs. Documents meet their fingerprint's
component by a join that broadcasts the fingerprints of many copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

#: Fingerprints to aim at in a subtree, and what makes one overfull.
LEAVES, OVERFULL = 1024, 8192
HALF = 32
#: Differing bits that link two fingerprints, and how many of them the first half may have.
BUDGET, FIRST_HALF = 3, 1


def fingerprint(words: list[bytes], shingle: int) -> np.ndarray:
    """The hashes that vote: XXH64 with seed 42 of each shingle, repeats included."""
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(min(shingle, len(words))))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)


def vote(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint for each array of hashes: a bit is 1 if over half have it. No hashes: 0."""
    sizes = np.array([len(h) for h in hashes])
    out = np.zeros(len(hashes), np.uint64)
    if sizes.any():
        some = np.flatnonzero(sizes)
        bits = np.unpackbits(np.concatenate(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > sizes[some, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp bigint). A-Z are lower-cased; a text with fewer words than
    a shingle is one shingle; a null text or one without words has 0."""

    def work(batch):
        hashes = [fingerprint(t.encode().lower().split(), shingle) for t in common.texts_of(batch)]
        return {"doc_id": batch.column(0), "fp": vote(hashes).view(np.int64)}

    return common.per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id bigint, fp bigint", work)


CELLS = "tag int, cell bigint, key bigint"


def _cells(fp: np.ndarray, depth: int, crowded: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(tag, low prefix, high prefix, key) of every pair of subtrees that fp goes to; tag is 64 * order + depth."""
    for order in (0, 1):
        key = fp if order == 0 else (fp << np.uint64(32)) | (fp >> np.uint64(32))
        own, deep = (key >> np.uint64(64 - d) if d else np.zeros_like(key) for d in (depth, HALF))
        full = np.isin(own, crowded[order])
        yield 64 * order + depth, own[~full], own[~full], key[~full]
        yield 64 * order + HALF, deep[full], deep[full], key[full]
        for bit in range(depth):
            near = own ^ np.uint64(1 << bit)
            split = full | np.isin(near, crowded[order])
            a, b = own[~split], near[~split]
            yield 64 * order + depth, np.minimum(a, b), np.maximum(a, b), key[~split]
            a = deep[split]
            b = a ^ np.uint64(1 << (HALF - depth + bit))
            yield 64 * order + HALF, np.minimum(a, b), np.maximum(a, b), key[split]
        for bit in range(HALF - depth):
            a = deep[full]
            b = a ^ np.uint64(1 << bit)
            yield 64 * order + HALF, np.minimum(a, b), np.maximum(a, b), key[full]


def trie_join(keys: np.ndarray, lo1, hi1, lo2, hi2, errors, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of keys within the budget. keys: sorted within each node;
    the first pairs of nodes are the ranges lo1:hi1 and lo2:hi2 at `depth`,
    whose prefixes differ in `errors` bits; equal ranges are joined with themselves."""
    found = []
    stack = [(depth, lo1, hi1, lo2, hi2, errors)]
    while stack:
        depth, lo1, hi1, lo2, hi2, errors = stack.pop()
        small = ((hi1 - lo1) * (hi2 - lo2) <= 16) | (depth == 64)
        if small.any():
            a, b, c, d = (x[small] for x in (lo1, hi1, lo2, hi2))
            n = (b - a) * (d - c)
            at = np.repeat(np.arange(len(n)), n)
            t = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            i, j = a[at] + t // (d - c)[at], c[at] + t % (d - c)[at]
            once = (a[at] != c[at]) | (i < j)
            i, j = i[once], j[once]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= BUDGET
            found.append((i[near], j[near]))
            lo1, hi1, lo2, hi2, errors = (x[~small] for x in (lo1, hi1, lo2, hi2, errors))
        if not len(lo1):
            continue
        if len(lo1) > 1 << 18:
            half = len(lo1) // 2
            stack += [(depth, *(x[s] for x in (lo1, hi1, lo2, hi2, errors))) for s in (slice(half), slice(half, None))]
            continue
        ones = np.concatenate(([0], np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)))
        m1, m2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
        other = lo1 != lo2
        children = ((lo1, m1, lo2, m2, errors), (m1, hi1, m2, hi2, errors), (lo1, m1, m2, hi2, errors + 1), tuple(x[other] for x in (m1, hi1, lo2, m2, errors + 1)))
        lo1, hi1, lo2, hi2, errors = (np.concatenate(x) for x in zip(*children, strict=True))
        alive = (lo1 < hi1) & (lo2 < hi2) & (errors <= (FIRST_HALF if depth < HALF else BUDGET)) & ((lo1 != lo2) | (hi1 - lo1 > 1))
        stack.append((depth + 1, *(x[alive] for x in (lo1, hi1, lo2, hi2, errors))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each value to the smallest that links a, b lead to."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links_of(tag: np.ndarray, cell: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within whole cells; fingerprints as they are in order 0."""
    out_a, out_b = [], []
    for t in np.unique(tag):
        depth, (c, k) = int(t) % 64, (x[tag == t].view(np.uint64) for x in (cell, key))
        rank = np.lexsort((k, c))
        c, k = c[rank], k[rank]
        first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        last = np.append(first[1:], len(c))
        low, high = c[first] >> np.uint64(32), c[first] & np.uint64(0xFFFFFFFF)
        prefix = k >> np.uint64(64 - depth) if depth else np.zeros_like(k)
        in_low = np.concatenate(([0], np.cumsum(prefix == np.repeat(low, last - first))))
        middle = first + in_low[last] - in_low[first]
        same = low == high
        lo2 = np.where(same, first, middle)
        some = (middle > first) & (last > lo2) & (~same | (last - first > 1))
        args = first[some], np.where(same, last, middle)[some], lo2[some], last[some], np.where(same, 0, 1)[some]
        i, j = trie_join(k, *args, depth)
        back = (lambda x: x) if t < 64 else (lambda x: (x << np.uint64(32)) | (x >> np.uint64(32)))
        out_a.append(back(k[i]))
        out_b.append(back(k[j]))
    return forest(np.concatenate(out_a), np.concatenate(out_b))


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between the distinct values of fps(fp) that leave the
    same components as all links within BUDGET bits do."""
    n = fps.count()
    depth = min(HALF, max(0, math.ceil(math.log2(max(n, 1) / LEAVES))))
    limit = max(OVERFULL, n // 50_000)  # so there are 50,000 overfull subtrees at most
    crowded = {0: [], 1: []}
    if depth:
        halves = fps.select(F.posexplode(F.array(F.shiftrightunsigned("fp", 64 - depth), F.shiftrightunsigned(F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32)), 64 - depth))).alias("o", "prefix"))
        for r in halves.groupBy("o", "prefix").count().where(F.col("count") > limit).collect():
            crowded[r.o].append(r.prefix)
    crowded = {o: np.array(v, np.uint64) for o, v in crowded.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for tag, low, high, key in _cells(fp, depth, crowded):
                if len(key):
                    cell = (low << np.uint64(32)) | high
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), tag, np.int32)), pa.array(cell.view(np.int64)), pa.array(key.view(np.int64))], schema=common.arrow_schema(CELLS))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, rows = [], 0
        for batch in _ended(batches):
            if batch is not None:
                rest.append(tuple(batch.column(i).to_numpy() for i in range(3)))
                rows += batch.num_rows
                if rows < 1 << 16:
                    continue
            if not rest:
                return
            tag, cell, key = (np.concatenate(x) for x in zip(*rest, strict=True))
            end = len(tag)
            if batch is not None:  # the last cell may go on
                others = np.flatnonzero((tag != tag[-1]) | (cell != cell[-1]))
                end = others[-1] + 1 if len(others) else 0
            rest = [(tag[end:], cell[end:], key[end:])] if end < len(tag) else []
            rows = 0  # a cell of any size gets whole before it is joined
            if end:
                a, b = _links_of(tag[:end], cell[:end], key[:end])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    cells = fps.select("fp").mapInArrow(deal, CELLS)
    return cells.repartition("tag", "cell").sortWithinPartitions("tag", "cell").mapInArrow(join, "a bigint, b bigint").distinct()


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _component_ids(each: DataFrame) -> DataFrame:
    """(fp, n, component_id) of every fingerprint in each(doc_id, fp), n: its rows."""
    nodes = common.checkpointed(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = connected_components(links(nodes))
    grouped = nodes.join(roots, nodes.fp == roots.node)
    least = grouped.groupBy("root").agg(F.min("least").alias("least"))
    ids = common.checkpointed(roots.join(least, "root").select(F.col("node").alias("fp"), F.col("least").alias("joined")))
    return common.stored(nodes.join(ids, "fp", "left").select("fp", "n", F.coalesce("joined", "least").alias("component_id")), "components")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    component_id is the smallest doc_id of a component. Texts without words
    (null, empty) have fingerprint zero and are linked like any other; texts
    of any length are taken whole. Repeated rows each get a row; a null
    doc_id stays null and gets its component's smallest doc_id that isn't, null if
    there is none. An empty table gives an empty result; other columns are
    not read.
    """
    each = common.stored(fingerprints(docs, shingle), "fingerprints")
    return common.spread_join(each, _component_ids(each), ["fp"], "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component. Rows
    that repeat that doc_id all stay; rows with a null doc_id stay too, as nothing tells
    them apart. Other edge cases as in near_duplicates()."""
    each = common.stored(fingerprints(docs, shingle), "fingerprints")
    ids = common.spread_join(each, _component_ids(each), ["fp"], "n").where("doc_id != component_id").select("doc_id", "fp").distinct()
    dropped = common.stored(ids, "dropped")
    # Texts of one doc_id are told apart by fingerprint, which only they need again.
    twice = common.stored(each.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count_distinct("fp").alias("n")).where("n > 1").select("doc_id"), "several")
    out = docs.join(dropped.join(twice, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    return out if twice.isEmpty() else _without(out, twice, dropped, shingle)


def _without(docs: DataFrame, several: DataFrame, dropped: DataFrame, shingle: int) -> DataFrame:
    """docs without the rows whose doc_id is in several and whose (doc_id, fingerprint) is in dropped."""
    many = docs.join(several, "doc_id", "left_semi").select(docs.columns)
    texts = many.select("doc_id", "text").distinct()
    by_text = texts.select(F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("tag"))
    fp = common.per_batch(by_text.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "tag"), "doc_id bigint, tag bigint, fp bigint", lambda b: {"doc_id": b.column(0), "tag": b.column(2), "fp": vote([fingerprint(t.encode().lower().split(), shingle) for t in common.texts_of(b)]).view(np.int64)})
    gone = common.stored(fp.join(dropped, ["doc_id", "fp"]).select(F.col("doc_id").alias("gone_id"), F.col("tag").alias("gone_tag")).distinct(), "gone")
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_tag"]), "left_anti").select(docs.columns)
