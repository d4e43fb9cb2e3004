"""Ranked search, score at a time over postings in the order of their impact.

The items are a stated query set; they are taken in blocks of a bounded size, one after the other, against all documents.
For a block the documents are read once: what is kept of each is its length and how often it has each
of the block's terms, written to the shared folder. Numbers of documents, of terms, and of documents with a term come from
that, and with them each posting's exact impact.

A task turns its documents, a chunk at a time, into postings by term and falling impact. An item takes
the groups of equal impact of all its terms in bands of falling contributions and adds them up for
each document. What is left of a document is at most the sum of the terms' next contributions. Once that sum
is below the item's k-th score no other document can come in; those that still can are then scored in
full through their own rows, and the others are left. The k-th scores start from those in a sample of about
SAMPLED documents, which are never above the true ones, so that a partition gives few rows to the merge.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Items' text in one block, in bytes; postings and documents that a task holds at once; documents of the sample, about.
BLOCK_BYTES, POSTINGS, DOCUMENTS, SAMPLED = 4 << 20, 1 << 20, 16_384, 20_000
#: Stands for a null doc_id, behind all others.
NO_ID = np.iinfo(np.int64).max

#: Letters A-Z become small ones, other ASCII signs that aren't letters or digits become spaces; all other bytes stay.
_LOWER = bytes((b | 0x20) if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms_of(text: str | bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of any signs beyond ASCII; only A-Z are lower-cased."""
    return (text.encode() if isinstance(text, str) else text or b"").translate(_LOWER).split()


def weight(documents: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1)))


def _blocks(items: DataFrame) -> tuple[int, Iterator[list[tuple]]]:
    """How many, and the items in lists of at most about BLOCK_BYTES of text, of which the driver holds one at a time. Equal rows are one."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = total // BLOCK_BYTES + 1
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return n, ([(r.item_id, Counter(terms_of(r.text))) for r in rows.where(key == b).collect()] for b in range(n))


FORWARD = "doc_id bigint, n bigint, terms array<int>, tfs array<int>"


def forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: how many it has, which of the vocabulary, and how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batch: pa.RecordBatch) -> dict:
        find, n, lengths, terms, tfs = shared.value.get, [], [0], [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            words = terms_of(text)
            counts = Counter(map(find, words))
            counts.pop(None, None)
            n.append(len(words))
            terms += counts.keys()
            tfs += counts.values()
            lengths.append(len(terms))
        lists = [pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
        return {"doc_id": batch.column(0), "n": n, "terms": lists[0], "tfs": lists[1]}

    return common.per_batch(common.pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long")), FORWARD, work).where("n > 0")


class Chunk:
    """Some documents' postings: by document as they come, and by term with the highest impact first."""

    def __init__(self, offsets: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int):
        self.offsets, self.terms, self.impacts = offsets, terms, impacts
        docs = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        order = np.lexsort((-impacts, terms))
        self.docs, self.falling = docs[order], -impacts[order]
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def whole(self, docs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Scores of documents through their own rows; times: how often the item has each term."""
        sizes = self.offsets[docs + 1] - self.offsets[docs]
        at = np.repeat(self.offsets[docs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        sums = np.r_[0, np.cumsum(times[self.terms[at]] * self.impacts[at])]
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]

    def search(self, item: dict[int, int], times: np.ndarray, k: int, needed: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of those that score `needed`, at least 1, or more, but for such as k others of the chunk beat; times holds
        the item as an array."""
        at = np.array([self.starts[t] for t in item])
        end = np.array([self.starts[t + 1] for t in item])
        often = np.array(list(item.values()), np.int64)
        left = lambda: np.where(at < end, often * -self.falling[np.minimum(at, len(self.falling) - 1)], 0)
        ahead = left() if len(self.falling) else np.zeros(len(at), np.int64)
        if ahead.sum() < needed:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found = np.zeros(len(self.offsets) - 1, np.int64)
        while True:
            rest = int(ahead.sum())
            if rest < needed or not rest:  # no document that wasn't met can come in
                docs = np.flatnonzero((found > 0) & (found + rest >= needed))
                if not rest:
                    return docs, found[docs]
                if (self.offsets[docs + 1] - self.offsets[docs]).sum() <= (end - at).sum():
                    scores = self.whole(docs, times)
                    return docs[scores >= needed], scores[scores >= needed]
            band = int(ahead.max()) // 2  # contributions above it are next; groups of equal impact stay together
            for i in np.flatnonzero(ahead > band):
                o = int(often[i])
                to = at[i] + np.searchsorted(self.falling[at[i] : end[i]], -(band // o), side="left")
                found[self.docs[at[i] : to]] -= o * self.falling[at[i] : to]
                at[i] = to
            ahead = left()
            if len(found) >= k:
                needed = max(needed, int(np.partition(found, -k)[-k]))


class _Top:
    """An item's k best documents so far: equal scores by ascending id."""

    def __init__(self, k: int, needed: int):
        self.k, self.needed = k, max(needed, 1)
        self.ids = self.scores = np.empty(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.needed = max(self.needed, int(self.scores[-1]))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most DOCUMENTS documents and, if they have more than one, about POSTINGS postings."""
    for batch in batches:
        ends, at = np.cumsum(batch.column(2).value_lengths().to_numpy()), 0
        while at < batch.num_rows:
            limit = (ends[at - 1] if at else 0) + POSTINGS
            to = max(at + 1, min(at + DOCUMENTS, int(np.searchsorted(ends, limit, side="right"))))
            yield batch.slice(at, to - at)
            at = to


def _best(rows: DataFrame, index, needed: list[int], k: int) -> DataFrame:
    """(item, item_id, doc_id, score): each partition's best documents of each item of a broadcast block that reach `needed`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, documents, length = index.value
        top = [_Top(k, x) for x in needed]
        times = np.zeros(len(weights), np.int64)
        for part in _chunks(batches):
            n = part.column(1).to_numpy()
            sizes = part.column(2).value_lengths().to_numpy()
            offsets = np.r_[0, np.cumsum(sizes)]
            terms, tfs = (part.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            m = 25 + (75 * documents * n) // length
            impacts = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * np.repeat(m, sizes)))
            chunk, ids = Chunk(offsets, terms, impacts, len(weights)), part.column(0).fill_null(NO_ID).to_numpy()
            for (_, item), best in zip(items, top, strict=True):
                if item:
                    which = np.fromiter(item, np.int64, len(item))
                    times[which] = np.fromiter(item.values(), np.int64, len(item))
                    docs, scores = chunk.search(item, times, k, best.needed)
                    times[which] = 0
                    if len(docs):
                        best.add(ids[docs], scores)
        at = np.repeat(np.arange(len(items)), [len(x.ids) for x in top])
        ids, scores = (np.concatenate([getattr(x, name) for x in top] or [np.empty(0, np.int64)]) for name in ("ids", "scores"))
        names = pa.array([items[i][0] for i in at], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), names, pa.array(ids, mask=ids == NO_ID), pa.array(scores)], names=["item", "item_id", "doc_id", "score"])

    return rows.mapInArrow(run, "item bigint, item_id bigint, doc_id bigint, score bigint")


def _block_results(docs: DataFrame, block: list[tuple], k: int, sampled: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of one block of items."""
    context = docs.sparkSession.sparkContext
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
    rows = common.stored(forward(docs, vocabulary), "postings")
    documents, length = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    having = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    weights = np.zeros(len(vocabulary), np.int64)
    for t, df in having.collect():  # at most the block's terms
        weights[t] = weight(documents, df)
    items = [(i, {vocabulary[t]: c for t, c in terms.items() if weights[vocabulary[t]]}) for i, terms in block]
    index = context.broadcast((items, weights, documents, length))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order))
    needed = [1] * len(items)
    if documents > sampled:
        for item, score in ranked(_best(rows.sample(sampled / documents, seed=1), index, needed, k)).where(F.col("rank") == k).select("item", "score").collect():  # a row an item of the block
            needed[item] = score
    return ranked(_best(rows, index, needed, k)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, sampled: int = SAMPLED) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents with the highest scores above 0, equal scores by ascending doc_id.

    Terms, weights and scores are whole numbers as in the module's weight() and Chunk. A null or empty text has no terms: such
    a document counts nowhere, such an item has no rows. Repeated rows of documents each count and are ranked each; a null doc_id ranks
    behind equal scores and stays null. Equal rows of items are one item; rows of one item_id with different texts are ranked each,
    and so is a null item_id. Texts of any length are read whole. Empty tables give an empty result; other columns are not read.
    """
    n, blocks = _blocks(items)
    out = docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in blocks:
        if any(terms for _, terms in block):
            found = _block_results(docs, block, k, sampled)
            if n == 1:
                return found
            out = out.unionByName(common.stored(found, "ranked"))  # so that one block's broadcasts live at a time
    return out


def sql(k: int = 10) -> str:
    """rank() of documents for benchmark in DuckDB SQL."""
    terms = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {terms} AS t FROM documents),
        s AS MATERIALIZED (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
        total AS MATERIALIZED (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM s),
        i AS MATERIALIZED (SELECT row_number() OVER () AS q, item_id, {terms} AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
        asked AS MATERIALIZED (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
        p AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
        w AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, total GROUP BY term),
        impacts AS MATERIALIZED (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // len))) AS impact FROM p JOIN w USING (term) JOIN s USING (r), total),
        scored AS (SELECT q, item_id, r, CAST(sum(times * impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY ALL)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored JOIN s USING (r) WHERE score > 0) WHERE rank <= {k}"""
