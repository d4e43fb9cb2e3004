"""Exact search for the vectors with the greatest inner products, block by block.

A stated query set is taken in blocks of a bounded size, which are broadcast one after the other. A task cuts its
vectors, in the order they are stored in, into ranges of BLOCK. A range has the greatest and the least value of
each component, and a forward index, its vectors as a matrix. A query's bound for a range is the sum over components of
its weight times the greatest value, or the least for a negative weight: no vector of the range scores more. Each query takes
the ranges by falling bounds and scores whole ranges through their matrices until the next bound is below its k-th score.

The k-th scores start from those in a sample of about SAMPLED vectors; as the sample is part of the
table, a k-th score in it is never above the true one. It decides how soon a range is left, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .vectors import matrix, usable

#: Vectors in a range; ranges' vectors that a task holds at once; queries in a broadcast block and in a step; vectors of the sample, about.
BLOCK, CHUNK, QUERIES, STEP, SAMPLED = 256, 16_384, 32_768, 2048, 16_384
#: Whole numbers up to here are exact as doubles.
EXACT = 1 << 53
UNSET = np.iinfo(np.int64).min


def scaled(rows: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles with whole values."""
    return np.floor(scale * rows)


class _Best:
    """Each query's k best vectors so far, and the score that another one needs: the k-th, or the sample's."""

    def __init__(self, k: int, floors: np.ndarray):
        self.k, self.needed = k, floors.copy()
        self.query = self.ids = self.scores = np.empty(0, np.int64)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        query, ids, scores = (np.concatenate(x) for x in ((self.query, query), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, np.int64)
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        last = place == self.k - 1
        self.needed[query[last]] = np.maximum(self.needed[query[last]], scores[last])
        keep = place < self.k
        self.query, self.ids, self.scores = query[keep], ids[keep], scores[keep]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact: as doubles where they fit, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return a @ b.T
    if most >= 2.0**63:
        raise OverflowError("inner products don't fit 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def search_blocks(best: _Best, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, block: int = BLOCK) -> int:
    """Puts what of the vectors is among the queries' best into best. How many pairs of query and range were scored."""
    cuts = np.arange(0, len(rows), block)
    high, low = np.maximum.reduceat(rows, cuts), np.minimum.reduceat(rows, cuts)
    scored = 0
    for at in range(0, len(queries), STEP):
        own, mine = queries[at : at + STEP], query_ids[at : at + STEP]
        bounds = _products(np.maximum(own, 0), high) + _products(np.minimum(own, 0), low)
        order = np.argsort(-bounds, axis=1, kind="stable")
        for step in range(len(cuts)):
            target = order[:, step]
            alive = np.flatnonzero(bounds[np.arange(len(own)), target] >= best.needed[at : at + STEP])
            if not len(alive):
                break
            scored += len(alive)
            found = []
            alive = alive[np.argsort(target[alive], kind="stable")]
            for group in np.split(alive, np.flatnonzero(np.diff(target[alive])) + 1):
                b = int(target[group[0]]) * block
                there = ids[b : b + block]
                scores = _products(own[group], rows[b : b + block]).astype(np.int64)
                other = there[None, :] != mine[group][:, None]
                needed = best.needed[at + group]
                if (needed == UNSET).any() and scores.shape[1] > best.k:
                    needed = np.maximum(needed, np.partition(np.where(other, scores, UNSET), -best.k, axis=1)[:, -best.k])
                hit, place = np.nonzero(other & (scores >= needed[:, None]))
                found.append((at + group[hit], there[place], scores[hit, place]))
            best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))
    return scored


def _chunks(batches: Iterator[pa.RecordBatch], width: int, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of CHUNK vectors at most."""
    ids, rows, n = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            if n + part.num_rows > CHUNK and n:
                yield np.concatenate(ids), np.concatenate(rows)
                ids, rows, n = [], [], 0
            ids.append(part.column(0).to_numpy())
            rows.append(scaled(matrix(part.column(1), width), scale))
            n += part.num_rows
    if n:
        yield np.concatenate(ids), np.concatenate(rows)


def _found(rows: DataFrame, queries, floors: np.ndarray, k: int, scale: float) -> DataFrame:
    """(query, query_id, vec_id, score): each partition's best vectors of each query of a broadcast block that reach its floor."""
    shared = rows.sparkSession.sparkContext.broadcast(floors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = queries.value
        vectors = vectors.astype(np.float64)
        best = _Best(k, shared.value)
        for there, part in _chunks(batches, vectors.shape[1], scale):
            search_blocks(best, ids, vectors, there, part)
        yield pa.RecordBatch.from_arrays([pa.array(best.query), pa.array(ids[best.query]), pa.array(best.ids), pa.array(best.scores)], names=["query", "query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query bigint, query_id bigint, vec_id bigint, score bigint")


def _block_results(rows: DataFrame, sample: DataFrame, block: list, k: int, scale: float) -> DataFrame:
    """The best of all rows for one block of queries."""
    spark = rows.sparkSession
    ids, width = np.array([r.vec_id for r in block], np.int64), max(len(r.embedding) for r in block)
    vectors = scaled(matrix(pa.array([r.embedding for r in block], pa.list_(pa.float64())), width), scale)
    small = np.abs(vectors).max(initial=0) < 2**15
    queries = spark.sparkContext.broadcast((ids, vectors.astype(np.int16) if small else vectors))
    best, floors = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"), np.full(len(ids), UNSET, np.int64)
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best))
    for query, score in ranked(_found(sample, queries, floors, k, scale)).where(F.col("rank") == k).select("query", "score").collect():  # a row a query of the block
        floors[query] = score
    return ranked(_found(rows, queries, floors, k, scale)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64, sampled: int = SAMPLED, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector that is_query chooses, by vec_id, the k others with the greatest inner products
    of components floor(scale * x); equal scores by ascending vec_id.

    Null vectors, those with a null, NaN or infinite component, and rows without an id take no part. A query is never compared with rows of its
    own id. Of several equal rows each is a candidate, but they are one query; rows of one id with different vectors are a query each. A vector that is shorter than another
    counts as ending in zeros. Fewer candidates than k give fewer rows, an empty table an empty result; other columns are not read. Scores that
    don't fit 64 bits raise.
    """
    rows = usable(vectors).where("vec_id IS NOT NULL")
    asked = rows.where(is_query).distinct()
    n, total = asked.count(), rows.count()
    sample = rows.sample(sampled / total, seed=1) if total > sampled else rows
    blocks = n // block + 1
    key = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks))
    out = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    for b in range(blocks):
        if got := asked.where(key == b).collect():  # a bounded block
            part = _block_results(rows, sample, got, k, scale)
            if blocks == 1:
                return part
            out = out.unionByName(common.stored(part, "top-k"))  # so that one block's broadcasts live at a time
    return out


def sql(every: int = 20, k: int = 20, scale: int = 64) -> str:
    """top_k() of embeddings in DuckDB SQL."""
    return f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""
