"""Centroid clustering by plain Lloyd rounds in integers.

Each round the centroids, k rows, reach the tasks with the job. A task takes its
vectors batch by batch: integer squared differences to one centroid after the other,
of which argmin takes the lowest index. A partition gives a count and integer sums for each of its clusters, and a
groupBy merges them, so that a cluster with most of the vectors is k numbers a partition like any other.
The vectors are read again in each round and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import usable

#: Components beyond this have squared distances of over 64 bits.
LARGEST = 1 << 27
#: Vectors whose differences are held at once.
ROWS = 4096


def scaled(rows: list[np.ndarray], scale: float) -> np.ndarray:
    """Vectors as integers: floor(scale * x) of each component as a double."""
    out = np.floor(scale * np.stack(rows).astype(np.float64))
    if np.abs(out).max() > LARGEST:
        raise ValueError(f"a scaled component is over {LARGEST}: squared distances don't fit 64 bits")
    return out.astype(np.int64)


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cluster and squared distance of each point, the smaller number of several."""
    away = np.empty((len(centroids), len(points)), np.int64)
    for i, c in enumerate(centroids):
        d = points - c
        away[i] = np.einsum("ij,ij->i", d, d)
    cluster = away.argmin(axis=0)
    return cluster, away[cluster, np.arange(len(points))]


def _batches(frames: Iterator[pd.DataFrame], scale: float) -> Iterator[tuple[pd.Series, np.ndarray]]:
    for frame in frames:
        for at in range(0, len(frame), ROWS):
            part = frame.iloc[at : at + ROWS]
            yield part["vec_id"], scaled(part["embedding"].tolist(), scale)


def first_centroids(kept: DataFrame, k: int, seed: str, scale: float) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of seed and id, in that order; equal ids by their components.
    A null id is never among them. Fewer than k vectors: all of them."""
    key = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    rows = kept.where("vec_id IS NOT NULL").select(key.alias("h"), "embedding").orderBy("h", "embedding").limit(k).collect()
    return scaled([np.array(r.embedding) for r in rows], scale) if rows else np.empty((0, 0), np.int64)


def lloyd_round(kept: DataFrame, centroids: np.ndarray, scale: float) -> np.ndarray:
    """The centroids after one round: exact floor of the mean of each one's vectors; one without vectors stays."""
    k, dim = centroids.shape

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for _, points in _batches(frames, scale):
            cluster, _ = nearest(points, centroids)
            n += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, points)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": some.astype(np.int32), "n": n[some], "total": list(total[some])})

    parts = kept.mapInPandas(sums, "cluster int, n bigint, total array<bigint>")
    merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dim)])
    out = centroids.copy()
    for r in merged.collect():  # k rows at most
        out[r.cluster] = [r[f"t{i}"] // r.n for i in range(dim)]
    return out


def fit(vectors: DataFrame, k: int, rounds: int, dim: int, scale: float, seed: str) -> np.ndarray:
    """The centroids, k rows of integers, after all rounds. Vectors that don't have dim finite components take no part; each of
    several equal rows counts. Empty if no vector takes part."""
    kept = usable(vectors, dim)
    centroids = first_centroids(kept, k, seed, scale)
    for _ in range(rounds if len(centroids) else 0):
        centroids = lloyd_round(kept, centroids, scale)
    return centroids


ASSIGNED = "vec_id bigint, cluster int, distance bigint"


def assign(vectors: DataFrame, centroids: np.ndarray, dim: int, scale: float) -> DataFrame:
    """(vec_id, cluster, distance) of each vector with dim finite components; a null id stays null."""
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], ASSIGNED)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, points in _batches(frames, scale):
            cluster, distance = nearest(points, centroids)
            yield pd.DataFrame({"vec_id": ids.to_numpy(), "cluster": cluster.astype(np.int32), "distance": distance})

    return usable(vectors, dim).mapInPandas(run, ASSIGNED)


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256, seed: str = "2:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with dim finite components.

    A null vector, one of another length, and one with a null, NaN or infinite component give no row. Repeated rows
    each count and each give a row. A null id is assigned but never a first centroid. Ties go to the smaller
    cluster. An empty table, or one without a usable vector, gives an empty result; other columns are not
    read. Components over 2**27 after scaling raise, as their distances don't fit.
    """
    centroids = fit(vectors, k, rounds, dim, scale, seed)
    rows = assign(vectors, centroids, dim, scale)
    own = dict(rows.groupBy("cluster").agg(F.sum("distance")).collect())  # k rows at most
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = vectors.sparkSession.createDataFrame([(c, inertia, sum(own.values()), names[c]) for c, inertia in own.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: str = "2:") -> str:
    """clusters() of embeddings in DuckDB SQL: a step for each round."""
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        "points AS MATERIALIZED (SELECT r, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM kept)",
        f"firsts AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e FROM (SELECT sha256('{seed}' || CAST(vec_id AS VARCHAR)) AS h, e FROM kept WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT {k}))",
        "c0 AS MATERIALIZED (SELECT c, unnest(e) AS y, generate_subscripts(e, 1) AS i FROM firsts)",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM points JOIN c{n} USING (i) GROUP BY r, c) GROUP BY r)")
        if n < rounds:
            steps.append(f"m{n} AS MATERIALIZED (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN points USING (r) GROUP BY c, i)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce((s - ((s % n) + n) % n) // n, o.y) AS y, o.i FROM c{n} o LEFT JOIN m{n} m ON o.c = m.c AND o.i = m.i)")
    steps.append(f"named AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return "WITH " + ",\n".join(steps) + f" SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN kept USING (r) JOIN named USING (c)"
