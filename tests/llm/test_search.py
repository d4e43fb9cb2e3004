"""Lexical search, centroid clusters and vector search against plain Python, on the given
tables and on rows with nulls, ties, repeats, odd lengths and clashing columns."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from runlens.llm import centroid_clusters, common, lexical_search, queries, vector_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = [(None, "river stone river", "a"), (3, None, "b"), (4, "", "c"), (5, "... !!", "d"), (6, "River-STONE_river\x7fmoon", "e"), (6, "River-STONE_river\x7fmoon", "e"), (2, "river stone", "f"), (1, "river stone", "g"), (7, "Éclair éclair straße 日本 river", "h"), (8, "moon " * 30_000 + "river", "i"), (9, "x1 2y", "j")]
ITEMS = [(1, "River river STONE unknownterm"), (1, "moon"), (None, "éclair Éclair 日本"), (2, None), (3, ""), (4, "neverseen"), (5, "2Y x1 x1"), (5, "2Y x1 x1"), (6, "river " * 50 + "moon")]


def ranked(docs, items, k):
    """item text -> [(rank, doc_id, score)] by the definition."""
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    rows = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    n_docs, length, df = len(rows), sum(n for *_, n in rows), Counter(t for _, c, _ in rows for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}
    out = Counter()
    for item_id, text in set(items):
        want, scores = Counter(terms(text)), []
        for d, c, n in rows:
            m = 100 - 75 + (75 * n * n_docs) // length
            if score := sum(x * w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, x in want.items() if t in c):
                scores.append((-score, d is None, d))
        for i, (score, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k]):
            out[item_id, i + 1, d, -score] += 1
    return out


def result(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("k", [1, 10])
def test_lexical_search(spark, sf, k, monkeypatch):
    own = [tuple(r) for r in common.table(spark, sf, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in common.table(spark, sf, "benchmark").select("item_id", "text").collect()] + ITEMS
    odd = spark.createDataFrame([(*r, 1, "clash", 2, 3) for r in DOCS], "doc_id long, text string, item_id string, n int, terms string, score int, rank int")
    docs = common.table(spark, sf, "documents").select("doc_id", "text").unionByName(odd, allowMissingColumns=True).repartition(3)
    asked = spark.createDataFrame([(*r, 9) for r in items], "item_id long, text string, doc_id int")
    want = ranked(own + [r[:2] for r in DOCS], items, k)
    assert result(lexical_search.rank(docs, asked, k)) == want
    assert result(lexical_search.rank(docs, asked, k, sampled=60)) == want  # floors from a part of the documents
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 4000)
    assert result(lexical_search.rank(docs, asked, k)) == want
    assert lexical_search.rank(docs.limit(0), asked).count() == 0
    assert lexical_search.rank(docs, asked.limit(0)).count() == 0


def test_impact_order_stops_early():
    """Documents of one rare strong term and many of a weak one: the strong ones are scored in full, the weak postings aren't read."""
    strong, weak = 0, 1
    rows = [{strong: 900, weak: 1} if d % 100 == 0 else {weak: 1} for d in range(5000)]
    offsets = np.r_[0, np.cumsum([len(r) for r in rows])]
    terms = np.array([t for r in rows for t in r])
    impacts = np.array([x for r in rows for x in r.values()])
    chunk = lexical_search.Chunk(offsets, terms, impacts, 2)
    read, add = [], chunk.docs

    class Seen:
        def __getitem__(self, at):
            read.append(at.stop - at.start)
            return add[at]

    chunk.docs = Seen()
    docs, scores = chunk.search({strong: 1, weak: 1}, np.array([1, 1]), 10, 1)
    assert sum(read) == 50 and docs.tolist() == list(range(0, 5000, 100)) and set(scores.tolist()) == {901}


@pytest.mark.parametrize("seed", range(20))
def test_chunks_of_chance_postings(seed):
    """Any chunk: at least the documents that a full scan has among the k best, with their scores."""
    rng = np.random.default_rng(seed)
    rows = [{int(t): int(rng.integers(0, 5)) ** int(rng.integers(1, 6)) for t in rng.permutation(12)[: rng.integers(0, 12)]} for _ in range(300)]
    offsets = np.r_[0, np.cumsum([len(r) for r in rows])]
    chunk = lexical_search.Chunk(offsets, np.array([t for r in rows for t in r]), np.array([x for r in rows for x in r.values()]), 12)
    item = {int(t): int(rng.integers(1, 4)) for t in rng.permutation(12)[:5]}
    times = np.zeros(12, np.int64)
    times[list(item)] = list(item.values())
    full = [sum(item.get(t, 0) * x for t, x in r.items()) for r in rows]
    for needed in (1, 40, 10**6):
        best = lexical_search._Top(7, needed)
        best.add(*chunk.search(item, times, 7, needed))
        want = sorted(((-s, d) for d, s in enumerate(full) if s >= needed))[:7]
        assert [(-s, d) for d, s in zip(best.ids.tolist(), best.scores.tolist(), strict=True)] == want


VECTORS = [(None, [0.5] * 4), (101, None), (102, [0.1, None, 0.2, 0.3]), (103, [0.1, float("nan"), 0.2, 0.3]), (104, [float("inf"), 0.0, 0.0, 0.0]), (105, []), (106, [1.0]), (107, [0.25, 0.25, 0.25, 0.25, 9.0]), (108, [0.5, 0.5, 0.5, 0.5]), (109, [0.5, 0.5, 0.5, 0.5]), (109, [0.5, 0.5, 0.5, 0.5]), (110, [-0.001, 0.0, 0.999, -3.0])]


@pytest.fixture(scope="module")
def small_vectors(spark):
    rng = np.random.default_rng(5)
    rows = VECTORS + [(i, np.round(rng.normal(size=4), 1).tolist()) for i in range(90)] + [(100, [0.5, 0.5, 0.5, 0.5])]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<float>, rank int, cluster string, score int")
    kept = [(v, np.array(e, np.float32).astype(float)) for v, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    return df.repartition(3), kept


def lloyd(kept, k, rounds, dim, scale, seed):
    points = [(v, [math.floor(scale * x) for x in e.tolist()]) for v, e in kept if len(e) == dim]
    first = sorted((hashlib.sha256(f"{seed}{v}".encode()).hexdigest(), p) for v, p in points if v is not None)[:k]
    centroids = [p for _, p in first]
    far = lambda p, c: sum((x - y) ** 2 for x, y in zip(p, c))
    near = lambda p: min(range(len(centroids)), key=lambda c: (far(p, centroids[c]), c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, p in points:
            groups[near(p)].append(p)
        centroids = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else old for c, old in enumerate(centroids)]
    rows = [(v, near(p), far(p, centroids[near(p)])) for v, p in points]
    own = Counter()
    for _, c, d in rows:
        own[c] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((v, c, d, own[c], sum(own.values()), name[c]) for v, c, d in rows)


@pytest.mark.parametrize(("k", "rounds"), [(1, 2), (7, 5), (500, 1), (7, 0)])
def test_centroid_clusters(small_vectors, k, rounds):
    df, kept = small_vectors
    assert result(centroid_clusters.clusters(df, k, rounds, 4, 256, "2:")) == lloyd(kept, k, rounds, 4, 256, "2:")


def test_centroid_clusters_without_vectors(small_vectors):
    df, _ = small_vectors
    assert centroid_clusters.clusters(df.limit(0)).count() == 0
    assert centroid_clusters.clusters(df.where("vec_id IN (101, 102, 103, 104, 105)"), dim=4).count() == 0
    with pytest.raises(Exception, match="don't fit"):
        centroid_clusters.clusters(df.select("vec_id", F.expr("array(1e9f, 1f, 1f, 1f)").alias("embedding")), dim=4).count()


def test_centroid_clusters_of_the_table(spark, sf):
    rows = [(r.vec_id, np.array(r.embedding)) for r in common.table(spark, sf, "embeddings").select("vec_id", "embedding").collect()]
    assert result(queries.op12_centroid_clusters(spark, sf)) == lloyd(rows, 40, 5, 64, 256, "2:")


def best(kept, every, k, scale):
    points = [(v, [math.floor(scale * x) for x in e.tolist()]) for v, e in kept if v is not None]
    asked = {(v, tuple(p)) for v, p in points if v % every == 0}
    out = Counter()
    for q, p in asked:
        scores = sorted((-sum(x * y for x, y in zip(p, c)), v) for v, c in points if v != q)[:k]
        out.update((q, i + 1, v, -s) for i, (s, v) in enumerate(scores))
    return out


@pytest.mark.parametrize("k", [1, 5, 500])
def test_vector_search(small_vectors, k, monkeypatch):
    df, kept = small_vectors
    every = F.col("vec_id") % 4 == 0
    monkeypatch.setattr(vector_search, "BLOCK", 7)
    monkeypatch.setattr(vector_search, "CHUNK", 20)
    monkeypatch.setattr(vector_search, "STEP", 3)
    want = best(kept, 4, k, 64)
    assert result(vector_search.top_k(df, every, k)) == want
    assert result(vector_search.top_k(df, every, k, sampled=20)) == want
    assert result(vector_search.top_k(df, every, k, block=5)) == want
    assert vector_search.top_k(df.limit(0), every, k).count() == 0
    assert vector_search.top_k(df, F.lit(False), k).count() == 0


def test_vector_search_of_large_numbers(spark):
    rows = [(i, [float(3 * i + 1) * 2.0**16, -1.0, 0.0, 0.5]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kept = [(v, np.array(e)) for v, e in rows]
    assert result(vector_search.top_k(df, F.col("vec_id") % 4 == 0, 5)) == best(kept, 4, 5, 64)
    with pytest.raises(Exception, match="don't fit"):
        vector_search.top_k(df.withColumn("embedding", F.expr("array(1e18d)")), F.col("vec_id") == 0).count()


def test_ranges_are_left_by_their_bounds():
    """Vectors in narrow ranges: most pairs of query and range aren't scored, and nothing is lost."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 16)) * 100
    rows = np.floor(np.repeat(centre, 256, axis=0) + rng.normal(size=(40 * 256, 16)))
    ids, asked = np.arange(len(rows)), np.arange(0, len(rows), 20)
    top = vector_search._Best(10, np.full(len(asked), vector_search.UNSET))
    scored = vector_search.search_blocks(top, asked, rows[asked], ids, rows)
    assert scored < 0.15 * len(asked) * 40
    scores = rows[asked] @ rows.T
    for i in range(0, len(asked), 37):
        order = sorted((-s, v) for v, s in enumerate(scores[i].tolist()) if v != asked[i])[:10]
        mine = top.query == i
        assert [(-s, v) for v, s in zip(top.ids[mine].tolist(), top.scores[mine].tolist(), strict=True)] == order
