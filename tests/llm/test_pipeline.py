"""run() against plain Python, DuckDB and the tokenizers library, from the documents to the last digest."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import corpus_pipeline
import duckdb
import numpy as np
import xxhash
from runlens.llm import common, quality_rules
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_keep_the_columns_and_only_take_away(spark, sf):
    docs = common.table(spark, sf, "documents")
    columns, seen = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf), name)
        assert docs.columns == columns
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left and left <= seen
        seen = left
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert Counter(map(tuple, last.collect())) == Counter(map(tuple, corpus_pipeline.run(spark, sf).collect()))


def series(stem, n):
    return " ".join(f"{stem}{i}" for i in range(n))


#: A copy, a shared passage, a leak and a text that is too short.
PLANTED = [
    (900_001, series("alpha", 120) + " " + series("shared", 60)),
    (900_002, series("alpha", 120) + " " + series("shared", 60)),
    (900_003, series("beta", 120) + "\n\n" + series("shared", 60) + "\t" + series("gamma", 30)),
    (900_004, series("delta", 60) + " " + series("bench", 40) + ". " + series("omega", 60)),
    (900_005, "one"),
    (900_006, None),
    (900_007, series("kappa", 30_000)),
]


def kept_by_quality(folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return {d for (d,) in con.execute(f"SELECT doc_id FROM ({quality_rules.sql()}) WHERE kept").fetchall()}


def first_of_each_group(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fps, root = {}, {d: d for d in docs}
    for d, text in docs.items():
        w = WORD.findall(text.translate(lower))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
        fps[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(docs), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {d: t for d, t in docs.items() if find(d) == d}


def without_repeats(docs):
    spans = {d: [m.span() for m in WORD.finditer(t)] for d, t in docs.items()}
    words = {d: [docs[d][a:b] for a, b in s] for d, s in spans.items()}
    first = defaultdict(lambda: float("inf"))
    for d, w in words.items():
        for i in range(len(w) - 12):
            first[tuple(w[i : i + 13])] = min(first[tuple(w[i : i + 13])], d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        parts, open_at = [], None
        for i, g in enumerate([*gone, True]):
            if g and open_at is not None:
                parts.append(docs[d][spans[d][open_at][0] : spans[d][i - 1][1]])
                open_at = None
            elif not g and open_at is None:
                open_at = i
        out[d] = "\n".join(parts) if any(gone) else docs[d]
    return out


def has_item(text, items):
    w = re.findall(r"\w+", text.lower())
    for item in items:
        k = min(5, len(item))
        n = len(item) - k + 1
        mine = Counter(tuple(item[i : i + k]) for i in range(n))
        shingles = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        known = np.concatenate(([0], np.cumsum([s in mine for s in shingles])))
        for at in np.flatnonzero(known[n:] - known[:-n] >= 0.8 * n) if len(shingles) >= n else ():
            shared = sum((mine & Counter(shingles[at : at + n])).values())
            if shared / (2 * n - shared) >= 0.8:
                return True
    return False


def test_run_against_brute_force(spark, sf, tmp_path):
    own = common.table(spark, sf, "documents")
    extra = spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in PLANTED], "doc_id long, text string, lang string, source string, n_chars long")
    own.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    item = spark.createDataFrame([(900_000, series("bench", 40))], "item_id long, text string")
    common.table(spark, sf, "benchmark").unionByName(item).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = {r.doc_id: r.text for r in common.table(spark, str(tmp_path), "documents").collect()}
    items = [re.findall(r"\w+", r.text.lower()) for r in common.table(spark, str(tmp_path), "benchmark").collect()]

    kept = kept_by_quality(tmp_path)
    good = {d: t for d, t in docs.items() if d in kept}
    alone = first_of_each_group(good)
    cut = without_repeats(alone)
    clean = {d: t for d, t in cut.items() if not has_item(t, [i for i in items if i])}
    assert {900_005, 900_006} <= docs.keys() - good.keys()
    assert 900_002 in good.keys() - alone.keys()
    assert cut[900_003] == series("beta", 120) + "\n" + series("gamma", 30)
    assert 900_004 in cut.keys() - clean.keys()
    assert {900_001, 900_003, 900_007} <= clean.keys()

    tokenizer = Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    want = Counter()
    for d, text in clean.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert Counter(map(tuple, got.collect())) == want


def test_empty_documents(spark, sf, tmp_path):
    for name in ("documents", "benchmark"):
        common.table(spark, sf, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
