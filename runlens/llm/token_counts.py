"""Token counts by a map-side lookup in two tiers.

A pre-token is a run of word marks with the letters behind it, or a line
feed with the letters behind it. No piece of the vocabulary crosses the start
of such a run (checked when the model is loaded), so a text has as many
tokens as its pre-tokens have together. Tier one is a broadcast table of the lengths of the
FREQUENT pre-tokens that occur most in a sample of about SAMPLED documents; it decides how
fast a count is, never the count. Tier two is a cache in each worker, of a
bounded size, whose misses the library itself encodes. The texts' pre-tokens are not shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Entries of the broadcast table and of a worker's cache, at most, and documents in the sample, about.
FREQUENT, CACHED, SAMPLED = 131_072, 400_000, 10_000

MARK = "▁"  # sentencepiece's sign for a space
RUNS = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*").findall


@lru_cache(maxsize=2)
def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def splits_safely(model: bytes) -> bool:
    """Whether texts may be cut before each run of marks and each line feed:
    no piece has a mark after another sign or contains a line feed, and
    texts are encoded as they are, behind one mark."""
    sp = _processor(model)
    probe = f"ﬁ Ａ  ä\n{MARK}x "
    return sp.normalize(probe) == MARK + probe.replace(" ", MARK) and not any(MARK in (p := sp.id_to_piece(i)).lstrip(MARK) or "\n" in p for i in range(sp.get_piece_size()))


def _length(sp, run: str) -> int:
    """Tokens of one pre-token. The library puts a mark before any text."""
    if run[0] == "\n":
        return len(sp.encode(run)) - 1
    return len(sp.encode(run[1:])) if len(run) > 1 else 1


def _runs(text: str) -> list[str]:
    """The pre-tokens of a text. The library puts a mark before it."""
    return RUNS(MARK + text.replace(" ", MARK)) if text else []


def frequent_lengths(docs: DataFrame, model: bytes, frequent: int = FREQUENT, sampled: int = SAMPLED) -> dict[str, int]:
    """Tier one: the lengths of the `frequent` most frequent pre-tokens of about `sampled` documents, ties by name."""
    rows = docs.count()
    some = docs.sample(sampled / rows, seed=1) if rows > sampled else docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for t in common.texts_of(batch.slice(at, 256)):
                    counts.update(_runs(t))
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["run", "n"])

    def lengths(batch):
        sp = _processor(shared.value)
        return {"run": batch.column(0), "tokens": [_length(sp, r) for r in batch.column(0).to_pylist()]}

    counted = common.pick(some, text="text").mapInArrow(count, "run string, n bigint").groupBy("run").agg(F.sum("n").alias("n"))
    most = counted.orderBy(F.desc("n"), "run").limit(frequent).select("run")
    found = common.per_batch(most, "run string, tokens bigint", lengths, rows=4096).toArrow()
    return dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))


class _Cache(dict):
    """Tier two: lengths of the pre-tokens that tier one lacks."""

    def __init__(self, sp, frequent: dict[str, int]):
        super().__init__(frequent)
        self.sp, self.frequent = sp, frequent

    def __missing__(self, run: str) -> int:
        if len(self) >= CACHED:
            self.clear()
            self.update(self.frequent)
        self[run] = n = _length(self.sp, run)
        return n


_caches: dict[bytes, _Cache] = {}


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs.

    A null text counts as empty: no bytes, no tokens. Texts of any length are
    counted whole; special strings inside them are ordinary text, as the
    library has it. Repeated rows each get a row, a null doc_id stays null,
    an empty table gives an empty result, other columns are not read.
    """
    model = common.file_bytes(model_path)
    if not splits_safely(model):
        raise ValueError(f"{model_path}: its pieces cross pre-tokens")
    shared = docs.sparkSession.sparkContext.broadcast((model, frequent_lengths(docs, model)))

    def work(batch):
        model, frequent = shared.value
        cache = _caches.get(model)
        if cache is None or cache.frequent != frequent:
            _caches.clear()
            cache = _caches[model] = _Cache(_processor(model), frequent)
        texts = common.texts_of(batch)
        n = [sum(map(cache.__getitem__, _runs(t))) for t in texts]
        return {"doc_id": batch.column(0), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return common.per_batch(common.pick(docs, doc_id="doc_id", text="text"), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", work)
