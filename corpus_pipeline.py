"""The corpus pipeline: every stage takes all that the one before it kept.

A stage gets (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last keep the
columns of documents.

In all stages texts of any length are taken whole, an empty table gives an empty
result, repeated rows are judged each for itself, and columns beyond those of documents, of
any name, are handed on and not read. What a stage does with nulls and ties is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import bpe, common, decontaminate, quality_rules, simhash_dedup, substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: what the rules reject goes. A null or empty text goes; a null language or source counts as
    the empty one; values equal to a limit stay."""
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5, with its contract's three-word shingles and three bits: of each component the document with the smallest doc_id
    stays, with all its rows. Null and empty texts are one component; rows with a null doc_id stay."""
    return simhash_dedup.representatives(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: passages of 13 words or more that a smaller doc_id has go; n_chars follows the text.
    A null text stays null; rows with a null doc_id neither take nor lose words; equal doc_ids don't take each other's."""
    left = substring_dedup.remove_repeats(docs, min_words=13)
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that contain a benchmark item go, at a similarity of 0.8 or more. Null and empty texts, and
    items without words, match nothing."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: (doc_id, n_tokens, ids_sha256, decoded_sha256) of each kept text. A null text has no tokens; a null
    doc_id stays null."""
    return bpe.digests(docs, common.tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("substring_dedup", substrings), ("benchmark_decontamination", decontamination), ("bpe_encoding", encoding)]

#: SimHash components, Hamming search and BPE have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents: the last one's result. Each stage's result is stored in the
    shared folder before the next one reads it, so that a lost executor costs one stage's tasks at most."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, common.stored(docs, name) if i else docs, sf_dir)
    return docs
