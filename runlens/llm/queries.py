"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroid_clusters, common, decontaminate, html_extract, lexical_search, license_scan, quality_rules, simhash_dedup, substring_dedup, token_counts, token_files, url_filter, vector_search


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(common.table(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.kept_digests(common.table(spark, sf_dir, "documents"), min_words=13)


#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(common.table(spark, sf_dir, "pages"), RULES, url_filter.labelled_urls(spark))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(common.table(spark, sf_dir, "documents"), common.tokenizer_path("word_bpe_49k.json"), end_id=1)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(common.table(spark, sf_dir, "documents"), shingle=3)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(common.table(spark, sf_dir, "documents"), common.tokenizer_path("word_bpe_49k.json"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(common.table(spark, sf_dir, "documents"), license_scan.known_licenses(spark))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(common.table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(common.table(spark, sf_dir, "documents"), common.tokenizer_path("piece_bpe_32k.model"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), k=10)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.clusters(common.table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64, scale=256, seed="2:")


def op13_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


_ALL = (
    op1_html_extract, op2_substring_dedup, op3_url_filter, op4_token_files, op5_simhash, op6_bpe, op7_license_scan, op8_decontaminate, op9_quality_rules, op10_token_counts,
    op11_lexical_search, op12_centroid_clusters, op13_vector_search,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op7_license_scan": license_scan.sql(), "op9_quality_rules": quality_rules.sql(), "op11_lexical_search": lexical_search.sql(), "op12_centroid_clusters": centroid_clusters.sql(), "op13_vector_search": vector_search.sql()}
