"""Catalogue queries: counts, dimensions with usage counts, single runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overview(**tables: DataFrame) -> DataFrame:
    """(name, n) of each table, in one plan."""
    frames = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def metrics_available(observations: DataFrame) -> DataFrame:
    return observations.select("metric_name").distinct().orderBy("metric_name")


def with_usage(dimension: DataFrame, conditions: DataFrame, key: str) -> DataFrame:
    """dimension with n_run_conditions: distinct run conditions that use it, 0 if none."""
    used = conditions.groupBy(key).agg(F.count_distinct("run_condition_hash").alias("n_run_conditions"))
    return dimension.join(used, key, "left").withColumn("n_run_conditions", F.coalesce("n_run_conditions", F.lit(0)))


def operators(nodes: DataFrame) -> DataFrame:
    """Operators by how many pipelines have them."""
    return nodes.groupBy("operator").agg(F.count_distinct("pipeline_dag_hash").alias("n_pipelines")).orderBy(F.desc("n_pipelines"), "operator")


def sweepable_parameters(params: DataFrame) -> DataFrame:
    return params.where("is_sweepable = 1").groupBy("param_name").agg(F.count_distinct("value_json").alias("n_values"), (F.sum("is_numeric") > 0).cast("int").alias("is_numeric"))


def planned(pairs: DataFrame, executions: DataFrame) -> DataFrame:
    """The (pipeline_dag_hash, dataset_fingerprint) pairs that no valid execution has run."""
    return pairs.join(executions.where("execution_validity = 'valid'"), ["pipeline_dag_hash", "dataset_fingerprint"], "left_anti")


def fold_scores(m: DataFrame, execution_hash: str, metric: str) -> DataFrame:
    keep = (F.col("execution_hash") == execution_hash) & (F.col("metric_name") == metric) & (F.col("score_validity") == "valid") & F.col("fold_id").isNotNull()
    return m.where(keep).select("fold_id", "partition", "score_scope", "metric_value").orderBy("fold_id")


def run_scores(m: DataFrame, execution_hash: str) -> DataFrame:
    """All scores of one execution; empty for one that isn't known."""
    return m.where(F.col("execution_hash") == execution_hash).select("execution_hash", "run_condition_hash", "label", "dataset_name", "score_scope", "score_validity", "metric_name", "fold_id", "metric_value")
