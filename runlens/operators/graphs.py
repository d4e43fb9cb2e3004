"""Graphs of pipelines and operators, and the composition of pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import classify, label_or_hash, leaf
from .rankings import selected


def _used(nodes: DataFrame) -> DataFrame:
    n = nodes.withColumn("role", classify(F.col("operator"), F.col("kind"))).where("operator IS NOT NULL AND role != 'input'")
    return n.withColumn("leaf", leaf(F.col("operator")))


def pipeline_nodes(m: DataFrame, metric: str = "rmse", scope: str = "cv", max_nodes: int = 150) -> DataFrame:
    """The pipelines with the most executions; max_nodes is the drawing's size."""
    g = selected(m, metric, scope).groupBy("pipeline_dag_hash").agg(F.avg("metric_value").alias("score"), F.count_distinct("execution_hash").alias("n_runs"), F.first("label", True).alias("label"), F.first("main_model", True).alias("main_model"))
    top = g.orderBy(F.desc("n_runs"), "pipeline_dag_hash").limit(max_nodes)
    return top.select("pipeline_dag_hash", label_or_hash(F.col("label"), F.col("pipeline_dag_hash")).alias("label"), F.coalesce(leaf(F.col("main_model")), F.lit("other")).alias("cluster"), "score", "n_runs")


def pipeline_edges(drawn: DataFrame, nodes: DataFrame, min_jaccard: float = 0.34) -> DataFrame:
    """Pairs of drawn pipelines whose sets of operators are alike: an inverted
    index on operators counts what two have in common."""
    sets = _used(nodes).join(drawn.select("pipeline_dag_hash"), "pipeline_dag_hash", "left_semi").select("pipeline_dag_hash", "leaf").distinct()
    sizes = sets.groupBy("pipeline_dag_hash").agg(F.count("*").alias("size"))
    sets = sets.join(sizes, "pipeline_dag_hash")
    a, b = (sets.select(F.col("pipeline_dag_hash").alias(s), "leaf", F.col("size").alias(f"size_{s}")) for s in ("source", "target"))
    both = a.join(b, "leaf").where("source < target").groupBy("source", "target", "size_source", "size_target").agg(F.count("*").alias("shared"))
    jaccard = F.col("shared") / (F.col("size_source") + F.col("size_target") - F.col("shared"))
    return both.where(jaccard >= min_jaccard).select("source", "target", F.bround(jaccard, 3).alias("weight"))


def operator_nodes(m: DataFrame, nodes: DataFrame, metric: str = "rmse", scope: str = "cv", max_nodes: int | None = 150) -> DataFrame:
    """Operators by pipelines and executions; a score counts once for each node."""
    rows = selected(m, metric, scope).select("pipeline_dag_hash", "execution_hash", "metric_value").join(_used(nodes), "pipeline_dag_hash")
    g = rows.groupBy("operator").agg(F.max("role").alias("role"), F.count_distinct("pipeline_dag_hash").alias("n_pipelines"), F.count_distinct("execution_hash").alias("n_runs"), F.avg("metric_value").alias("score"))
    return g if max_nodes is None else g.orderBy(F.desc("n_pipelines"), "operator").limit(max_nodes)


def operator_edges(nodes: DataFrame) -> DataFrame:
    """How many pipelines have both of two operators."""
    sets = _used(nodes).select("pipeline_dag_hash", "leaf").distinct()
    a, b = sets.withColumnRenamed("leaf", "source"), sets.withColumnRenamed("leaf", "target")
    return a.join(b, "pipeline_dag_hash").where("source < target").groupBy("source", "target").agg(F.count("*").alias("weight"))


def composition(m: DataFrame, nodes: DataFrame, metric: str = "rmse", scope: str = "cv") -> DataFrame:
    return operator_nodes(m, nodes, metric, scope, None).orderBy("role", F.desc("n_runs"), "operator")


def composition_rollup(m: DataFrame, nodes: DataFrame, metric: str = "rmse", scope: str = "cv") -> DataFrame:
    """Operators and their roles: totals and the mean score weighted by use."""
    g = operator_nodes(m, nodes, metric, scope, None).withColumn("w", F.greatest("n_runs", F.lit(1)))
    return g.rollup("role", "operator").agg(F.sum("n_runs").alias("n_runs"), (F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("score")).where("role IS NOT NULL")
