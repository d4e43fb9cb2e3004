"""What reports and plots take from the queries: findings, whole runs, coded and scaled axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .facets import pivot
from .rankings import ascending, best_first, leaderboard, ranked, robustness


def _best(p: DataFrame, finding: str, metric: str) -> DataFrame:
    """The pivot's best row, ties by value."""
    top = p.where("score IS NOT NULL").orderBy(*best_first(metric, "score", "value")).limit(1)
    return top.select(F.lit(finding).alias("finding"), F.col("value").alias("subject"), F.col("score").alias("figure"))


def findings(m: DataFrame, facets: DataFrame, metric: str = "rmse", scope: str = "cv") -> DataFrame:
    """(finding, subject, figure): the top condition, the best model family and preprocessing, how much augmentation
    takes from the score, how far split methods lie apart, and the steadiest pipeline; what has no data gives no row."""
    top = leaderboard(m, metric, scope, limit=1).select(F.lit("top_pipeline").alias("finding"), F.col("label").alias("subject"), F.col("mean_score").alias("figure"))
    by = lambda key: pivot(m, facets, key, metric=metric, scope=scope)
    side = lambda v: F.max(F.when(F.col("value") == v, F.col("score")))
    lift = by("has_augmentation").agg((side("no") - side("yes")).alias("figure")).select(F.lit("augmentation_lift").alias("finding"), F.lit("no - yes").alias("subject"), "figure")
    split = by("split_method").agg((F.max("score") - F.min("score")).alias("figure"), F.count("score").alias("n"), (F.min_by if ascending(metric) else F.max_by)("value", "score").alias("subject")).where("n > 1")
    steady = robustness(m, metric, scope).where("std IS NOT NULL").orderBy("std", "pipeline_dag_hash", "dataset_fingerprint").limit(1)
    out = top.unionByName(_best(by("model_family"), "best_model_family", metric)).unionByName(_best(by("preprocessing_op"), "best_preprocessing", metric))
    out = out.unionByName(lift).unionByName(split.select(F.lit("split_sensitivity").alias("finding"), "subject", "figure"))
    return out.unionByName(steady.select(F.lit("most_robust").alias("finding"), F.concat_ws(" on ", "pipeline_dag_hash", "dataset_fingerprint").alias("subject"), F.col("std").alias("figure"))).where("figure IS NOT NULL")


def coded(rows: DataFrame, column: str) -> DataFrame:
    """rows with <column>_code: the place of the value among the sorted distinct values, from 0; null stays null.
    The distinct values are numbered, by sorted ranges, not the rows."""
    seen = rows.where(F.col(column).isNotNull()).select(column).distinct()
    codes = ranked(seen, [F.col(column).asc()]).select(column, (F.col("rank") - 1).cast("int").alias(f"{column}_code"))
    return rows.join(codes, column, "left")


def scaled(value: Column, low: Column, high: Column, least: float = 16, most: float = 60) -> Column:
    """value between low and high as a size between least and most; all equal: the least."""
    return F.coalesce(least + F.try_divide(value - low, high - low) * (most - least), F.lit(float(least)))


def filtered_pipelines(pipelines: DataFrame, text: str = "", linear: bool | None = None) -> DataFrame:
    """Pipelines whose label or main model has the text, in any case, and the structure."""
    has = F.contains(F.lower(F.concat_ws(" ", "label", "main_model")), F.lit(text.lower()))
    return pipelines.where(has if linear is None else has & (F.col("is_linear") == int(linear)))


def run_detail(execution_hash: str, executions: DataFrame, conditions: DataFrame, pipelines: DataFrame, datasets: DataFrame, nodes: DataFrame, params: DataFrame, backbone: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """One row of an execution with everything about it: its condition, pipeline, dataset, cv, seed and refit, and
    arrays of its nodes, edges, parameters and scores (by metric and fold). No row for one that isn't known."""
    run = executions.where(F.col("execution_hash") == execution_hash)
    row = run.join(conditions.drop("pipeline_dag_hash", "dataset_fingerprint", "seed"), "run_condition_hash", "left").join(pipelines, "pipeline_dag_hash", "left").join(datasets, "dataset_fingerprint", "left")
    of_run = run.select("pipeline_dag_hash")

    def gathered(rows: DataFrame, key: str, name: str, *columns: str) -> DataFrame:
        return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))

    row = row.join(gathered(nodes.join(of_run, "pipeline_dag_hash", "left_semi"), "pipeline_dag_hash", "nodes", "node_id", "kind", "operator"), "pipeline_dag_hash", "left")
    row = row.join(gathered(params.join(of_run, "pipeline_dag_hash", "left_semi"), "pipeline_dag_hash", "params", "node_id", "param_name", "value_json"), "pipeline_dag_hash", "left")
    if edges is not None:
        row = row.join(gathered(edges.join(of_run, "pipeline_dag_hash", "left_semi"), "pipeline_dag_hash", "edges", "src", "dst"), "pipeline_dag_hash", "left")
    scores = backbone.where(F.col("execution_hash") == execution_hash)
    return row.join(gathered(scores, "execution_hash", "scores", "metric_name", "fold_id", "score_scope", "metric_value"), "execution_hash", "left")


def planned_list(plans: DataFrame, pipelines: DataFrame, cards: DataFrame) -> DataFrame:
    """Open plans with their pipeline's label and their dataset's cards, newest first; a fingerprint of several cards gives a row for each."""
    open_ = plans.where("status = 'planned'")
    rows = open_.join(pipelines.select("pipeline_dag_hash", "label", "main_model"), "pipeline_dag_hash", "left").join(cards.select("dataset_fingerprint", F.col("name").alias("dataset_name")), "dataset_fingerprint", "left")
    return rows.orderBy(F.desc("created_at"), "plan_id")


def comparable(residual_sets: DataFrame, residuals: DataFrame) -> DataFrame:
    """The residuals of sets whose rows are named by sample: positional ones can't be compared between runs."""
    return residuals.join(residual_sets.where("key = 'sample_id'").select("residual_set_id"), "residual_set_id", "left_semi")


def found(table: DataFrame, key: str, value) -> DataFrame:
    """The rows of a key; isEmpty() of it tells whether it exists."""
    return table.where(F.col(key) == value)


def settings(events: DataFrame) -> DataFrame:
    """(key, value) of a store's settings: the last of each key's (key, value, seq) wins."""
    return events.groupBy("key").agg(F.max(F.struct("seq", "value"))["value"].alias("value"))

