"""Aggregation and ranking over the backbone: leaderboards, matrices, effects, robustness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.roles import classify, label_or_hash
from ..sources.scratch import checkpointed
from .quantiles import distribution

# The metrics in which more is better, those in which less is, and the scopes.
MAXIMISED = ("r2", "rpd", "rpiq", "ccc", "accuracy", "balanced_accuracy", "f1_macro", "f1_micro", "precision_macro", "recall_macro", "roc_auc", "mcc")
MINIMISED = ("mse", "rmse", "mae", "medae", "bias", "log_loss")
SCOPES = ("fold", "cv", "refit", "test", "view")
PARTITIONS = ("train", "validation", "test", "final")


def ascending(metric: str) -> bool:
    """Whether less is better; metrics that aren't known are minimised."""
    return metric.lower() not in MAXIMISED


def direction(metric: Column) -> Column:
    """max or min, as ascending() says."""
    return F.when(F.lower(metric).isin(*sorted(MAXIMISED)), "max").otherwise("min")


def directions(spark: SparkSession) -> DataFrame:
    """(metric_name, direction) of every known metric."""
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, sorted(MAXIMISED + MINIMISED)))).alias("metric_name"))
    return names.withColumn("direction", direction(F.col("metric_name")))


def selected(m: DataFrame, metric: str, scope: str = "cv", *, quarantined: bool = False, superseded: bool = False, **equal: str | None) -> DataFrame:
    """The rows of one metric and scope; equal: further columns' values, None for any."""
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}")
    if equal.get("partition") is not None and equal["partition"] not in PARTITIONS:
        raise ValueError(f"partition must be one of {PARTITIONS}")
    keep = (F.col("metric_name") == metric) & (F.col("score_scope") == scope)
    if not superseded:
        keep &= F.col("score_validity") == "valid"
    if not quarantined:
        keep &= F.col("execution_validity") == "valid"
    for name, value in equal.items():
        if value is not None:
            keep &= F.col(name) == value
    return m.where(keep)


def best_first(metric: str, score: str, *ties: str) -> list[Column]:
    """The better score first, null last, equal ones by ties."""
    c = F.col(score)
    return [c.asc_nulls_last() if ascending(metric) else c.desc_nulls_last(), *[F.col(t).asc() for t in ties]]


def leaderboard(m: DataFrame, metric: str = "rmse", scope: str = "cv", limit: int | None = 200, of: DataFrame | None = None, **options) -> DataFrame:
    """Run conditions by their mean score; rank is the row's number. limit is the report's length. of: the conditions, one row each, with
    pipeline_dag_hash, dataset_fingerprint, label and dataset_name, where the scores needn't bring these through the shuffle."""
    rows = selected(m, metric, scope, **options)
    score = F.col("metric_value")
    numbers = [F.avg(score).alias("mean_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.count("*").alias("n_obs")]
    if of is not None:
        names = of.select("run_condition_hash", "pipeline_dag_hash", "dataset_fingerprint", label_or_hash(F.col("label"), F.col("pipeline_dag_hash")).alias("label"), "dataset_name")
        g = rows.groupBy("run_condition_hash").agg(*numbers).join(names, "run_condition_hash")
    else:
        label = label_or_hash(F.first("label", True), F.col("pipeline_dag_hash"))
        g = rows.groupBy("run_condition_hash", "pipeline_dag_hash", "dataset_fingerprint").agg(label.alias("label"), F.first("dataset_name", True).alias("dataset_name"), *numbers)
    order = best_first(metric, "mean_score", "run_condition_hash")
    top = g.orderBy(*order).limit(limit) if limit is not None else g
    # A report of `limit` rows is ranked in one window; a whole one is numbered by sorted ranges.
    if limit is not None:
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return ranked(g, order)


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with a global row number: range-partitioned, numbered in each range,
    and moved by the counts of the ranges before (one row a range)."""
    part = checkpointed(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    part = part.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    sizes = part.groupBy("_range").agg(F.max("_n").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return part.join(before.select("_range", "_before"), "_range").withColumn("rank", (F.col("_n") + F.col("_before")).cast("long")).drop("_range", "_n", "_before")


def matrix_cells(m: DataFrame, metric: str = "rmse", scope: str = "cv", **options) -> DataFrame:
    rows = selected(m, metric, scope, **options)
    return rows.groupBy("pipeline_dag_hash", "dataset_fingerprint").agg(F.avg("metric_value").alias("mean_score"), F.count_distinct("execution_hash").alias("n_runs"))


def matrix_wide(m: DataFrame, datasets: list[str], metric: str = "rmse", scope: str = "cv", **options) -> DataFrame:
    """A row per pipeline and a column per dataset name; absent cells are null."""
    return selected(m, metric, scope, **options).groupBy("pipeline_dag_hash").pivot("dataset_name", datasets).agg(F.avg("metric_value"))


def run_explorer(m: DataFrame, nodes: DataFrame, metric: str = "rmse", scope: str = "cv", operator: str | None = None, limit: int | None = 500, quarantined: bool = True, **equal) -> DataFrame:
    """Executions by their mean score, best first and then cut to the limit."""
    rows = selected(m, metric, scope, quarantined=quarantined, **equal)
    if operator is not None:
        rows = rows.join(nodes.where(F.col("operator") == operator), "pipeline_dag_hash", "left_semi")
    g = rows.groupBy("execution_hash", "run_condition_hash", "pipeline_dag_hash", "dataset_fingerprint", "execution_validity").agg(F.avg("metric_value").alias("score"))
    return g.orderBy(*best_first(metric, "score", "execution_hash")).limit(limit) if limit is not None else g


def _spread(score: Column) -> list[Column]:
    """A group's statistics; nulls are skipped, the deviation is the population's."""
    return [F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std")]


def operator_effect(m: DataFrame, nodes: DataFrame, metric: str = "rmse", scope: str = "cv") -> DataFrame:
    """Scores by operator: an observation counts once for each matching node,
    superseded scores included."""
    used = nodes.withColumn("role", classify(F.col("operator"), F.col("kind"))).where("operator IS NOT NULL AND role != 'input'")
    rows = selected(m, metric, scope, superseded=True).join(used, "pipeline_dag_hash")
    roles = used.groupBy("operator").agg(F.max("role").alias("role"))
    return distribution(rows, ["operator"], "metric_value", {"median": 0.5}).join(roles, "operator")


def parameter_effect(m: DataFrame, params: DataFrame, param: str, metric: str = "rmse", scope: str = "cv") -> DataFrame:
    """A point per observation and node with the parameter: (value_num, value_label, score)."""
    p = params.where(F.col("param_name") == param).select("pipeline_dag_hash", "numeric_value", "is_numeric", "value_json")
    rows = selected(m, metric, scope, superseded=True).join(p, "pipeline_dag_hash")
    numeric = F.col("is_numeric") == 1
    return rows.select("execution_hash", "dataset_fingerprint", "fold_id", F.when(numeric, F.col("numeric_value")).alias("value_num"), F.when(~numeric, F.col("value_json")).alias("value_label"), F.col("metric_value").alias("score"))


def parameter_trend(m: DataFrame, params: DataFrame, param: str, metric: str = "rmse", scope: str = "cv") -> DataFrame:
    points = parameter_effect(m, params, param, metric, scope)
    return points.groupBy("dataset_fingerprint", F.coalesce("value_label", F.col("value_num").cast("long").cast("string")).alias("value")).agg(F.count("*").alias("n"), F.avg("score").alias("mean"))


def robustness(m: DataFrame, metric: str = "rmse", scope: str = "cv") -> DataFrame:
    """Spread by pipeline and dataset; cv_pct is 0 for single scores and a mean of 0."""
    g = selected(m, metric, scope, superseded=True).groupBy("pipeline_dag_hash", "dataset_fingerprint").agg(*_spread(F.col("metric_value")))
    return g.withColumn("cv_pct", F.coalesce(F.try_divide("std", "mean") * 100, F.lit(0.0)))


def best_per_dataset(m: DataFrame, metric: str = "rmse", scope: str = "cv") -> DataFrame:
    """The best run condition of each dataset."""
    g = selected(m, metric, scope).groupBy("dataset_fingerprint", "run_condition_hash").agg(F.avg("metric_value").alias("mean_score"))
    first = (F.min_by if ascending(metric) else F.max_by)(F.struct("run_condition_hash", "mean_score"), F.struct("mean_score", "run_condition_hash"))
    return g.groupBy("dataset_fingerprint").agg(first.alias("b")).select("dataset_fingerprint", "b.run_condition_hash", "b.mean_score")
