"""Facets: what describes a run condition, as (key, value, number) rows, and the queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.roles import classify, label_or_hash, leaf
from ..sources.scratch import checkpointed
from .quantiles import distribution, null_safe_join
from .rankings import selected

FACET = "facet_key", "facet_value", "facet_num", "facet_role"


def _facet(key: str, value: Column, num: Column | None = None, role: str = "condition") -> Column:
    return F.struct(F.lit(key).alias("facet_key"), value.cast("string").alias("facet_value"), (F.lit(None) if num is None else num).cast("double").alias("facet_num"), F.lit(role).alias("facet_role"))


def _rows(df: DataFrame, key: str, facets: list[Column]) -> DataFrame:
    return df.select(key, F.explode(F.array(*facets)).alias("f")).select(key, "f.*").where("facet_value IS NOT NULL")


def pipeline_facets(pipelines: DataFrame, nodes: DataFrame, params: DataFrame) -> DataFrame:
    """(pipeline_dag_hash, facets): of a pipeline, its nodes and its parameters."""
    n = nodes.withColumn("role", classify(F.col("operator"), F.col("kind"))).where("role != 'input' AND operator != ''").withColumn("leaf", leaf(F.col("operator")))
    yes = lambda c: F.when(F.coalesce(c, F.lit(0)) > 0, "yes").otherwise("no")
    roles = ("model", "preprocessing", "augmentation", "scaler", "feature_selection")
    counts = n.groupBy("pipeline_dag_hash").agg(*[F.count_if(F.col("role") == r).alias(r) for r in roles], F.count("*").alias("stages"))
    p = pipelines.join(counts, "pipeline_dag_hash", "left")
    own = _rows(p, "pipeline_dag_hash", [
        _facet("pipeline", label_or_hash(F.col("label"), F.col("pipeline_dag_hash"))),
        _facet("is_linear", F.when(F.col("is_linear") == 1, "linear").otherwise("branching")),
        _facet("model", leaf(F.col("main_model")), role="model"),
        _facet("model_family", F.coalesce("model_family", leaf(F.col("main_model"))) if "model_family" in pipelines.columns else leaf(F.col("main_model")), role="model"),
        _facet("n_models", F.col("model"), F.col("model"), "model"),
        _facet("n_preprocessing", F.col("preprocessing"), F.col("preprocessing"), "preprocessing"),
        _facet("n_augmentation", F.col("augmentation"), F.col("augmentation"), "augmentation"),
        _facet("has_augmentation", yes(F.col("augmentation")), role="augmentation"),
        _facet("has_scaler", yes(F.col("scaler")), role="scaler"),
        _facet("has_feature_selection", yes(F.col("feature_selection")), role="feature_selection"),
        _facet("n_stages", F.col("stages"), F.col("stages")),
    ])
    null = F.lit(None).cast("double").alias("facet_num")
    by_role = n.select("pipeline_dag_hash", F.concat("role", F.lit("_op")).alias("facet_key"), F.col("leaf").alias("facet_value"), null, F.col("role").alias("facet_role"))
    by_node = n.select("pipeline_dag_hash", F.lit("operator").alias("facet_key"), F.col("leaf").alias("facet_value"), null, F.col("role").alias("facet_role"))
    merged = n.where("role = 'merge'").select("pipeline_dag_hash", F.lit("merge_strategy").alias("facet_key"), F.col("leaf").alias("facet_value"), null, F.col("role").alias("facet_role"))
    by_param = params.select("pipeline_dag_hash", F.concat(F.lit("param:"), "param_name").alias("facet_key"), literal_text(F.col("value_json")).alias("facet_value"), F.when(F.col("is_numeric") == 1, F.col("numeric_value")).alias("facet_num"), F.lit("param").alias("facet_role"))
    every = own.unionByName(by_role).unionByName(by_node).unionByName(merged).unionByName(by_param)
    return every.groupBy("pipeline_dag_hash", "facet_key", "facet_value").agg(F.max("facet_num").alias("facet_num"), F.max("facet_role").alias("facet_role"))


def literal_text(json: Column) -> Column:
    """A scalar JSON literal as Python's str() writes it."""
    return F.when(json == "true", "True").when(json == "false", "False").when(json.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v")).otherwise(json)


def condition_facets(conditions: DataFrame, datasets: DataFrame) -> DataFrame:
    rows = conditions.join(datasets, "dataset_fingerprint", "left")
    return _rows(rows, "run_condition_hash", [_facet("dataset", label_or_hash(F.col("dataset_name"), F.col("dataset_fingerprint"))), _facet("seed", F.col("seed"), F.col("seed")), *[_facet(c, F.col(c), F.col(c) if c == "n_folds" else None) for c in ("domain", "task_type", "split_method", "cv_method", "n_folds", "refit_strategy") if c in rows.columns]])


def run_facets(conditions: DataFrame, datasets: DataFrame, pipelines: DataFrame, nodes: DataFrame, params: DataFrame) -> DataFrame:
    """Facets of run conditions: those of a pipeline are made once and joined to its conditions."""
    of_pipeline = conditions.select("run_condition_hash", "pipeline_dag_hash").join(pipeline_facets(pipelines, nodes, params), "pipeline_dag_hash").drop("pipeline_dag_hash")
    return condition_facets(conditions, datasets).unionByName(of_pipeline)


def index(facets: DataFrame) -> DataFrame:
    """Facet keys with more than one value, and all parameters."""
    g = facets.groupBy("facet_key").agg(F.count_distinct("facet_value").alias("n_values"), F.max("facet_role").alias("role"), F.max(F.col("facet_num").isNotNull().cast("int")).alias("is_numeric"))
    return g.where((F.col("n_values") > 1) | F.col("facet_key").startswith("param:")).orderBy(F.col("facet_key").startswith("param:"), "facet_key")


def values(facets: DataFrame, key: str, limit: int | None = 200) -> DataFrame:
    g = facets.where(F.col("facet_key") == key).groupBy("facet_value").agg(F.max("facet_num").alias("facet_num"), F.count("*").alias("n"))
    out = g.orderBy(F.col("facet_num").asc_nulls_last(), "facet_value")
    return out if limit is None else out.limit(limit)


#: What a pivot can make of a group's scores.
AGGREGATES = {"mean": F.avg, "median": None, "min": F.min, "max": F.max}


def pivot(m: DataFrame, facets: DataFrame, group_by: str, color_by: str | None = None, metric: str = "rmse", scope: str = "cv", agg: str = "mean", **options) -> DataFrame:
    """Scores by one or two facets; a condition with several values counts for each."""
    if agg not in AGGREGATES:
        raise ValueError(f"agg must be one of {sorted(AGGREGATES)}")
    rows, keys, v = selected(m, metric, scope, **options), ["value", "num"], F.col("metric_value")
    if agg != "median":  # an execution has one condition: what is distinct there is so in a group
        rows = rows.groupBy("run_condition_hash").agg(F.sum(v.cast("double")).alias("sum"), F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.count_distinct("execution_hash").alias("n_runs"))
    rows = rows.join(facets.where(F.col("facet_key") == group_by).select("run_condition_hash", F.col("facet_value").alias("value"), F.col("facet_num").alias("num")), "run_condition_hash")
    if color_by is not None:
        rows, keys = rows.join(facets.where(F.col("facet_key") == color_by).select("run_condition_hash", F.col("facet_value").alias("color")), "run_condition_hash"), [*keys, "color"]
    if agg == "median":
        rows = checkpointed(rows.select(*keys, "metric_value", "execution_hash"))
        middle = distribution(rows, keys, "metric_value", {"score": 0.5}).select(*keys, "score")
        return null_safe_join(rows.groupBy(*keys).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.count_distinct("execution_hash").alias("n_runs")), middle, keys)
    score = F.try_divide(F.sum("sum"), F.sum("n")) if agg == "mean" else AGGREGATES[agg](agg)
    return rows.groupBy(*keys).agg(score.alias("score"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("n_runs").alias("n_runs"))


def parallel(m: DataFrame, facets: DataFrame, dimensions: list[str], metric: str = "rmse", scope: str = "cv", **options) -> DataFrame:
    """A row per execution: its mean score and a column per facet, the least value of several."""
    scores = selected(m, metric, scope, **options).groupBy("execution_hash", "run_condition_hash").agg(F.avg("metric_value").alias("score"))
    wide = facets.where(F.col("facet_key").isin(*dimensions)).groupBy("run_condition_hash").pivot("facet_key", dimensions).agg(F.min("facet_value"))
    return scores.join(wide, "run_condition_hash", "left")
