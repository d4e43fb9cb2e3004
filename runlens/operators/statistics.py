"""Distributions of scores: summaries, histograms, correlations with numeric facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed
from .quantiles import distribution
from .rankings import selected


def pearson(x: Column, y: Column) -> Column:
    """Null for constant input, where corr() would raise."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def execution_scores(m: DataFrame, metric: str = "rmse", scope: str = "cv", of: tuple[str, ...] = ("run_condition_hash", "dataset_fingerprint"), **options) -> DataFrame:
    """Each execution's mean score, with what is asked of it: columns that have one value an execution."""
    return selected(m, metric, scope, **options).groupBy("execution_hash", *of).agg(F.avg("metric_value").alias("score"))


def summary(m: DataFrame, metric: str = "rmse", scope: str = "cv", by: str | None = None) -> DataFrame:
    """Statistics of the executions' mean scores, of all or by one column."""
    return distribution(execution_scores(m, metric, scope), [by] if by else [], "score", {"median": 0.5, "p25": 0.25, "p75": 0.75})


def correlations(m: DataFrame, facets: DataFrame, metric: str = "rmse", scope: str = "cv") -> DataFrame:
    """Pearson's r of each numeric facet with the executions' scores, where there are
    four points or more and neither side is constant."""
    numeric = facets.where("facet_num IS NOT NULL").select("run_condition_hash", "facet_key", "facet_num")
    points = execution_scores(m, metric, scope).join(numeric, "run_condition_hash")
    g = points.groupBy("facet_key").agg(F.count("*").alias("n"), pearson(F.col("facet_num"), F.col("score")).alias("r"))
    return g.where("n >= 4 AND r IS NOT NULL")


def histogram(m: DataFrame, metric: str = "rmse", scope: str = "cv", bins: int = 28) -> DataFrame:
    """(bin, n): executions' scores in equal bins from the least to the greatest; empty bins are absent."""
    scores = checkpointed(execution_scores(m, metric, scope))
    lo, hi = (scores.agg(f("score")).scalar() for f in (F.min, F.max))
    at = F.coalesce(F.floor(F.try_divide((F.col("score") - lo) * bins, hi - lo)), F.lit(0))
    return scores.groupBy(F.least(at, F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def surface(m: DataFrame, facets: DataFrame, x: str, y: str, y_values: list[str], metric: str = "rmse", scope: str = "cv") -> DataFrame:
    """A grid of mean scores by two facets; gaps are null."""
    side = lambda key, name: facets.where(F.col("facet_key") == key).select("run_condition_hash", F.col("facet_value").alias(name))
    rows = selected(m, metric, scope).join(side(x, "x"), "run_condition_hash").join(side(y, "y"), "run_condition_hash")
    return rows.groupBy("x").pivot("y", y_values).agg(F.avg("metric_value"))
