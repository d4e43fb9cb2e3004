"""Residuals of executions: scans, sample-keyed pairs and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .statistics import pearson


def scan(residuals: DataFrame, residual_set_id: str, partition: str | None = None) -> DataFrame:
    """Both predicates reach the scan."""
    rows = residuals.where(F.col("residual_set_id") == residual_set_id)
    return rows if partition is None else rows.where(F.col("partition") == partition)


def paired(residuals: DataFrame, a: str, b: str, partition: str | None = "validation") -> DataFrame:
    """(sample_id, residual_a, residual_b) of the samples that both executions
    have: of a sample's rows the last by ordinal counts."""
    rows = residuals if partition is None else residuals.where(F.col("partition") == partition)

    def side(execution: str, name: str) -> DataFrame:
        last = F.max_by(F.struct("residual"), F.col("ordinal"))["residual"]
        return rows.where(F.col("execution_hash") == execution).groupBy("sample_id").agg(last.alias(name))

    return side(a, "residual_a").join(side(b, "residual_b"), "sample_id")


def compare(pairs: DataFrame) -> DataFrame:
    """One row: common samples, pairs without nulls, their correlation and errors."""
    both = F.col("residual_a").isNotNull() & F.col("residual_b").isNotNull()
    x, y = (F.when(both, F.col(c)) for c in ("residual_a", "residual_b"))
    rmse = lambda c: F.sqrt(F.avg(c * c))
    return pairs.agg(F.count("*").alias("n_common"), F.count_if(both).alias("n_paired"), F.when(F.count_if(both) >= 2, pearson(x, y)).alias("r"), rmse(x).alias("rmse_a"), rmse(y).alias("rmse_b"), F.max(F.greatest(F.abs(x), F.abs(y))).alias("span"))
