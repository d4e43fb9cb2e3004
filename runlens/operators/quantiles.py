"""Exact ranks and quantiles of groups of any size.

Ranks: equal values are counted first. The counts are dealt by sorted ranges of group and value, so that a group
may lie in many tasks; the ranges' sums, one row a range and group, tell how many rows are before each range.

Quantiles: a first pass brackets each one by an approximate sketch, whose error is known; a second counts what lies between the brackets
and the values within them, both before any shuffle. Only the values within brackets are sorted, a few in ten thousand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed


#: The sketch's error is 1 in ACCURACY rows; groups of up to WHOLE rows are sorted whole.
ACCURACY, WHOLE = 10_000, 10_000


def null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys are equal; without keys both have one row. The keys are a's."""
    right = b.select(*[F.col(f"`{k}`").alias(f"_r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_r_{k}`")) for k in keys]
    joined = a.join(right, reduce(Column.__and__, on), how) if keys else a.crossJoin(F.broadcast(right))
    return joined.drop(*[f"_r_{k}" for k in keys])


def ranks(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """counts(keys, value, n, ...), one row a value, with before (rows of smaller values), total and mean of
    the group. Null values count as no rows."""
    n = F.when(F.col(value).isNotNull(), F.col("n")).otherwise(0)
    part = checkpointed(counts.withColumn("n", n).repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()))
    sums = part.groupBy(*keys, "_range").agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.col(value)).alias("_v"))
    each = Window.partitionBy(*keys)
    before = F.sum("_n").over(each.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*keys, "_range", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(each).alias("total"), F.try_divide(F.sum("_v").over(each), F.sum("_n").over(each)).alias("mean"))
    own = Window.partitionBy("_range", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = null_safe_join(part, sums, [*keys, "_range"])
    return joined.withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0)) + F.col("_before")).drop("_range", "_before")


def quantile(value: Column, part: float) -> Column:
    """An aggregate of ranks(): the value at that part of the rows, linear between neighbours."""
    at = (F.col("total") - 1) * F.lit(part)
    held = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n")), value))
    low, high = held(F.floor(at)), held(F.ceil(at))
    return low + (high - low) * F.max(at - F.floor(at))


def distribution(rows: DataFrame, keys: list[str], value: str, parts: dict[str, float]) -> DataFrame:
    """(keys, n, mean, std, min, max, parts' names) of the rows' values; the deviation is the population's.
    Nulls are skipped; a group of nulls alone has n = 0. rows are read twice."""
    base, v = rows.select(*keys, F.col(value).cast("double").alias("_v")), F.col("_v")
    at = sorted(set(parts.values()))
    ends = [max(0.0, p - 2 / ACCURACY) for p in at] + [min(1.0, p + 2 / ACCURACY) for p in at]
    sketch = F.percentile_approx("_v", F.array(*map(F.lit, ends)), F.lit(ACCURACY))
    groups = checkpointed(base.groupBy(*keys).agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.min("_v").alias("min"), F.max("_v").alias("max"), sketch.alias("_ends")))
    whole = F.col("n") <= WHOLE
    bounds = groups.where("n > 0").select(*keys, F.col("n").alias("total"), *[F.when(whole, float("-inf")).otherwise(F.col("_ends")[i]).alias(f"_low{i}") for i in range(len(at))], *[F.when(whole, float("inf")).otherwise(F.col("_ends")[len(at) + i]).alias(f"_high{i}") for i in range(len(at))])
    found = null_safe_join(base.where("_v IS NOT NULL"), bounds, keys)
    low, high = ([F.col(f"_{side}{i}") for i in range(len(at))] for side in ("low", "high"))
    inside = reduce(Column.__or__, [(v >= x) & (v <= y) for x, y in zip(low, high, strict=True)])
    # Regions follow the values' order; what is in no bracket is one row a region.
    region = reduce(Column.__add__, [(v >= x).cast("int") + (v > y).cast("int") for x, y in zip(low, high, strict=True)])
    counts = found.groupBy(*keys, "total", region.alias("_region"), F.when(inside, v).alias("_value")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("_region", "_value").rowsBetween(Window.unboundedPreceding, -1))
    picked = counts.withColumn("before", F.coalesce(before, F.lit(0))).groupBy(*keys).agg(*[quantile(F.col("_value"), p).alias(name) for name, p in parts.items()])
    return null_safe_join(groups.drop("_ends"), picked, keys, "left")
