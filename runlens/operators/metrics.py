"""The metric library: scores computed again from residual rows, in long form.

A metric that isn't defined for a group gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import distribution, null_safe_join, ranks
from .rankings import direction

#: Probabilities are kept this far from 0 and 1.
EPS = 1e-15
REGRESSION = ("mse", "rmse", "mae", "medae", "bias", "r2", "rpd", "rpiq", "ccc")


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _long(wide: DataFrame, keys: list[str], names: tuple[str, ...]) -> DataFrame:
    """unpivot leaves nulls in; they go."""
    return wide.unpivot(keys, list(names), "metric_name", "metric_value").where("metric_value IS NOT NULL")


def regression(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_samples, coverage, metric_name, metric_value) of rows(keys, y_true, y_pred)."""
    t, p = F.col("y_true").cast("double"), F.col("y_pred").cast("double")
    ok = _finite(t) & _finite(p)
    pairs = rows.select(*keys, F.when(ok, t).alias("t"), F.when(ok, p).alias("p"), F.when(ok, t - p).alias("e"))
    both = pairs.select(*keys, F.explode(F.array(F.struct(F.lit("t").alias("side"), F.col("t").alias("v")), F.struct(F.lit("e").alias("side"), F.abs("e").alias("v")))).alias("x")).select(*keys, "x.*")
    q = distribution(both, [*keys, "side"], "v", {"low": 0.25, "middle": 0.5, "high": 0.75})
    q = q.groupBy(*keys).agg(F.max(F.when(F.col("side") == "e", F.col("middle"))).alias("medae"), F.max(F.when(F.col("side") == "t", F.col("high") - F.col("low"))).alias("iqr"))
    g = pairs.groupBy(*keys).agg(
        F.count("e").alias("n_samples"), F.count("*").alias("n"), F.avg(F.col("e") * F.col("e")).alias("mse"), F.avg(F.abs("e")).alias("mae"), F.avg("e").alias("bias"),
        F.var_pop("t").alias("vt"), F.var_pop("p").alias("vp"), F.covar_pop("t", "p").alias("cov"), (F.avg("t") - F.avg("p")).alias("gap"),
    ).where("n_samples > 0")
    g = null_safe_join(g, q, keys)
    rmse, varied = F.sqrt("mse"), F.col("vt") > 0
    wide = g.withColumns({
        "coverage": F.col("n_samples") / F.col("n"),
        "rmse": rmse,
        "r2": F.when(varied, 1 - F.try_divide("mse", "vt")),
        "rpd": F.when(varied & (rmse > 0), F.try_divide(F.sqrt("vt"), rmse)),
        "rpiq": F.when(varied & (rmse > 0), F.try_divide("iqr", rmse)),
        "ccc": F.when(F.col("n_samples") > 1, F.try_divide(2 * F.col("cov"), F.col("vt") + F.col("vp") + F.col("gap") * F.col("gap"))),
    })
    return _long(wide, [*keys, "n_samples", "coverage"], REGRESSION)


def confusion(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y_true, y_pred, n) for all pairs of labels seen on either side: the labels of a
    group are few, so that the dense table is made from them alone."""
    seen = rows.where("y_true IS NOT NULL AND y_pred IS NOT NULL").groupBy(*keys, "y_true", "y_pred").agg(F.count("*").alias("n"))
    labels = seen.groupBy(*keys).agg(F.array_union(F.collect_set("y_true"), F.collect_set("y_pred")).alias("l"))
    dense = labels.select(*keys, F.explode("l").alias("y_true"), "l").select(*keys, "y_true", F.explode("l").alias("y_pred"))
    return dense.join(seen, [*keys, "y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def classification(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, macro averages over all labels seen, and Matthews' coefficient."""
    cells = rows.where("y_true IS NOT NULL AND y_pred IS NOT NULL").groupBy(*keys, "y_true", "y_pred").agg(F.count("*").alias("n"))
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    sides = cells.select(*keys, F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), hit.alias("tp")), F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("tp")))).alias("s")).select(*keys, "s.*")
    per = sides.groupBy(*keys, "label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("tp").alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    t, p, tp = F.col("t"), F.col("p"), F.col("tp")
    d = lambda c: F.sum(c.cast("double"))
    g = per.groupBy(*keys).agg(F.sum("t").alias("n_samples"), d(tp).alias("c"), d(t).alias("s"), F.avg(ratio(tp, p)).alias("precision_macro"), F.avg(ratio(tp, t)).alias("recall_macro"), F.avg(ratio(2 * tp, t + p)).alias("f1_macro"), F.sum(t.cast("double") * p).alias("tp_"), F.sum(p.cast("double") * p).alias("pp"), F.sum(t.cast("double") * t).alias("tt"))
    s, c = F.col("s"), F.col("c")
    denominator = F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))
    wide = g.withColumns({"accuracy": c / s, "balanced_accuracy": F.col("recall_macro"), "mcc": F.when(denominator > 0, F.try_divide(c * s - F.col("tp_"), denominator))})
    return _long(wide, [*keys, "n_samples"], ("accuracy", "precision_macro", "recall_macro", "f1_macro", "balanced_accuracy", "mcc"))


def log_loss(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows(keys, y_true, y_proba): a label's column is its rank among the labels seen, unknown columns are skipped."""
    labels = rows.where("y_true IS NOT NULL").groupBy(*keys).agg(F.array_sort(F.collect_set("y_true")).alias("labels"))
    at = F.array_position("labels", F.col("y_true")).cast("int")
    p = F.when(at > 0, F.get("y_proba", at - 1))
    loss = -F.log(F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS)))
    return rows.join(labels, keys).groupBy(*keys).agg(F.avg(loss).alias("log_loss"))


def roc_auc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows(keys, y_true 0/1, score), by average ranks. Scores are counted first;
    then a running sum over distinct scores replaces a rank over rows."""
    c = F.least(F.greatest(F.col("score"), F.lit(EPS)), F.lit(1 - EPS))
    g = rows.where("y_true IS NOT NULL AND score IS NOT NULL").groupBy(*keys, c.alias("score")).agg(F.count("*").alias("n"), F.count_if(F.col("y_true") == 1).alias("pos"))
    r = ranks(g, keys, "score").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2).groupBy(*keys).agg(F.sum(F.col("rank") * F.col("pos")).alias("ranks"), F.sum("pos").cast("double").alias("pos"), F.sum("n").cast("double").alias("n"))
    auc = F.try_divide(F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * (F.col("n") - F.col("pos")))
    return r.select(*keys, auc.alias("roc_auc")).where("roc_auc IS NOT NULL")


def probabilities(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_samples, metric_name, metric_value): log_loss, and for two classes roc_auc, of rows(keys, y_true, y_pred, y_proba). A probability's
    column is its label's place among the sorted labels of its group, seen on either side, which travel with the rows; labels beyond the columns are
    skipped. A group in which a pair lacks its probabilities has neither."""
    pairs = rows.where("y_true IS NOT NULL AND y_pred IS NOT NULL")
    whole = F.min(F.col("y_proba").isNotNull()).alias("whole")
    labels = F.array_sort(F.array_union(F.collect_set("y_true"), F.collect_set("y_pred"))).alias("labels")  # classes, which are few
    groups = pairs.groupBy(*keys).agg(labels, whole, F.max(F.size("y_proba")).alias("k"), F.count("*").alias("n_samples")).where("whole")
    found = null_safe_join(pairs, groups, keys).withColumn("at", F.array_position("labels", F.col("y_true")).cast("int"))
    p = F.get("y_proba", F.col("at") - 1)
    loss = -F.log(F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS)))
    losses = found.groupBy(*keys, "n_samples").agg(F.avg(loss).alias("log_loss"))
    two = found.where("k = 2").select(*keys, (F.col("at") == 2).cast("int").alias("y_true"), F.get("y_proba", F.lit(1)).alias("score"))
    areas = null_safe_join(groups.select(*keys, "n_samples"), roc_auc(two, keys), keys)
    return _long(losses, [*keys, "n_samples"], ("log_loss",)).unionByName(_long(areas, [*keys, "n_samples"], ("roc_auc",)))


def recompute(residuals: DataFrame, task_type: str = "regression") -> DataFrame:
    """Observations of residual sets by scope, fold and partition, with the direction of each metric, how many pairs it is made of and their share of the rows."""
    keys = ["residual_set_id", "scope", "fold_id", "partition"]
    probable = task_type != "regression" and "y_proba" in residuals.columns
    rows = residuals.select("residual_set_id", F.coalesce("scope", F.lit("cv")).alias("scope"), "fold_id", F.coalesce("partition", F.lit("validation")).alias("partition"), "y_true", "y_pred", *(["y_proba"] if probable else []))
    if task_type == "regression":
        found = regression(rows, keys)
    else:
        found = classification(rows, keys)
        found = found.unionByName(probabilities(rows, keys)) if probable else found
        totals = rows.groupBy(*keys).agg(F.count("*").alias("_rows"))
        found = null_safe_join(found, totals, keys).withColumn("coverage", F.col("n_samples") / F.col("_rows")).drop("_rows")
    return found.withColumn("direction", direction(F.col("metric_name")))
