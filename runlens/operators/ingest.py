"""Set-oriented ingestion: a batch of manifests is verified, resolved and merged as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import is_hash, plan_id, pseudonym, run_condition_hash

# What a manifest's fields may be.
TASKS = ("regression", "binary", "multiclass", "multilabel")
#: Residual rows of an export beyond which only its scores are kept.
RESIDUAL_CAP = 1_000_000


def once(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row per key, the least of several."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")).select(*key, "_row.*").select(rows.columns) if rest else rows.distinct()


def upsert(new: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """The rows of new to append: one per key, the least of several, none that exists."""
    return once(new, key).join(existing.select(*key), key, "left_anti")


def verify(manifests: DataFrame, quarantine: bool = True) -> DataFrame:
    """manifests with issues (array of messages) and status. Columns: schema_version,
    dataset_fingerprint, task_type, n_folds, n_samples, n_observations, oof_enforced, unsafe_flags, residual_key."""

    def rule(bad: Column, level: str, message: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{level}: {message}"))

    version = ~F.col("schema_version").eqNullSafe(1)
    hash_bad = F.col("dataset_fingerprint").isNull() | ~is_hash(F.col("dataset_fingerprint"))
    leak = ~F.coalesce("oof_enforced", F.lit(True))
    rules = F.array(
        rule(version, "error", "schema version"),
        rule(hash_bad, "error", "dataset fingerprint"),
        rule(F.col("task_type").isNull() | ~F.col("task_type").isin(*TASKS), "error", "task type"),
        rule(F.col("n_folds") > F.col("n_samples"), "error", "more folds than samples"),
        rule(F.coalesce("n_observations", F.lit(0)) == 0, "warning", "no scores"),
        rule(F.size("unsafe_flags") > 0, "warning", "unsafe flags"),
        rule(F.col("residual_key") == "positional", "warning", "positional residuals"),
        rule(leak, "error" if quarantine else "warning", "leakage"),
    )
    out = manifests.withColumn("issues", F.filter(rules, lambda x: x.isNotNull()))
    fatal = F.exists("issues", lambda x: x.startswith("error") & (x != "error: leakage"))
    return out.withColumn("status", F.when(fatal, "rejected").when(leak & F.lit(quarantine), "quarantined").otherwise("committed"))


def issue_counts(verified: DataFrame) -> DataFrame:
    return verified.select(F.explode("issues").alias("i")).groupBy(F.substring_index("i", ":", 1).alias("level")).agg(F.count("*").alias("n"))


def new_exports(manifests: DataFrame, batches: DataFrame) -> DataFrame:
    """Manifests not ingested before: one for each export hash, in any collection."""
    return upsert(manifests, batches.where(F.col("status").isin("committed", "quarantined")), ["export_hash", "schema_version"])


def publishable(residuals: DataFrame, salt: str, regression: bool = True) -> DataFrame:
    """Residual rows as they may be kept: pseudonymous ids, withheld values masked by the
    flags may_y_true, may_y_pred and may_y_proba; a given residual stays."""
    masked = {c: F.when(F.coalesce(F.col(f"may_{c}"), F.lit(True)), F.col(c)) for c in ("y_true", "y_pred", "y_proba")}
    derived = F.coalesce("residual", masked["y_true"] - masked["y_pred"]) if regression else F.col("residual")
    ids = {c: pseudonym(salt, F.col(c)) for c in ("sample_id", "group_id", "origin_sample_id") if c in residuals.columns}
    out = residuals.withColumns({"residual": derived, **masked, **ids, "scope": F.coalesce("scope", F.lit("cv")), "partition": F.coalesce("partition", F.lit("validation"))})
    return out.drop("may_y_true", "may_y_pred", "may_y_proba")


def within_cap(residuals: DataFrame, cap: int = RESIDUAL_CAP) -> DataFrame:
    """The residuals of exports with at most cap rows; others keep their scores
    only, as the policy says, and are flagged by cap_report(). Counts are aggregated before any join."""
    few = cap_report(residuals, cap).where("NOT truncated")
    return residuals.join(few.select("export_hash"), "export_hash", "left_semi")


def cap_report(residuals: DataFrame, cap: int = RESIDUAL_CAP) -> DataFrame:
    """(export_hash, n_rows, truncated) of every export with residuals: what within_cap() leaves out is flagged here."""
    return residuals.groupBy("export_hash").agg(F.count("*").alias("n_rows")).withColumn("truncated", F.col("n_rows") > cap)


def superseded(score_sets: DataFrame) -> DataFrame:
    """score_sets with validity: of an execution's sets of a scope the latest by seq is valid."""
    ties = [c for c in ("score_set_id",) if c in score_sets.columns]
    last = Window.partitionBy("execution_hash", "scope").orderBy(F.desc("seq"), *ties)
    return score_sets.withColumn("validity", F.when(F.row_number().over(last) == 1, "valid").otherwise("superseded"))


def latest(events: DataFrame, key: str, value: str) -> DataFrame:
    """The last status of each key from appended status events."""
    return events.groupBy(key).agg(F.max(F.struct("seq", value))[value].alias(value))


def plan(targets: DataFrame, executions: DataFrame) -> DataFrame:
    """targets(pipeline_dag_hash, dataset_fingerprint, collection_id) with status: already_run or planned, and a plan_id."""
    done = executions.where("execution_validity = 'valid'").select("pipeline_dag_hash", "dataset_fingerprint").distinct().withColumn("done", F.lit(True))
    out = targets.join(done, ["pipeline_dag_hash", "dataset_fingerprint"], "left")
    key = plan_id(F.col("pipeline_dag_hash"), F.col("dataset_fingerprint"), F.col("collection_id"))
    return out.select("pipeline_dag_hash", "dataset_fingerprint", "collection_id", F.when(F.col("done"), "already_run").otherwise("planned").alias("status"), key.alias("plan_id"))


def with_condition_hash(parts: DataFrame) -> DataFrame:
    """parts with run_condition_hash of its six component hashes."""
    return parts.withColumn("run_condition_hash", run_condition_hash(**{c: F.col(c) for c in parts.columns if c.endswith("_hash")}))
