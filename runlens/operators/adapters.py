"""Whole batches from workspaces and engine bundles: manifests, and their scores and residuals by export, as ingest() takes them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import quoted
from ..sources import bundles as B
from ..sources import manifests as M
from ..sources import workspace as W
from ..sources.scratch import checkpointed
from ..sources.store import Store
from . import resolve, uploads
from .batches import KEYS, Policy, ingest, plan
from .ingest import once


class Batch(NamedTuple):
    manifests: DataFrame
    scores: DataFrame
    residuals: DataFrame


def _by_export(rows: DataFrame, manifests: DataFrame) -> DataFrame:
    """rows(path, ...) under their manifest's hash."""
    return rows.join(manifests.select("path", "export_hash"), "path").drop("path")


def workspace(spark: SparkSession, root: str) -> Batch:
    """A workspace's runs: its SQLite file store.sqlite and the arrays beside it. A run without attestation is what a workspace has,
    so a release keeps all of it apart."""
    file = f"{root}/store.sqlite"
    predictions = W.table(spark, file, "predictions", W.PREDICTIONS)
    path = F.concat_ws(":", *W.RUN).alias("path")
    texts = W.manifest_texts(W.runs(W.table(spark, file, "pipelines", W.PIPELINES), predictions))
    m = checkpointed(M.parsed(texts.select(path, "text")))
    scores = W.observations(predictions).select(path, "metric_name", "metric_value", "direction", "scope", "fold_id", "partition")
    residuals = W.residuals(predictions, W.arrays(spark, root)).select(path, "sample_id", "scope", "fold_id", "partition", "y_true", "y_pred", "y_proba", "residual")
    return Batch(m, _by_export(scores, m), _by_export(residuals, m))


def bundles(rows: DataFrame, reports: DataFrame | None = None) -> Batch:
    """Engine bundles(path, text, graph, envelope) with their cached predictions; reports(path, partition, level, fold_id, metrics): their scores."""
    m = checkpointed(M.parsed(B.bundle_manifests(rows).where("text IS NOT NULL")))
    residuals = B.cached_residuals(rows).withColumnRenamed("residual_set_id", "path")
    if reports is None:
        reports = rows.sparkSession.createDataFrame([], "path string, partition string, level string, fold_id string, metrics map<string,string>")
    scores = M.report_observations(reports).select("path", "metric_name", "metric_value", "scope", "fold_id", "partition", "aggregation_level")
    return Batch(m, _by_export(scores, m), _by_export(residuals, m))


def take(store: Store, batch: Batch, policy: Policy) -> DataFrame:
    """ingest() of a batch; runs without scores get them from their residuals."""
    return ingest(store, batch.manifests, policy, side=batch.residuals, scores=batch.scores)


def register(store: Store, recipes: DataFrame) -> DataFrame:
    """Writes the pipelines of recipes(path, text, label) that the store lacks: (path, pipeline_dag_hash), null for what is no pipeline."""
    head = F.lit('{"dataset":{"dataset_fingerprint":"' + "0" * 64 + '"},"task":{"task_type":"regression"},"execution":{"execution_id":')
    text = F.concat(head, quoted(F.col("path")), F.lit('},"pipeline":{"human_label":'), quoted(F.col("label")), F.lit(',"graph":'), "text", F.lit("}}"))
    found = checkpointed(resolve.resolve(recipes.select(text.alias("text"))))
    nodes, params, state = resolve.pipeline_nodes(found), resolve.node_params(found), store.state()
    offered = {
        "pipeline_dags": resolve.pipeline_dags(found), "pipeline_nodes": nodes.withColumnRenamed("role", "kind"), "pipeline_edges": resolve.pipeline_edges(found),
        "operator_specs": resolve.operator_specs(nodes), "node_params": params, "parameter_values": resolve.parameter_values(params),
    }
    store.commit(state, **{name: store.absent(name, once(rows, KEYS[name]), state) for name, rows in offered.items()})
    return recipes.select("path").join(found.select(F.col("execution_id").alias("path"), "pipeline_dag_hash"), "path", "left")


def upload(store: Store, files: DataFrame, policy: Policy, datasets: list[str] | None = None) -> DataFrame:
    """files(path, content) go where their content says: exports and bundles are ingested, recipes registered and planned on datasets,
    which are fingerprints or names of cards. (path, kind, status, pipeline_dag_hash, dataset_fingerprint); a recipe has a row for each dataset, a file of an unknown kind is said to be one."""
    uploads.guard_collection(policy.collection, policy.release)
    spark, told = files.sparkSession, checkpointed(uploads.kinds(files))
    there = {r.kind for r in told.select("kind").distinct().collect()}  # four at most
    none = F.lit(None).cast("string")
    out = told.where("kind = 'unknown'").select("path", "kind", F.lit("unknown").alias("status"), none.alias("pipeline_dag_hash"), none.alias("dataset_fingerprint"))

    def ingested(kind: str, batch: Batch) -> DataFrame:
        report = take(store, batch, policy)
        known = told.where(F.col("kind") == kind).select("path", "kind").join(batch.manifests.select("path", "export_hash"), "path", "left").join(report.select("export_hash", "status"), "export_hash", "left")
        return known.select("path", "kind", F.coalesce("status", F.lit("rejected")).alias("status"), none.alias("pipeline_dag_hash"), none.alias("dataset_fingerprint"))

    if "export" in there:
        m = checkpointed(M.parsed(told.where("kind = 'export'").select("path", "text")))
        empty = m.where("false").select("export_hash")
        out = out.unionByName(ingested("export", Batch(m, empty.withColumns({"metric_name": none, "metric_value": none.cast("double"), "scope": none, "fold_id": none, "partition": none}), empty.withColumn("sample_id", none))))
    if "bundle" in there:
        out = out.unionByName(ingested("bundle", bundles(told.where("kind = 'bundle'").select("path", "text", none.alias("graph"), none.alias("envelope")))))
    if "recipe" in there:
        known = checkpointed(register(store, told.where("kind = 'recipe'").select("path", "text", "label")))
        cards = store.read("dataset_cards").select("name", "dataset_id", "dataset_fingerprint")
        tokens = spark.createDataFrame([(d,) for d in sorted(set(datasets or []))], "token string")
        targets = known.where("pipeline_dag_hash IS NOT NULL").select("pipeline_dag_hash").distinct().withColumn("token", F.explode(F.array(*map(F.lit, sorted(set(datasets or [])))).cast("array<string>")))
        targets = targets.join(resolve.dataset_of(tokens, cards), "token").select("pipeline_dag_hash", "dataset_fingerprint", F.lit(policy.collection).alias("collection_id"))
        planned = plan(store, targets).select("pipeline_dag_hash", "dataset_fingerprint", "status")
        status = F.when(F.col("pipeline_dag_hash").isNull(), "unknown").otherwise(F.coalesce("status", F.lit("registered")))
        out = out.unionByName(known.join(planned, "pipeline_dag_hash", "left").select("path", F.lit("recipe").alias("kind"), status.alias("status"), "pipeline_dag_hash", "dataset_fingerprint"))
    return out
