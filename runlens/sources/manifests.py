"""Sources of runs: export manifests, engine bundles' prediction blocks and recipe archives."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import fingerprint
from .commitlog import Files

MANIFEST = """schema_version int, export_hash string, dataset struct<dataset_fingerprint:string, n_samples:long>, task struct<task_type:string>, cv struct<n_folds:long>,
    leakage_attestation struct<oof_enforced:boolean, unsafe_flags:array<string>>,
    scores struct<observations:array<struct<metric_name:string, metric_value:double, direction:string, scope:string, fold_id:string, partition:string, aggregation_level:string, metric_unit:string, n_samples:long, coverage:double>>>,
    residuals struct<key:string, inline:array<struct<sample_id:string, group_id:string, origin_sample_id:string, scope:string, fold_id:string, partition:string, y_true:double, y_pred:double, y_proba:array<double>, residual:double, weight:double>>>"""


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, m, export_hash) of each JSON file of a folder: the raw text is kept, as hashes start from it."""
    return parsed(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text")))


def fields(rows: DataFrame) -> DataFrame:
    """rows(path, text) with m, what ingestion reads of a manifest."""
    return rows.withColumn("m", F.from_json("text", MANIFEST.replace("schema_version", "arena_export_schema_version", 1).replace("export_hash", "arena_export_hash", 1)))


def parsed(rows: DataFrame) -> DataFrame:
    """fields() with export_hash, the hash of a manifest's content."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                try:
                    body = json.loads(text)
                    out.append(fingerprint({k: v for k, v in body.items() if k != "arena_export_hash"}))
                except (ValueError, AttributeError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["path", "text", "export_hash"])

    return fields(rows.select("path", "text").mapInArrow(hashed, "path string, text string, export_hash string"))


def checked_fields(manifest: DataFrame, *more: Column | str) -> DataFrame:
    """manifests() with the columns that ingestion verifies, and more."""
    return manifest.select(
        "export_hash", "path", F.col("m.arena_export_schema_version").alias("schema_version"), "m.dataset.dataset_fingerprint", "m.task.task_type", "m.cv.n_folds", "m.dataset.n_samples",
        F.coalesce(F.size("m.scores.observations"), F.lit(0)).alias("n_observations"), "m.leakage_attestation.oof_enforced", "m.leakage_attestation.unsafe_flags", F.col("m.residuals.key").alias("residual_key"), *more,
    )


def observations(manifest: DataFrame) -> DataFrame:
    return manifest.select("export_hash", F.inline("m.scores.observations"))


def inline_residuals(manifest: DataFrame) -> DataFrame:
    return manifest.select("export_hash", F.inline("m.residuals.inline"))


def prediction_residuals(blocks: DataFrame) -> DataFrame:
    """blocks(residual_set_id, partition, fold_id, sample_ids, values, y_true) as rows: arrays side by side, null past
    the end; of nested values the first element counts."""
    arrays = {f.name: f.dataType for f in blocks.schema}
    first = lambda c: F.get(F.get(c, F.col("i")), F.lit(0)) if arrays[c].elementType.typeName() == "array" else F.get(c, F.col("i"))
    partition = F.lower(F.coalesce("partition", F.lit("validation")))
    scope = F.when(partition == "test", "test").when(partition == "final", "refit").otherwise("cv")
    group = F.get("group_ids", F.col("i")) if "group_ids" in arrays else F.lit(None).cast("string")
    rows = blocks.withColumns({"partition": partition, "scope": scope}).select("*", F.posexplode("sample_ids").alias("i", "sample_id"))
    out = rows.withColumns({"group_id": group, "y_pred": first("values"), "y_true": first("y_true")})
    return out.select("residual_set_id", "sample_id", "group_id", "scope", "fold_id", "partition", "y_true", "y_pred", (F.col("y_true") - F.col("y_pred")).alias("residual"))


def report_observations(reports: DataFrame) -> DataFrame:
    """reports(partition, level, fold_id, metrics map of text, ...) as observations with scope; values that are no numbers go.
    The scope is test by partition, fold for a fold's own, else the level if it is a scope, else cv."""
    partition, level = F.lower(F.coalesce("partition", F.lit("validation"))), F.lower(F.coalesce("level", F.lit("cv")))
    scope = F.when(partition == "test", "test").when(F.col("fold_id") != "", "fold").when(level.isin("fold", "cv", "refit", "test", "view"), level).otherwise("cv")
    of = F.when(F.col("level") == "macro", "target").otherwise("sample")
    rest = [c for c in reports.columns if c not in ("metrics", "partition")]
    rows = reports.select(*rest, partition.alias("partition"), scope.alias("scope"), of.alias("aggregation_level"), F.explode("metrics").alias("metric_name", "_text"))
    return rows.withColumns({"metric_name": F.lower("metric_name"), "metric_value": F.col("_text").try_cast("double")}).where("metric_value IS NOT NULL").drop("_text")


def residual_rows(spark: SparkSession, manifest: DataFrame, folder: str | None = None) -> DataFrame:
    """manifests()' residuals: those inline, else those of the Parquet file that residuals.ref names in the folder, by default the
    manifest's own. Only named files are opened, each once however many manifests name it; one that isn't there has no rows."""
    inline = inline_residuals(manifest)
    bare = manifest.where(F.coalesce(F.size("m.residuals.inline"), F.lit(0)) == 0)
    decoded = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    beside = F.lit(folder.rstrip("/")) if folder else decoded(F.regexp_replace("path", "/[^/]*$", ""))
    refs = bare.select("export_hash", F.concat(beside, F.lit("/"), F.get_json_object("text", "$.residuals.ref")).alias("_named")).where("_named IS NOT NULL")
    files = Files(spark)
    named = [r[0] for r in refs.select("_named").distinct().collect()]  # the batch's file names, which the reader needs
    there = [x for x in named if files.exists(x)]
    if not there:
        return inline
    kinds = {f.name: f.dataType for f in inline.schema if f.name != "export_hash"}
    side = spark.read.option("mergeSchema", True).parquet(*there)
    cols = [(F.col(f"`{n}`") if n in side.columns else F.lit(None)).cast(kind).alias(n) for n, kind in kinds.items()]
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "^[a-z0-9+.-]+:/*", "/"), "/+", "/")
    rows = side.select(plain(decoded(F.col("_metadata.file_path"))).alias("_file"), *cols)
    return inline.unionByName(refs.withColumn("_file", plain(F.col("_named"))).join(rows, "_file").select(inline.columns))


def reshaped(flat, n, k):
    """A flat array as n rows of k; null if its size isn't n * k."""
    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(flat, i * k + 1, k))
    return F.when((n > 0) & (k > 0) & (F.size(flat) == n * k), rows)


def archived_recipe(content: bytes) -> tuple[str | None, str | None, list[str]]:
    """(recipe, source_name, artifacts) of an archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            artifacts = sorted(x for x in names if x.startswith("artifacts/"))
            if "pipeline.json" in names:
                return z.read("pipeline.json").decode(), "pipeline.json", artifacts
            chain = json.loads(z.read("manifest.json")).get("preprocessing_chain") if "manifest.json" in names else None
            return (json.dumps(chain), "manifest.json", artifacts) if chain else (None, None, artifacts)
    except (zipfile.BadZipFile, ValueError, AttributeError):
        return None, None, []


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """(path, recipe, source_name, artifacts) of recipe archives: a recipe is pipeline.json's text, else the manifest's
    preprocessing chain; artifacts are only named. Files that aren't archives have null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [archived_recipe(content) for content in b.column(1).to_pylist()]
            cols = zip(*found, strict=True) if found else [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.list_(pa.string())), strict=True))], names=["path", "recipe", "source_name", "artifacts"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, recipe string, source_name string, artifacts array<string>")
