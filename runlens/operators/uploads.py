"""Uploads: files are told apart by their content and go on to ingestion, to bundles or to registration as recipes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import dag_hashes
from ..sources.cards import parsed
from ..sources.manifests import archived_recipe
from .ingest import plan

# Names of collections that only releases may use.
PUBLIC = ("benchmark_release", "benchmark_releases", "release", "releases", "public", "published")



def guard_collection(name: str, as_release: bool = False) -> str:
    """The collection's name; raises if it is a public one and this is no release."""
    if not as_release and name.strip().lower().replace("-", "_") in PUBLIC:
        raise ValueError(f"collection {name} takes releases only")
    return name


def is_path(text: str) -> bool:
    """Whether an upload's text may name a file: recipes and manifests are data, whatever files there are."""
    t = text.strip()
    return bool(t) and len(t) <= 1024 and "\n" not in t and t[0] not in '{["'


def sniffed(content: bytes) -> tuple[str, str | None, str | None]:
    """(kind, text, label) of a file: export, bundle, recipe or unknown. A recipe's text is its JSON source for dag_hashes()."""
    if content[:4] == b"PK\x03\x04":
        recipe = archived_recipe(content)[0]
        return ("recipe", recipe, None) if recipe else ("unknown", None, None)
    try:
        text = content.decode()
        body = parsed(text.strip())
    except ValueError:
        return "unknown", None, None
    if isinstance(body, list):
        return "recipe", json.dumps(body, ensure_ascii=False), None
    if not isinstance(body, dict):
        return "unknown", None, None
    if "arena_export_schema_version" in body:
        return "export", text, None
    if "graph_fingerprint" in body or "bundle_id" in body:
        return "bundle", text, None
    source = next((body[k] for k in ("pipeline", "steps") if isinstance(body.get(k), list)), body if "nodes" in body else None)
    return ("recipe", json.dumps(source, ensure_ascii=False), body.get("name") or body.get("label")) if source is not None else ("unknown", None, None)


def kinds(files: DataFrame) -> DataFrame:
    """files(path, content binary) as (path, kind, text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sniffed(x or b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in found], pa.string()) for i in range(3))], names=["path", "kind", "text", "label"])

    return files.select("path", "content").mapInArrow(run, "path string, kind string, text string, label string")


def register(uploads: DataFrame, datasets: list[str], executions: DataFrame, collection: str = "uploads") -> DataFrame:
    """The recipes among kinds(), planned for each of the fingerprints in datasets: path, label and what plan() gives."""
    recipes = uploads.where("kind = 'recipe'")
    hashed = dag_hashes(recipes.select(F.col("path").alias("pipeline_id"), F.col("text").alias("source"))).select(F.col("pipeline_id").alias("path"), "pipeline_dag_hash").where("pipeline_dag_hash IS NOT NULL")
    each = F.explode(F.array(*map(F.lit, sorted(set(datasets)))).cast("array<string>")).alias("dataset_fingerprint")
    targets = hashed.select("pipeline_dag_hash", each, F.lit(guard_collection(collection)).alias("collection_id")).distinct()
    return plan(targets, executions).join(hashed, "pipeline_dag_hash").join(recipes.select("path", "label"), "path")
