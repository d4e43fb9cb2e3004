"""Dataset cards from a catalogue of YAML files, a file to a dataset."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import fingerprint

_YAML = """id string, name string, description string, domain string, tier string, versions struct<content:string>, governance struct<license:string>, keywords array<string>,
    sources array<struct<n_variables:string, n_observations:string, modality:string, signal_type:string, axis_unit:string, axis_min:string, axis_max:string, axis_resolution:string>>, variables array<struct<name:string, role:string>>"""


def parsed(text: str):
    """JSON, else YAML."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml  # optional: only catalogues and YAML recipes need it

        try:
            return yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError("neither JSON nor YAML") from e


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of a folder's YAML files."""
    return spark.read.option("pathGlobFilter", "*.{yaml,yml}").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def as_json(texts: DataFrame) -> DataFrame:
    """texts(path, text) with json: the same content as JSON, and card_hash, its fingerprint; null for what can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                try:
                    body = parsed(text)
                    out.append((json.dumps(body, ensure_ascii=False), fingerprint(body)) if isinstance(body, dict) else (None, None))
                except (TypeError, ValueError):
                    out.append((None, None))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in out], pa.string()) for i in (0, 1))], names=["path", "json", "card_hash"])

    return texts.select("path", "text").mapInArrow(run, "path string, json string, card_hash string")


def cards(texts: DataFrame) -> DataFrame:
    """A card for each readable text: features are summed over its sources, samples are the most that a source has
    (null for none), coordinates those of its first source; numbers that can't be read are null or count as 0."""
    y = as_json(texts).where("json IS NOT NULL").select("card_hash", F.from_json("json", _YAML).alias("y")).select("card_hash", "y.*")
    first = F.get("sources", F.lit(0))
    number = lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint"))
    features = F.aggregate("sources", F.lit(0).cast("bigint"), lambda n, s: n + number(s["n_variables"]))
    samples = F.array_max(F.transform("sources", lambda s: number(s["n_observations"])))
    axis = [first[c].try_cast("double").alias(c) for c in ("axis_min", "axis_max", "axis_resolution")]
    return y.select(
        "card_hash", F.coalesce("id", F.lit("unknown")).alias("dataset_id"), F.col("versions.content").alias("dataset_version"), "name", "description", "domain", first["modality"].alias("modality"), first["signal_type"].alias("signal_type"),
        F.when(F.col("tier") == "public", "public").otherwise("restricted").alias("visibility"), first["axis_unit"].alias("axis_unit"), *axis, F.nullif(samples, F.lit(0).cast("bigint")).alias("n_samples"), F.nullif(features, F.lit(0).cast("bigint")).alias("n_features"),
        F.col("governance.license").alias("license"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), F.size(F.filter(F.coalesce("variables", F.array().cast("array<struct<name:string, role:string>>")), lambda v: v["role"] == "target")).alias("n_targets"),
    )
