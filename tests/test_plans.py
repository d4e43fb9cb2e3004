"""Every query that has SQL gives DuckDB's rows; small frames for what the tables lack."""

import glob
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from runlens import plans
from runlens.functions import identity
from runlens.operators import ingest, metrics, rankings, residuals
from runlens.sources import manifests, store
from runlens.streaming import monitor


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    return Counter(tuple(f"{x + 0.0:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_against_sql(spark, sf, duck, name):
    got = plans.queries()[name](spark, sf)
    want = duck.execute(plans.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(got.select(*[f"`{n}`" for n in names]).collect()) == plain(want.fetchall())


def test_scope_and_partition_are_checked(spark, sf):
    for bad in ({"scope": "none"}, {"partition": "none"}):
        with pytest.raises(ValueError):
            rankings.selected(spark.range(1), "rmse", **bad)


def test_regression_metrics_of_known_vectors(spark):
    rows = [("a", 1.0, 1.5), ("a", 2.0, 2.0), ("a", 3.0, 2.5), ("a", None, 1.0), ("a", float("nan"), 1.0), ("flat", 2.0, 2.0)]
    got = {(r.k, r.metric_name): r.metric_value for r in metrics.regression(spark.createDataFrame(rows, "k string, y_true double, y_pred double"), ["k"]).collect()}
    assert got["a", "mae"] == pytest.approx(1 / 3) and got["a", "rmse"] == pytest.approx((1 / 6) ** 0.5) and got["a", "bias"] == pytest.approx(0)
    assert ("flat", "r2") not in got and got["flat", "mse"] == 0


def test_classification_and_auc_of_known_vectors(spark):
    rows = spark.createDataFrame([("k", a, b) for a, b in zip("aabb", "abbb")], "k string, y_true string, y_pred string")
    assert {r.metric_name: r.metric_value for r in metrics.classification(rows, ["k"]).collect()}["accuracy"] == 0.75
    auc = spark.createDataFrame([("k", y, p) for y, p in zip([0, 0, 1, 1], [0.1, 0.2, 0.7, 0.8])], "k string, y_true int, score double")
    assert metrics.roc_auc(auc, ["k"]).first().roc_auc == 1.0


def test_constant_residuals_have_no_correlation(spark):
    pairs = spark.createDataFrame([("s", 1.0, 2.0), ("t", 1.0, 3.0), ("u", None, 1.0)], "sample_id string, residual_a double, residual_b double")
    r = residuals.compare(pairs).first()
    assert (r.n_common, r.n_paired, r.r) == (3, 2, None)


def test_native_hashes_are_those_of_canonical_json(spark):
    row = spark.createDataFrame([('a"b\\c', "é")], "x string, y string").select(identity.hash_of(y=F.col("y"), x=F.col("x")).alias("h")).first()
    assert row.h == identity.fingerprint({"x": 'a"b\\c', "y": "é"})
    with pytest.raises(ValueError):
        identity.canonical_json({"x": float("nan")})


def test_graph_hash_ignores_ids_in_chains(spark):
    chain = lambda a, b: {"nodes": [{"id": a, "operator": "X"}, {"id": b, "operator": "Y", "params": {"k": 1.0}}], "edges": [{"src": a, "dst": b}]}
    assert identity.normal_graph(chain("a", "b"))["dag_hash"] == identity.normal_graph(chain("n1", "n2"))["dag_hash"]
    assert identity.normal_graph(chain("a", "b"))["dag_hash"] != identity.normal_graph({"nodes": [{"id": "a", "operator": "X"}, {"id": "b", "operator": "Y"}], "edges": []})["dag_hash"]
    got = identity.dag_hashes(spark.createDataFrame([("p", '[{"operator": "X"}]'), ("bad", "{"), ("none", None)], "pipeline_id string, source string")).collect()
    assert [bool(r.pipeline_dag_hash) for r in sorted(got, key=lambda r: r.pipeline_id)] == [False, False, True]


def test_store_shows_committed_batches_only(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), {"t": "k string, v long", "residuals": store.RESIDUAL})
    assert s.read("t").count() == 0
    s.commit(t=spark.createDataFrame([("a", 1, 9)], "k string, v int, other int"))
    with pytest.raises(Exception):  # noqa: B017
        s.commit(t=spark.createDataFrame([("b",)], "k string").select("k", F.raise_error(F.lit("lost")).alias("v")))
    assert [tuple(r) for r in s.read("t").collect()] == [("a", 1)]
    assert s.read("residuals").count() == 0


def test_manifests_from_files(spark, tmp_path):
    good = '{"arena_export_schema_version": 1, "dataset": {"dataset_fingerprint": "' + "a" * 64 + '", "n_samples": 9}, "task": {"task_type": "regression"}, "cv": {"n_folds": 3}, "scores": {"observations": [{"metric_name": "rmse", "metric_value": 1.5, "scope": "cv"}]}, "residuals": {"inline": [{"sample_id": "s", "y_true": 1.0, "y_pred": 0.5}]}, "leakage_attestation": {"oof_enforced": true}}'
    (tmp_path / "a.json").write_text(good)
    (tmp_path / "b.json").write_text("{not json")
    m = manifests.manifests(spark, str(tmp_path)).cache()
    assert sorted(r.status for r in ingest.verify(manifests.checked_fields(m)).collect()) == ["committed", "rejected"]
    assert manifests.observations(m).first().metric_value == 1.5 and manifests.inline_residuals(m).first().sample_id == "s"
    blocks = spark.createDataFrame([("r", "test", "f", ["a", "b"], [1.0], [2.0, 3.0])], "residual_set_id string, partition string, fold_id string, sample_ids array<string>, values array<double>, y_true array<double>")
    assert [(r.sample_id, r.residual, r.scope) for r in manifests.prediction_residuals(blocks).collect()] == [("a", 1.0, "test"), ("b", None, "test")]


def test_windows_of_a_stream(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    q = monitor.windowed(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{tmp_path}/in").count()
