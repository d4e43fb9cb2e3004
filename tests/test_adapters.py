"""Workspaces and bundles through to a leaderboard."""

import json
import sqlite3

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from runlens.operators import adapters, batches, metrics, rankings
from runlens.sources import manifests, workspace


def test_a_workspace_reaches_the_leaderboard(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "store.sqlite")
    con.execute("CREATE TABLE pipelines (pipeline_id TEXT, name TEXT, dataset_name TEXT, dataset_hash TEXT, expanded_config TEXT)")
    con.execute("INSERT INTO pipelines VALUES ('p1', 'one', 'corn', 'h', '[{\"class\": \"a.Snv\"}, {\"model\": {\"class\": \"b.Pls\"}, \"params\": {\"n\": 3}}]')")
    con.execute("CREATE TABLE predictions (prediction_id TEXT, pipeline_id TEXT, model_name TEXT, branch_id TEXT, fold_id TEXT, partition TEXT, task_type TEXT, metric TEXT, val_score REAL, scores TEXT)")
    con.executemany("INSERT INTO predictions VALUES (?, 'p1', ?, NULL, ?, 'validation', 'regression', 'rmse', ?, NULL)", [("x1", "Pls", "f0", 2.0), ("x2", "Pls", "f1", 4.0), ("x3", "Ridge", "f0", 1.0), ("x4", "Svr", "f0", None)])
    con.commit()
    con.close()
    (tmp_path / "arrays").mkdir()
    rows = [("x1", [1.0, 2.0], [1.5, 2.5], None, None, None), ("x4", [1.0, 2.0], [4.0, 5.0], None, None, None)]
    kinds = pa.schema([("prediction_id", pa.string()), *((c, pa.list_(pa.int64() if c in ("sample_indices", "y_proba_shape") else pa.float64())) for c in ("y_true", "y_pred", "sample_indices", "y_proba", "y_proba_shape"))])
    pq.write_table(pa.Table.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], kinds), tmp_path / "arrays" / "corn.parquet")
    s = batches.open_store(spark, f"{tmp_path}/s")
    report = adapters.take(s, adapters.workspace(spark, str(tmp_path)), batches.Policy("lab")).collect()
    assert sorted(r.status for r in report) == ["committed"] * 3 and not any("error" in i for r in report for i in r.issues)
    m = batches.backbone(s)
    assert sorted((r.mean_score, r.label, r.n_obs) for r in rankings.leaderboard(m).collect()) == [(1.0, "one [Ridge]", 1), (3.0, "one [Pls]", 2), (3.0, "one [Svr]", 1)]
    assert {r.operator for r in s.read("pipeline_nodes").collect()} == {"a.Snv", "b.Pls", "Pls", "Ridge", "Svr"}
    assert s.read("residuals").count() == 4 and {r.key for r in s.read("residual_sets").collect()} == {"positional"}


def test_bundles_reach_the_leaderboard(spark, tmp_path):
    graph = json.dumps({"nodes": [{"id": "a", "operator": "x.Snv"}, {"id": "b", "kind": "model", "operator": "y.Pls"}], "edges": [{"src": "a", "dst": "b"}]})
    cache = lambda y: [{"partition": "validation", "fold_id": "f0", "sample_ids": ["s1", "s2"], "values": [[y], [y + 1]], "y_true": [1.0, 2.0]}]
    rows = [(f"b{i}", json.dumps({"bundle_id": f"b{i}", "graph_fingerprint": "g", "campaign_fingerprint": f"c{i}", "metadata": {"label": f"run{i}", "root_seed": i}, "prediction_caches": cache(2.0 * i)}), graph if i else None, json.dumps({"schema_fingerprint": "e" * 64})) for i in range(3)]
    frame = spark.createDataFrame(rows + [("bad", "{", None, None)], "path string, text string, graph string, envelope string")
    reports = spark.createDataFrame([("b1", "validation", "cv", None, {"RMSE": "0.25", "note": "x"})], "path string, partition string, level string, fold_id string, metrics map<string,string>")
    s = batches.open_store(spark, f"{tmp_path}/s")
    assert [r.status for r in adapters.take(s, adapters.bundles(frame, reports), batches.Policy("lab")).collect()] == ["committed"] * 3
    board = [(r.label, round(r.mean_score, 6)) for r in rankings.leaderboard(batches.backbone(s)).collect()]
    assert board == [("run1", 0.25), ("run0", 1.0), ("run1", 3.0)]  # b1 has a score of its own, the others theirs from their residuals; one graph has one label
    assert s.read("rng_contexts").count() == 3 and s.read("cv_instances").count() == 3
    sets = {r.execution_hash: r.residual_set_id for r in s.read("residual_sets").collect()}
    assert len(sets) == 3 and s.read("residuals").select("sample_id").distinct().count() == 2  # samples meet across runs


def test_sparse_row_numbers_give_few_ranges(spark, tmp_path):
    file = str(tmp_path / "w.sqlite")
    con = sqlite3.connect(file)
    con.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(1, "a"), (900_000_000_000, "b"), (2**63 - 1, "c"), (-5, "d")])
    con.commit()
    con.close()
    rows = workspace.table(spark, file, "t", "k long, v string")
    assert rows.rdd.getNumPartitions() <= 4 and sorted(r.v for r in rows.collect()) == ["a", "b", "c", "d"]
    assert rows.where(F.col("k") == 2**63 - 1).count() == 1


def test_only_named_files_are_opened(spark, tmp_path):
    """Refs are relative to each manifest; all columns of residuals come along; what nothing names isn't read."""
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "m.json").write_text(json.dumps({"arena_export_schema_version": 1, "dataset": {"n_samples": ord(d)}, "residuals": {"ref": "r é.parquet"}}))
        pq.write_table(pa.table({"sample_id": [d], "group_id": ["g"], "weight": [0.5], "y_proba": [[0.1, 0.9]], "other": [1]}), tmp_path / d / "r é.parquet")
    (tmp_path / "a" / "broken.parquet").write_text("no parquet")
    m = manifests.manifests(spark, f"{tmp_path}/*/*.json")
    rows = manifests.residual_rows(spark, m)
    assert sorted((r.sample_id, r.group_id, r.weight, r.y_proba) for r in rows.collect()) == [("a", "g", 0.5, [0.1, 0.9]), ("b", "g", 0.5, [0.1, 0.9])]
    assert rows.select("export_hash").distinct().count() == 2 and not any("broken" in f for f in rows.inputFiles())


def test_probability_metrics_follow_the_residuals(spark):
    """Against the definitions, with labels that only predictions have, a set without some probabilities and a null fold."""
    rng = np.random.default_rng(3)
    rows = []
    for name, k, fold in (("two", 2, None), ("three", 3, "f0"), ("part", 2, "f0")):
        for i in range(40):
            p = rng.dirichlet(np.ones(k)).tolist()
            rows.append((name, "cv", fold, "validation", float(10 * rng.integers(k)) if i else 0.0, float(10 * int(np.argmax(p))), None if name == "part" and i == 7 else p))
    rows += [("two", "cv", None, "validation", None, 0.0, [0.5, 0.5]), ("two", "cv", None, "validation", 10.0, None, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "residual_set_id string, scope string, fold_id string, partition string, y_true double, y_pred double, y_proba array<double>")
    got = {(r.residual_set_id, r.metric_name): r for r in metrics.recompute(df, "multiclass").collect()}
    assert {n for s, n in got if s == "part"} == {"accuracy", "precision_macro", "recall_macro", "f1_macro", "balanced_accuracy", "mcc"} and ("three", "roc_auc") not in got
    for name in ("two", "three"):
        pairs = [(t, q) for s, *_, t, p, q in rows if s == name and t is not None and p is not None]
        labels = sorted({t for s, *_, t, p, q in rows if s == name and None not in (t, p)} | {p for s, *_, t, p, q in rows if s == name and None not in (t, p)})
        want = -np.mean([np.log(np.clip(q[labels.index(t)], 1e-15, 1 - 1e-15)) for t, q in pairs])
        assert abs(got[name, "log_loss"].metric_value - want) < 1e-9 and got[name, "log_loss"].direction == "min" and got[name, "log_loss"].n_samples == 40
    high, low = ([q[1] for t, q in [(t, q) for s, *_, t, p, q in rows if s == "two" and None not in (t, p)] if (t == 10.0) == yes] for yes in (True, False))
    area = np.mean([(a > b) + 0.5 * (a == b) for a in high for b in low])
    assert abs(got["two", "roc_auc"].metric_value - area) < 1e-9 and abs(got["two", "accuracy"].coverage - 40 / 42) < 1e-12 and got["three", "mcc"].coverage == 1.0


def test_a_classification_batch_gets_its_probability_scores(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"sample_id": f"s{i}", "y_true": i % 2, "y_pred": i % 2, "y_proba": [0.8 - 0.6 * (i % 2), 0.2 + 0.6 * (i % 2)]} for i in range(6)]
    body = {"arena_export_schema_version": 1, "dataset": {"dataset_fingerprint": "a" * 64}, "task": {"task_type": "binary"}, "pipeline": {"nodes": [{"node_id": "a", "kind": "model", "operator": "x.Y"}]}, "residuals": {"inline": rows}, "leakage_attestation": {"oof_enforced": True}}
    (tmp_path / "in" / "a.json").write_text(json.dumps(body))
    s = batches.open_store(spark, f"{tmp_path}/s")
    assert [r.status for r in batches.ingest(s, manifests.manifests(spark, f"{tmp_path}/in"), batches.Policy("lab")).collect()] == ["committed"]
    got = {r.metric_name: (round(r.metric_value, 9), r.direction, r.n_samples, r.coverage) for r in s.read("observations").collect()}
    assert got["roc_auc"] == (1.0, "max", 6, 1.0) and got["log_loss"] == (round(-float(np.log(0.8)), 9), "min", 6, 1.0) and got["accuracy"][0] == 1.0
    assert s.read("residuals").where("size(y_proba) = 2").count() == 6


def test_uploads_go_where_their_content_says(spark, tmp_path):
    """A recipe is registered and planned; the export that runs it fulfils the plan; the recipe uploaded again has been run."""
    steps = [{"class": "a.Snv"}, {"model": "b.Pls", "params": {"n": 3}}]
    body = {"arena_export_schema_version": 1, "dataset": {"dataset_fingerprint": "a" * 64, "dataset_card": {"name": "corn"}}, "task": {"task_type": "regression"}, "pipeline": {"graph": {"nodes": [{"node_id": "n0", "operator": "a.Snv"}, {"node_id": "n1", "kind": "model", "operator": "b.Pls", "params": {"n": 3}}], "edges": [{"src": "n0", "dst": "n1"}]}}, "scores": {"observations": [{"metric_name": "rmse", "metric_value": 1.0}]}}
    bundle = {"bundle_id": "b1", "graph_fingerprint": "g", "prediction_caches": [{"partition": "validation", "sample_ids": ["s"], "values": [1.0], "y_true": [2.0]}]}
    frame = lambda *rows: spark.createDataFrame([(k, v if isinstance(v, bytes) else json.dumps(v).encode()) for k, v in rows], "path string, content binary")
    s = batches.open_store(spark, f"{tmp_path}/s")
    policy = batches.Policy("lab")
    first = {r.path: r for r in adapters.upload(s, frame(("recipe", steps), ("odd", b"\xff"), ("bad", {"nodes": "no list"})), policy, ["a" * 64]).collect()}
    assert {k: (r.kind, r.status) for k, r in first.items()} == {"recipe": ("recipe", "planned"), "odd": ("unknown", "unknown"), "bad": ("recipe", "unknown")}
    assert s.read("pipeline_nodes").count() == 2 and {r.status for r in batches.plans(s).collect()} == {"planned"}
    then = {r.path: (r.kind, r.status) for r in adapters.upload(s, frame(("export", body), ("bundle", bundle)), policy).collect()}
    assert then == {"export": ("export", "committed"), "bundle": ("bundle", "committed")}
    assert {r.status for r in batches.plans(s).collect()} == {"fulfilled"} and s.read("executions").count() == 2
    assert sorted((r.metric_name, r.metric_value) for r in batches.backbone(s).where("metric_name = 'rmse'").collect()) == [("rmse", 1.0), ("rmse", 1.0)]
    again = adapters.upload(s, frame(("recipe", steps)), policy, ["corn"]).first()
    assert (again.status, again.dataset_fingerprint) == ("already_run", "a" * 64) and again.pipeline_dag_hash == first["recipe"].pipeline_dag_hash
    with pytest.raises(ValueError, match="releases"):
        adapters.upload(s, frame(("export", body)), batches.Policy("release"))
