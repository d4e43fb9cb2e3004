"""Workspaces, bundles, cards and uploads from files, and the sinks."""

import io
import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F
from runlens.functions import identity
from runlens.operators import resolve, uploads
from runlens.sources import bundles, cards, manifests, store, workspace


@pytest.fixture
def space(tmp_path, monkeypatch):
    """A workspace of two pipelines; ranges of two rows, so that a table has several tasks."""
    monkeypatch.setattr(workspace, "RANGE", 2)
    con = sqlite3.connect(tmp_path / "store.sqlite")
    con.execute("CREATE TABLE pipelines (pipeline_id TEXT, name TEXT, dataset_name TEXT, dataset_hash TEXT, expanded_config TEXT)")
    con.executemany("INSERT INTO pipelines VALUES (?, ?, ?, ?, ?)", [("p1", "one", "corn", "h", '{"steps": [{"class": "a.Scale", "params": {"k": 2}}, {"model": {"class": "b.Pls"}}]}'), ("p2", None, None, None, "no json"), ("empty", "none", "corn", "h", "[]")])
    con.execute("CREATE TABLE predictions (prediction_id TEXT, pipeline_id TEXT, model_name TEXT, branch_id TEXT, fold_id TEXT, partition TEXT, task_type TEXT, metric TEXT, val_score REAL, scores TEXT)")
    rows = [
        ("x1", "p1", "Pls", None, "f0", None, "regression", "rmse", 0.1, '{"RMSE": 0.30000000000000004, "note": "a"}'), ("x2", "p1", "Pls", None, "final", "train", "regression", "rmse", 0.25, "{bad"), ("x3", "p1", "Ridge", "b", "_agg", "validation", "regression", None, 0.5, None),
        ("x4", "p2", None, None, "f1", "test", "binary", "acc", None, "{}"), (None, "p1", "Pls", None, "f1", "validation", "regression", "rmse", 1.5, None),
    ]
    con.executemany(f"INSERT INTO predictions VALUES ({', '.join('?' * 10)})", rows)
    con.commit()
    con.close()
    return tmp_path


def test_workspace_of_a_sqlite_file(spark, space):
    file = str(space / "store.sqlite")
    pipes, preds = workspace.table(spark, file, "pipelines", workspace.PIPELINES), workspace.table(spark, file, "predictions", workspace.PREDICTIONS)
    assert preds.count() == 5 and preds.rdd.getNumPartitions() == 3 and workspace.table(spark, file, "nothing", "a string").count() == 0
    got = sorted((r.model_name, r.metric_name, r.metric_value, r.direction, r.scope, r.fold_id, r.partition) for r in workspace.observations(preds).collect())
    assert got == [("Pls", "rmse", 0.25, "min", "refit", None, "final"), ("Pls", "rmse", 0.30000000000000004, "min", "cv", "f0", "validation"), ("Pls", "rmse", 1.5, "min", "cv", "f1", "validation"), ("Ridge", "score", 0.5, "min", "cv", None, "validation")]
    runs = workspace.runs(pipes, preds)
    assert {(r.pipeline_id, r.label, r.n_folds, r.refit_strategy) for r in runs.collect()} == {("p1", "one [Pls]", 2, "global_best_params_full_train"), ("p1", "one [Ridge/b]", None, "none"), ("p2", "p2", 1, "none")}
    found = {(r.pipeline_id, r.model_name): r for r in workspace.manifest_texts(runs).collect()}
    assert [n["operator"] for n in json.loads(found["p1", "Pls"].text)["pipeline"]["nodes"]] == ["a.Scale", "b.Pls", "Pls"]
    assert [n["operator"] for n in json.loads(found["p2", ""].text)["pipeline"]["nodes"]] == ["model"]
    done = resolve.resolve(workspace.manifest_texts(runs)).collect()
    assert {r.error for r in done} == {None} and len({r.pipeline_dag_hash for r in done}) == 3 and len({r.execution_hash for r in done}) == 3


def test_arrays_of_a_workspace(spark, space):
    preds = workspace.table(spark, str(space / "store.sqlite"), "predictions", workspace.PREDICTIONS)
    assert workspace.arrays(spark, str(space)).count() == 0
    (space / "arrays").mkdir()
    rows = [("x1", [1.0, 2.0], [0.5, 2.5, 3.0], [4, 5, 6], None, None), ("x3", [1.0], [1.0], None, None, None), ("x4", [0.0, 1.0], [0.0, 1.0], None, [0.9, 0.1, 0.2, 0.8], None), ("x2", None, [], None, None, None)]
    spark.createDataFrame(rows, workspace.ARRAYS).coalesce(1).write.parquet(f"{space}/arrays/corn.parquet")
    got = sorted((r.model_name, r.sample_id, r.y_true, r.y_pred, r.residual, r.y_proba) for r in workspace.residuals(preds, spark.read.schema(workspace.ARRAYS).parquet(f"{space}/arrays/corn.parquet")).collect())
    assert got == [("", "pos_0", 0.0, 0.0, None, [0.9, 0.1]), ("", "pos_1", 1.0, 1.0, None, [0.2, 0.8]), ("Pls", "pos_4", 1.0, 0.5, 0.5, None), ("Pls", "pos_5", 2.0, 2.5, -0.5, None), ("Pls", "pos_6", None, 3.0, None, None)]


def test_bundles_with_and_without_graph(spark):
    graph = '{"nodes": [{"id": "a", "operator": "x.Y"}], "edges": []}'
    rows = [("one", '{"bundle_id": "b1", "graph_fingerprint": "g", "refit_artifacts": ["m"]}', graph, '{"schema_fingerprint": "s"}'), ("two", '{"bundle_id": "b2", "graph_fingerprint": "g"}', None, None), ("bad", "[1", None, None), ("list", "[1]", None, None), ("none", None, None, None)]
    texts = {r.path: r.text for r in bundles.bundle_manifests(spark.createDataFrame(rows, "path string, text string, graph string, envelope string")).collect()}
    one, two = json.loads(texts["one"]), json.loads(texts["two"])
    assert one["dataset"]["dataset_fingerprint"] == "s" and one["pipeline"]["graph"]["nodes"][0]["operator"] == "x.Y" and one["refit"]["strategy"] != "none"
    assert two["pipeline"]["nodes"][0]["operator"] == "bundle:g" and two["dataset"]["dataset_fingerprint"] == identity.fingerprint({"bundle": "b2", "graph": "g"})
    assert texts["bad"] is texts["list"] is texts["none"] is None


def test_cards_of_a_folder(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("id: a\ntier: public\nsources:\n- {n_variables: 5, n_observations: x, axis_min: 1.5}\n- {n_observations: 8}\nvariables: [{name: y, role: target}]\n")
    (tmp_path / "b.yml").write_text("[1, 2")
    (tmp_path / "c.txt").write_text("id: c")
    (tmp_path / "d.yaml").write_text("name: bare")
    got = sorted((r.dataset_id, r.visibility, r.n_samples, r.n_features, r.axis_min, r.n_targets) for r in cards.cards(cards.files(spark, str(tmp_path))).collect())
    assert got == [("a", "public", 8, 5, 1.5, 1), ("unknown", "restricted", None, None, None, 0)]


def test_uploads_by_content(spark):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("pipeline.json", '[{"operator": "a.B"}]')
        z.writestr("artifacts/model.bin", b"\x00")
    files = [("zip", packed.getvalue()), ("same", b'[{"operator": "a.B"}]'), ("broken", b"PK\x03\x04no"), ("bytes", b"\xff\xfe"), ("empty", b""), ("null", None), ("text", b"just words"), ("export", b'{"arena_export_schema_version": 1}')]
    kinds = uploads.kinds(spark.createDataFrame(files, "path string, content binary"))
    assert {r.path: r.kind for r in kinds.collect()} == {"zip": "recipe", "same": "recipe", "broken": "unknown", "bytes": "unknown", "empty": "unknown", "null": "unknown", "text": "unknown", "export": "export"}
    none = spark.createDataFrame([], "pipeline_dag_hash string, dataset_fingerprint string, execution_validity string")
    plans = uploads.register(kinds, ["d1", "d2"], none).collect()
    assert len(plans) == 4 and len({r.plan_id for r in plans}) == 2 and {r.status for r in plans} == {"planned"}
    with pytest.raises(ValueError):
        uploads.guard_collection("Benchmark-Release")
    assert uploads.guard_collection("release", as_release=True) and uploads.is_path("runs/a.json") and not uploads.is_path('{"a": 1}') and not uploads.is_path("a\nb")


def test_residuals_beside_manifests(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text('{"arena_export_schema_version": 1, "residuals": {"key": "sample_id", "inline": [{"sample_id": "in"}], "ref": "side/r.parquet"}}')
    (tmp_path / "m" / "b.json").write_text('{"arena_export_schema_version": 1, "residuals": {"key": "sample_id", "ref": "side/r.parquet"}}')
    (tmp_path / "m" / "c.json").write_text('{"arena_export_schema_version": 1, "residuals": {"key": "sample_id", "ref": "side/none.parquet"}}')
    m = manifests.manifests(spark, f"{tmp_path}/m/*.json")
    assert sorted(r.sample_id for r in manifests.residual_rows(spark, m, str(tmp_path)).collect()) == ["in"]
    (tmp_path / "side").mkdir()
    spark.createDataFrame([("s", 1.0)], "sample_id string, y_true double").toPandas().to_parquet(tmp_path / "side" / "r.parquet")
    assert sorted((r.sample_id, r.y_true) for r in manifests.residual_rows(spark, m, str(tmp_path)).collect() if r.sample_id != "in") == [("s", 1.0)]


def test_manifests_of_many_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "arena_export_schema_version": 1,\n "task": {"task_type": "regression"}\n}\n')
    one = manifests.manifests(spark, str(tmp_path)).collect()
    assert len(one) == 1 and one[0].m.task.task_type == "regression" and one[0].export_hash


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "a", 1.0), ("r2", "b", 2.0)], "residual_set_id string, sample_id string, y_true double")
    store.write_residuals(rows, f"{tmp_path}/r")
    store.write_residuals(spark.createDataFrame([("r2", "c", 9)], "residual_set_id string, sample_id string, unknown int"), f"{tmp_path}/r")
    one = store.residual_set(spark, f"{tmp_path}/r", "r2")
    assert [(r.sample_id, r.y_true) for r in one.collect()] == [("c", None)] and store.residual_set(spark, f"{tmp_path}/r", "r1").count() == 1
    store.snapshot(f"{tmp_path}/s", per_run=("runs",), runs=spark.createDataFrame([("e1", 1), ("e2", 2)], "execution_hash string, v int"), all=rows)
    assert (tmp_path / "s" / "runs" / "execution_hash=e1").is_dir() and spark.read.json(f"{tmp_path}/s/all").count() == 2
    store.audit_copy(spark.createDataFrame([("h", '{"b": 1.0, "a": 2}'), ("h", '{"b": 1.0, "a": 2}'), (None, "x")], "export_hash string, text string"), f"{tmp_path}/a")
    assert [r.text for r in spark.read.parquet(f"{tmp_path}/a").collect()] == ['{"a":2,"b":1.0}']
    assert store.select(spark, "SELECT sample_id FROM r WHERE y_true > :low AND sample_id != :not", {"r": rows}, low=0.5, **{"not": "a' OR 1=1"}).count() == 2
    assert store.select(spark, "SELECT F FROM (SELECT count(*) AS F FROM r)", {"r": rows.where(F.lit(False))}).first()[0] == 0
