"""The store: its log, filters, hidden rows, compaction and upgrades, and every ranking operator over what was ingested."""

import json

import pytest
from pyspark.sql import functions as F
from runlens.operators import batches, catalogue, facets, graphs, rankings, statistics, views
from runlens.sources import commitlog, manifests, store

TABLES = {"t": "k string, v long", "r": "g string, x long"}


def hashes(spark, low, high):
    return spark.range(low, high).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.col("id").alias("v")).coalesce(1)


@pytest.fixture
def made(spark, tmp_path, monkeypatch):
    """A store of 6 commits, each with a filter although it is small."""
    monkeypatch.setattr(store, "SMALL", 0)
    monkeypatch.setattr(store, "FILTERED", 0)
    s = store.Store(spark, str(tmp_path / "s"), TABLES, {"t": ["k"]}, {"r": ["g"]})
    for i in range(6):
        rows = hashes(spark, 50 * i, 50 * i + 50)
        s.commit(s.state(), t=rows, r=rows.select(F.lit(f"g{i}").alias("g"), F.col("v").alias("x")))
    return s


def test_a_batch_opens_only_files_that_may_hold_its_keys(spark, made):
    offered = hashes(spark, 40, 60).unionByName(hashes(spark, 900, 910))
    assert len(made.state().of("t")) == 6 and len(made.candidates("t", offered)) <= 3
    assert sorted(r.v for r in made.absent("t", offered).collect()) == list(range(900, 910))
    files = made.absent("t", offered).join(offered, "k").select("k").inputFiles()
    assert 0 < len({f for f in files if "/t/" in f}) <= 3
    every = offered.join(made.read("t").select("k"), "k", "left_anti")
    assert {r.k for r in made.absent("t", offered).collect()} == {r.k for r in every.collect()}


def test_lookups_and_deletes(spark, made):
    assert [r.x for r in made.lookup("r", "g3").collect()] == list(range(150, 200)) and len(made.lookup("r", "g3").inputFiles()) == 1
    assert made.lookup("r", "nothing").count() == 0
    old = made.state()
    made.delete("r", F.col("g") == "g3")
    made.delete("r", F.col("x") < 10)
    assert made.lookup("r", "g3").count() == 0 and made.read("r").count() == 240 and made.read("r", old).count() == 300
    before = {tuple(r) for r in made.read("r").collect()}
    made.compact("r", rows=1000)
    assert len(made.state().of("r")) == 1 and {tuple(r) for r in made.read("r").collect()} == before
    assert not any(f.get("hidden") for f in made.state().of("r").values())
    assert made.compact("r", rows=1000) == made.state().version


def test_readers_open_one_list_and_the_entries_behind_it(spark, made, monkeypatch):
    monkeypatch.setattr(commitlog, "CHECKPOINT", 4)
    for i in range(6, 10):
        made.commit(made.state(), t=hashes(spark, 50 * i, 50 * i + 50))
    opened = []
    monkeypatch.setattr(commitlog.Files, "text", lambda self, path, f=commitlog.Files.text: opened.append(path.rsplit("/", 1)[-1]) or f(self, path))
    again = store.Store(spark, made.root, TABLES, {"t": ["k"]})
    assert len(opened) == 3 and opened[0].endswith("7.files") and again.read("t").count() == 500
    opened.clear()
    assert again.read("t").count() == 500 and not opened


def test_of_two_writers_one_inserts_a_key(spark, made):
    other = store.Store(spark, made.root, TABLES, {"t": ["k"]}, {"r": ["g"]})
    state, rows = made.state(), hashes(spark, 1000, 1001)
    other.commit(state, t=other.absent("t", rows, state))
    with pytest.raises(commitlog.Conflict):
        made.commit(state, t=made.absent("t", rows, state))
    assert made.read("t").where("v = 1000").count() == 1
    made.commit(made.state(), t=made.absent("t", rows))
    assert made.read("t").where("v = 1000").count() == 1
    made.commit(state, r=rows.select(F.lit("g").alias("g"), F.col("v").alias("x")))  # tables without keys don't mind
    stale = made.state()
    other.compact("t", rows=1000)
    with pytest.raises(commitlog.Conflict):
        made.delete("t", F.col("v") == 1, read=stale)


def test_a_store_of_the_first_version_is_read_and_a_newer_one_refused(spark, tmp_path):
    root = f"{tmp_path}/old"
    for batch, node in (("a1", "g0"), ("b2", "g1")):
        spark.createDataFrame([("d", node, "sig", "model", "x.Y")], "pipeline_dag_hash string, node_id string, signature string, role string, operator string").write.parquet(f"{root}/pipeline_nodes/batch={batch}")
        spark.createDataFrame([("s", "rmse", 1.0)], "score_set_id string, metric_name string, metric_value double").write.parquet(f"{root}/observations/batch={batch}")
        if batch == "a1":  # the other batch was lost before its marker
            spark.createDataFrame([(batch, 1)], "batch string, version int").withColumn("seq", F.current_timestamp()).write.mode("append").parquet(f"{root}/_commits")
    s = batches.open_store(spark, root)
    assert [(r.node_id, r.kind, r.params_json) for r in s.read("pipeline_nodes").collect()] == [("g0", "model", None)]
    assert [(r.metric_value, r.aggregation_level, r.coverage) for r in s.read("observations").collect()] == [(1.0, "sample", None)]
    s.commit(s.state(), pipeline_nodes=spark.createDataFrame([("d", "g2", "merge")], "pipeline_dag_hash string, node_id string, kind string"))
    again = batches.open_store(spark, root)
    assert sorted((r.node_id, r.kind) for r in again.read("pipeline_nodes").collect()) == [("g0", "model"), ("g2", "merge")]
    again.compact("pipeline_nodes")
    assert {f["format"] for f in again.state().of("pipeline_nodes").values()} == {store.VERSION} and again.read("pipeline_nodes").count() == 2
    spark.createDataFrame([("z", 9)], "batch string, version int").write.parquet(f"{tmp_path}/new/_commits")
    spark.createDataFrame([("d",)], "pipeline_dag_hash string").write.parquet(f"{tmp_path}/new/pipeline_dags/batch=z")
    with pytest.raises(ValueError, match="newer"):
        batches.open_store(spark, f"{tmp_path}/new")


def export(i, **more):
    """Runs of two pipelines on two datasets; one run in four lacks its attestation."""
    steps = [{"id": "a", "operator": "p.Snv" if i % 2 else "p.GaussianNoise", "params": {"k": i % 2}}, {"id": "m", "kind": "model", "operator": "q.PLSRegression", "params": {"n_components": 5 + i % 2}}]
    rows = [{"sample_id": f"s{k}", "group_id": f"g{k % 2}", "origin_sample_id": f"o{k}", "weight": 0.5, "y_true": 1.0 * k, "y_pred": k + 0.1 * i, "fold_id": f"f{k % 2}"} for k in range(4)]
    observed = [{"metric_name": "rmse", "metric_value": 1.0 + i + f, "scope": "cv", "fold_id": f"f{f}", "direction": "min", "aggregation_level": "target", "n_samples": 2, "coverage": 0.5, "metric_unit": "%"} for f in range(2)]
    body = {
        "arena_export_schema_version": 1, "dataset": {"dataset_fingerprint": "ab"[i // 2 % 2] * 64, "n_samples": 9, "dataset_card": {"name": f"corn{i // 2 % 2}", "domain": "food", "axis": {"unit": "nm", "range": [1, 2.5]}}}, "task": {"task_type": "regression"}, "split": {"method": "holdout"}, "cv": {"method": "kfold", "n_folds": 2},
        "rng": {"root_seed": i // 4}, "refit": {"strategy": "full"}, "execution": {"execution_id": f"x{i}", "time_ms": 1.5}, "pipeline": {"human_label": f"pipe{i % 2}", "graph": {"nodes": steps, "edges": [{"src": "a", "dst": "m"}]}}, "leakage_attestation": {"oof_enforced": i % 4 != 3}, "scores": {"observations": observed}, "residuals": {"inline": rows},
    }
    return body | more


@pytest.fixture(scope="module")
def lab(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lab")
    for n, part in enumerate((range(4), range(3, 8))):
        (root / f"in{n}").mkdir()
        for i in part:
            (root / f"in{n}" / f"{i}.json").write_text(json.dumps(export(i)))
    s = batches.open_store(spark, str(root / "store"))
    dag = batches.resolve.resolve(spark.createDataFrame([(json.dumps(export(4)),)], "text string")).first().pipeline_dag_hash
    targets = spark.createDataFrame([(dag, "a" * 64, "lab"), (dag, "c" * 64, "lab")], "pipeline_dag_hash string, dataset_fingerprint string, collection_id string")
    first = {r.status for r in batches.plan(s, targets).collect()}
    for n in range(2):
        batches.ingest(s, manifests.manifests(spark, str(root / f"in{n}")), batches.Policy("lab", quarantine=True))
    return s, first, targets


def test_every_operator_runs_on_the_store(lab):
    s, *_ = lab
    m, nodes, params, found = batches.backbone(s).cache(), s.read("pipeline_nodes"), batches.params(s), s.read("run_facets")
    board = rankings.leaderboard(m).collect()
    assert [(r.rank, r.label, r.dataset_name, r.mean_score, r.n_obs) for r in board] == [(1, "pipe0", "corn0", 1.5, 2), (2, "pipe1", "corn0", 2.5, 2), (3, "pipe0", "corn1", 3.5, 2), (4, "pipe0", "corn0", 5.5, 2), (5, "pipe1", "corn0", 6.5, 2), (6, "pipe0", "corn1", 7.5, 2)]
    assert rankings.leaderboard(m, quarantined=True).count() == 8 and rankings.leaderboard(m, limit=None).count() == 6
    assert rankings.matrix_cells(m).count() == 3 and rankings.matrix_wide(m, ["corn0", "corn1"]).count() == 2
    assert rankings.run_explorer(m, nodes, operator="p.Snv").count() == 4 and rankings.run_explorer(m, nodes, collection_id="lab").count() == 8
    effect = {r.operator: (r.role, r.n) for r in rankings.operator_effect(m, nodes).collect()}
    assert effect == {"p.Snv": ("preprocessing", 4), "p.GaussianNoise": ("augmentation", 8), "q.PLSRegression": ("model", 12)}
    assert sorted({r.value_num for r in rankings.parameter_effect(m, params, "n_components").collect()}) == [5.0, 6.0]
    assert rankings.parameter_trend(m, params, "n_components").count() == 3 and rankings.robustness(m).count() == 3 and rankings.best_per_dataset(m).count() == 2
    assert {r.value: r.n_runs for r in facets.pivot(m, found, "has_augmentation").collect()} == {"yes": 4, "no": 2}
    assert facets.pivot(m, found, "param:n_components", "split_method", agg="median").count() == 2
    keys = {r.facet_key for r in facets.index(found).collect()}
    assert {"dataset", "seed", "pipeline", "operator", "has_augmentation", "param:n_components"} <= keys and facets.values(found, "dataset").count() == 2
    assert facets.parallel(m, found, ["model", "seed"]).count() == 6
    assert {r.facet_key for r in statistics.correlations(m, found).collect()} >= {"param:n_components", "seed"} and statistics.summary(m, by="dataset_fingerprint").count() == 2 and statistics.histogram(m, bins=3).count() == 3
    drawn = graphs.pipeline_nodes(m)
    assert drawn.count() == 2 and graphs.pipeline_edges(drawn, nodes, 0.3).count() == 1 and graphs.operator_nodes(m, nodes).count() == 3 and graphs.operator_edges(nodes).count() == 2 and graphs.composition(m, nodes).count() == 3
    conditions = batches.conditions(s)
    assert {(r.split_method, r.cv_method, r.n_folds, r.refit_strategy, r.task_type, r.size_label) for r in conditions.collect()} == {("holdout", "kfold", 2, "full", "regression", "all")}
    assert catalogue.with_usage(batches.datasets(s), conditions, "dataset_fingerprint").where("n_run_conditions = 4").count() == 2
    assert views.findings(m, found).count() >= 3


def test_a_snapshot_ranks_as_its_store_does(spark, lab, tmp_path):
    s, *_ = lab
    batches.export_snapshot(s, f"{tmp_path}/out")
    shot = batches.open_snapshot(spark, f"{tmp_path}/out")
    board = lambda x: [tuple(r) for r in rankings.leaderboard(batches.backbone(x)).collect()]
    assert board(shot) == board(s) and not (tmp_path / "out" / "settings").exists()
    effect = lambda x: sorted(tuple(r) for r in rankings.operator_effect(batches.backbone(x), x.read("pipeline_nodes")).collect())
    assert effect(shot) == effect(s)
    key = s.read("score_sets").first().execution_hash
    one = shot.run("score_sets", key)
    assert one.count() == 1 and one.first().execution_hash == key and len(one.inputFiles()) == len(shot.read("score_sets").inputFiles()) and "PartitionFilters: [isnotnull(execution_hash" in one._jdf.queryExecution().toString()
    assert shot.read("settings").count() == 0


def test_what_a_batch_leaves(spark, lab):
    s, first, targets = lab
    counts = {r.name: r.n for r in batches.overview(s).collect()}
    assert counts == {"datasets": 2, "dataset_cards": 2, "tasks": 2, "pipelines": 2, "operators": 3, "parameters": 4, "run_conditions": 8, "executions": 8, "score_sets": 8, "metric_observations": 16, "residual_sets": 8, "collections": 1, "valid_executions": 6, "quarantined_executions": 2, "metrics": 1}
    o = s.read("observations").first()
    assert (o.direction, o.aggregation_level, o.n_samples, o.coverage, o.metric_unit) == ("min", "target", 2, 0.5, "%")
    rows = s.read("residuals").collect()
    assert len(rows) == 32 and all(r.weight == 0.5 and r.group_id.startswith("s_") and r.origin_sample_id.startswith("s_") and r.fold_id for r in rows)
    assert len({r.sample_id for r in rows}) == 4  # one salt for all batches, which the store made
    with pytest.raises(ValueError, match="salt"):
        batches.ingest(s, spark.createDataFrame([], "path string, text string").transform(manifests.parsed), batches.Policy("lab", "another"))
    told = {(r.version, r.table): (r.new, r.deduplicated) for r in s.history().collect()}
    assert {v for (_, t), v in told.items() if t == "executions"} == {(4, 0)} and sorted(v for (_, t), v in told.items() if t == "pipeline_dags") == [(0, 2), (2, 0)] and sorted(v for (_, t), v in told.items() if t == "dataset_cards") == [(0, 2), (2, 0)]
    assert first == {"planned"}
    got = {r.dataset_fingerprint[0]: (r.status, r.fulfilled_by is not None) for r in batches.plans(s).collect()}
    assert got == {"a": ("fulfilled", True), "c": ("planned", False)}
    again = {r.dataset_fingerprint[0]: r.status for r in batches.plan(s, targets).collect()}
    assert again == {"a": "already_run", "c": "planned"} and batches.plans(s).count() == 2
    assert views.planned_list(batches.plans(s), s.read("pipeline_dags"), s.read("dataset_cards")).count() == 1
    key = s.read("executions").where("execution_id = 'x0'").first().execution_hash
    of = batches.executions(s).join(batches.conditions(s).select("run_condition_hash", "seed"), "run_condition_hash")
    row = views.run_detail(key, of, batches.conditions(s).select("run_condition_hash", "pipeline_dag_hash", "dataset_fingerprint", "seed", "cv_method"), s.read("pipeline_dags"), batches.datasets(s).select("dataset_fingerprint", "dataset_name"), s.read("pipeline_nodes"), batches.params(s), batches.backbone(s), s.read("pipeline_edges")).first()
    assert (row.label, row.dataset_name, row.cv_method, row.time_ms, len(row.nodes), len(row.edges), len(row.params), len(row.scores)) == ("pipe0", "corn0", "kfold", 1.5, 2, 1, 2, 2)
    one = s.read("residual_sets").first().residual_set_id
    assert s.lookup("residuals", one).count() == 4
    s.delete("residuals", F.col("residual_set_id") == one)
    assert s.lookup("residuals", one).count() == 0 and s.read("residuals").count() == 28


def test_ranges_of_hashes_need_no_pass_over_the_rows(spark):
    """Each partition has one range of the hashes, in order, and no other's."""
    from pyspark.sql import functions as F
    from runlens.sources.scratch import ranged

    rows = ranged(spark.range(3000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h")), "h", 5)
    parts = [[r.h for r in p] for p in rows.rdd.glom().collect()]
    assert len(parts) == 5 and all(400 < len(p) < 800 and p == sorted(p) for p in parts)
    assert sum(parts, []) == sorted(sum(parts, []))
