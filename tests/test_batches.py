"""Batches of manifests into a store, from files to a leaderboard."""

import json

from pyspark.sql import functions as F
from runlens.functions.identity import fingerprint
from runlens.operators import batches, rankings, statistics
from runlens.sources import manifests, store


def manifest(label, seed, value=None, residuals=(), oof=True, **more):
    scores = [{"metric_name": "rmse", "metric_value": value, "scope": "cv", "fold_id": "f0", "partition": "validation"}] if value is not None else []
    nodes = [{"node_id": "a", "kind": "transform", "operator": "x.Scale", "params": {"k": 1.0}}, {"node_id": "b", "kind": "model", "operator": "y.Pls", "params": {"n": len(label)}}]
    return {
        "arena_export_schema_version": 1, "dataset": {"dataset_fingerprint": "a" * 64, "n_samples": 9}, "task": {"task_type": "regression"}, "cv": {"n_folds": 3, "method": "kfold"}, "rng": {"root_seed": seed}, "execution": {"execution_id": f"{label}{seed}"},
        "pipeline": {"human_label": label, "nodes": nodes}, "leakage_attestation": {"oof_enforced": oof}, "scores": {"observations": scores}, "residuals": {"key": "sample_id", "publishable": {"y_true": False}, "inline": list(residuals)}, **more,
    }


def write(folder, **files):
    folder.mkdir()
    for name, body in files.items():
        (folder / f"{name}.json").write_text(body if isinstance(body, str) else json.dumps(body, indent=1))
    return str(folder)


def test_batches_fill_a_store_once(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"), batches.TABLES)
    rows = [{"sample_id": f"s{i}", "y_true": 1.0 * i, "y_pred": 1.0 * i + 0.5, "partition": "validation", "scope": "cv", "fold_id": "f0"} for i in range(4)]
    first = write(tmp_path / "one", a=manifest("pls", 1, 2.0), twin=manifest("pls", 1, 2.0), b=manifest("pls", 2, residuals=rows), c=manifest("ridge", 1, 1.0, oof=False), bad=manifest("x", 1, 1.0, task={"task_type": "none"}), broken="{", lost=manifest("z", 3, 1.0, dataset={"dataset_fingerprint": "b" * 64}, pipeline={"nodes": "word"}))
    policy = batches.Policy("lab", "salt", quarantine=True, cap=3)
    report = {r.export_hash: r for r in batches.ingest(s, manifests.manifests(spark, first), policy).collect()}
    assert sorted(r.status for r in report.values()) == ["committed", "committed", "quarantined", "rejected", "rejected", "rejected"]
    assert [i for r in report.values() for i in r.issues].count("error: unresolved") == 1
    assert [(r.n_residuals, r.truncated) for r in report.values() if r.n_residuals] == [(4, True)]
    n = {t: s.read(t).count() for t in batches.TABLES}
    assert n["collections"] == 1 and n["pipeline_dags"] == 2 and n["pipeline_nodes"] == 4 and n["residual_sets"] == 1 and n["residuals"] == 0 and n["executions"] == n["batches"] == n["run_conditions"] == 3
    again = batches.ingest(s, manifests.manifests(spark, first), policy).collect()
    assert {r.status for r in again} == {"already_ingested", "rejected"} and {t: s.read(t).count() for t in batches.TABLES} == n
    more = write(tmp_path / "two", b=manifest("pls", 4, residuals=rows))
    assert [r.status for r in batches.ingest(s, manifests.manifests(spark, more), batches.Policy("lab", "salt")).collect()] == ["committed"]
    kept = s.read("residuals").collect()
    assert len(kept) == 4 and all(r.y_true is None and r.residual is None and r.sample_id.startswith("s_") for r in kept)
    board = batches.backbone(s).where("metric_name = 'rmse'")
    assert board.where("execution_validity = 'valid'").count() == 1 and {r.direction for r in board.collect()} == {"min"}
    assert rankings.selected(board, "rmse").where(F.col("execution_validity") == "quarantined").count() == 0


def test_scores_are_made_from_residuals(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"), batches.TABLES)
    rows = [{"sample_id": f"s{i}", "y_true": 1.0 * i, "y_pred": 1.0 * i + 0.5, "partition": "validation", "scope": "cv", "fold_id": "f0"} for i in range(4)]
    body = manifest("pls", 1, residuals=rows)
    body["residuals"].pop("publishable")
    batches.ingest(s, manifests.manifests(spark, write(tmp_path / "in", a=body, b=manifest("pls", 2, 9.0))), batches.Policy("lab", "salt"))
    found = {(r.label, r.metric_name, round(r.metric_value, 6)) for r in batches.backbone(s).where("metric_name IN ('rmse', 'mae')").collect()}
    assert found == {("pls", "rmse", 0.5), ("pls", "mae", 0.5), ("pls", "rmse", 9.0)}
    assert s.read("residuals").where("residual = -0.5").count() == 4


def test_scratch_holds_no_texts(spark, tmp_path):
    """Manifests are kept in narrow rows: a batch's scratch is a fraction of its texts."""
    import os
    import random
    from urllib.parse import urlparse

    from runlens.sources.scratch import folder

    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(urlparse(folder(spark)).path) for f in names)
    noise, before = random.Random(1), size()
    texts = [json.dumps(manifest("pls", i, 1.0 * i, notes=f"{noise.getrandbits(160_000):x}")) for i in range(60)]
    rows = manifests.parsed(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string"))
    s = batches.open_store(spark, str(tmp_path / "store"))
    assert {r.status for r in batches.ingest(s, rows, batches.Policy("lab", "salt")).collect()} == {"committed"}
    assert s.read("executions").count() == 60 and size() - before < sum(map(len, texts)) / 2


def _texts(spark, n):
    odd = lambda i: [{"metric_name": "rmse", "metric_value": 1.0 + i, "scope": s, "fold_id": "f0", "partition": "validation"} for s in ("cv", 'a "\\ b', None)[: 1 + i % 3]]
    rows = [{"sample_id": f"s{i}", "y_true": 1.0 * i, "y_pred": 1.0 * i + 0.5, "partition": "validation", "scope": "cv", "fold_id": "f0"} for i in range(4)]
    made = [manifest("pls", i, residuals=rows) if i % 5 == 4 else manifest("pls", i, scores={"observations": odd(i)}, oof=i % 4 > 0) for i in range(n)]
    return spark.createDataFrame([(str(i), json.dumps(m)) for i, m in enumerate(made)], "path string, text string").repartition(4)


def _whole(s):
    return {t: sorted(repr(r) for r in s.read(t).drop("seq", "created_at").collect()) for t in batches.TABLES}


def test_a_batch_in_slices_is_the_same_and_leaves_no_scratch(spark, tmp_path, monkeypatch):
    import os
    from urllib.parse import urlparse

    from runlens.sources.scratch import folder

    texts = spark.createDataFrame(_texts(spark, 24).collect() + [("bad", "{")], "path string, text string").repartition(4)
    stores, reports = [batches.open_store(spark, str(tmp_path / n)) for n in ("whole", "sliced")], []
    for s, size in zip(stores, (batches.SLICE, 1), strict=True):
        monkeypatch.setattr(batches, "SLICE", size)
        before = set(os.listdir(urlparse(folder(spark)).path))
        reports.append(sorted(map(repr, batches.ingest(s, manifests.parsed(texts), batches.Policy("lab", "salt")).collect())))
        left = [os.path.join(d, f) for new in set(os.listdir(urlparse(folder(spark)).path)) - before for d, _, names in os.walk(f"{urlparse(folder(spark)).path}/{new}") for f in names if f.endswith(".parquet")]
        assert "m" not in {c for f in left for c in spark.read.parquet(f).columns}  # rows of manifests go once they are in the store
    assert [len({p.split("/")[1] for p in s.state().of("executions")}) for s in stores] == [1, 4]
    assert _whole(stores[0]) == _whole(stores[1]) and reports[0] == reports[1] and len(reports[0]) == 25
    told = [{(r.table): (r.new, r.deduplicated) for r in s.history().collect()} for s in stores]
    assert told[0] == told[1] and told[1]["executions"] == (24, 0)
    again = batches.ingest(stores[1], manifests.parsed(texts), batches.Policy("lab", "salt")).collect()
    assert {r.status for r in again} == {"already_ingested", "rejected"} and _whole(stores[0]) == _whole(stores[1])


def test_scores_are_the_backbone_without_its_joins(spark, tmp_path):
    s = batches.open_store(spark, str(tmp_path / "store"))
    batches.ingest(s, manifests.parsed(_texts(spark, 24)), batches.Policy("lab", "salt", release=True))
    paths = [f"{s.root}/{p}" for t in ("score_sets", "observations") for p in s.state().of(t)]
    assert all("score_set_id" not in spark.read.parquet(p).columns for p in paths)
    own = batches.resolve.score_set_id(F.col("execution_hash"), F.col("score_spec_hash"), F.col("scope"))
    assert s.read("score_sets").where(own != F.col("score_set_id")).count() == 0 and s.read("score_sets").where("scope LIKE 'a %'").count() > 0

    def same():
        found = batches.scores(s)
        rows = [sorted(repr(r) for r in df.select(sorted(found.columns)).collect()) for df in (found, batches.backbone(s))]
        assert rows[0] == rows[1] and rows[0]
        return found

    files = same().inputFiles()
    assert files and not any("/executions/" in f or "/score_sets/" in f for f in files)
    # Another policy's set of the same execution and scope comes later: the first one is replaced.
    one = s.read("score_sets").where("scope = 'cv'").orderBy("execution_hash").limit(1)
    later = one.withColumns({"score_spec_hash": F.lit("f" * 64), "seq": F.current_timestamp()}).drop("score_set_id").withColumn("score_set_id", own)
    s.commit(s.state(), score_sets=later)
    assert same().where("score_validity = 'superseded'").count() > 0
    s.delete("executions", F.col("execution_hash") == one.first().execution_hash)
    assert same().where(F.col("execution_hash") == one.first().execution_hash).count() == 0


def test_an_executions_hash_is_made_as_it_is_read(spark, tmp_path):
    s = batches.open_store(spark, str(tmp_path / "store"))
    batches.ingest(s, manifests.parsed(_texts(spark, 24)), batches.Policy("lab", "salt"))
    paths = [f"{s.root}/{p}" for p in s.state().of("executions")]
    assert paths and all("execution_hash" not in spark.read.parquet(p).columns for p in paths)
    rows = s.read("executions").collect()
    assert len(rows) == 24 and all(r.execution_hash == fingerprint({"run_condition": r.run_condition_hash, "export": r.export_hash, "execution_id": r.execution_id}) for r in rows)
    assert {r.execution_hash for r in rows} >= {r[0] for r in s.read("observations").select("execution_hash").collect()}
    one = min(r.execution_hash for r in rows)
    assert [r.execution_hash for r in s.lookup("executions", one).collect()] == [one]
    _bring_only_what_is_asked(s)


def test_sets_of_one_batch_are_not_looked_at_for_later_ones(spark, tmp_path, monkeypatch):
    s = batches.open_store(spark, str(tmp_path / "store"))
    texts = _texts(spark, 24)
    batches.ingest(s, manifests.parsed(texts.where("path < '2'")), batches.Policy("lab", "salt"))
    looked = []
    monkeypatch.setattr(batches, "written", lambda df, made=batches.written: looked.append(df.columns) or made(df))
    assert batches.scores(s).count() > 0 and not looked
    batches.ingest(s, manifests.parsed(texts), batches.Policy("lab", "salt"))
    looked.clear()
    assert batches.scores(s).count() == batches.backbone(s).count() and ["_short"] in looked
    s.compact("score_sets")
    assert batches.scores(s).count() == batches.backbone(s).count()


def _bring_only_what_is_asked(s):
    """Scores meet the names of conditions behind the shuffle, and rows are the same."""
    m = batches.scores(s)
    for limit in (None, 5):
        old, new = (rankings.leaderboard(m, limit=limit, of=of) for of in (None, batches.named_conditions(s)))
        assert sorted(map(repr, new.select(old.columns).collect())) == sorted(map(repr, old.collect())) and old.count() > 0
    old = statistics.execution_scores(m).join(batches.datasets(s), "dataset_fingerprint").select("execution_hash", "domain", "score")
    new = statistics.execution_scores(m, of=("domain",))
    assert sorted(map(repr, new.select(old.columns).collect())) == sorted(map(repr, old.collect())) and old.count() > 0
    shuffled = [x for x in new._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x]
    assert shuffled and not any("dataset_fingerprint" in x or "run_condition_hash" in x for x in shuffled)
