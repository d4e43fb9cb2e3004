"""Resolution in narrow rows: the same hashes as resolve(), parts once, whatever the number of manifests."""

import json

from pyspark.sql import functions as F
from runlens.functions.identity import fingerprint
from runlens.operators import resolve
from runlens.plans import uploads
from runlens.sources import driver_manifests, manifests


def manifest(i, **more):
    nodes = [{"node_id": "a", "kind": "transform", "operator": "x.Scale", "params": {"k": 1.0}}, {"node_id": "b", "kind": "model", "operator": "y.Pls", "params": {"n": i % 3}}]
    return {"dataset": {"dataset_fingerprint": "ab"[i % 2] * 64}, "task": {"task_type": "regression"}, "rng": {"root_seed": i % 5}, "execution": {"execution_id": f"e{i}"}, "pipeline": {"nodes": nodes}, **more}


def test_equal_parts_are_worked_out_once(monkeypatch):
    calls, real, parts = [], resolve.normal_graph, resolve.Parts()
    monkeypatch.setattr(resolve, "normal_graph", lambda source: calls.append(source) or real(source))
    shared = [resolve.resolved_manifest(manifest(i), parts=parts) for i in range(60)]
    assert len(calls) == 3 and shared == [resolve.resolved_manifest(manifest(i)) for i in range(60)]
    assert resolve.resolved_manifest(manifest(0, rng={"root_seed": 1}), parts=parts)["rng_context_hash"] != resolve.resolved_manifest(manifest(0, rng={"root_seed": 1.0}), parts=parts)["rng_context_hash"]


def test_narrow_rows_have_the_same_hashes(spark):
    odd = ["{", json.dumps({"dataset": {}}), json.dumps(manifest(1, cv={"cv_instance_hash": 5})), json.dumps(manifest(2, pipeline={"nodes": "word"}))]
    texts = spark.createDataFrame([(json.dumps(manifest(i)),) for i in range(40)] + [(t,) for t in odd], "text string")
    cols = [*resolve.HASHES, "execution_id", "run_condition_hash", "execution_hash", "error"]
    rows = lambda df: sorted(map(repr, df.select(*cols).collect()))
    assert rows(resolve.identities(texts)) == rows(resolve.resolve(texts))
    assert resolve.identities(texts).where("error IS NOT NULL").count() == 4


def test_every_part_is_told_in_few_rows(spark):
    texts = spark.createDataFrame([(json.dumps(manifest(i)), i != 0) for i in range(300)], "text string, good boolean").coalesce(1)
    found = resolve.identities(texts, tell="good")
    told = found.where("told IS NOT NULL").select(*resolve.HASHES, "error", "told.*").persist()
    assert told.count() < 12 and found.where("execution_id IS NULL").count() == 1
    whole = resolve.resolve(texts.where("good")).persist()
    for make in (resolve.pipeline_nodes, resolve.node_params, resolve.pipeline_edges):
        assert set(make(told).collect()) == set(make(whole).collect())
    a, b = resolve.specs(told), resolve.specs(whole)
    for name in a:
        kept = [c for c in a[name].columns if c != "created_at"]
        assert set(a[name].select(*kept).collect()) == set(b[name].select(*kept).collect()), name
    assert set(resolve.conditions(found.where("good" if "good" in found.columns else F.col("execution_id").isNotNull())).collect()) == set(resolve.conditions(whole).collect())

def test_bundles_of_one_file_are_many_tasks(spark, sf):
    assert uploads._bundles(spark, sf).rdd.getNumPartitions() > 1


def test_texts_are_read_once(monkeypatch):
    """Fields whose text has come before aren't read again, whatever stands between them; what isn't plain is left to json.loads()."""
    texts, shared = resolve.Texts(), {"nodes": [{"operator": f"x.S{i}", "params": {"k": 1.0, "é\n": [i]}} for i in range(9)]}
    odd = [manifest(i, pipeline=shared, notes=["}", '"', {"a": None}], n=10**i, flag=True, x=None) for i in range(9)]
    given = [json.dumps(m, indent=i % 3 or None, ensure_ascii=i % 2 > 0) for i, m in enumerate(odd)] * 2
    for text in given:
        fields = texts(text)
        assert {k: x[0] for k, x in fields.items()} == json.loads(text) and resolve._fingerprint(fields) == fingerprint(json.loads(text))
    read = []
    monkeypatch.setattr(texts, "scan", lambda text, at, scan=texts.scan: read.append(text[at : at + 1]) or scan(text, at))
    for text in given:
        assert texts(text)
        read.clear()
        assert texts(text) and sorted(read) == ["1", "n", "t"]  # the number, the null and the boolean
    for bad in ("", "{", "[1]", "{}", '{"a":1}x', '{"a":1,}', '{"a" 1}', '{"\\u0061":1}', '﻿{"a":1}', '{"a":{"b":1}', '{"a":{"b":1}}}'):
        assert texts(bad) is None and texts('{"a":{"b":1},"a":{"b":2}}')["a"][0] == {"b": 2}
    assert texts('{"a":{"b":1}  ,"b":[ ] }\n')["b"][0] == [] and texts('{"a":NaN}')["a"][0] != 0


def test_hashes_are_made_in_the_same_pass(spark):
    texts = [json.dumps(manifest(i)) for i in range(5)] + ['{"a":NaN}', "{", json.dumps({"arena_export_hash": "given", "é": 1})]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    given = F.get_json_object("text", "$.arena_export_hash")
    found = {r.path: r.export_hash for r in resolve.told(rows.withColumns({"export_hash": given, "good": F.lit(False)}), ("export_hash", "path"), "good").collect()}
    named = {r.path: r.h for r in manifests.parsed(rows).select("path", F.coalesce(given, "export_hash", F.sha2("text", 256)).alias("h")).collect()}
    assert found == named and len(set(found.values())) == 8


def test_orders_texts_are_made_in_many_tasks(spark, sf):
    """A small table's one file isn't one task of all manifests, and a pipeline's text isn't made for each order."""
    texts = driver_manifests.manifest_texts(spark, sf)
    assert texts.rdd.getNumPartitions() > 1
    made = [r.text for r in texts.collect()]
    graphs = {json.dumps(json.loads(t)["pipeline"]) for t in made}
    assert len(made) == len({json.loads(t)["execution"]["execution_id"] for t in made}) and 1 < len(graphs) < len(made)
