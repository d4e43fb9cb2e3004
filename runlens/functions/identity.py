"""Content identities: hashes of canonical JSON, and of pipeline graphs.

Where a payload is made of strings only, the hash is a native expression.
Open payloads and graphs are hashed from their raw JSON text in Arrow batches, since
Spark's own JSON functions change how numbers are written.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The parts of a run condition, in the order in which they are hashed.
RUN_CONDITION = ("dataset_variant_hash", "split_instance_hash", "cv_instance_hash", "rng_context_hash", "pipeline_dag_hash", "refit_strategy_hash")
# Node kinds that don't mind the order of their inputs, and the graph format's name in the payload.
UNORDERED = ("mean", "average", "weighted_mean", "weightedmean", "vote", "voting", "bagging", "bag", "sum", "aggregator", "ensemble")
GRAPH_FORMAT = "arena.graph/1"


_CANONICAL = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical_json(value) -> str:
    return _CANONICAL.encode(value)


def fingerprint(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def is_hash(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def quoted(c: Column) -> Column:
    """A string or null as JSON writes it: hashes, names and ids need quotes and backslashes escaped, no more."""
    text = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.coalesce(text, F.lit("null"))


def hash_of(**fields: Column) -> Column:
    """The fingerprint of an object of plain strings."""
    parts: list[Column] = []
    for i, key in enumerate(sorted(fields)):
        parts += [F.lit(("{" if i == 0 else ",") + f'"{key}":'), quoted(fields[key])]
    return F.sha2(F.concat(*parts, F.lit("}")), 256)


def run_condition_hash(**parts: Column) -> Column:
    """The fingerprint of the six component hashes in their fixed order."""
    pairs = [F.concat(F.lit(f'["{name}",'), quoted(parts[name]), F.lit("]")) for name in RUN_CONDITION]
    return F.sha2(F.concat(F.lit('{"components":['), F.concat_ws(",", *pairs), F.lit('],"kind":"run_condition","v":1}')), 256)


def pseudonym(salt: str, c: Column) -> Column:
    return F.concat(F.lit("s_"), F.substring(F.sha2(F.concat(F.lit(salt), c), 256), 1, 16))


def plan_id(dag: Column, dataset: Column, collection: Column) -> Column:
    return F.concat(F.lit("plan_"), F.substring(hash_of(p=dag, d=dataset, c=collection), 1, 16))


# Graphs


def _first(d: dict, *keys: str):
    return next((d[k] for k in keys if d.get(k)), None)


def node_of(raw, place: int) -> dict:
    """A step of any accepted shape: its id, branch path and content."""
    blank = {"kind": "transform", "operator_version": None, "params": {}, "fit_scope": None}
    if not isinstance(raw, dict):
        return {"id": f"n{place}", "branch_path": [], "content": blank | {"operator": str(raw)}}
    operator, params = _first(raw, "operator", "class", "op", "model"), raw.get("params")
    if isinstance(operator, dict):
        params = operator.get("params") if params is None else params
        operator = _first(operator, "class", "operator") or operator.get("name")
    kind = _first(raw, "kind", "role", "type") or ("model" if "model" in raw else "transform")
    content = {"kind": str(kind), "operator": None if operator is None else str(operator), "operator_version": raw.get("operator_version") or raw.get("version"), "params": params if isinstance(params, dict) else {}, "fit_scope": raw.get("fit_scope")}
    return {"id": str(_first(raw, "node_id", "id") or f"n{place}"), "branch_path": raw.get("branch_path") or [], "content": content}


def _graph(source) -> tuple[list[dict], list[tuple[str, str, str, str]], bool]:
    """Nodes, (src, src_port, dst, dst_port) and whether the source is a plain chain of steps."""
    if isinstance(source, dict) and "nodes" not in source:
        source = next((source[k] for k in ("pipeline", "steps") if isinstance(source.get(k), list)), source)
    steps = source if isinstance(source, list) else source.get("nodes") if isinstance(source, dict) else None
    if not isinstance(steps, list):
        raise TypeError("a pipeline is a list of steps, or an object with nodes, pipeline or steps")
    nodes = [node_of(x, i) for i, x in enumerate(steps)]
    given = source.get("edges") if isinstance(source, dict) else None
    if not isinstance(given, list):
        return nodes, [(a["id"], "out", b["id"], "in") for a, b in zip(nodes, nodes[1:])], True  # noqa: B905
    edges = []
    for e in given:
        if isinstance(e, dict) and (src := _first(e, "src", "from", "source", "from_node")) is not None and (dst := _first(e, "dst", "to", "target", "to_node")) is not None:
            edges.append((str(src), str(_first(e, "src_port", "from_port") or "out"), str(dst), str(_first(e, "dst_port", "to_port") or "in")))
    return nodes, edges, False


def _sorted_topologically(ids: list[str], edges: list[tuple]) -> list[str]:
    """Ready nodes leave in the order of their ids; nodes of a cycle follow, sorted."""
    waits, after = dict.fromkeys(ids, 0), {i: [] for i in ids}
    for src, _, dst, _ in edges:
        if src in after and dst in waits:
            after[src].append(dst)
            waits[dst] += 1
    ready, out = [i for i in ids if not waits[i]], []
    heapify(ready)
    while ready:
        out.append(i := heappop(ready))
        for j in after[i]:
            waits[j] -= 1
            if not waits[j]:
                heappush(ready, j)
    return out + sorted(set(ids) - set(out)) if len(out) < len(ids) else out


def normal_graph(source) -> dict:
    """{nodes, edges, linear, dag_hash, step_hash}: nodes renamed by their place, each with a
    signature over its content and its inputs' signatures."""
    nodes, edges, linear = _graph(source)
    by_id = {n["id"]: n for n in nodes}
    order = _sorted_topologically([n["id"] for n in nodes], edges)
    signed: dict[str, str] = {}
    into: dict[str, list[tuple[str, str]]] = {i: [] for i in by_id}
    for src, _, dst, port in edges:
        if src in by_id and dst in by_id:
            into[dst].append((port, src))
    for i in _sorted_topologically(list(by_id), edges):
        inputs = [(port, signed.get(src, "<unresolved>")) for port, src in into[i]]
        loose = by_id[i]["content"]["kind"].lower() in UNORDERED
        rows = sorted(map(list, inputs)) if loose else [[k, *x] for k, x in enumerate(inputs)]
        signed[i] = fingerprint({"content": by_id[i]["content"], "inputs": rows, "order_sensitive": not loose})
    place = {i: f"g{k}" for k, i in enumerate(order)}
    out_edges = sorted(({"src": place[s], "src_port": sp, "dst": place[d], "dst_port": dp} for s, sp, d, dp in edges if s in place and d in place), key=lambda e: (e["dst"], e["dst_port"], e["src"], e["src_port"]))
    out_nodes = [{"id": place[i], "signature": signed[i], **by_id[i]["content"], "branch_path": by_id[i]["branch_path"]} for i in order]
    dag = fingerprint({"schema": GRAPH_FORMAT, "nodes": sorted(n["signature"] for n in out_nodes), "edges": out_edges})
    return {"nodes": out_nodes, "edges": out_edges, "linear": linear, "dag_hash": dag, "step_hash": fingerprint(source)[:16] if linear and isinstance(source, list) else None}


def dag_hashes(pipelines: DataFrame) -> DataFrame:
    """(pipeline_id, pipeline_dag_hash, is_linear, step_hash, graph_json, error) of pipelines(pipeline_id, source): JSON text of any accepted shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    g = normal_graph(json.loads(text))
                    rows.append((key, g["dag_hash"], g["linear"], g["step_hash"], canonical_json({"schema": GRAPH_FORMAT, "nodes": g["nodes"], "edges": g["edges"]}), None))
                except (TypeError, ValueError, AttributeError) as e:
                    rows.append((key, None, None, None, None, str(e)))
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string()]
            cols = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["pipeline_id", "pipeline_dag_hash", "is_linear", "step_hash", "graph_json", "error"])

    schema = "pipeline_id string, pipeline_dag_hash string, is_linear boolean, step_hash string, graph_json string, error string"
    return pipelines.select(F.col("pipeline_id").cast("string"), "source").mapInArrow(run, schema)
