"""Pipelines that follow from the rows of orders: their graphs' hashes, dimensions, roles and catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..functions.roles import classify, classify_sql
from ..operators import catalogue, graphs, rankings, resolve, views
from ..sources import driver_manifests as D
from ..sources import driver_tables as T
from .registry import query

_STEPS = ", ".join(f"({i}, '{s}')" for i, s in enumerate(T.STEPS.values()))
_MODELS = ", ".join(f"('{k}', '{v}')" for k, v in T.MODELS.items())
#: Nodes with their places, contents and signatures, and each pipeline's hash: chains step by step, others from the input to the merge and the model.
_VIEWS = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT DISTINCT c_mktsegment || '/' || o_orderpriority || '/' || n AS label, c_mktsegment AS segment, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS prio, CAST(n AS INTEGER) AS n
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
    steps AS (SELECT * FROM (VALUES {_STEPS}) t(j, op)),
    bare AS (SELECT label, n, 0 AS g, 'input' AS kind, 'X' AS operator, '{{}}' AS params FROM p
        UNION ALL SELECT label, n, i, 'transform', op, '{{"center":' || CASE WHEN i % 2 = 0 THEN 'true' ELSE 'false' END || ',"window":' || (2 * i + 1) || '}}' FROM (SELECT label, n, prio, CAST(unnest(range(1, n + 1)) AS INTEGER) AS i FROM p) JOIN steps ON (prio + i) % {len(T.STEPS)} = j
        UNION ALL SELECT label, n, n + 1, 'mean', 'ensemble.MeanEnsemble', '{{}}' FROM p WHERE n % 2 = 0
        UNION ALL SELECT label, n, CASE WHEN n % 2 = 1 THEN n + 1 ELSE n + 2 END, 'model', m, '{{"kernel":"' || lower(segment) || '","n_components":' || (2 * n) || '}}' FROM p JOIN (VALUES {_MODELS}) t(k, m) ON k = segment),
    nodes AS MATERIALIZED (SELECT *, '{{"fit_scope":null,"kind":"' || kind || '","operator":"' || operator || '","operator_version":null,"params":' || params || '}}' AS c FROM bare),
    chain AS (SELECT label, g, sha256('{{"content":' || c || ',"inputs":[],"order_sensitive":true}}') AS s FROM nodes WHERE g = 0
        UNION ALL SELECT o.label, o.g, sha256('{{"content":' || c || ',"inputs":[[0,"in","' || s || '"]],"order_sensitive":true}}') FROM chain h JOIN nodes o ON h.label = o.label AND (n % 2 = 1 AND o.g = h.g + 1 OR n % 2 = 0 AND h.g = 0 AND o.g BETWEEN 1 AND n)),
    merged AS (SELECT o.label, o.g, sha256('{{"content":' || any_value(o.c) || ',"inputs":[' || string_agg('["in' || lpad(CAST(h.g AS VARCHAR), 2, '0') || '","' || s || '"]', ',' ORDER BY h.g) || '],"order_sensitive":false}}') AS s FROM nodes o JOIN chain h ON h.label = o.label AND h.g > 0 WHERE o.kind = 'mean' GROUP BY o.label, o.g),
    signed AS MATERIALIZED (SELECT * FROM chain UNION ALL SELECT * FROM merged UNION ALL SELECT o.label, o.g, sha256('{{"content":' || c || ',"inputs":[[0,"in","' || s || '"]],"order_sensitive":true}}') FROM merged h JOIN nodes o ON h.label = o.label WHERE kind = 'model'),
    edges AS (SELECT label, g AS dst, 'in' AS port, g - 1 AS src FROM nodes WHERE n % 2 = 1 AND g > 0 UNION ALL SELECT label, g, 'in', 0 FROM nodes WHERE n % 2 = 0 AND g BETWEEN 1 AND n
        UNION ALL SELECT label, n + 1, 'in' || lpad(CAST(g AS VARCHAR), 2, '0'), g FROM nodes WHERE n % 2 = 0 AND g BETWEEN 1 AND n UNION ALL SELECT label, n + 2, 'in', n + 1 FROM p WHERE n % 2 = 0),
    dags AS MATERIALIZED (SELECT label, sha256('{{"edges":[' || e || '],"nodes":["' || s || '"],"schema":"arena.graph/1"}}') AS dag FROM (SELECT label, string_agg(s, '","' ORDER BY s) AS s FROM signed GROUP BY label)
        JOIN (SELECT label, string_agg('{{"dst":"g' || dst || '","dst_port":"' || port || '","src":"g' || src || '","src_port":"out"}}', ',' ORDER BY 'g' || dst, port, src) AS e FROM edges GROUP BY label) USING (label))"""


def _sql(body: str) -> str:
    return f"{_VIEWS}\n{body}"


def _graphs(spark: SparkSession, sf: str) -> DataFrame:
    """(label, graph): the distinct pipelines of all orders."""
    label, graph = F.concat_ws("/", "segment", "priority", F.col("n").cast("string")), D.graph(F.col("segment"), F.col("priority"), F.col("n"))
    return D.orders(spark, sf).select("segment", "priority", "n").distinct().select(label.alias("label"), graph.alias("graph"))


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    """The pipelines as manifests of one dataset."""
    head = '{"dataset": {"dataset_fingerprint": "' + "0" * 64 + '"}, "task": {"task_type": "regression"}, "pipeline": {"human_label": "'
    return resolve.resolve(_graphs(spark, sf).select(F.concat(F.lit(head), "label", F.lit('", "graph": '), "graph", F.lit("}}")).alias("text")))


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.pipeline_nodes(_resolved(spark, sf)).withColumnRenamed("role", "kind")


@query(_sql("SELECT label AS pipeline_id, dag AS pipeline_dag_hash FROM dags"), views=False)
def dag_hashes(spark, sf):
    return identity.dag_hashes(_graphs(spark, sf).select(F.col("label").alias("pipeline_id"), F.col("graph").alias("source"))).select("pipeline_id", "pipeline_dag_hash")


_SPEC = "sha256('{\"entrypoint\":\"' || operator || '\",\"role\":\"' || kind || '\",\"version\":null}')"


@query(_sql(f"SELECT dag AS pipeline_dag_hash, 'g' || g AS node_id, s AS signature, kind AS role, operator, {_SPEC} AS operator_spec_hash, sha256(params) AS params_hash, CASE WHEN kind = 'model' THEN kind END AS model_family FROM nodes JOIN signed USING (label, g) JOIN dags USING (label)"), views=False)
def dimension_nodes(spark, sf):
    return resolve.pipeline_nodes(_resolved(spark, sf)).select("pipeline_dag_hash", "node_id", "signature", "role", "operator", "operator_spec_hash", "params_hash", "model_family")


@query(_sql(f"SELECT DISTINCT {_SPEC} AS operator_spec_hash, split_part(operator, '.', 1) AS library, operator AS entrypoint, CAST(NULL AS VARCHAR) AS version, kind AS role FROM nodes"), views=False)
def dimension_operators(spark, sf):
    return resolve.operator_specs(resolve.pipeline_nodes(_resolved(spark, sf)))


_PARAMS = "(SELECT label, g, 'n_components' AS name, CAST(2 * n AS VARCHAR) AS value_json, 'numeric' AS kind FROM nodes WHERE kind = 'model' UNION ALL SELECT label, g, 'kernel', '\"' || lower(segment) || '\"', 'categorical' FROM nodes JOIN p USING (label) WHERE kind = 'model' UNION ALL SELECT label, g, 'window', CAST(2 * g + 1 AS VARCHAR), 'numeric' FROM nodes WHERE kind = 'transform' UNION ALL SELECT label, g, 'center', CASE WHEN g % 2 = 0 THEN 'true' ELSE 'false' END, 'bool' FROM nodes WHERE kind = 'transform')"


@query(_sql(f"SELECT DISTINCT sha256('{{\"name\":\"' || name || '\",\"value\":' || value_json || '}}') AS param_value_hash, name, value_json, kind, CASE WHEN kind = 'numeric' THEN CAST(value_json AS DOUBLE) END AS numeric_value, CAST(kind = 'numeric' AS INTEGER) AS is_numeric, CAST(kind = 'numeric' AS INTEGER) AS is_ordinal, 1 AS is_sweepable FROM {_PARAMS}"), views=False)
def dimension_parameters(spark, sf):
    return resolve.parameter_values(resolve.node_params(_resolved(spark, sf)))


@query(_sql("SELECT dag AS pipeline_dag_hash, 'g' || g AS node_id, kind = 'input' AS is_entry, kind = 'model' AS is_terminal FROM nodes JOIN dags USING (label) WHERE kind IN ('input', 'model')"), views=False)
def graph_end_nodes(spark, sf):
    found = _resolved(spark, sf)
    return resolve.end_nodes(resolve.pipeline_nodes(found), resolve.pipeline_edges(found))


@query(_sql("SELECT operator, count(DISTINCT label) AS n_pipelines FROM nodes GROUP BY operator"), views=False)
def operators_catalog(spark, sf):
    return catalogue.operators(_nodes(spark, sf))


@query(_sql(f"SELECT name AS param_name, count(DISTINCT value_json) AS n_values, CAST(max(kind = 'numeric') AS INTEGER) AS is_numeric FROM {_PARAMS} GROUP BY name"), views=False)
def sweepable_parameters(spark, sf):
    params = resolve.node_params(_resolved(spark, sf))
    values = resolve.parameter_values(params).select("param_value_hash", "is_numeric", "is_sweepable")
    return catalogue.sweepable_parameters(params.join(values, "param_value_hash"))


_LEAVES = "(SELECT DISTINCT label, split_part(operator, '.', -1) AS leaf FROM nodes WHERE kind <> 'input')"


@query(_sql(f"SELECT a.leaf AS source, b.leaf AS target, count(*) AS weight FROM {_LEAVES} a JOIN {_LEAVES} b ON a.label = b.label AND a.leaf < b.leaf GROUP BY ALL"), views=False)
def operator_graph_edges(spark, sf):
    return graphs.operator_edges(_nodes(spark, sf))


@query(_sql(f"SELECT dag AS pipeline_dag_hash, 'g' || g AS node_id, operator, {classify_sql('operator', 'kind')} AS role FROM nodes JOIN dags USING (label)"), views=False)
def role_classification(spark, sf):
    return _nodes(spark, sf).select("pipeline_dag_hash", "node_id", "operator", classify(F.col("operator"), F.col("kind")).alias("role"))


@query(_sql("SELECT dag AS pipeline_dag_hash, label FROM dags JOIN nodes USING (label) WHERE kind = 'model' AND contains(lower(label || ' ' || operator), 'svr') AND n % 2 = 0"), views=False)
def pipelines_filtered(spark, sf):
    """Pipelines of support vector machines whose steps are merged."""
    found = _resolved(spark, sf)
    merged = resolve.pipeline_nodes(found).where("role = 'mean'").select("pipeline_dag_hash")
    return views.filtered_pipelines(resolve.pipeline_dags(found), "SVR", linear=False).join(merged, "pipeline_dag_hash", "left_semi").select("pipeline_dag_hash", "label")


_NAMES = sorted(rankings.MAXIMISED + rankings.MINIMISED)
_LIST = ", ".join(f"'{n}'" for n in _NAMES)


@query(f"SELECT metric_name, CASE WHEN metric_name IN ({', '.join(repr(n) for n in rankings.MAXIMISED)}) THEN 'max' ELSE 'min' END AS direction, count(*) AS n FROM (SELECT CASE WHEN l_linenumber = 1 THEN lower(l_returnflag || l_linestatus) ELSE [{_LIST}][l_orderkey % {len(_NAMES)} + 1] END AS metric_name FROM lineitem) GROUP BY metric_name", views=False)
def metric_directions(spark, sf):
    """Line items as reports of metrics, known ones and others, with their directions."""
    known = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("l_orderkey") % len(_NAMES) + 1).cast("int"))
    rows = T.table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") == 1, F.lower(F.concat("l_returnflag", "l_linestatus"))).otherwise(known).alias("metric_name"))
    return rows.groupBy("metric_name").agg(F.count("*").alias("n")).withColumn("direction", rankings.direction(F.col("metric_name")))
