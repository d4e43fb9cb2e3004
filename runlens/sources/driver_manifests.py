"""Export manifests made of the driver's tables, one for each order, with pipelines that follow from the rows.

An order's line items are its scores. Its pipeline has a step for each line item, in a chain if their number is odd, else side by side
and merged, and a model of the customer's segment; so pipelines differ in length, edges, ports, kinds and parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import driver_tables as T
from .scratch import spread

_STEPS = list(T.STEPS.values())


def _text(x: Column) -> Column:
    return F.concat(F.lit('"'), x, F.lit('"'))


def _step(i: Column, prio: Column) -> Column:
    """The operator of the i-th step, from 1: they rotate, from one that the priority chooses."""
    return F.element_at(F.array(*map(F.lit, _STEPS)), ((prio + i) % len(_STEPS) + 1).cast("int"))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    """(l_orderkey, n): an order's number of line items."""
    return spread(T.table(spark, sf, "lineitem"), "l_orderkey").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))


def orders(spark: SparkSession, sf: str, items: DataFrame | None = None) -> DataFrame:
    """One row an order: its key, segment, priority, number of line items, year, validity, nation and region, and what items(l_orderkey, n, ...) has
    of its line items beside. Joined by merging: a small table's few files would be as few tasks, however much is then made of an order."""
    o, c = T.table(spark, sf, "orders"), T.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    items = _counts(spark, sf) if items is None else items
    rows = o.join(c, o.o_custkey == c.c_custkey).join(T.datasets(spark, sf).withColumnRenamed("dataset_fingerprint", "nation"), F.col("c_nationkey").cast("string") == F.col("nation"))
    rows = rows.select("o_orderkey", F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"), (F.col("o_orderstatus") != "P").alias("attested"), "nation", "dataset_name", "domain")
    rows = items.join(rows.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("o_orderkey", "segment", "priority", "n", "year", "attested", "nation", "dataset_name", "domain", *items.columns[2:])


def graph(segment: Column, priority: Column, n: Column) -> Column:
    """The pipeline as JSON: nodes and edges."""
    prio = F.substring(priority, 1, 1).cast("int")
    at = F.sequence(F.lit(1), n)
    odd = n % 2 == 1
    node = lambda name, kind, operator, params: F.concat(F.lit('{"id":"'), name, F.lit(f'","kind":"{kind}","operator":'), _text(operator), F.lit(',"params":{'), params, F.lit("}}"))
    number = lambda x: x.cast("string")
    s = lambda i: F.concat(F.lit("s"), F.lpad(number(i), 2, "0"))
    steps = F.transform(at, lambda i: node(s(i), "transform", _step(i, prio), F.concat(F.lit('"window":'), number(i * 2 + 1), F.lit(',"center":'), F.when(i % 2 == 0, "true").otherwise("false"))))
    model = F.element_at(F.create_map(*[F.lit(x) for kv in T.MODELS.items() for x in kv]), segment)
    ends = F.array(node(F.lit("x"), "input", F.lit("X"), F.lit("")), node(F.lit("z"), "model", model, F.concat(F.lit('"n_components":'), number(n * 2), F.lit(',"kernel":'), _text(F.lower(segment)))))
    merge = F.when(odd, F.array().cast("array<string>")).otherwise(F.array(node(F.lit("m"), "mean", F.lit("ensemble.MeanEnsemble"), F.lit(""))))
    edge = lambda a, b, port: F.concat(F.lit('{"src":"'), a, F.lit('","dst":"'), b, F.lit('","dst_port":"'), port, F.lit('"}'))
    chain = F.array_append(F.transform(at, lambda i: edge(F.when(i == 1, "x").otherwise(s(i - 1)), s(i), F.lit("in"))), edge(s(n), F.lit("z"), F.lit("in")))
    wide = F.concat(F.transform(at, lambda i: edge(F.lit("x"), s(i), F.lit("in"))), F.transform(at, lambda i: edge(s(i), F.lit("m"), F.concat(F.lit("in"), F.lpad(number(i), 2, "0")))), F.array(edge(F.lit("m"), F.lit("z"), F.lit("in"))))
    return F.concat(F.lit('{"nodes":['), F.concat_ws(",", ends, steps, merge), F.lit('],"edges":['), F.concat_ws(",", F.when(odd, chain).otherwise(wide)), F.lit("]}"))


def manifest_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(path, text): a manifest for each order."""
    lit, flag, test = F.lit, F.col("l_returnflag"), F.col("l_linestatus") == "F"
    score = F.concat(
        lit('{"metric_name":"'), F.when(flag == "A", "rmse").when(flag == "N", "r2").otherwise("mae"), lit('","metric_value":'), F.sqrt(F.col("l_extendedprice") / F.col("l_quantity")).cast("string"), lit(',"scope":"'), F.when(test, "test").otherwise("cv"), lit('","fold_id":"fold'), F.col("l_linenumber").cast("string"),
        lit('","partition":"'), F.when(test, "test").otherwise("validation"), lit('","aggregation_level":"'), F.when(F.col("l_linenumber") % 2 == 0, "target").otherwise("sample"), lit('","n_samples":'), F.col("l_quantity").cast("int").cast("string"), lit("}"),
    )
    items = spread(T.table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_extendedprice"), "l_orderkey").select("l_orderkey", score.alias("score"))
    items = items.groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"), F.collect_list("score").alias("items"))
    o = orders(spark, sf, items).withColumn("scores", F.concat_ws(",", F.sort_array("items")))
    # A pipeline's text is made once and joined to the orders that have it: kinds and counts make a few hundred.
    kinds = {f"_{c}": F.col(c) for c in ("segment", "priority", "n")}
    pairs = T.table(spark, sf, "orders").join(T.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("_segment"), F.col("o_orderpriority").alias("_priority")).distinct()
    made = pairs.crossJoin(_counts(spark, sf).select(F.col("n").alias("_n")).distinct()).withColumn("graph", graph(*map(F.col, kinds)))
    o = o.join(F.broadcast(made), [c.eqNullSafe(F.col(k)) for k, c in kinds.items()]).drop(*kinds)
    text = lambda c: F.col(c).cast("string")
    body = F.concat(
        lit('{"arena_export_schema_version":1,"dataset":{"n_samples":100,"dataset_fingerprint":"'), F.sha2(F.concat(lit("d"), "nation"), 256), lit('","dataset_card":{"name":"'), "dataset_name", lit('","domain":"'), "domain",
        lit('"}},"task":{"task_type":"regression","target_name":"price"},"split":{"method":"'), F.when(F.col("priority").contains("-"), "holdout").otherwise("kennard_stone"), lit('","params":{"test_size":0.25}},"cv":{"method":"'), F.when(F.col("year") % 2 == 1, 'kfold","n_folds":5').otherwise('shuffle","n_folds":10'),
        lit('},"rng":{"root_seed":'), text("year"), lit('},"refit":{"strategy":"full"},"execution":{"execution_id":"e'), text("o_orderkey"), lit('"},"leakage_attestation":{"oof_enforced":'), text("attested"), lit('},"pipeline":{"human_label":"'), F.concat_ws("/", "segment", "priority", text("n")), lit('","graph":'),
        "graph", lit('},"scores":{"observations":['), "scores", lit("]}}"),
    )
    return o.select(F.concat(lit("order-"), text("o_orderkey")).alias("path"), body.alias("text"))


def sql_views() -> str:
    """Orders, scores and pipelines' nodes as common table expressions."""
    steps = ", ".join(f"({i}, '{s}')" for i, s in enumerate(_STEPS))
    models = ", ".join(f"('{k}', '{v}')" for k, v in T.MODELS.items())
    return f"""WITH o AS MATERIALIZED (SELECT o_orderkey, c_mktsegment AS segment, o_orderpriority AS priority, n, year(o_orderdate) AS year, o_orderstatus <> 'P' AS attested, n_name AS dataset_name, r_name AS domain,
            c_mktsegment || '/' || o_orderpriority || '/' || n AS label, CASE WHEN contains(o_orderpriority, '-') THEN 'holdout' ELSE 'kennard_stone' END AS split_method, CASE WHEN year(o_orderdate) % 2 = 1 THEN 'kfold' ELSE 'shuffle' END AS cv_method
            FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
        s AS MATERIALIZED (SELECT o.*, CASE l_returnflag WHEN 'A' THEN 'rmse' WHEN 'N' THEN 'r2' ELSE 'mae' END AS metric_name, sqrt(l_extendedprice / l_quantity) AS metric_value, CASE WHEN l_linestatus = 'F' THEN 'test' ELSE 'cv' END AS score_scope
            FROM o JOIN lineitem ON l_orderkey = o_orderkey),
        p AS MATERIALIZED (SELECT DISTINCT label, segment, CAST(substr(priority, 1, 1) AS INTEGER) AS prio, n FROM o),
        nodes AS MATERIALIZED (SELECT label, 'input' AS kind, 'X' AS operator FROM p UNION ALL SELECT label, 'model', m FROM p JOIN (VALUES {models}) t(k, m) ON k = segment UNION ALL SELECT label, 'mean', 'ensemble.MeanEnsemble' FROM p WHERE n % 2 = 0
            UNION ALL SELECT label, 'transform', op FROM (SELECT label, (prio + unnest(range(1, n + 1))) % {len(_STEPS)} AS i FROM p) JOIN (VALUES {steps}) t(j, op) ON i = j)"""
