"""The engine's tables, read from the driver's TPC-H-like tables.

An order is an execution of a pipeline (customer segment and order priority) on
a dataset (the customer's nation); a line item is a metric observation of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import RUN_CONDITION

# What stands for the pipelines' operators.
MODELS = {
    "AUTOMOBILE": "sklearn.cross_decomposition.PLSRegression",
    "BUILDING": "sklearn.svm.SVR",
    "FURNITURE": "sklearn.ensemble.RandomForestRegressor",
    "HOUSEHOLD": "sklearn.linear_model.Ridge",
    "MACHINERY": "tabpfn.TabPFNRegressor",
}
STEPS = {
    "1-URGENT": "sklearn.preprocessing.StandardScaler",
    "2-HIGH": "spectra.SavitzkyGolay",
    "3-MEDIUM": "spectra.augment.GaussianNoise",
    "4-NOT SPECIFIED": "sklearn.feature_selection.SelectKBest",
    "5-LOW": "spectra.StandardNormalVariate",
}
COMPONENTS = {"AUTOMOBILE": 5, "BUILDING": 8, "FURNITURE": 12, "HOUSEHOLD": 16, "MACHINERY": 20}
KERNELS = {"1-URGENT": "rbf", "2-HIGH": "linear", "3-MEDIUM": "rbf", "4-NOT SPECIFIED": "poly", "5-LOW": "linear"}

NODES = "pipeline_dag_hash string, node_id string, kind string, operator string"
PARAMS = "pipeline_dag_hash string, node_id string, param_name string, value_json string, numeric_value double, is_numeric int, is_sweepable int"
PIPELINES = "pipeline_dag_hash string, label string, main_model string, is_linear int"


def pipeline_rows() -> tuple[list, list, list]:
    """(pipelines, nodes, params): 25 pipelines. AUTOMOBILE's have two equal models and a merge."""
    pipes, nodes, params = [], [], []
    for seg, model in MODELS.items():
        for prio, step in STEPS.items():
            dag, double = f"{seg}|{prio}", seg == "AUTOMOBILE"
            pipes.append((dag, f"{seg.title()} {prio}", model, int(not double)))
            nodes += [(dag, "g0", "input", "X"), (dag, "g1", "transform", step), (dag, "g2", "model", model)]
            nodes += [(dag, "g3", "model", model), (dag, "g4", "mean", "ensemble.MeanEnsemble")] if double else []
            n = COMPONENTS[seg]
            params += [(dag, "g2", "n_components", str(n), float(n), 1, 1), (dag, "g2", "kernel", f'"{KERNELS[prio]}"', None, 0, 1), (dag, "g1", "center", "true" if prio < "3" else "false", None, 0, 0)]
    return pipes, nodes, params


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _literal(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """rows as a local relation of the plan, which needs no Python on executors."""
    names = [c.split() for c in ddl.split(", ")]
    return spark.sql(f"SELECT {', '.join(f'CAST({n} AS {k}) AS {n}' for n, k in names)} FROM VALUES {literal_rows(rows)} AS v({', '.join(n for n, _ in names)})")


def pipelines(spark: SparkSession) -> DataFrame:
    return _literal(spark, pipeline_rows()[0], PIPELINES)


def nodes(spark: SparkSession) -> DataFrame:
    return _literal(spark, pipeline_rows()[1], NODES)


def params(spark: SparkSession) -> DataFrame:
    return _literal(spark, pipeline_rows()[2], PARAMS)


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset_fingerprint, dataset_name, domain)."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").cast("string").alias("dataset_fingerprint"), F.col("n_name").alias("dataset_name"), F.col("r_name").alias("domain"))


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, with its run condition's parts."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    e = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("order_key"),
        F.concat(F.lit("e"), "o_orderkey").alias("execution_hash"),
        F.concat_ws("|", "c_mktsegment", "o_orderpriority").alias("pipeline_dag_hash"),
        F.col("c_nationkey").cast("string").alias("dataset_fingerprint"),
        F.year("o_orderdate").cast("long").alias("seed"),
        F.when(F.col("o_orderstatus") == "P", "quarantined").otherwise("valid").alias("execution_validity"),
        F.when(F.col("o_custkey") % 2 == 0, "release").otherwise("user").alias("collection_id"),
    )
    return e.withColumn("run_condition_hash", F.concat_ws("|", "pipeline_dag_hash", "dataset_fingerprint", F.col("seed").cast("string")))


def run_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each with what its facets tell."""
    return with_methods(executions(spark, sf_dir).select("run_condition_hash", "pipeline_dag_hash", "dataset_fingerprint", "seed").distinct())


def with_methods(conditions: DataFrame) -> DataFrame:
    """A condition's methods follow from its pipeline's priority and its seed."""
    odd = F.col("seed") % 2 == 1
    return conditions.withColumns({"task_type": F.lit("regression"), "split_method": F.when(F.col("pipeline_dag_hash").contains("-"), "holdout").otherwise("kennard_stone"), "cv_method": F.when(odd, "kfold").otherwise("shuffle"), "n_folds": F.when(odd, 5).otherwise(10).cast("long"), "refit_strategy": F.lit("full")})


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: (order_key, score_scope, score_validity, metric_name, metric_value, fold_id, partition)."""
    test = F.col("l_linestatus") == "F"
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_key"),
        F.when(test, "test").otherwise("cv").alias("score_scope"),
        F.when(F.col("l_orderkey") % 10 == 0, "superseded").otherwise("valid").alias("score_validity"),
        F.when(F.col("l_returnflag") == "A", "rmse").when(F.col("l_returnflag") == "N", "r2").otherwise("mae").alias("metric_name"),
        F.sqrt(F.col("l_extendedprice") / F.col("l_quantity")).alias("metric_value"),
        F.concat(F.lit("fold"), "l_linenumber").alias("fold_id"),
        F.when(test, "test").otherwise("validation").alias("partition"),
    )


def backbone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per execution and metric observation, with the labels of its pipeline and dataset."""
    facts = executions(spark, sf_dir).join(observations(spark, sf_dir), "order_key").drop("order_key")
    return facts.join(pipelines(spark), "pipeline_dag_hash", "left").join(datasets(spark, sf_dir), "dataset_fingerprint", "left")


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample-keyed regression residuals: a line item's price against quantity times list price."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.concat_ws("|", "l_linestatus", "l_returnflag").alias("residual_set_id"),
        F.when(F.col("l_linestatus") == "F", "test").otherwise("cv").alias("scope"),
        F.concat(F.lit("fold"), "l_linenumber").alias("fold_id"),
        F.when(F.col("l_linestatus") == "F", "test").otherwise("validation").alias("partition"),
        F.col("l_partkey").cast("string").alias("sample_id"),
        F.col("l_extendedprice").alias("y_true"),
        (F.col("l_quantity") * F.col("p_retailprice")).alias("y_pred"),
    )


def event_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(execution_hash, sample_id, ordinal, residual, partition): many rows for a sample, in the order of ordinal."""
    e = table(spark, sf_dir, "events")
    mean = e.groupBy("event_type").agg(F.avg("value").alias("mean"))
    rows = e.join(mean, "event_type").select(F.col("event_type").alias("execution_hash"), F.col("user_id").cast("string").alias("sample_id"), F.struct("ts", "event_id").alias("ordinal"), (F.col("value") - F.col("mean")).alias("residual"))
    return rows.withColumn("partition", F.lit("validation"))


def condition_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_condition_hash with a stand-in for each of its six component hashes."""
    rc = run_conditions(spark, sf_dir)
    part = {"dataset_variant_hash": "dataset_fingerprint", "pipeline_dag_hash": "pipeline_dag_hash", "rng_context_hash": "seed"}
    cols = [F.sha2(F.col(part[n]).cast("string") if n in part else F.lit(n), 256).alias(n) for n in RUN_CONDITION]
    return rc.select(F.col("run_condition_hash").alias("run_key"), *cols)


def recipe_texts(spark: SparkSession) -> DataFrame:
    """(pipeline_id, source): the pipelines as JSON recipes, a list of nodes each."""
    p = params(spark).groupBy("pipeline_dag_hash", "node_id").agg(F.concat_ws(",", F.sort_array(F.collect_list(F.concat(F.lit('"'), "param_name", F.lit('":'), "value_json")))).alias("j"))
    n = nodes(spark).join(p, ["pipeline_dag_hash", "node_id"], "left")
    text = F.concat(F.lit('{"node_id":"'), "node_id", F.lit('","kind":"'), "kind", F.lit('","operator":"'), "operator", F.lit('","params":{'), F.coalesce("j", F.lit("")), F.lit("}}"))
    each = n.groupBy("pipeline_dag_hash").agg(F.sort_array(F.collect_list(F.struct("node_id", text.alias("t")))).alias("n"))
    return each.select(F.col("pipeline_dag_hash").alias("pipeline_id"), F.concat(F.lit('{"nodes":['), F.concat_ws(",", "n.t"), F.lit("]}")).alias("source"))


def manifest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(execution_hash, text): an export manifest as JSON for each execution; its scores are one per scope."""
    lit = F.lit
    score = lambda scope: F.when(F.bool_or(F.col("score_scope") == scope), lit(f'{{"metric_name":"rmse","metric_value":1.5,"scope":"{scope}"}}'))
    scopes = observations(spark, sf_dir).groupBy("order_key").agg(F.concat_ws(",", score("cv"), score("test")).alias("obs"))
    e = with_methods(executions(spark, sf_dir)).join(scopes, "order_key", "left")
    e = e.join(F.broadcast(recipe_texts(spark).withColumnRenamed("pipeline_id", "pipeline_dag_hash")), "pipeline_dag_hash")
    text = F.concat(
        lit('{"arena_export_schema_version": 1, "arena_export_hash": "'), F.sha2("execution_hash", 256), lit('", "dataset": {"dataset_fingerprint": "'), F.sha2(F.concat(lit("d"), "dataset_fingerprint"), 256),
        lit('"}, "task": {"task_type": "regression", "target_name": "price"}, "dataset_variant": {"variant_spec": {"size": "all"}}, "split": {"method": "'), "split_method", lit('", "params": {"test_size": 0.25}}, "cv": {"method": "'), "cv_method",
        lit('", "n_folds": '), F.col("n_folds").cast("string"), lit('}, "rng": {"root_seed": '), F.col("seed").cast("string"), lit('}, "refit": {"strategy": "full"}, "execution": {"execution_id": "'), "execution_hash",
        lit('"}, "pipeline": '), "source", lit(', "scores": {"observations": ['), F.coalesce("obs", lit("")), lit("]}}"),
    )
    return e.select("execution_hash", text.alias("text"))


def literal_rows(rows: list[tuple]) -> str:
    """rows as the text of SQL VALUES."""
    one = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def sql_views() -> str:
    """The same tables as common table expressions in ANSI SQL."""
    pipes, node_rows, param_rows = pipeline_rows()
    names = lambda ddl: ", ".join(c.split()[0] for c in ddl.split(", "))
    views = {
        "pipelines": f"SELECT * FROM (VALUES {literal_rows(pipes)}) v({names(PIPELINES)})",
        "nodes": f"SELECT * FROM (VALUES {literal_rows(node_rows)}) v({names(NODES)})",
        "params": f"SELECT * FROM (VALUES {literal_rows(param_rows)}) v({names(PARAMS)})",
        "datasets": "SELECT CAST(n_nationkey AS VARCHAR) AS dataset_fingerprint, n_name AS dataset_name, r_name AS domain FROM nation JOIN region ON n_regionkey = r_regionkey",
        "executions": """SELECT o_orderkey AS order_key, 'e' || o_orderkey AS execution_hash, c_mktsegment || '|' || o_orderpriority AS pipeline_dag_hash,
            CAST(c_nationkey AS VARCHAR) AS dataset_fingerprint, CAST(year(o_orderdate) AS BIGINT) AS seed,
            CASE WHEN o_orderstatus = 'P' THEN 'quarantined' ELSE 'valid' END AS execution_validity, CASE WHEN o_custkey % 2 = 0 THEN 'release' ELSE 'user' END AS collection_id,
            c_mktsegment || '|' || o_orderpriority || '|' || c_nationkey || '|' || year(o_orderdate) AS run_condition_hash
            FROM orders JOIN customer ON o_custkey = c_custkey""",
        "run_conditions": "SELECT DISTINCT run_condition_hash, pipeline_dag_hash, dataset_fingerprint, seed, 'regression' AS task_type, CASE WHEN contains(pipeline_dag_hash, '-') THEN 'holdout' ELSE 'kennard_stone' END AS split_method, CASE WHEN seed % 2 = 1 THEN 'kfold' ELSE 'shuffle' END AS cv_method, CAST(CASE WHEN seed % 2 = 1 THEN 5 ELSE 10 END AS BIGINT) AS n_folds, 'full' AS refit_strategy FROM executions",
        "observations": """SELECT l_orderkey AS order_key, CASE WHEN l_linestatus = 'F' THEN 'test' ELSE 'cv' END AS score_scope, CASE WHEN l_orderkey % 10 = 0 THEN 'superseded' ELSE 'valid' END AS score_validity,
            CASE l_returnflag WHEN 'A' THEN 'rmse' WHEN 'N' THEN 'r2' ELSE 'mae' END AS metric_name, sqrt(l_extendedprice / l_quantity) AS metric_value,
            'fold' || l_linenumber AS fold_id, CASE WHEN l_linestatus = 'F' THEN 'test' ELSE 'validation' END AS "partition" FROM lineitem""",
        "backbone": "SELECT * FROM executions JOIN observations USING (order_key) LEFT JOIN pipelines USING (pipeline_dag_hash) LEFT JOIN datasets USING (dataset_fingerprint)",
        "residuals": """SELECT l_linestatus || '|' || l_returnflag AS residual_set_id, CASE WHEN l_linestatus = 'F' THEN 'test' ELSE 'cv' END AS scope, 'fold' || l_linenumber AS fold_id,
            CASE WHEN l_linestatus = 'F' THEN 'test' ELSE 'validation' END AS "partition", CAST(l_partkey AS VARCHAR) AS sample_id, l_extendedprice AS y_true, l_quantity * p_retailprice AS y_pred FROM lineitem JOIN part ON l_partkey = p_partkey""",
        "event_residuals": """SELECT e.event_type AS execution_hash, CAST(user_id AS VARCHAR) AS sample_id, ts, event_id, value - mean AS residual FROM events e JOIN (SELECT event_type, avg(value) AS mean FROM events GROUP BY event_type) m ON e.event_type = m.event_type""",
    }
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in views.items())


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
