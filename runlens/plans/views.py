"""What reports show: findings, whole runs, plans, coded axes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facets, graphs, ingest, views
from ..operators.quantiles import distribution
from ..operators.rankings import selected
from ..sources import driver_tables as T
from .registry import query, rounded

SEL = "metric_name = 'rmse' AND score_scope = 'cv' AND score_validity = 'valid' AND execution_validity = 'valid'"


def _facets(spark, sf):
    return facets.run_facets(T.run_conditions(spark, sf), T.datasets(spark, sf), T.pipelines(spark), T.nodes(spark), T.params(spark))


_BY = {k: f"(SELECT facet_value AS value, avg(metric_value) AS score FROM backbone JOIN facets USING (run_condition_hash) WHERE facet_key = '{k}' AND {SEL} GROUP BY 1)" for k in ("model_family", "preprocessing_op", "has_augmentation", "split_method")}


@query(f"""SELECT finding, subject, round(figure, 6) AS figure FROM (
    (SELECT 'top_pipeline' AS finding, min(label) AS subject, avg(metric_value) AS figure FROM backbone WHERE {SEL} GROUP BY run_condition_hash ORDER BY avg(metric_value), run_condition_hash LIMIT 1)
    UNION ALL (SELECT 'best_model_family', value, score FROM {_BY["model_family"]} ORDER BY score, value LIMIT 1)
    UNION ALL (SELECT 'best_preprocessing', value, score FROM {_BY["preprocessing_op"]} ORDER BY score, value LIMIT 1)
    UNION ALL SELECT 'augmentation_lift', 'no - yes', max(score) FILTER (value = 'no') - max(score) FILTER (value = 'yes') FROM {_BY["has_augmentation"]}
    UNION ALL SELECT 'split_sensitivity', arg_min(value, score), max(score) - min(score) FROM {_BY["split_method"]} HAVING count(*) > 1
    UNION ALL (SELECT 'most_robust', pipeline_dag_hash || ' on ' || dataset_fingerprint, stddev_pop(metric_value) FROM backbone WHERE metric_name = 'rmse' AND score_scope = 'cv' AND execution_validity = 'valid' GROUP BY pipeline_dag_hash, dataset_fingerprint ORDER BY 3, pipeline_dag_hash, dataset_fingerprint LIMIT 1)) WHERE figure IS NOT NULL""")
def findings(spark, sf):
    return rounded(views.findings(T.backbone(spark, sf), _facets(spark, sf)))


@query("SELECT execution_hash, label, main_model, dataset_name, domain, e.seed, split_method, cv_method, n_folds, refit_strategy, (SELECT string_agg(node_id || ' ' || kind || ' ' || operator, '; ' ORDER BY node_id) FROM nodes n WHERE n.pipeline_dag_hash = e.pipeline_dag_hash) AS nodes, (SELECT string_agg(node_id || ' ' || param_name || '=' || value_json, '; ' ORDER BY node_id, param_name) FROM params n WHERE n.pipeline_dag_hash = e.pipeline_dag_hash) AS params, (SELECT string_agg('g' || (i - 1) || '>g' || i, '; ' ORDER BY i) FROM content c WHERE c.pipeline_dag_hash = e.pipeline_dag_hash AND i > 0) AS edges, (SELECT string_agg(metric_name || ' ' || fold_id || ' ' || score_scope, '; ' ORDER BY metric_name, fold_id, score_scope, metric_value) FROM backbone b WHERE b.execution_hash = e.execution_hash) AS scores FROM executions e JOIN run_conditions r USING (run_condition_hash) JOIN pipelines p ON p.pipeline_dag_hash = e.pipeline_dag_hash JOIN datasets d ON d.dataset_fingerprint = e.dataset_fingerprint WHERE execution_hash = 'e7'")
def run_detail(spark, sf):
    n = T.nodes(spark)
    last = F.substring("node_id", 2, 9).cast("int")
    edges = n.where(last > 0).select("pipeline_dag_hash", F.concat(F.lit("g"), (last - 1).cast("string")).alias("src"), F.col("node_id").alias("dst"))
    d = views.run_detail("e7", T.executions(spark, sf), T.run_conditions(spark, sf), T.pipelines(spark), T.datasets(spark, sf), n, T.params(spark), T.backbone(spark, sf), edges)
    text = lambda c, f: F.array_join(F.transform(c, f), "; ").alias(c)
    return d.select("execution_hash", "label", "main_model", "dataset_name", "domain", "seed", "split_method", "cv_method", "n_folds", "refit_strategy", text("nodes", lambda x: F.concat_ws(" ", x["node_id"], x["kind"], x["operator"])), text("params", lambda x: F.concat(x["node_id"], F.lit(" "), x["param_name"], F.lit("="), x["value_json"])), text("edges", lambda x: F.concat(x["src"], F.lit(">"), x["dst"])), text("scores", lambda x: F.concat_ws(" ", x["metric_name"], x["fold_id"], x["score_scope"])))


@query("SELECT plan_id, p.pipeline_dag_hash, p.dataset_fingerprint, label, main_model, c.name AS dataset_name FROM (SELECT *, 'plan_' || substr(sha256('{\"c\":\"release\",\"d\":\"' || dataset_fingerprint || '\",\"p\":\"' || pipeline_dag_hash || '\"}'), 1, 16) AS plan_id FROM (SELECT pipeline_dag_hash, dataset_fingerprint FROM pipelines CROSS JOIN datasets)) p LEFT JOIN pipelines USING (pipeline_dag_hash) LEFT JOIN (SELECT dataset_fingerprint, dataset_name AS name FROM datasets WHERE dataset_fingerprint <> '3' UNION ALL SELECT dataset_fingerprint, domain FROM datasets WHERE dataset_fingerprint = '5') c ON c.dataset_fingerprint = p.dataset_fingerprint WHERE NOT EXISTS (SELECT 1 FROM executions e WHERE execution_validity = 'valid' AND seed = 2001 AND e.pipeline_dag_hash = p.pipeline_dag_hash AND e.dataset_fingerprint = p.dataset_fingerprint)")
def planned_runs(spark, sf):
    """What no execution of one year has run yet; one dataset has no card, another has two."""
    each = F.explode(F.array(*[F.lit(str(i)) for i in range(25)])).alias("dataset_fingerprint")
    targets = T.pipelines(spark).select("pipeline_dag_hash", each, F.lit("release").alias("collection_id"))
    d = T.datasets(spark, sf)
    cards = d.where("dataset_fingerprint != '3'").select("dataset_fingerprint", F.col("dataset_name").alias("name")).unionByName(d.where("dataset_fingerprint = '5'").select("dataset_fingerprint", F.col("domain").alias("name")))
    plans = ingest.plan(targets, T.executions(spark, sf).where("seed = 2001")).withColumn("created_at", F.lit("2001-01-01T00:00:00Z"))
    return views.planned_list(plans, T.pipelines(spark), cards).select("plan_id", "pipeline_dag_hash", "dataset_fingerprint", "label", "main_model", "dataset_name")


@query("SELECT collection_id, min(created_at) AS created_at FROM (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'release' ELSE 'user' END AS collection_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM orders) GROUP BY collection_id", views=False)
def collections(spark, sf):
    """Every collection, the oldest first."""
    o = T.table(spark, sf, "orders").select(F.when(F.col("o_custkey") % 2 == 0, "release").otherwise("user").alias("collection_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    return o.groupBy("collection_id").agg(F.min("created_at").alias("created_at")).orderBy("created_at", "collection_id")


@query("SELECT dataset_fingerprint, domain, dense_rank() OVER (ORDER BY domain) - 1 AS domain_code FROM datasets")
def coded_axis(spark, sf):
    return views.coded(T.datasets(spark, sf).select("dataset_fingerprint", "domain"), "domain").select("dataset_fingerprint", "domain", F.col("domain_code").cast("long").alias("domain_code"))


@query(f"SELECT pipeline_dag_hash, round(coalesce(16 + (n - min(n) OVER ()) / nullif(max(n) OVER () - min(n) OVER (), 0)::DOUBLE * 44, 16), 6) AS size FROM (SELECT pipeline_dag_hash, count(DISTINCT execution_hash) AS n FROM backbone WHERE {SEL} GROUP BY 1)")
def node_sizes(spark, sf):
    n = graphs.pipeline_nodes(T.backbone(spark, sf)).select("pipeline_dag_hash", "n_runs")
    ends = n.agg(F.min("n_runs").alias("low"), F.max("n_runs").alias("high"))
    return rounded(n.crossJoin(F.broadcast(ends)).select("pipeline_dag_hash", views.scaled(F.col("n_runs"), F.col("low"), F.col("high")).alias("size")))


@query("SELECT residual_set_id, count(*) AS n FROM residuals WHERE residual_set_id LIKE 'O%' GROUP BY 1")
def comparable_residuals(spark, sf):
    """Only sets whose rows are named by sample may be compared; here those of one kind are positional."""
    r = T.residuals(spark, sf)
    sets = r.select("residual_set_id").distinct().withColumn("key", F.when(F.col("residual_set_id").startswith("O"), "sample_id").otherwise("positional"))
    return views.comparable(sets, r).groupBy("residual_set_id").agg(F.count("*").alias("n"))


@query("SELECT execution_hash, pipeline_dag_hash FROM executions WHERE execution_hash = 'e7'")
def point_lookup(spark, sf):
    return views.found(T.executions(spark, sf), "execution_hash", "e7").select("execution_hash", "pipeline_dag_hash")


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 1000 GROUP BY o_custkey", views=False)
def parametrised_sql(spark, sf):
    """SQL text with named parameters, over tables given as frames."""
    return spark.sql("SELECT o_custkey, count(*) AS n FROM {orders} WHERE o_orderstatus = :status AND o_totalprice > :least GROUP BY o_custkey", args={"status": "P", "least": 1000}, orders=T.table(spark, sf, "orders"))


@query("SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id", views=False)
def settings_latest(spark, sf):
    return views.settings(T.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq")))


@query(f"SELECT domain, round(quantile_cont(metric_value, 0.25), 6) AS p25, round(median(metric_value), 6) AS median, round(quantile_cont(metric_value, 0.75), 6) AS p75 FROM backbone WHERE {SEL} GROUP BY domain")
def box_by_domain(spark, sf):
    rows = selected(T.backbone(spark, sf), "rmse")
    return rounded(distribution(rows, ["domain"], "metric_value", {"p25": 0.25, "median": 0.5, "p75": 0.75}).select("domain", "p25", "median", "p75"))
