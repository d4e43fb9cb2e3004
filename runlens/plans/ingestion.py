"""Ingestion end to end: manifests are resolved into identities, dimensions and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity
from ..operators import ingest, metrics, resolve
from ..sources import driver_tables as T
from ..sources import manifests
from .registry import query, rounded


_IDS = """SELECT *, sha256('{"dataset_fingerprint":"' || dataset_fingerprint || '","task_hash":"' || task_hash || '","variant_spec":{"size":"all"}}') AS dataset_variant_hash, sha256('{"spec":"' || split_spec_hash || '","summary":{}}') AS split_instance_hash, sha256('{"spec":"' || cv_spec_hash || '","summary":{}}') AS cv_instance_hash FROM (
    SELECT execution_hash AS execution_id, sha256(execution_hash) AS export_hash, dag AS pipeline_dag_hash, f AS dataset_fingerprint, coalesce(scopes, []) AS scopes,
        sha256('{"dataset_fingerprint":"' || f || '","encoding":{},"target_hash":null,"target_name":"price","task_type":"regression"}') AS task_hash,
        sha256('{"method":"' || split_method || '","params":{"test_size":0.25}}') AS split_spec_hash,
        sha256('{"method":"' || cv_method || '","n_folds":' || n_folds || ',"n_repeats":null,"nested":false,"within_train_only":true}') AS cv_spec_hash,
        sha256('{"derivation":null,"determinism_flags":{},"framework_seeds":{},"root_seed":' || seed || '}') AS rng_context_hash,
        sha256('{"params":{},"selection_scope":null,"strategy":"full","train_scope":null}') AS refit_strategy_hash,
        sha256('{"aggregation_policy":"macro_mean","direction":null,"filters":{},"metric_implementation":"metrics/1","score_level":"' || CASE WHEN coalesce(len(scopes), 0) = 0 OR list_contains(scopes, 'cv') THEN 'cv' ELSE list_min(scopes) END || '","score_version":"1.0","standardization":null}') AS score_spec_hash
    FROM (SELECT e.*, sha256('d' || e.dataset_fingerprint) AS f, r.split_method, r.cv_method, r.n_folds, d.dag, o.scopes FROM executions e JOIN run_conditions r USING (run_condition_hash) JOIN dags d ON d.pipeline_dag_hash = e.pipeline_dag_hash LEFT JOIN (SELECT order_key, list(DISTINCT score_scope) AS scopes FROM observations GROUP BY 1) o USING (order_key)))"""
_CONDITION = "sha256('{\"components\":[' || " + " || ',' || ".join(f"'[\"{c}\",\"' || {c} || '\"]'" for c in identity.RUN_CONDITION) + " || '],\"kind\":\"run_condition\",\"v\":1}')"
_RESOLVED = f"(SELECT *, sha256('{{\"execution_id\":\"' || execution_id || '\",\"export\":\"' || export_hash || '\",\"run_condition\":\"' || run_condition_hash || '\"}}') AS execution_hash FROM (SELECT *, {_CONDITION} AS run_condition_hash FROM ({_IDS})))"
_LISTED = ("execution_id", *resolve.HASHES, "run_condition_hash", "execution_hash")


@query(f"SELECT {', '.join(_LISTED)} FROM {_RESOLVED}")
def manifest_identities(spark, sf):
    return resolve.identities(T.manifest_texts(spark, sf)).select(*_LISTED)


_SETS = f"SELECT sha256('{{\"execution\":\"' || execution_hash || '\",\"scope\":\"' || scope || '\",\"score_spec\":\"' || score_spec_hash || '\"}}') AS score_set_id, execution_hash, scope FROM (SELECT *, unnest(scopes) AS scope FROM {_RESOLVED})"


@query(f"SELECT score_set_id, execution_hash, scope, 1 AS n_observations FROM ({_SETS})")
def manifest_facts(spark, sf):
    texts = T.manifest_texts(spark, sf)
    parsed = texts.select(F.from_json("text", "arena_export_hash string, scores struct<observations:array<struct<metric_name:string, metric_value:double, scope:string>>>").alias("m"))
    observed = parsed.select(F.col("m.arena_export_hash").alias("export_hash"), F.inline("m.scores.observations"))
    return resolve.score_sets(resolve.identities(texts), observed)


@query(f"SELECT execution_hash, sha256('{{\"execution\":\"' || execution_hash || '\",\"key\":\"sample_id\"}}') AS residual_set_id FROM {_RESOLVED}")
def residual_set_ids(spark, sf):
    return resolve.identities(T.manifest_texts(spark, sf)).select("execution_hash", resolve.residual_set_id(F.col("execution_hash"), F.lit("sample_id")).alias("residual_set_id"))


_YEAR = "execution_validity = 'valid' AND seed = 2001"
_TARGETS = "SELECT pipeline_dag_hash, dataset_fingerprint, 'release' AS collection_id FROM pipelines CROSS JOIN datasets"


@query(f"SELECT p.pipeline_dag_hash, p.dataset_fingerprint, p.collection_id, 'plan_' || substr(sha256('{{\"c\":\"' || collection_id || '\",\"d\":\"' || dataset_fingerprint || '\",\"p\":\"' || pipeline_dag_hash || '\"}}'), 1, 16) AS plan_id, fulfilled_by, CASE WHEN fulfilled_by IS NULL THEN 'planned' ELSE 'fulfilled' END AS status FROM ({_TARGETS}) p LEFT JOIN (SELECT pipeline_dag_hash, dataset_fingerprint, min(execution_hash) AS fulfilled_by FROM executions WHERE {_YEAR} GROUP BY ALL) USING (pipeline_dag_hash, dataset_fingerprint)")
def fulfilled_plans(spark, sf):
    """Plans of every pipeline on every dataset, fulfilled by the executions of one year."""
    each = F.explode(F.array(*[F.lit(str(i)) for i in range(25)])).alias("dataset_fingerprint")
    targets = T.pipelines(spark).select("pipeline_dag_hash", each, F.lit("release").alias("collection_id"))
    plans = targets.withColumn("plan_id", identity.plan_id(F.col("pipeline_dag_hash"), F.col("dataset_fingerprint"), F.col("collection_id")))
    return resolve.fulfilled(plans, T.executions(spark, sf).where("seed = 2001"))


@query("SELECT n_name AS token, CASE WHEN n_nationkey % 3 = 0 THEN sha256(n_name) ELSE sha256('{\"dataset_token\":\"' || n_name || '\"}') END AS dataset_fingerprint FROM nation UNION ALL SELECT sha256(r_name), sha256(r_name) FROM region", views=False)
def dataset_tokens(spark, sf):
    nation, region = T.table(spark, sf, "nation"), T.table(spark, sf, "region")
    cards = nation.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("name"), F.concat(F.lit("id"), "n_nationkey").alias("dataset_id"), F.sha2("n_name", 256).alias("dataset_fingerprint"))
    tokens = nation.select(F.col("n_name").alias("token")).unionByName(region.select(F.sha2("r_name", 256).alias("token")))
    return resolve.dataset_of(tokens, cards)


@query("SELECT user_id AS export_hash, count(*) AS n_rows, count(*) > 66 AS truncated FROM events GROUP BY user_id", views=False)
def residual_caps(spark, sf):
    return ingest.cap_report(T.table(spark, sf, "events").select(F.col("user_id").alias("export_hash")), cap=66)


@query("SELECT e.user_id, e.event_id FROM events e JOIN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) <= 66) USING (user_id)", views=False)
def residuals_within_cap(spark, sf):
    rows = T.table(spark, sf, "events").select(F.col("user_id").alias("export_hash"), "event_id")
    return ingest.within_cap(rows, cap=66).select(F.col("export_hash").alias("user_id"), "event_id")


@query("SELECT event_type AS level, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY event_type", views=False)
def issue_counts(spark, sf):
    e = T.table(spark, sf, "events").select(F.when(F.col("event_id") % 2 == 0, F.array(F.concat("event_type", F.lit(": x")))).otherwise(F.array().cast("array<string>")).alias("issues"))
    return ingest.issue_counts(e)


@query("SELECT o_custkey AS export_hash, min(o_orderkey) AS seq FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) GROUP BY o_custkey", views=False)
def new_exports(spark, sf):
    sent = T.table(spark, sf, "orders").select(F.col("o_custkey").alias("export_hash"), F.lit(1).alias("schema_version"), F.col("o_orderkey").alias("seq"))
    known = T.table(spark, sf, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("export_hash"), F.lit(1).alias("schema_version"), F.lit("committed").alias("status"))
    return ingest.new_exports(sent, known).select("export_hash", "seq")


_MASKED = "SELECT 's_' || substr(sha256('salt' || sample_id), 1, 16) AS sample_id, scope, \"partition\", CASE WHEN l % 2 = 0 THEN y_true END AS y_true, y_pred, CASE WHEN l % 2 = 0 THEN y_true - y_pred END AS residual FROM (SELECT *, CAST(substr(fold_id, 5) AS INTEGER) AS l FROM residuals)"


@query(f"SELECT sample_id, scope, \"partition\", round(y_true, 4) AS y_true, round(y_pred, 4) AS y_pred, round(residual, 4) AS residual FROM ({_MASKED})")
def publishable_residuals(spark, sf):
    r = T.residuals(spark, sf).withColumns({"may_y_true": F.substring("fold_id", 5, 9).cast("int") % 2 == 0, "may_y_pred": F.lit(True), "may_y_proba": F.lit(True), "y_proba": F.lit(None).cast("array<double>"), "residual": F.lit(None).cast("double")})
    return rounded(ingest.publishable(r, "salt").select("sample_id", "scope", "partition", "y_true", "y_pred", "residual"), 4)


@query("SELECT 'b' || (vec_id % 50) AS residual_set_id, 's' || vec_id AS sample_id, CAST(vec_id AS DOUBLE) AS y_true, round(CAST(embedding[1] AS DOUBLE), 6) AS y_pred, round(vec_id - CAST(embedding[1] AS DOUBLE), 6) AS residual, 'cv' AS scope FROM embeddings", views=False)
def prediction_blocks(spark, sf):
    """Blocks of parallel arrays with nested predictions, of which the first element counts."""
    e = T.table(spark, sf, "embeddings").select(F.concat(F.lit("b"), (F.col("vec_id") % 50).cast("string")).alias("residual_set_id"), F.struct("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).alias("s"))
    b = e.groupBy("residual_set_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    blocks = b.select("residual_set_id", F.lit("validation").alias("partition"), F.lit("f0").alias("fold_id"), F.transform("s", lambda x: F.concat(F.lit("s"), x["vec_id"].cast("string"))).alias("sample_ids"), F.col("s.v").alias("values"), F.transform("s", lambda x: x["vec_id"].cast("double")).alias("y_true"))
    return rounded(manifests.prediction_residuals(blocks).select("residual_set_id", "sample_id", "y_true", "y_pred", "residual", "scope"))


@query("SELECT event_id, lower(event_type) AS metric_name, CAST(json_extract(props, '$.k') AS DOUBLE) AS metric_value, CASE WHEN event_id % 2 = 0 THEN 'test' ELSE 'fold' END AS scope FROM events", views=False)
def metric_reports(spark, sf):
    """Reports' metric maps as observations; what isn't a number is dropped."""
    k = F.get_json_object("props", "$.k")
    reports = T.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "test").otherwise("validation").alias("partition"), F.lit("fold").alias("level"), F.lit(None).cast("string").alias("fold_id"), F.create_map(F.lower("event_type"), k, F.lit("note"), F.lit("text")).alias("metrics"))
    return manifests.report_observations(reports).select("event_id", "metric_name", "metric_value", "scope")


@query("SELECT vec_id, 2 AS n_rows, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[33] AS DOUBLE), 6) AS second FROM embeddings", views=False)
def reshaped_probabilities(spark, sf):
    e = T.table(spark, sf, "embeddings").select("vec_id", manifests.reshaped(F.transform("embedding", lambda x: x.cast("double")), F.lit(2), F.lit(32)).alias("r"))
    return rounded(e.select("vec_id", F.size("r").alias("n_rows"), F.col("r")[0][0].alias("first"), F.col("r")[1][0].alias("second")))


@query("SELECT fold_id AS residual_set_id, 'mae' AS metric_name, round(avg(abs(y_true - y_pred)), 4) AS metric_value FROM residuals WHERE CAST(substr(fold_id, 5) AS INTEGER) % 2 = 1 GROUP BY fold_id")
def recomputed_scores(spark, sf):
    """Exports without scores get them from their residuals; the others keep theirs."""
    r = T.residuals(spark, sf).withColumns({"residual_set_id": F.col("fold_id"), "scope": F.lit("cv"), "partition": F.lit("validation")})
    given = r.where(F.substring("fold_id", 5, 9).cast("int") % 2 == 0).select("residual_set_id").distinct()
    return rounded(metrics.recompute(r.join(given, "residual_set_id", "left_anti")).where("metric_name = 'mae'").select("residual_set_id", "metric_name", "metric_value"), 4)
