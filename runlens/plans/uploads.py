"""What comes in beside manifests: workspaces, engine bundles, dataset cards and uploaded files, made of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity
from ..operators import resolve, uploads
from ..sources import bundles, cards, workspace
from ..sources import driver_tables as T
from ..sources.scratch import spread
from .registry import query, rounded


def _predictions(spark, sf):
    """Events as predictions: one in five of a final fold, one in five aggregated, half with a map of scores."""
    e, k = T.table(spark, sf, "events"), F.col("event_id")
    none = F.lit(None).cast("string")
    fold = F.when(k % 5 == 0, "final").when(k % 5 == 1, "_agg").otherwise(F.concat(F.lit("f"), (k % 5).cast("string")))
    scores = F.when(k % 2 == 0, F.concat(F.lit('{"RMSE": '), k.cast("string"), F.lit('.5, "note": "7", "flag": true}')))
    return e.select(
        k.cast("string").alias("prediction_id"), F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("pipeline_id"), F.col("event_type").alias("model_name"), F.when(k % 3 == 0, "b").alias("branch_id"), fold.alias("fold_id"),
        F.when(k % 4 == 0, "Test").alias("partition"), F.when(F.col("event_type") != "view", "regression").otherwise("binary").alias("task_type"), F.when(k % 7 != 0, "MAE").alias("metric"), F.when(k % 11 != 0, k.cast("double")).alias("val_score"),
        scores.alias("scores"), F.lit(9).cast("long").alias("n_samples"), none.cast("long").alias("n_features"),
    )


_PREDICTIONS = """(SELECT CAST(event_id AS VARCHAR) AS prediction_id, event_id AS k, 'p' || (user_id % 7) AS pipeline_id, event_type AS model_name, CASE WHEN event_id % 3 = 0 THEN 'b' ELSE '' END AS branch_id,
    CASE WHEN event_id % 5 NOT IN (0, 1) THEN 'f' || (event_id % 5) END AS fold_id, CASE WHEN event_id % 4 = 0 THEN 'test' WHEN event_id % 5 = 0 THEN 'refit' ELSE 'cv' END AS scope,
    CASE WHEN event_id % 5 = 0 THEN 'final' WHEN event_id % 4 = 0 THEN 'test' ELSE 'validation' END AS "partition" FROM events)"""


@query(f"""SELECT pipeline_id, model_name, branch_id, metric_name, metric_value, 'min' AS direction, scope, fold_id, "partition" FROM (
    SELECT *, 'rmse' AS metric_name, k + 0.5::DOUBLE AS metric_value FROM {_PREDICTIONS} WHERE k % 2 = 0 UNION ALL SELECT *, 'flag', 1.0 FROM {_PREDICTIONS} WHERE k % 2 = 0
    UNION ALL SELECT *, CASE WHEN k % 7 = 0 THEN 'score' ELSE 'mae' END, k FROM {_PREDICTIONS} WHERE k % 2 = 1 AND k % 11 <> 0)""", views=False)
def workspace_scores(spark, sf):
    return workspace.observations(_predictions(spark, sf))


@query(f"""WITH p AS {_PREDICTIONS}, g AS (SELECT pipeline_id, model_name, branch_id, nullif(count(DISTINCT fold_id), 0) AS n_folds, bool_or(k % 5 = 0) AS final FROM p GROUP BY ALL)
    SELECT pipeline_id, model_name, branch_id, pipeline_id || ':' || model_name || ':' || branch_id AS execution_id, sha256('{{"dataset_hash":"h","dataset_name":"' || pipeline_id || '"}}') AS dataset_fingerprint,
    pipeline_id || ' [' || model_name || CASE WHEN branch_id = '' THEN '' ELSE '/' || branch_id END || ']' AS label, CASE WHEN model_name = 'view' THEN 'binary' ELSE 'regression' END AS task_type, n_folds,
    CASE WHEN final THEN 'global_best_params_full_train' ELSE 'none' END AS refit_strategy FROM g""", views=False)
def workspace_runs(spark, sf):
    p = _predictions(spark, sf)
    pipes = p.select("pipeline_id").distinct().select("pipeline_id", F.lit(None).cast("string").alias("name"), F.col("pipeline_id").alias("dataset_name"), F.lit("h").alias("dataset_hash"), F.lit("[]").alias("expanded_config"), F.lit(None).cast("string").alias("original_template"))
    return workspace.runs(pipes, p).drop("n_samples", "n_features", "steps")


@query("""SELECT 'w' AS pipeline_id, CASE WHEN vec_id % 2 = 0 THEN 'm' ELSE 'c' END AS model_name, 'pos_' || (CASE WHEN vec_id % 3 = 0 THEN 10 * i ELSE i END) AS sample_id, round(CASE WHEN i < 2 THEN CAST(embedding[i + 1] AS DOUBLE) END, 6) AS y_true, round(CAST(embedding[i + 4] AS DOUBLE), 6) AS y_pred,
    round(CASE WHEN vec_id % 2 = 0 AND i < 2 THEN CAST(embedding[i + 1] AS DOUBLE) - CAST(embedding[i + 4] AS DOUBLE) END, 6) AS residual, CASE WHEN vec_id % 2 = 1 THEN i * 2 END AS first_probability
    FROM embeddings, (SELECT unnest([0, 1, 2]) AS i) WHERE vec_id % 5 <> 0""", views=False)
def workspace_residuals(spark, sf):
    """Arrays of three predictions and two true values; probabilities of two classes, flat."""
    k = F.col("vec_id")
    e = T.table(spark, sf, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    none = F.lit(None).cast("string")
    p = e.select(k.cast("string").alias("prediction_id"), F.lit("w").alias("pipeline_id"), F.when(k % 2 == 0, "m").otherwise("c").alias("model_name"), none.alias("branch_id"), F.when(k % 5 == 0, "_agg").otherwise("f").alias("fold_id"), none.alias("partition"), F.when(k % 2 == 0, "regression").otherwise("binary").alias("task_type"))
    values = e.select(k.cast("string").alias("prediction_id"), F.slice("v", 1, 2).alias("y_true"), F.slice("v", 4, 3).alias("y_pred"), F.when(k % 3 == 0, F.array(F.lit(0), F.lit(10), F.lit(20)).cast("array<long>")).alias("sample_indices"), F.array(*[F.lit(float(i)) for i in range(6)]).alias("y_proba"), F.array(F.lit(3), F.lit(2)).cast("array<long>").alias("y_proba_shape"))
    r = workspace.residuals(p, values)
    return rounded(r.select("pipeline_id", "model_name", "sample_id", "y_true", "y_pred", "residual", F.get("y_proba", F.lit(0)).cast("int").alias("first_probability")))


def _bundles(spark, sf):
    """A bundle for each part: predictions are nested, every third has an envelope."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit('{"bundle_id": "b'), k, F.lit('", "graph_fingerprint": "g", "campaign_fingerprint": "c'), k, F.lit('", "unsafe_flags": [], "prediction_caches": [{"partition": "TEST", "fold_id": null, "sample_ids": ["s1", "s2"], "values": [[1.5], '), k, F.lit('], "targets": ['), k, F.lit("]}]}"))
    return spread(T.table(spark, sf, "part").select("p_partkey"), "p_partkey").select(k.alias("path"), text.alias("text"), F.lit(None).cast("string").alias("graph"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('{"schema_fingerprint": "'), F.sha2(k, 256), F.lit('"}'))).alias("envelope"))


@query("""SELECT 'b' || p_partkey AS execution_id, CASE WHEN p_partkey % 3 = 0 THEN sha256(CAST(p_partkey AS VARCHAR)) ELSE sha256('{"bundle":"b' || p_partkey || '","graph":"g"}') END AS dataset_fingerprint, 'c' || p_partkey AS cv_instance_hash,
    sha256('{"derivation":"sha256-hash-chain","determinism_flags":{},"framework_seeds":{},"root_seed":null}') AS rng_context_hash, CAST(NULL AS VARCHAR) AS error FROM part""", views=False)
def bundle_identities(spark, sf):
    return resolve.identities(bundles.bundle_manifests(_bundles(spark, sf))).select("execution_id", "dataset_fingerprint", "cv_instance_hash", "rng_context_hash", "error")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS residual_set_id, sample_id, 'test' AS scope, 'test' AS "partition", y_true, y_pred, y_true - y_pred AS residual FROM (
    SELECT p_partkey, 's1' AS sample_id, p_partkey::DOUBLE AS y_true, 1.5::DOUBLE AS y_pred FROM part UNION ALL SELECT p_partkey, 's2', NULL, p_partkey FROM part)""", views=False)
def bundle_residuals(spark, sf):
    return bundles.cached_residuals(_bundles(spark, sf)).select("residual_set_id", "sample_id", "scope", "partition", "y_true", "y_pred", "residual")


@query("""SELECT 'd' || n_nationkey AS dataset_id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'public' ELSE 'restricted' END AS visibility, CASE WHEN n_nationkey % 4 < 3 THEN CAST(n_nationkey + 100 AS BIGINT) END AS n_samples, CASE WHEN n_nationkey % 4 < 3 THEN CAST(n_nationkey + 7 AS BIGINT) END AS n_features, 1 AS n_targets,
    sha256('{"id":"d' || n_nationkey || '","name":"' || n_name || '","sources":[' || CASE WHEN n_nationkey % 4 < 3 THEN '{"n_observations":' || (n_nationkey + 100) || ',"n_variables":' || n_nationkey || '},{"n_observations":3,"n_variables":7}' ELSE '' END || '],"tier":"' || CASE WHEN n_nationkey % 2 = 0 THEN 'public' ELSE 'own' END || '","variables":[{"name":"y","role":"target"},{"name":"x","role":"input"}]}') AS card_hash FROM nation""", views=False)
def dataset_cards(spark, sf):
    """Cards of YAML texts: two sources, or none for every fourth."""
    k = F.col("n_nationkey").cast("string")
    sources = F.when(F.col("n_nationkey") % 4 < 3, F.concat(F.lit("\n- {n_variables: "), k, F.lit(", n_observations: "), (F.col("n_nationkey") + 100).cast("string"), F.lit("}\n- {n_variables: 7, n_observations: 3}\n"))).otherwise(" []\n")
    text = F.concat(F.lit("id: d"), k, F.lit('\nname: "'), "n_name", F.lit('"\ntier: '), F.when(F.col("n_nationkey") % 2 == 0, "public").otherwise("own"), F.lit("\nsources:"), sources, F.lit("variables:\n- {name: 'y', role: target}\n- {name: x, role: input}\n"))
    return cards.cards(T.table(spark, sf, "nation").select(k.alias("path"), text.alias("text"))).select("dataset_id", "name", "visibility", "n_samples", "n_features", "n_targets", "card_hash")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'export' WHEN 1 THEN 'bundle' WHEN 2 THEN 'recipe' WHEN 3 THEN 'recipe' WHEN 4 THEN 'recipe' ELSE 'unknown' END AS kind, CASE WHEN event_id % 6 = 3 THEN event_type END AS label FROM events", views=False)
def upload_kinds(spark, sf):
    """Uploaded files of every kind: manifests, bundles, JSON and YAML recipes, and what is none of them."""
    k = F.col("event_id") % 6
    text = F.when(k == 0, F.lit('{"arena_export_schema_version": 1}')).when(k == 1, F.lit('{"bundle_id": "b"}')).when(k == 2, F.lit('[{"operator": "a.B"}]')).when(k == 3, F.concat(F.lit("name: "), "event_type", F.lit("\npipeline:\n- operator: a.B\n"))).when(k == 4, F.lit('{"nodes": []}')).otherwise(F.col("props"))
    files = T.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("path"), F.encode(text, "UTF-8").alias("content"))
    return uploads.kinds(files).select(F.col("path").cast("long").alias("event_id"), "kind", "label")


@query(f"SELECT d.pipeline_dag_hash AS path, d.dag AS pipeline_dag_hash, s AS dataset_fingerprint, CASE WHEN EXISTS (SELECT 1 FROM executions e WHERE e.pipeline_dag_hash = d.pipeline_dag_hash AND e.dataset_fingerprint = s AND execution_validity = 'valid' AND seed = 2001) THEN 'already_run' ELSE 'planned' END AS status, 'plan_' || substr(sha256('{{\"c\":\"uploads\",\"d\":\"' || s || '\",\"p\":\"' || d.dag || '\"}}'), 1, 16) AS plan_id FROM dags d, (SELECT unnest(['1', '2', '3']) AS s)")
def upload_plans(spark, sf):
    """Recipes that are uploaded as files, planned for three datasets."""
    recipes = T.recipe_texts(spark)
    files = recipes.select(F.col("pipeline_id").alias("path"), F.encode("source", "UTF-8").alias("content"))
    hashed = identity.dag_hashes(recipes).select(F.col("pipeline_id").alias("key"), F.col("pipeline_dag_hash").alias("dag"))
    done = T.executions(spark, sf).where("seed = 2001").join(hashed, F.col("pipeline_dag_hash") == F.col("key")).select(F.col("dag").alias("pipeline_dag_hash"), "dataset_fingerprint", "execution_validity")
    return uploads.register(uploads.kinds(files), ["1", "2", "3"], done).select("path", "pipeline_dag_hash", "dataset_fingerprint", "status", "plan_id")
