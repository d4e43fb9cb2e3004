"""The registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import RUN_CONDITION, pseudonym
from ..operators import catalogue, facets, graphs, ingest, metrics, rankings, residuals, statistics
from ..sources import driver_tables as T
from . import registry
from .registry import query, rounded

SEL = "metric_name = 'rmse' AND score_scope = 'cv' AND score_validity = 'valid' AND execution_validity = 'valid'"
ALL = "metric_name = 'rmse' AND score_scope = 'cv' AND execution_validity = 'valid'"
NATIONS = ("FRANCE", "GERMANY", "INDIA")
MODELS = ("PLSRegression", "RandomForestRegressor", "Ridge", "SVR", "TabPFNRegressor")

_ROLES, _USED, _FACETS = "roles", "used", "facets"


def _pipes(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {"conditions": T.run_conditions(spark, sf), "datasets": T.datasets(spark, sf), "pipelines": T.pipelines(spark), "nodes": T.nodes(spark), "params": T.params(spark)}


def _facets(spark: SparkSession, sf: str) -> DataFrame:
    return facets.run_facets(**_pipes(spark, sf))


# Catalogue


_COUNTED = {
    "collections": "SELECT DISTINCT collection_id FROM executions", "datasets": "SELECT * FROM datasets", "domains": "SELECT DISTINCT domain FROM datasets", "executions": "SELECT * FROM executions", "metrics": "SELECT DISTINCT metric_name FROM observations",
    "nodes": "SELECT * FROM nodes", "observations": "SELECT * FROM observations", "operators": "SELECT DISTINCT operator FROM nodes", "parameters": "SELECT DISTINCT param_name, value_json FROM params", "pipelines": "SELECT * FROM pipelines",
    "residual_sets": "SELECT DISTINCT residual_set_id FROM residuals", "run_conditions": "SELECT * FROM run_conditions", "seeds": "SELECT DISTINCT seed FROM run_conditions", "valid_executions": "SELECT * FROM executions WHERE execution_validity = 'valid'",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS name, count(*) AS n FROM ({v})" for k, v in _COUNTED.items()))
def overview_counts(spark, sf):
    e, o, d, n, rc = T.executions(spark, sf), T.observations(spark, sf), T.datasets(spark, sf), T.nodes(spark), T.run_conditions(spark, sf)
    distinct = lambda df, *c: df.select(*c).distinct()
    return catalogue.overview(
        collections=distinct(e, "collection_id"), datasets=d, domains=distinct(d, "domain"), executions=e, metrics=distinct(o, "metric_name"), nodes=n, observations=o, operators=distinct(n, "operator"), parameters=distinct(T.params(spark), "param_name", "value_json"),
        pipelines=T.pipelines(spark), residual_sets=distinct(T.residuals(spark, sf), "residual_set_id"), run_conditions=rc, seeds=distinct(rc, "seed"), valid_executions=e.where("execution_validity = 'valid'"),
    )


@query("SELECT DISTINCT metric_name FROM observations")
def metrics_available(spark, sf):
    return catalogue.metrics_available(T.observations(spark, sf))


@query("SELECT d.*, (SELECT count(DISTINCT run_condition_hash) FROM run_conditions r WHERE r.dataset_fingerprint = d.dataset_fingerprint) AS n_run_conditions FROM datasets d")
def datasets_catalog(spark, sf):
    return catalogue.with_usage(T.datasets(spark, sf), T.run_conditions(spark, sf), "dataset_fingerprint")


@query("SELECT p.*, (SELECT count(DISTINCT run_condition_hash) FROM run_conditions r WHERE r.pipeline_dag_hash = p.pipeline_dag_hash) AS n_run_conditions FROM pipelines p")
def pipelines_catalog(spark, sf):
    return catalogue.with_usage(T.pipelines(spark), T.run_conditions(spark, sf), "pipeline_dag_hash")


_PAIRS = "SELECT pipeline_dag_hash, dataset_fingerprint, 'release' AS collection_id FROM pipelines CROSS JOIN datasets"


def _targets(spark, sf):
    """Every pipeline on every dataset: 25 of either, of a fixed size."""
    each = F.explode(F.array(*[F.lit(str(i)) for i in range(25)])).alias("dataset_fingerprint")
    return T.pipelines(spark).select("pipeline_dag_hash", each, F.lit("release").alias("collection_id"))


@query(f"""SELECT pipeline_dag_hash, dataset_fingerprint, collection_id, CASE WHEN EXISTS (SELECT 1 FROM executions e WHERE execution_validity = 'valid' AND e.pipeline_dag_hash = p.pipeline_dag_hash AND e.dataset_fingerprint = p.dataset_fingerprint) THEN 'already_run' ELSE 'planned' END AS status,
    'plan_' || substr(sha256('{{"c":"' || collection_id || '","d":"' || dataset_fingerprint || '","p":"' || pipeline_dag_hash || '"}}'), 1, 16) AS plan_id FROM ({_PAIRS}) p""")
def plan_or_display(spark, sf):
    return ingest.plan(_targets(spark, sf), T.executions(spark, sf))


@query("SELECT execution_hash, run_condition_hash, label, dataset_name, score_scope, score_validity, metric_name, fold_id, round(metric_value, 6) AS metric_value FROM backbone WHERE execution_hash = 'e7'")
def run_scores_detail(spark, sf):
    return rounded(catalogue.run_scores(T.backbone(spark, sf), "e7"))


@query("SELECT fold_id, \"partition\", score_scope, round(metric_value, 6) AS metric_value FROM backbone WHERE execution_hash = 'e7' AND metric_name = 'rmse' AND score_validity = 'valid'")
def fold_scores(spark, sf):
    return rounded(catalogue.fold_scores(T.backbone(spark, sf), "e7", "rmse"))


# Rankings


def _board(metric: str, direction: str, where: str, limit: str = "LIMIT 200") -> str:
    return f"""SELECT run_condition_hash, pipeline_dag_hash, dataset_fingerprint, label, dataset_name, round(mean_score, 6) AS mean_score, round(min_score, 6) AS min_score, round(max_score, 6) AS max_score, n_obs, rank FROM (
        SELECT *, row_number() OVER (ORDER BY mean_score {direction} NULLS LAST, run_condition_hash) AS rank FROM (
            SELECT run_condition_hash, pipeline_dag_hash, dataset_fingerprint, min(label) AS label, min(dataset_name) AS dataset_name, avg(metric_value) AS mean_score, min(metric_value) AS min_score, max(metric_value) AS max_score, count(*) AS n_obs
            FROM backbone WHERE metric_name = '{metric}' AND score_scope = 'cv' AND score_validity = 'valid' AND {where} GROUP BY ALL)) ORDER BY rank {limit}"""


@query(_board("rmse", "ASC", "execution_validity = 'valid'"))
def leaderboard_min(spark, sf):
    return rounded(rankings.leaderboard(T.backbone(spark, sf)))


@query(_board("r2", "DESC", "execution_validity = 'valid'"))
def leaderboard_max(spark, sf):
    return rounded(rankings.leaderboard(T.backbone(spark, sf), "r2"))


@query(_board("rmse", "ASC", "collection_id = 'release' AND \"partition\" = 'validation'"))
def leaderboard_filtered(spark, sf):
    return rounded(rankings.leaderboard(T.backbone(spark, sf), quarantined=True, collection_id="release", partition="validation"))


@query(_board("rmse", "ASC", "execution_validity = 'valid'", ""))
def leaderboard_whole(spark, sf):
    return rounded(rankings.leaderboard(T.backbone(spark, sf), limit=None))


@query(f"SELECT pipeline_dag_hash, dataset_fingerprint, round(avg(metric_value), 6) AS mean_score, count(DISTINCT execution_hash) AS n_runs FROM backbone WHERE {SEL} GROUP BY ALL")
def matrix_cells(spark, sf):
    return rounded(rankings.matrix_cells(T.backbone(spark, sf)))


@query("SELECT pipeline_dag_hash, " + ", ".join(f"round(avg(CASE WHEN dataset_name = '{n}' THEN metric_value END), 6) AS \"{n}\"" for n in NATIONS) + f" FROM backbone WHERE {SEL} GROUP BY pipeline_dag_hash")
def matrix_wide(spark, sf):
    return rounded(rankings.matrix_wide(T.backbone(spark, sf), list(NATIONS)))


def _explorer(where: str) -> str:
    return f"SELECT execution_hash, run_condition_hash, pipeline_dag_hash, dataset_fingerprint, execution_validity, round(avg(metric_value), 6) AS score FROM backbone b WHERE metric_name = 'rmse' AND score_scope = 'cv' AND score_validity = 'valid' AND {where} GROUP BY ALL ORDER BY avg(metric_value), execution_hash LIMIT 500"


@query(_explorer("true"))
def run_explorer(spark, sf):
    return rounded(rankings.run_explorer(T.backbone(spark, sf), T.nodes(spark)))


@query(_explorer("EXISTS (SELECT 1 FROM nodes n WHERE n.operator = 'sklearn.svm.SVR' AND n.pipeline_dag_hash = b.pipeline_dag_hash)"))
def run_explorer_operator(spark, sf):
    return rounded(rankings.run_explorer(T.backbone(spark, sf), T.nodes(spark), operator="sklearn.svm.SVR"))


@query(f"SELECT operator, max(role) AS role, count(metric_value) AS n, round(avg(metric_value), 6) AS mean, round(stddev_pop(metric_value), 6) AS std, round(median(metric_value), 6) AS median, round(min(metric_value), 6) AS min, round(max(metric_value), 6) AS max FROM backbone JOIN {_USED} u USING (pipeline_dag_hash) WHERE {ALL} GROUP BY operator")
def operator_effect(spark, sf):
    return rounded(rankings.operator_effect(T.backbone(spark, sf), T.nodes(spark)))


@query(f"SELECT execution_hash, dataset_fingerprint, fold_id, CASE WHEN is_numeric = 1 THEN numeric_value END AS value_num, CASE WHEN is_numeric <> 1 THEN value_json END AS value_label, round(metric_value, 6) AS score FROM backbone JOIN params USING (pipeline_dag_hash) WHERE param_name = 'n_components' AND {ALL}")
def parameter_effect(spark, sf):
    return rounded(rankings.parameter_effect(T.backbone(spark, sf), T.params(spark), "n_components"))


@query(f"SELECT dataset_fingerprint, value_json AS value, count(*) AS n, round(avg(metric_value), 6) AS mean FROM backbone JOIN params USING (pipeline_dag_hash) WHERE param_name = 'kernel' AND {ALL} GROUP BY ALL")
def parameter_trend(spark, sf):
    return rounded(rankings.parameter_trend(T.backbone(spark, sf), T.params(spark), "kernel"))


@query(f"SELECT pipeline_dag_hash, dataset_fingerprint, count(metric_value) AS n, round(avg(metric_value), 6) AS mean, round(stddev_pop(metric_value), 6) AS std, round(coalesce(stddev_pop(metric_value) / nullif(avg(metric_value), 0) * 100, 0), 6) AS cv_pct FROM backbone WHERE {ALL} GROUP BY ALL")
def robustness(spark, sf):
    return rounded(rankings.robustness(T.backbone(spark, sf)))


@query(f"SELECT dataset_fingerprint, run_condition_hash, round(mean_score, 6) AS mean_score FROM (SELECT *, row_number() OVER (PARTITION BY dataset_fingerprint ORDER BY mean_score, run_condition_hash) AS rn FROM (SELECT dataset_fingerprint, run_condition_hash, avg(metric_value) AS mean_score FROM backbone WHERE {SEL} GROUP BY ALL)) WHERE rn = 1")
def best_per_dataset(spark, sf):
    return rounded(rankings.best_per_dataset(T.backbone(spark, sf)))


# Facets

@query(f"SELECT * FROM {_FACETS}")
def run_facets(spark, sf):
    return _facets(spark, sf)


@query(f"SELECT facet_key, count(DISTINCT facet_value) AS n_values, max(facet_role) AS role, max(CAST(facet_num IS NOT NULL AS INTEGER)) AS is_numeric FROM {_FACETS} GROUP BY facet_key HAVING count(DISTINCT facet_value) > 1 OR facet_key LIKE 'param:%'")
def facets_index(spark, sf):
    return facets.index(_facets(spark, sf))


@query(f"SELECT facet_value, max(facet_num) AS facet_num, count(*) AS n FROM {_FACETS} WHERE facet_key = 'param:n_components' GROUP BY facet_value")
def facet_values(spark, sf):
    return facets.values(_facets(spark, sf), "param:n_components")


def _pivot(key: str, color: str | None, score: str = "avg") -> str:
    one = lambda k, v: f"(SELECT run_condition_hash, facet_value AS {v}, facet_num AS num FROM {_FACETS} WHERE facet_key = '{k}')"
    join = f" JOIN {one(color, 'color')[:-1].replace(', facet_num AS num', '')}) USING (run_condition_hash)" if color else ""
    return f"SELECT value, num, {'color, ' if color else ''}round({score}(metric_value), 6) AS score, round(min(metric_value), 6) AS min, round(max(metric_value), 6) AS max, count(DISTINCT execution_hash) AS n_runs FROM backbone JOIN {one(key, 'value')} USING (run_condition_hash){join} WHERE {SEL} GROUP BY ALL"


@query(_pivot("model", None))
def pivot_one(spark, sf):
    return rounded(facets.pivot(T.backbone(spark, sf), _facets(spark, sf), "model"))


@query(_pivot("operator", "domain"))
def pivot_two(spark, sf):
    return rounded(facets.pivot(T.backbone(spark, sf), _facets(spark, sf), "operator", "domain"))


@query(_pivot("seed", None, "median"))
def pivot_numeric(spark, sf):
    return rounded(facets.pivot(T.backbone(spark, sf), _facets(spark, sf), "seed", agg="median"))


@query(f"SELECT execution_hash, run_condition_hash, round(score, 6) AS score, " + ", ".join(f"(SELECT min(facet_value) FROM facets f WHERE f.run_condition_hash = s.run_condition_hash AND facet_key = '{k}') AS {k}" for k in ("model", "domain", "seed")) + f" FROM (SELECT execution_hash, run_condition_hash, avg(metric_value) AS score FROM backbone WHERE {SEL} GROUP BY ALL) s")
def parallel_coordinates(spark, sf):
    return rounded(facets.parallel(T.backbone(spark, sf), _facets(spark, sf), ["model", "domain", "seed"]))


# Statistics and graphs

_EXEC = f"(SELECT execution_hash, run_condition_hash, dataset_fingerprint, avg(metric_value) AS score FROM backbone WHERE {SEL} GROUP BY ALL)"
_STATS = "count(score) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(stddev_pop(score), 6) AS std, round(min(score), 6) AS min, round(max(score), 6) AS max, round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.75), 6) AS p75"


@query(f"SELECT {_STATS} FROM {_EXEC}")
def stats_summary(spark, sf):
    return rounded(statistics.summary(T.backbone(spark, sf)))


@query(f"SELECT dataset_fingerprint, {_STATS} FROM {_EXEC} GROUP BY dataset_fingerprint")
def stats_by_dataset(spark, sf):
    return rounded(statistics.summary(T.backbone(spark, sf), by="dataset_fingerprint"))


@query(f"SELECT facet_key, n, round(r, 6) AS r FROM (SELECT facet_key, count(*) AS n, covar_pop(facet_num, score) / nullif(stddev_pop(facet_num) * stddev_pop(score), 0) AS r FROM {_EXEC} JOIN {_FACETS} USING (run_condition_hash) WHERE facet_num IS NOT NULL GROUP BY facet_key) WHERE n >= 4 AND r IS NOT NULL")
def stats_correlations(spark, sf):
    return rounded(statistics.correlations(T.backbone(spark, sf), _facets(spark, sf)))


@query(f"SELECT least(coalesce(CAST(floor((score - lo) * 28 / nullif(hi - lo, 0)) AS BIGINT), 0), 27) AS bin, count(*) AS n FROM {_EXEC}, (SELECT min(score) AS lo, max(score) AS hi FROM {_EXEC}) GROUP BY 1")
def metric_histogram(spark, sf):
    return statistics.histogram(T.backbone(spark, sf))


@query(f"SELECT x, " + ", ".join(f"round(avg(CASE WHEN y = '{m}' THEN metric_value END), 6) AS \"{m}\"" for m in MODELS) + f" FROM backbone JOIN (SELECT run_condition_hash, facet_value AS x FROM {_FACETS} WHERE facet_key = 'domain') USING (run_condition_hash) JOIN (SELECT run_condition_hash, facet_value AS y FROM {_FACETS} WHERE facet_key = 'model') USING (run_condition_hash) WHERE {SEL} GROUP BY x")
def surface_grid(spark, sf):
    return rounded(statistics.surface(T.backbone(spark, sf), _facets(spark, sf), "domain", "model", list(MODELS)))


@query(f"SELECT pipeline_dag_hash, min(label) AS label, split_part(min(main_model), '.', -1) AS cluster, round(avg(metric_value), 6) AS score, count(DISTINCT execution_hash) AS n_runs FROM backbone WHERE {SEL} GROUP BY pipeline_dag_hash")
def pipeline_graph_nodes(spark, sf):
    return rounded(graphs.pipeline_nodes(T.backbone(spark, sf)))


@query(f"SELECT a.pipeline_dag_hash AS source, b.pipeline_dag_hash AS target, round_even(len(list_intersect(a.ops, b.ops))::DOUBLE / len(list_distinct(list_concat(a.ops, b.ops))), 3) AS weight FROM (SELECT pipeline_dag_hash, list(DISTINCT leaf) AS ops FROM {_USED} WHERE pipeline_dag_hash IN (SELECT pipeline_dag_hash FROM backbone WHERE {SEL}) GROUP BY 1) a JOIN (SELECT pipeline_dag_hash, list(DISTINCT leaf) AS ops FROM {_USED} WHERE pipeline_dag_hash IN (SELECT pipeline_dag_hash FROM backbone WHERE {SEL}) GROUP BY 1) b ON a.pipeline_dag_hash < b.pipeline_dag_hash WHERE len(list_intersect(a.ops, b.ops)) >= 0.34 * len(list_distinct(list_concat(a.ops, b.ops)))")
def pipeline_graph_edges(spark, sf):
    return graphs.pipeline_edges(graphs.pipeline_nodes(T.backbone(spark, sf)), T.nodes(spark))


_OPS = f"SELECT operator, max(role) AS role, count(DISTINCT pipeline_dag_hash) AS n_pipelines, count(DISTINCT execution_hash) AS n_runs, avg(metric_value) AS score FROM backbone JOIN {_USED} u USING (pipeline_dag_hash) WHERE {SEL} GROUP BY operator"


@query(f"SELECT operator, role, n_pipelines, n_runs, round(score, 6) AS score FROM ({_OPS})")
def operator_graph_nodes(spark, sf):
    return rounded(graphs.operator_nodes(T.backbone(spark, sf), T.nodes(spark)))


@query(f"SELECT operator, role, n_pipelines, n_runs, round(score, 6) AS score FROM ({_OPS})")
def composition(spark, sf):
    return rounded(graphs.composition(T.backbone(spark, sf), T.nodes(spark)))


@query(f"SELECT role, operator, CAST(sum(n_runs) AS BIGINT) AS n_runs, round(sum(greatest(n_runs, 1) * score) / sum(greatest(n_runs, 1)), 6) AS score FROM ({_OPS}) GROUP BY ROLLUP (role, operator) HAVING role IS NOT NULL")
def composition_rollup(spark, sf):
    return rounded(graphs.composition_rollup(T.backbone(spark, sf), T.nodes(spark)))


# Residuals and metrics


@query("SELECT residual_set_id, scope, fold_id, \"partition\", sample_id, round(y_true, 6) AS y_true, round(y_pred, 6) AS y_pred FROM residuals WHERE residual_set_id = 'O|A' AND \"partition\" = 'validation'")
def residuals_scan(spark, sf):
    return rounded(residuals.scan(T.residuals(spark, sf), "O|A", "validation"))


_PAIRED = " JOIN ".join(f"(SELECT sample_id, arg_max(residual, row(ts, event_id)) AS residual_{s} FROM event_residuals WHERE execution_hash = '{e}' GROUP BY sample_id) {s}" for s, e in (("a", "click"), ("b", "view"))) + " USING (sample_id)"


@query(f"SELECT sample_id, round(residual_a, 6) AS residual_a, round(residual_b, 6) AS residual_b FROM {_PAIRED}")
def residual_pairs(spark, sf):
    return rounded(residuals.paired(T.event_residuals(spark, sf), "click", "view"))


@query(f"SELECT count(*) AS n_common, count(residual_a + residual_b) AS n_paired, round(covar_pop(residual_a, residual_b) / nullif(stddev_pop(residual_a) * stddev_pop(residual_b), 0), 6) AS r, round(sqrt(avg(residual_a * residual_a)), 6) AS rmse_a, round(sqrt(avg(residual_b * residual_b)), 6) AS rmse_b, round(max(greatest(abs(residual_a), abs(residual_b))), 6) AS span FROM {_PAIRED}")
def residual_compare(spark, sf):
    return rounded(residuals.compare(residuals.paired(T.event_residuals(spark, sf), "click", "view")))


_REG = """SELECT residual_set_id, scope, fold_id, "partition", count(*) AS n_samples, 1.0::DOUBLE AS coverage, avg((y_true - y_pred) ** 2) AS mse, avg(abs(y_true - y_pred)) AS mae, median(abs(y_true - y_pred)) AS medae, avg(y_true - y_pred) AS bias,
    var_pop(y_true) AS vt, var_pop(y_pred) AS vp, covar_pop(y_true, y_pred) AS cov, avg(y_true) - avg(y_pred) AS gap, quantile_cont(y_true, 0.75) - quantile_cont(y_true, 0.25) AS iqr FROM residuals GROUP BY ALL"""
#: Large values are compared by the logarithm.
_REG_ROWS = " UNION ALL ".join(f"SELECT residual_set_id, scope, fold_id, \"partition\", n_samples, coverage, '{n}' AS metric_name, '{'min' if rankings.ascending(n) else 'max'}' AS direction, round(asinh({e}), 6) AS metric_value FROM ({_REG}) WHERE ({e}) IS NOT NULL" for n, e in {
    "mse": "mse", "rmse": "sqrt(mse)", "mae": "mae", "medae": "medae", "bias": "bias", "r2": "1 - mse / nullif(vt, 0)", "rpd": "sqrt(vt) / nullif(sqrt(mse), 0)", "rpiq": "iqr / nullif(sqrt(mse), 0)", "ccc": "2 * cov / nullif(vt + vp + gap * gap, 0)",
}.items())


@query(_REG_ROWS)
def regression_metrics(spark, sf):
    return rounded(metrics.recompute(T.residuals(spark, sf)).withColumn("metric_value", F.asinh("metric_value")))


def _labels(spark, sf):
    return T.table(spark, sf, "labels").select(F.col("quality").cast("long").alias("y_true"), F.col("toxic").cast("long").alias("y_pred"), F.lit("labels").alias("name"), "doc_id")


@query("SELECT 'labels' AS name, t.y AS y_true, p.y AS y_pred, (SELECT count(*) FROM labels WHERE quality = t.y AND toxic = p.y) AS n FROM (SELECT DISTINCT unnest([quality, toxic])::BIGINT AS y FROM labels) t, (SELECT DISTINCT unnest([quality, toxic])::BIGINT AS y FROM labels) p", views=False)
def confusion_matrix(spark, sf):
    return metrics.confusion(_labels(spark, sf), ["name"])


_CLASS = """WITH k AS (SELECT y, count(*) FILTER (quality = y)::DOUBLE AS t, count(*) FILTER (toxic = y)::DOUBLE AS p, count(*) FILTER (quality = y AND toxic = y)::DOUBLE AS tp FROM labels, (SELECT DISTINCT unnest([quality, toxic]) AS y FROM labels) GROUP BY y),
    g AS (SELECT sum(t)::BIGINT AS n_samples, sum(tp) / sum(t) AS accuracy, avg(coalesce(tp / nullif(p, 0), 0)) AS precision_macro, avg(coalesce(tp / nullif(t, 0), 0)) AS recall_macro, avg(coalesce(2 * tp / nullif(t + p, 0), 0)) AS f1_macro, avg(coalesce(tp / nullif(t, 0), 0)) AS balanced_accuracy,
    (sum(tp) * sum(t) - sum(t * p)) / nullif(sqrt((sum(t) ** 2 - sum(p * p)) * (sum(t) ** 2 - sum(t * t))), 0) AS mcc FROM k)"""


@query(_CLASS + " UNION ALL ".join(f" SELECT 'labels' AS name, n_samples, '{n}' AS metric_name, round({n}, 6) AS metric_value FROM g WHERE {n} IS NOT NULL" for n in ("accuracy", "precision_macro", "recall_macro", "f1_macro", "balanced_accuracy", "mcc")), views=False)
def classification_metrics(spark, sf):
    return rounded(metrics.classification(_labels(spark, sf), ["name"]))


@query("""WITH e AS (SELECT label, list_transform(embedding[1:10], lambda x: exp(x::DOUBLE)) AS p FROM embeddings), l AS (SELECT list_sort(list(DISTINCT label)) AS ls FROM embeddings)
    SELECT 'embeddings' AS name, round(avg(-ln(least(greatest(p[list_position(ls, label)] / list_sum(p), 1e-15::DOUBLE), 1 - 1e-15::DOUBLE))), 6) AS log_loss FROM e, l""", views=False)
def log_loss(spark, sf):
    e = T.table(spark, sf, "embeddings").select(F.col("label").alias("y_true"), F.transform(F.slice("embedding", 1, 10), lambda x: F.exp(x.cast("double"))).alias("x"), F.lit("embeddings").alias("name"))
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    return rounded(metrics.log_loss(e.select("name", "y_true", F.transform("x", lambda v: v / total).alias("y_proba")), ["name"]))


@query("""WITH r AS (SELECT quality AS y, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS rk FROM labels JOIN documents USING (doc_id))
    SELECT 'labels' AS name, round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))), 6) AS roc_auc FROM r""", views=False)
def roc_auc(spark, sf):
    rows = _labels(spark, sf).join(T.table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 1e9).alias("score")), "doc_id")
    return rounded(metrics.roc_auc(rows, ["name"]))


# Identity and ingestion


@query("SELECT c_custkey, 's_' || substr(sha256('salt' || c_name), 1, 16) AS pseudonym FROM customer", views=False)
def pseudonymized_ids(spark, sf):
    return T.table(spark, sf, "customer").select("c_custkey", pseudonym("salt", F.col("c_name")).alias("pseudonym"))


_PARTS = {"dataset_variant_hash": "sha256(dataset_fingerprint)", "pipeline_dag_hash": "sha256(pipeline_dag_hash)", "rng_context_hash": "sha256(CAST(seed AS VARCHAR))"}
_COMPONENTS = " || ',' || ".join(f"'[\"{c}\",\"' || {_PARTS.get(c, f'sha256({chr(39)}{c}{chr(39)})')} || '\"]'" for c in RUN_CONDITION)


@query(f"SELECT run_condition_hash AS run_key, sha256('{{\"components\":[' || {_COMPONENTS} || '],\"kind\":\"run_condition\",\"v\":1}}') AS run_condition_hash FROM run_conditions")
def run_condition_hash(spark, sf):
    return ingest.with_condition_hash(T.condition_parts(spark, sf)).select("run_key", "run_condition_hash")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'A') n WHERE NOT EXISTS (SELECT 1 FROM lineitem e WHERE l_returnflag = 'A' AND e.l_orderkey = n.l_orderkey AND e.l_linenumber = n.l_linenumber)", views=False)
def dedup_upsert(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    old = F.col("l_returnflag") == "A"
    return ingest.upsert(li.where(~old).drop("l_returnflag"), li.where(old), ["l_orderkey", "l_linenumber"])


@query("SELECT execution_hash, scope, seq, CASE WHEN row_number() OVER (PARTITION BY execution_hash, scope ORDER BY seq DESC) = 1 THEN 'valid' ELSE 'superseded' END AS validity FROM (SELECT user_id AS execution_hash, event_type AS scope, event_id AS seq FROM events)", views=False)
def supersede_latest(spark, sf):
    return ingest.superseded(T.table(spark, sf, "events").selectExpr("user_id AS execution_hash", "event_type AS scope", "event_id AS seq"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 OR o_orderpriority = '5-LOW' OR o_orderkey % 20 > o_custkey % 40 THEN 'rejected' WHEN o_orderkey % 7 = 0 THEN 'quarantined' ELSE 'committed' END AS status,
    CAST(CAST(o_custkey % 11 = 0 AS INTEGER) + CAST(o_orderpriority = '5-LOW' AS INTEGER) + CAST(o_orderkey % 20 > o_custkey % 40 AS INTEGER) + CAST(o_orderkey % 7 = 0 AS INTEGER) + CAST(o_orderkey % 3 = 0 AS INTEGER) AS INTEGER) AS n_issues FROM orders""", views=False)
def validate_manifests(spark, sf):
    o = T.table(spark, sf, "orders")
    m = o.select(
        "o_orderkey", F.lit(1).alias("schema_version"), F.when(F.col("o_custkey") % 11 == 0, "none").otherwise(F.sha2(F.col("o_custkey").cast("string"), 256)).alias("dataset_fingerprint"),
        F.when(F.col("o_orderpriority") == "5-LOW", "ranking").otherwise("regression").alias("task_type"), (F.col("o_orderkey") % 20).alias("n_folds"), (F.col("o_custkey") % 40).alias("n_samples"), (F.col("o_orderkey") % 3).alias("n_observations"),
        (F.col("o_orderkey") % 7 != 0).alias("oof_enforced"), F.array().cast("array<string>").alias("unsafe_flags"), F.lit("sample_id").alias("residual_key"),
    )
    return ingest.verify(m).select("o_orderkey", "status", F.size("issues").alias("n_issues"))


from . import ingestion, pipelines, stored, uploads, views  # noqa: E402, F401  (they register their queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return registry.composed()
