"""The whole path: manifests made of orders are ingested into a store, whose tables the queries read.

All queries of a session and folder share one store, which is made in the shared scratch folder when the first one asks for it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.roles import classify_sql
from ..operators import batches, facets, rankings, statistics, views
from ..sources import driver_manifests, manifests
from ..sources.scratch import folder
from ..sources.store import Store
from .registry import query, rounded

_made: dict[tuple[str, str], str] = {}
_VIEWS = driver_manifests.sql_views()
_CV = "metric_name = 'rmse' AND score_scope = 'cv' AND attested"


def store(spark: SparkSession, sf: str) -> Store:
    """The store of all orders' manifests, taken in as a release that keeps runs without attestation apart."""
    key = spark.sparkContext.applicationId, sf
    if key not in _made:
        root = f"{folder(spark)}/orders-{uuid.uuid4().hex}"
        batches.ingest(batches.open_store(spark, root), manifests.fields(driver_manifests.manifest_texts(spark, sf)), batches.Policy("orders", salt="salt", release=True))
        _made[key] = root
    return batches.open_store(spark, _made[key])


def _as_sql(body: str) -> str:
    return f"{_VIEWS}\n{body}"


@query(_as_sql(f"SELECT label, dataset_name, year, round(avg(metric_value), 6) AS mean_score, round(min(metric_value), 6) AS min_score, round(max(metric_value), 6) AS max_score, count(*) AS n_obs FROM s WHERE {_CV} GROUP BY ALL"), views=False)
def store_leaderboard(spark, sf) -> DataFrame:
    s = store(spark, sf)
    board = rankings.leaderboard(batches.scores(s), limit=None, of=batches.named_conditions(s))
    seeds = batches.conditions(s).select("run_condition_hash", F.col("seed").alias("year"))
    return rounded(board.join(seeds, "run_condition_hash").select("label", "dataset_name", "year", "mean_score", "min_score", "max_score", "n_obs"))


@query(_as_sql(f"SELECT label, dataset_name, round(avg(metric_value), 6) AS mean_score, count(DISTINCT o_orderkey) AS n_runs FROM s WHERE {_CV} GROUP BY ALL"), views=False)
def store_matrix(spark, sf) -> DataFrame:
    s = store(spark, sf)
    cells = rankings.matrix_cells(batches.scores(s))
    names = s.read("pipeline_dags").select("pipeline_dag_hash", "label")
    return rounded(cells.join(names, "pipeline_dag_hash").join(batches.datasets(s), "dataset_fingerprint").select("label", "dataset_name", "mean_score", "n_runs"))


@query(_as_sql(f"SELECT operator, max({classify_sql('operator', 'kind')}) AS role, count(*) AS n, round(avg(metric_value), 6) AS mean, round(median(metric_value), 6) AS median, round(min(metric_value), 6) AS min, round(max(metric_value), 6) AS max FROM s JOIN nodes USING (label) WHERE {_CV} AND kind <> 'input' GROUP BY operator"), views=False)
def store_operator_effect(spark, sf) -> DataFrame:
    s = store(spark, sf)
    return rounded(rankings.operator_effect(batches.scores(s), s.read("pipeline_nodes")).select("operator", "role", "n", "mean", "median", "min", "max"))


@query(_as_sql(f"SELECT CAST(2 * n AS DOUBLE) AS value_num, dataset_name, count(*) AS n, round(avg(metric_value), 6) AS mean FROM s WHERE {_CV} GROUP BY ALL"), views=False)
def store_parameter_effect(spark, sf) -> DataFrame:
    s = store(spark, sf)
    points = rankings.parameter_effect(batches.scores(s), batches.params(s), "n_components").join(batches.datasets(s), "dataset_fingerprint")
    return rounded(points.groupBy("value_num", "dataset_name").agg(F.count("*").alias("n"), F.avg("score").alias("mean")))


@query(_as_sql(f"SELECT cv_method AS value, CAST(2 * n AS VARCHAR) AS color, round(avg(metric_value), 6) AS score, round(min(metric_value), 6) AS min, round(max(metric_value), 6) AS max, count(DISTINCT o_orderkey) AS n_runs FROM s WHERE {_CV} GROUP BY ALL"), views=False)
def store_pivot(spark, sf) -> DataFrame:
    s = store(spark, sf)
    return rounded(facets.pivot(batches.scores(s), s.read("run_facets"), "cv_method", "param:n_components").select("value", "color", "score", "min", "max", "n_runs"))


_CONDITIONS = "(SELECT DISTINCT label, dataset_name, domain, year, n, segment, priority, split_method, cv_method FROM o)"
_COUNTS = f"SELECT label, count(*) FILTER (role = 'preprocessing') AS pre, count(*) FILTER (role = 'scaler') AS sc FROM (SELECT label, {classify_sql('operator', 'kind')} AS role FROM nodes) GROUP BY label"
_FACETS = [("dataset", "dataset_name", "NULL"), ("domain", "domain", "NULL"), ("seed", "year", "year"), ("task_type", "'regression'", "NULL"), ("split_method", "split_method", "NULL"), ("cv_method", "cv_method", "NULL"), ("n_folds", "CASE cv_method WHEN 'kfold' THEN 5 ELSE 10 END", "CASE cv_method WHEN 'kfold' THEN 5 ELSE 10 END"), ("pipeline", "label", "NULL"), ("is_linear", "'branching'", "NULL"), ("n_preprocessing", "pre", "pre"), ("has_scaler", "CASE WHEN sc > 0 THEN 'yes' ELSE 'no' END", "NULL"), ("param:n_components", "2 * n", "2 * n"), ("param:kernel", "lower(segment)", "NULL")]


@query(_as_sql("SELECT facet_key, facet_value, facet_num, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS facet_key, CAST({v} AS VARCHAR) AS facet_value, CAST({x} AS DOUBLE) AS facet_num FROM {_CONDITIONS} JOIN ({_COUNTS}) USING (label)" for k, v, x in _FACETS) + ") GROUP BY ALL"), views=False)
def store_facets(spark, sf) -> DataFrame:
    """How many of the conditions have each value of a facet."""
    rows = store(spark, sf).read("run_facets").where(F.col("facet_key").isin(*[k for k, *_ in _FACETS]))
    return rows.groupBy("facet_key", "facet_value", "facet_num").agg(F.count("*").alias("n"))


@query(_as_sql(f"SELECT domain, count(*) AS n, round(avg(score), 6) AS mean, round(min(score), 6) AS min, round(max(score), 6) AS max FROM (SELECT o_orderkey, domain, avg(metric_value) AS score FROM s WHERE {_CV} GROUP BY ALL) GROUP BY domain"), views=False)
def store_scores_by_domain(spark, sf) -> DataFrame:
    s = store(spark, sf)
    scores = statistics.execution_scores(batches.scores(s).withColumn("execution_hash", F.unhex("execution_hash")), of=("domain",))  # half a text's bytes to shuffle
    return rounded(scores.groupBy("domain").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.min("score").alias("min"), F.max("score").alias("max")))


@query(_as_sql("""SELECT 'datasets' AS name, count(DISTINCT dataset_name) AS n FROM o UNION ALL SELECT 'dataset_cards', count(DISTINCT dataset_name) FROM o UNION ALL SELECT 'tasks', count(DISTINCT dataset_name) FROM o UNION ALL SELECT 'pipelines', count(DISTINCT label) FROM o
    UNION ALL SELECT 'operators', count(*) FROM (SELECT DISTINCT operator, kind FROM nodes) UNION ALL SELECT 'parameters', count(*) FROM (SELECT DISTINCT 'n', CAST(2 * n AS VARCHAR) FROM o UNION SELECT 'k', segment FROM o UNION SELECT 'w', CAST(i AS VARCHAR) FROM (SELECT unnest(range(1, n + 1)) AS i FROM o) UNION SELECT 'c', CAST(i % 2 AS VARCHAR) FROM (SELECT unnest(range(1, n + 1)) AS i FROM o))
    UNION ALL SELECT 'run_conditions', count(*) FROM (SELECT DISTINCT label, dataset_name, year FROM o) UNION ALL SELECT 'executions', count(*) FROM o UNION ALL SELECT 'valid_executions', count(*) FROM o WHERE attested UNION ALL SELECT 'quarantined_executions', count(*) FROM o WHERE NOT attested
    UNION ALL SELECT 'score_sets', count(*) FROM (SELECT DISTINCT o_orderkey, score_scope FROM s) UNION ALL SELECT 'metric_observations', count(*) FROM s UNION ALL SELECT 'residual_sets', 0 UNION ALL SELECT 'collections', 1 UNION ALL SELECT 'metrics', count(DISTINCT metric_name) FROM s"""), views=False)
def store_overview(spark, sf) -> DataFrame:
    return batches.overview(store(spark, sf))


_ONE = "(SELECT * FROM o WHERE o_orderkey = (SELECT min(o_orderkey) FROM o))"


@query(_as_sql(f"SELECT 'e' || o_orderkey AS execution_id, label, dataset_name, year AS seed, cv_method, CASE cv_method WHEN 'kfold' THEN 5 ELSE 10 END AS n_folds, (SELECT count(*) FROM nodes WHERE nodes.label = o.label) AS n_nodes, CASE WHEN n % 2 = 1 THEN n + 1 ELSE 2 * n + 1 END AS n_edges, 2 * n + 2 AS n_params, (SELECT round(sum(metric_value), 4) FROM s WHERE s.o_orderkey = o.o_orderkey) AS total FROM {_ONE} o"), views=False)
def store_run_detail(spark, sf) -> DataFrame:
    """Everything about the run with the least order key."""
    s = store(spark, sf)
    of = batches.executions(s).join(batches.conditions(s).select("run_condition_hash", "seed"), "run_condition_hash")
    first = of.agg(F.min_by("execution_hash", F.substring("execution_id", 2, 20).cast("long"))).first()[0]
    row = views.run_detail(first, of, batches.conditions(s).select("run_condition_hash", "pipeline_dag_hash", "dataset_fingerprint", "seed", "cv_method", "n_folds"), s.read("pipeline_dags").drop("n_nodes"), batches.datasets(s).select("dataset_fingerprint", "dataset_name"), s.read("pipeline_nodes"), batches.params(s), batches.scores(s), s.read("pipeline_edges"))
    total = F.aggregate("scores", F.lit(0.0), lambda n, x: n + x["metric_value"])
    return rounded(row.select("execution_id", "label", "dataset_name", "seed", "cv_method", "n_folds", F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"), F.size("params").alias("n_params"), total.alias("total")), 4)
