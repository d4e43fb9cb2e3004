"""Queries by name, with the SQL that gives the same rows, over views that each query's SQL computes once."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.roles import classify_sql
from ..sources import driver_tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, tuple[str, bool]] = {}


def query(sql: str | None = None, views: bool = True):
    """Registers a query under its name, with its SQL over the common views."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql, views
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on the order of rows: results are compared without their last digits."""
    return df.select(*[F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def _facet_sql() -> str:
    plain = lambda key, value, num="NULL", role="condition": f"SELECT pipeline_dag_hash, '{key}' AS facet_key, CAST({value} AS VARCHAR) AS facet_value, CAST({num} AS DOUBLE) AS facet_num, '{role}' AS facet_role FROM counts"
    yes = lambda c: f"CASE WHEN {c} > 0 THEN 'yes' ELSE 'no' END"
    parts = [plain("pipeline", "label"), plain("is_linear", "CASE WHEN is_linear = 1 THEN 'linear' ELSE 'branching' END"), plain("n_stages", "stages", "stages")]
    parts += [plain(k, "split_part(main_model, '.', -1)", role="model") for k in ("model", "model_family")]
    parts += [plain(f"n_{r}{s}", r, r, r) for r, s in (("model", "s"), ("preprocessing", ""), ("augmentation", ""))]
    parts += [plain(f"has_{r}", yes(r), role=r) for r in ("augmentation", "scaler", "feature_selection")]
    parts += [f"SELECT pipeline_dag_hash, {key}, leaf, NULL, role FROM used WHERE {where}" for key, where in (("role || '_op'", "true"), ("'operator'", "true"), ("'merge_strategy'", "role = 'merge'"))]
    parts.append("SELECT pipeline_dag_hash, 'param:' || param_name, CASE value_json WHEN 'true' THEN 'True' WHEN 'false' THEN 'False' ELSE trim(value_json, '\"') END, numeric_value, 'param' FROM params")
    own = " UNION ALL ".join(parts)
    cond = " UNION ALL ".join(f"SELECT run_condition_hash, '{k}', CAST({v} AS VARCHAR), CAST({n} AS DOUBLE), 'condition' FROM run_conditions JOIN datasets USING (dataset_fingerprint)" for k, v, n in (("dataset", "dataset_name", "NULL"), ("domain", "domain", "NULL"), ("seed", "seed", "seed"), ("task_type", "task_type", "NULL"), ("split_method", "split_method", "NULL"), ("cv_method", "cv_method", "NULL"), ("n_folds", "n_folds", "n_folds"), ("refit_strategy", "refit_strategy", "NULL")))
    return f"SELECT run_condition_hash, facet_key, facet_value, max(facet_num) AS facet_num, max(facet_role) AS facet_role FROM run_conditions JOIN ({own}) USING (pipeline_dag_hash) GROUP BY ALL UNION ALL {cond}"


#: A node's content as canonical JSON, and a chain's signatures, each over its content and the one before.
_CONTENT = """SELECT n.pipeline_dag_hash, CAST(substr(n.node_id, 2) AS INTEGER) AS i, n.kind, n.operator, '{"fit_scope":null,"kind":"' || n.kind || '","operator":"' || n.operator || '","operator_version":null,"params":{' || coalesce(p.j, '') || '}}' AS c, '{' || coalesce(p.j, '') || '}' AS params_json
    FROM nodes n LEFT JOIN (SELECT pipeline_dag_hash, node_id, string_agg('"' || param_name || '":' || value_json, ',' ORDER BY param_name) AS j FROM params GROUP BY ALL) p ON n.pipeline_dag_hash = p.pipeline_dag_hash AND n.node_id = p.node_id"""
_CHAIN = """SELECT pipeline_dag_hash, i, sha256('{"content":' || c || ',"inputs":[],"order_sensitive":true}') AS s FROM content WHERE i = 0
    UNION ALL SELECT n.pipeline_dag_hash, n.i, sha256('{"content":' || c || ',"inputs":[[' || CASE kind WHEN 'mean' THEN '' ELSE '0,' END || '"in","' || s || '"]],"order_sensitive":' || CASE kind WHEN 'mean' THEN 'false' ELSE 'true' END || '}') FROM chain h JOIN content n ON h.pipeline_dag_hash = n.pipeline_dag_hash AND n.i = h.i + 1"""
_DAGS = """SELECT pipeline_dag_hash, sha256('{"edges":[' || string_agg('{"dst":"g' || i || '","dst_port":"in","src":"g' || (i - 1) || '","src_port":"out"}', ',' ORDER BY i) FILTER (i > 0) || '],"nodes":["' || string_agg(s, '","' ORDER BY s) || '"],"schema":"arena.graph/1"}') AS dag FROM chain GROUP BY pipeline_dag_hash"""


def _shared(sql: str) -> str:
    """The views that a query's SQL needs beyond the tables', each computed once."""
    roles = ("model", "preprocessing", "augmentation", "scaler", "feature_selection")
    made = {
        "roles": f"SELECT *, {classify_sql('operator', 'kind')} AS role, split_part(operator, '.', -1) AS leaf FROM nodes",
        "used": "SELECT * FROM roles WHERE operator IS NOT NULL AND role <> 'input'",
        "counts": f"SELECT p.*, {', '.join(f'coalesce({r}, 0) AS {r}' for r in (*roles, 'stages'))} FROM pipelines p LEFT JOIN (SELECT pipeline_dag_hash, count(*) AS stages, {', '.join(f'count(*) FILTER (role = {chr(39)}{r}{chr(39)}) AS {r}' for r in roles)} FROM used GROUP BY 1) USING (pipeline_dag_hash)",
        "facets": _facet_sql(),
        "content": _CONTENT,
    }
    made |= {"chain": _CHAIN, "dags": _DAGS}
    has = lambda name: re.search(rf"\b{name}\b", sql)
    need = ["roles", "used", "counts", "facets"] if has("facets") else ["roles", "used"] if has("used") or has("roles") else []
    need += ["content", "chain", "dags"] if has("dags") or has("content") else []
    return "".join(f",\n{k} AS {'' if k == 'chain' else 'MATERIALIZED '}({made[k]})" for k in need)


def composed() -> dict[str, str]:
    """Every query's SQL with the views that it needs."""
    common = T.sql_views()
    return {name: f"{common}{_shared(sql)}\n{sql}" if views else sql for name, (sql, views) in SQL.items()}
