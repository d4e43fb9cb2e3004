"""One batch of manifests into a store: verified, told apart from what is there, resolved, and committed to all tables or to none."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources import manifests as M
from ..sources.commitlog import Conflict, State
from ..sources.scratch import checkpointed, ranged, remove, short_shuffles, size, sliced, written
from ..sources.store import RESIDUAL, SMALL, Snapshot, Store, snapshot
from . import catalogue, facets, metrics, resolve
from .ingest import RESIDUAL_CAP, cap_report, latest, once, publishable, superseded, verify, within_cap
from .rankings import direction

_PARTS = ("dataset_fingerprint", "task_hash", "dataset_variant_hash", "split_instance_hash", "cv_instance_hash", "rng_context_hash", "refit_strategy_hash", "pipeline_dag_hash")
#: The store's tables.
TABLES = {
    "settings": "key string, value string, seq timestamp",
    "collections": "collection_id string, kind string, created_at timestamp",
    "batches": "export_hash string, schema_version int, status string, collection_id string, issues array<string>, n_residuals long, truncated boolean, seq timestamp",
    "dataset_fingerprints": "dataset_fingerprint string, privacy_level string, n_samples long, n_features long, task_type string, schema_fingerprint string, relation_fingerprint string, plan_fingerprint string, x_stats_json string, y_stats_json string, group_stats_json string, dataset_card_hash string, created_at timestamp",
    "dataset_cards": "dataset_card_hash string, dataset_id string, dataset_version string, source_registry string, dataset_fingerprint string, visibility string, name string, domain string, modality string, signal_type string, axis_unit string, axis_min double, axis_max double, axis_resolution double, n_samples long, n_features long, license string, content_hash string, descriptor_hash string, card_json string, created_at timestamp",
    "task_specs": "task_hash string, dataset_fingerprint string, task_type string, target_name string, target_unit string, target_hash string, encoding_json string",
    "dataset_variants": "dataset_variant_hash string, dataset_fingerprint string, task_hash string, variant_spec_json string, sample_manifest_hash string, size_label string, aggregation string",
    "split_specs": "split_spec_hash string, method string, params_json string, group_policy string, stratification_policy string",
    "split_instances": "split_instance_hash string, split_spec_hash string, rng_context_hash string, partition_summary_json string, split_indices_hash string",
    "cv_specs": "cv_spec_hash string, method string, n_folds long, n_repeats long, nested int, within_train_only int",
    "cv_instances": "cv_instance_hash string, cv_spec_hash string, rng_context_hash string, fold_summary_json string, engine_fold_set_fingerprint string",
    "rng_contexts": "rng_context_hash string, root_seed long, derivation string, framework_seeds_json string, determinism_flags_json string",
    "refit_strategies": "refit_strategy_hash string, strategy string, selection_scope string, train_scope string, params_json string",
    "score_specs": "score_spec_hash string, score_version string, metric_implementation string, score_level string, aggregation_policy string",
    "pipeline_dags": "pipeline_dag_hash string, label string, main_model string, is_linear int, n_nodes long, entry_nodes_json string, terminal_nodes_json string, graph_json string, engine_graph_fingerprint string, identity_hash string",
    "pipeline_nodes": "pipeline_dag_hash string, node_id string, signature string, kind string, operator string, operator_version string, params_json string, branch_path_json string, fit_scope string, operator_spec_hash string, params_hash string, model_family string",
    "pipeline_edges": "pipeline_dag_hash string, src string, src_port string, dst string, dst_port string",
    "operator_specs": "operator_spec_hash string, library string, entrypoint string, version string, role string",
    "node_params": "pipeline_dag_hash string, node_id string, param_name string, value_json string, param_value_hash string",
    "parameter_values": "param_value_hash string, name string, value_json string, kind string, numeric_value double, is_numeric int, is_ordinal int, is_sweepable int",
    "run_conditions": "run_condition_hash string, collection_id string, " + ", ".join(f"{h} string" for h in _PARTS),
    "run_facets": "run_condition_hash string, facet_key string, facet_value string, facet_num double, facet_role string",
    "executions": "execution_hash string, run_condition_hash string, export_hash string, execution_id string, collection_id string, execution_validity string, status string, producer_capsule string, time_ms double, peak_mem_mb double, os string, hardware string, failure_code string, failure_message string, oof_enforced int, unsafe_flags_json string, seq timestamp",
    "score_sets": "score_set_id string, execution_hash string, scope string, n_observations long, score_spec_hash string, seq timestamp",
    "observations": "score_set_id string, execution_hash string, score_spec_hash string, scope string, run_condition_hash string, execution_validity string, metric_name string, metric_value double, direction string, fold_id string, partition string, aggregation_level string, metric_unit string, n_samples long, coverage double",
    "residual_sets": "residual_set_id string, execution_hash string, key string, n_rows long, truncated boolean, partitions array<string>, publishable_json string",
    "residuals": RESIDUAL,
    "plan_events": "plan_id string, pipeline_dag_hash string, dataset_fingerprint string, collection_id string, status string, source string, fulfilled_by string, seq timestamp",
}
KEYS = {
    "settings": ["key"], "collections": ["collection_id"], "dataset_fingerprints": ["dataset_fingerprint"], "dataset_cards": ["dataset_card_hash"], "task_specs": ["task_hash"], "dataset_variants": ["dataset_variant_hash"], "split_specs": ["split_spec_hash"],
    "split_instances": ["split_instance_hash"], "cv_specs": ["cv_spec_hash"], "cv_instances": ["cv_instance_hash"], "rng_contexts": ["rng_context_hash"], "refit_strategies": ["refit_strategy_hash"], "score_specs": ["score_spec_hash"],
    "pipeline_dags": ["pipeline_dag_hash"], "pipeline_nodes": ["pipeline_dag_hash", "node_id"], "pipeline_edges": ["pipeline_dag_hash", "src", "src_port", "dst", "dst_port"], "operator_specs": ["operator_spec_hash"], "node_params": ["pipeline_dag_hash", "node_id", "param_name"],
    "parameter_values": ["param_value_hash"], "run_conditions": ["run_condition_hash"], "run_facets": ["run_condition_hash", "facet_key", "facet_value"], "executions": ["execution_hash"], "score_sets": ["score_set_id"], "residual_sets": ["residual_set_id"],
}
#: Columns by which rows that several runs have are laid out, so that one run's are in few files.
CLUSTERED = {"residuals": ["residual_set_id"], "observations": ["execution_hash"]}
#: What follows from other columns isn't stored: a score set's id from what names the set, an execution's hash from its condition and export. A run's sets lie side by side.
DERIVED = {"executions": {"execution_hash": resolve.EXECUTION_HASH}, "score_sets": {"score_set_id": resolve.SCORE_SET_ID}, "observations": {"score_set_id": resolve.SCORE_SET_ID}}
IN_ORDER = {"executions": ["export_hash"], "score_sets": ["execution_hash", "scope"]}
#: Bytes of a batch's rows that are brought into the store at a time, and then removed.
SLICE = 64 << 20
#: Bytes of a slice's rows from which its scores go to another file.
LAID = 2 << 20
_NODES_1 = TABLES["pipeline_nodes"].replace("kind string", "role string")
#: Stores of version 1 called a node's declared kind its role, and had scores of single samples only.
UPGRADES = {1: {"pipeline_nodes": (_NODES_1, lambda df: df.withColumnRenamed("role", "kind")), "observations": (TABLES["observations"], lambda df: df.withColumn("aggregation_level", F.coalesce("aggregation_level", F.lit("sample"))))}}


def open_store(spark: SparkSession, root: str) -> Store:
    """The store under root, of this version or an older one; a new one where there is none."""
    return Store(spark, root, TABLES, KEYS, CLUSTERED, UPGRADES, DERIVED, IN_ORDER)


#: Tables of which a snapshot has a folder for each run.
PER_RUN = ("score_sets", "residual_sets")


def export_snapshot(store: Store, path: str) -> None:
    """All tables of one state but the settings, which hold the salt, as folders of JSON lines."""
    state = store.state()
    snapshot(path, per_run=PER_RUN, **{name: store.read(name, state) for name in TABLES if name != "settings"})


def open_snapshot(spark: SparkSession, path: str) -> Snapshot:
    """An exported snapshot, for backbone() and whatever else reads a store's tables."""
    return Snapshot(spark, path, TABLES)


@dataclass(frozen=True)
class Policy:
    """How a batch is taken. salt: of the pseudonyms, for a store's first batch; the store keeps it, and another one is refused. quarantine: whether a
    missing attestation keeps a run apart (by default in releases only); recompute: scores are made from residuals even where a manifest has some."""

    collection: str
    salt: str | None = None
    release: bool = False
    quarantine: bool | None = None
    cap: int = RESIDUAL_CAP
    recompute: bool = False


def settings(store: Store, state: State | None = None) -> dict[str, str]:
    """The store's settings: the last value of each key."""
    return dict(latest(store.read("settings", state), "key", "value").select("key", "value").collect())  # a few rows


#: How many residual rows and scores a manifest has inline.
_INLINE, _SCORES = "coalesce(nullif(size(m.residuals.inline), -1), 0)", "coalesce(nullif(size(m.scores.observations), -1), 0)"


def _residuals(usable: DataFrame, salt: str, side: DataFrame | None) -> DataFrame:
    """Residual rows as they may be kept, by export; side: rows from beside the manifests."""
    flags = "export_hash", "may.*", F.coalesce(F.col("m.task.task_type") == "regression", F.lit(False)).alias("_regression")
    rows = usable.where(f"{_INLINE} > 0").select(*flags, F.inline("m.residuals.inline"))
    if side is not None:
        rows = rows.unionByName(side.join(usable.where(f"{_INLINE} = 0").select(*flags), "export_hash"), allowMissingColumns=True)
    parts = [publishable(rows.where(F.col("_regression") == yes), salt, yes) for yes in (True, False)]
    return parts[0].unionByName(parts[1])


def _recomputed(rows: DataFrame, which: DataFrame) -> DataFrame:
    """Observations from the residuals of the exports in which."""
    own = rows.join(which, "export_hash", "left_semi").withColumn("residual_set_id", F.col("export_hash"))
    made = [metrics.recompute(own.where(F.col("_regression") == yes), "regression" if yes else "classification") for yes in (True, False)]
    cols = F.col("residual_set_id").alias("export_hash"), "metric_name", "metric_value", "scope", "fold_id", "partition", "n_samples", "coverage"
    return made[0].select(*cols).unionByName(made[1].select(*cols))


def run_facets(conditions: DataFrame, dags: DataFrame, nodes: DataFrame, params: DataFrame, values: DataFrame, names: DataFrame) -> DataFrame:
    """Facets of conditions, each key and value once."""
    typed = params.join(values.select("param_value_hash", "numeric_value", "is_numeric"), "param_value_hash", "left")
    rows = facets.run_facets(conditions, names, dags, nodes, typed)
    return rows.groupBy("run_condition_hash", "facet_key", "facet_value").agg(F.max("facet_num").alias("facet_num"), F.max("facet_role").alias("facet_role"))


def ingest(store: Store, manifests: DataFrame, policy: Policy, side: DataFrame | None = None, scores: DataFrame | None = None, tries: int = 4) -> DataFrame:
    """Commits what is new of manifests(), or of fields(), and returns a report: a row for each export with its status (committed, quarantined,
    rejected or already_ingested), issues, n_residuals and truncated. An export that comes twice counts once; what can't be read or
    resolved is rejected and leaves nothing. side: residual rows by export, of manifests without inline ones; scores: observations
    by export, of manifests without any. If another writer comes first the batch is told apart from what that one wrote, `tries` times at most."""
    store = store if store.keys else open_store(store.spark, store.root)
    with short_shuffles(store.spark):
        for left in reversed(range(tries)):
            rows = _read(_named(manifests), policy)
            try:
                return _ingested(store, manifests, rows, _twice(rows), policy, side, scores)
            except Conflict:
                remove(rows)
                if not left:
                    raise
    raise ValueError("tries must be 1 or more")


def _named(manifests: DataFrame) -> DataFrame:
    """Manifests with the hash that they give, else that of their content, else that of their text; of fields() null where none is given, as _read() makes it."""
    named = F.coalesce("m.arena_export_hash", "export_hash", F.sha2("text", 256)) if "export_hash" in manifests.columns else F.col("m.arena_export_hash")
    return manifests.withColumn("export_hash", named).select("export_hash", "path", "text", "m")


def _verified(rows: DataFrame, policy: Policy, scores: DataFrame | None = None) -> DataFrame:
    """rows with schema_version, status and issues."""
    fields = M.checked_fields(rows, F.struct(*[c for c in rows.columns if c != "export_hash"]).alias("row"))
    if scores is not None:
        counted = scores.groupBy("export_hash").agg(F.count("*").alias("_n"))
        fields = fields.join(counted, "export_hash", "left").withColumn("n_observations", F.coalesce("_n", F.lit(0)) + F.col("n_observations")).drop("_n")
    return verify(fields, policy.release if policy.quarantine is None else policy.quarantine).select("export_hash", "schema_version", "status", "issues", "row.*")


def _read(m: DataFrame, policy: Policy) -> DataFrame:
    """Manifests in narrow rows, which are all that is kept of them: their texts are many times larger. What is rejected isn't resolved."""
    named = F.contains("text", F.lit("publishable")) | F.contains("text", F.lit("\\u"))  # else no name is that one: the text needn't be read for it
    may = [F.when(named, F.get_json_object("text", f"$.residuals.publishable.{c}")).cast("boolean").alias(f"may_{c}") for c in ("y_true", "y_pred", "y_proba")]
    told = _verified(m, policy).withColumns({"may": F.struct(*may), "_good": (F.col("status") != "rejected") & F.coalesce(F.col("m.arena_export_hash") != "", F.lit(True))})
    return written(resolve.identities(told, ("export_hash", "path", "m", "may", "status"), "_good"))


def _twice(rows: DataFrame) -> DataFrame | None:
    """The exports that come more than once, if any: short hashes are counted, and whole ones where those are equal."""
    short = F.xxhash64("export_hash").alias("_short")
    again = written(rows.groupBy(short).agg(F.count("*").alias("n")).where("n > 1").select("_short"))
    if again.isEmpty():
        return None
    return written(rows.select("export_hash", short).join(again, "_short", "left_semi").groupBy("export_hash").agg(F.count("*").alias("n")).where("n > 1").select("export_hash"))


def _ingested(store: Store, manifests: DataFrame, read: DataFrame, twice: DataFrame | None, policy: Policy, side: DataFrame | None, scores: DataFrame | None) -> DataFrame:
    now, state = F.current_timestamp(), store.state()
    kept_salt = settings(store, state).get("salt")
    if kept_salt is not None and policy.salt not in (None, kept_salt):
        raise ValueError("the store has another salt: samples would no longer meet")
    salt = kept_salt or policy.salt or uuid.uuid4().hex
    first = _verified(read.drop("status"), policy, scores).select("export_hash", "schema_version", "status", "issues")
    kept_rows = read
    if twice is not None:
        least = F.min_by(F.struct("schema_version", "status", "issues"), F.coalesce("schema_version", F.lit(0))).alias("v")
        several = written(first.join(twice, "export_hash", "left_semi").groupBy("export_hash").agg(least).select("export_hash", "v.*"))
        first = first.join(twice, "export_hash", "left_anti").unionByName(several)
    seen = store.read("batches", state).where(F.col("status").isin("committed", "quarantined")) if state.of("batches") else None
    old = None if seen is None else written(first.join(seen, ["export_hash", "schema_version"], "left_semi").select("export_hash"))
    if old is not None and old.isEmpty():
        old = None
    if twice is not None or old is not None:  # parts are told by what is taken
        m = _named(manifests if "export_hash" in manifests.columns else M.parsed(manifests))
        rest = m if old is None else m.join(old, "export_hash", "left_anti")
        if twice is not None:
            least = rest.join(twice, "export_hash", "left_semi").groupBy("export_hash").agg(*[F.min(c).alias(c) for c in ("path", "text", "m")])
            rest = rest.join(twice, "export_hash", "left_anti").unionByName(least)
        kept_rows = _read(rest, policy)

    def taken(part: DataFrame) -> DataFrame:
        out = part
        if twice is not None:
            out = out.join(several.select("export_hash", F.col("status").alias("_status")), "export_hash", "left").withColumn("status", F.coalesce("_status", "status"))
        return out.where("status != 'rejected'")

    accepted = taken(kept_rows)
    usable = accepted.where("execution_hash IS NOT NULL")
    residuals = written(_residuals(usable, salt, side))
    caps = written(cap_report(residuals, policy.cap))
    # Exports whose scores are in their rows need no join; the others get theirs from beside or from residuals.
    bare = usable if policy.recompute else usable.where(f"{_SCORES} = 0")
    direct = usable.where(f"{_SCORES} > 0")
    wanted = bare.select("export_hash")
    if scores is not None:
        beside = scores.join(usable.where(f"{_SCORES} = 0").select("export_hash"), "export_hash", "left_semi")
        wanted = wanted if policy.recompute else wanted.join(beside.select("export_hash").distinct(), "export_hash", "left_anti")
    wanted = written(wanted.join(caps.where("NOT truncated"), "export_hash", "left_semi"))
    if policy.recompute:
        direct = direct.join(wanted, "export_hash", "left_anti")
    made = _recomputed(within_cap(residuals, policy.cap), wanted)
    given = M.observations(direct.select("export_hash", "m"))
    if scores is not None:
        made = made.unionByName(beside.join(wanted, "export_hash", "left_anti"), allowMissingColumns=True)
    scope = F.coalesce("scope", F.lit("cv"))
    made = written(given.limit(0).unionByName(made, allowMissingColumns=True).select(given.columns).withColumn("scope", scope))
    told = written(kept_rows.where("told IS NOT NULL").select(*resolve.HASHES, "error", "told.*"))
    nodes, params = resolve.pipeline_nodes(told), resolve.node_params(told)
    values, dags = resolve.parameter_values(params), resolve.pipeline_dags(told)
    fresh_conditions = checkpointed(store.absent("run_conditions", resolve.conditions(usable), state))
    spec = resolve.specs(told)
    names = spec["dataset_cards"].groupBy("dataset_fingerprint").agg(F.min("name").alias("dataset_name"), F.min("domain").alias("domain"))
    key = F.coalesce("m.residuals.key", F.lit("sample_id"))
    parts = written(residuals.groupBy("export_hash").agg(F.array_sort(F.collect_set("partition")).alias("partitions")))
    residual_sets = usable.select("export_hash", "execution_hash", "run.publishable_json", key.alias("key")).join(caps, "export_hash").join(parts, "export_hash").withColumn("residual_set_id", resolve.residual_set_id(F.col("execution_hash"), F.col("key")))
    kept = within_cap(residuals, policy.cap).join(residual_sets.select("export_hash", "residual_set_id"), "export_hash")
    offered = {
        "settings": store.spark.range(1).select(F.lit("salt").alias("key"), F.lit(salt).alias("value"), now.alias("seq")),
        "collections": store.spark.range(1).select(F.lit(policy.collection).alias("collection_id"), F.lit("benchmark_release" if policy.release else "user_run_collection").alias("kind"), now.alias("created_at")),
        **spec, "pipeline_dags": dags, "pipeline_nodes": nodes.withColumnRenamed("role", "kind"), "pipeline_edges": resolve.pipeline_edges(told), "operator_specs": resolve.operator_specs(nodes), "node_params": params, "parameter_values": values,
        "run_conditions": usable.select("run_condition_hash", F.lit(policy.collection).alias("collection_id"), *_PARTS).distinct(), "run_facets": run_facets(fresh_conditions, dags, nodes.withColumnRenamed("role", "kind"), params, values, names),
        "residual_sets": residual_sets.select("residual_set_id", "execution_hash", "key", "n_rows", "truncated", "partitions", "publishable_json"),
    }
    counters = {name: [Observation()] for name in offered} | {"executions": []}
    tables = {name: store.absent(name, once(rows, KEYS[name]).observe(counters[name][0], F.count(F.lit(1)).alias("n")), state) for name, rows in offered.items()}
    if state.of("plan_events"):
        tables["plan_events"] = _fulfilled(plans(store, state), usable).withColumn("seq", now)
    lost = written(accepted.where("execution_hash IS NULL").select("export_hash", F.lit(True).alias("lost")))
    report = first.join(lost, "export_hash", "left").join(caps, "export_hash", "left")
    report = report.withColumn("seen", F.lit(False)) if seen is None else report.join(seen.select("export_hash").distinct().withColumn("seen", F.lit(True)), "export_hash", "left")
    status = F.when(F.col("seen"), "already_ingested").when(F.col("lost"), "rejected").otherwise(F.col("status"))
    issues = F.when(F.col("lost"), F.array_append("issues", F.lit("error: unresolved"))).otherwise(F.col("issues"))
    report = report.select("export_hash", "schema_version", status.alias("status"), issues.alias("issues"), F.coalesce("n_rows", F.lit(0).cast("bigint")).alias("n_residuals"), F.coalesce("truncated", F.lit(False)).alias("truncated"))
    batch = report.where("status IN ('committed', 'quarantined')").withColumns({"collection_id": F.lit(policy.collection), "seq": now})
    tables |= {"batches": batch, "residuals": kept}

    def bulk(part: DataFrame) -> dict[str, DataFrame]:
        """The runs of some of the batch's rows, their sets and scores. An execution is its export's, which is there once."""
        counters["executions"].append(Observation())
        own = taken(part).where("execution_hash IS NOT NULL").withColumn("execution_validity", F.when(F.col("status") == "quarantined", "quarantined").otherwise("valid"))
        run = own.select("execution_hash", "run_condition_hash", "export_hash", "execution_id", F.lit(policy.collection).alias("collection_id"), "execution_validity", *[f"run.{c}" for c in resolve.RUN if c != "publishable_json"], now.alias("seq"))
        direct = own.where(f"{_SCORES} > 0")
        bare = own if policy.recompute else own.where(f"{_SCORES} = 0")
        if policy.recompute:
            direct = direct.join(wanted, "export_hash", "left_anti")
        named = "export_hash", "execution_hash", "score_spec_hash"
        ids, set_id = (*named, "run_condition_hash", "execution_validity"), resolve.score_set_id(F.col("execution_hash"), F.col("score_spec_hash"), F.col("scope"))
        rows = direct
        if laid:
            rows = ranged(direct.select(*ids, "m"), "execution_hash", min(store.spark.sparkContext.defaultParallelism, size(part) // LAID))
        scored = rows.select(*ids, F.inline("m.scores.observations")).withColumn("scope", scope)
        scored = (scored if laid else scored.unionByName(made.join(bare.select(*ids), "export_hash"))).withColumn("score_set_id", set_id)
        scopes = F.transform("m.scores.observations", lambda o: F.coalesce(o["scope"], F.lit("cv")))
        sets = direct.select(*named, scopes.alias("_scopes")).select("*", F.explode(F.array_distinct("_scopes")).alias("scope"))
        sets = sets.select("execution_hash", "score_spec_hash", "scope", F.size(F.filter("_scopes", lambda x: x == F.col("scope"))).cast("long").alias("n_observations")).withColumn("score_set_id", set_id)
        sets = sets.unionByName(resolve.score_sets(bare, made, policies=True)).withColumn("seq", now)
        rest = {"direction": F.coalesce(F.col("direction"), direction(F.col("metric_name"))), "aggregation_level": F.coalesce("aggregation_level", F.lit("sample"))}
        run = store.absent("executions", run.observe(counters["executions"][-1], F.count(F.lit(1)).alias("n")), state)
        return {"executions": run, "score_sets": store.absent("score_sets", sets, state), "observations": store.absent("score_sets", scored, state).withColumns(rest)}

    # What is in the store goes from the scratch folder: a large batch is brought there a slice at a time.
    parts = sliced(kept_rows, SLICE)
    # Where all scores are their manifests' own and none can be there yet, whole manifests are shuffled to their place, which are fewer and shorter than their scores.
    laid = not state.of("score_sets") and not policy.recompute and made.isEmpty()
    in_place = {"observations"} if laid else set()
    others = written(report.where("status NOT IN ('committed', 'quarantined')"))
    staged = store.stage(in_place, **tables, **(bulk(parts[0]) if len(parts) == 1 else {}))
    for part in parts if len(parts) > 1 else []:
        staged |= store.stage(in_place, **bulk(part))
        remove(part)
    taken_as = uuid.uuid4().hex
    for f in staged.files.values():
        if f["table"] == "score_sets":
            f["batch"] = taken_as
    store.commit(state, counters, staged)
    for used in (read, kept_rows, residuals, made, told):
        remove(used)
    return store.rows("batches", staged).select(others.columns).unionByName(others)


def _fulfilled(open_plans: DataFrame, resolved: DataFrame) -> DataFrame:
    """An event for each open plan that an execution of this batch carries out: the least one."""
    done = resolved.groupBy("pipeline_dag_hash", "dataset_fingerprint").agg(F.min("execution_hash").alias("by"))
    hit = open_plans.where("status = 'planned'").join(done, ["pipeline_dag_hash", "dataset_fingerprint"])
    return hit.withColumns({"status": F.lit("fulfilled"), "fulfilled_by": F.col("by")}).drop("by")


def plan(store: Store, targets: DataFrame, source: str = "upload") -> DataFrame:
    """Plans targets(pipeline_dag_hash, dataset_fingerprint, collection_id) and returns them with plan_id and status: already_run where the store
    has a run of the pair, else planned; a plan that is open or done already isn't made again."""
    from .ingest import plan as planned

    state = store.state()
    found = checkpointed(planned(targets.distinct(), executions(store, state)))
    known = plans(store, state).select("plan_id")
    fresh = found.where("status = 'planned'").join(known, "plan_id", "left_anti").withColumns({"source": F.lit(source), "seq": F.current_timestamp()})
    store.commit(state, plan_events=fresh)
    return found


# What the store's tables say, in the columns that rankings, facets and statistics read


def plans(store: Store, state: State | None = None) -> DataFrame:
    """Each plan's last event; of several at one time fulfilled counts."""
    events = store.read("plan_events", state)
    rest = ("status", "pipeline_dag_hash", "dataset_fingerprint", "collection_id", "source", "fulfilled_by")
    last = F.max_by(F.struct(*rest), F.struct("seq", F.col("status") == "fulfilled"))
    return events.groupBy("plan_id").agg(last.alias("e"), F.min("seq").alias("created_at")).select("plan_id", "e.*", "created_at")


def datasets(store: Store, state: State | None = None) -> DataFrame:
    """(dataset_fingerprint, dataset_name, domain, modality, signal_type, privacy_level, n_samples, n_features, task_type): names are the card's, null without one."""
    cards = store.read("dataset_cards", state).select("dataset_card_hash", F.col("name").alias("dataset_name"), "domain", "modality", "signal_type")
    own = store.read("dataset_fingerprints", state).select("dataset_fingerprint", "dataset_card_hash", "privacy_level", "n_samples", "n_features", "task_type")
    return own.join(cards, "dataset_card_hash", "left").drop("dataset_card_hash")


def conditions(store: Store, state: State | None = None) -> DataFrame:
    """Run conditions with what their parts say: task_type, split_method, cv_method, n_folds, seed, refit_strategy, size_label."""
    read = lambda t, *cols: store.read(t, state).select(*cols)
    rows = store.read("run_conditions", state)
    rows = rows.join(read("task_specs", "task_hash", "task_type", "target_name"), "task_hash", "left").join(read("dataset_variants", "dataset_variant_hash", "size_label", F.col("aggregation").alias("variant_aggregation")), "dataset_variant_hash", "left")
    split = read("split_instances", "split_instance_hash", "split_spec_hash").join(read("split_specs", "split_spec_hash", F.col("method").alias("split_method")), "split_spec_hash", "left").drop("split_spec_hash")
    cv = read("cv_instances", "cv_instance_hash", "cv_spec_hash").join(read("cv_specs", "cv_spec_hash", F.col("method").alias("cv_method"), "n_folds"), "cv_spec_hash", "left").drop("cv_spec_hash")
    rows = rows.join(split, "split_instance_hash", "left").join(cv, "cv_instance_hash", "left")
    rows = rows.join(read("rng_contexts", "rng_context_hash", F.col("root_seed").alias("seed"), "derivation"), "rng_context_hash", "left")
    rows = rows.join(read("refit_strategies", "refit_strategy_hash", F.col("strategy").alias("refit_strategy")), "refit_strategy_hash", "left")
    return _few(store, "run_conditions", rows, state)


def _few(store: Store | Snapshot, table: str, rows: DataFrame, state: State | None) -> DataFrame:
    return store.small(table, rows, state) if isinstance(store, Store) else rows


def executions(store: Store, state: State | None = None) -> DataFrame:
    """Executions with their condition's pipeline, dataset and origin collection."""
    origin = _few(store, "run_conditions", store.read("run_conditions", state), state)
    return store.read("executions", state).drop("collection_id").join(origin, "run_condition_hash")


def params(store: Store, state: State | None = None) -> DataFrame:
    """(pipeline_dag_hash, node_id, param_name, value_json, numeric_value, is_numeric, is_sweepable)."""
    values = store.read("parameter_values", state).select("param_value_hash", "numeric_value", "is_numeric", "is_sweepable")
    return store.read("node_params", state).join(values, "param_value_hash", "left").drop("param_value_hash")


def current_score_sets(store: Store, state: State | None = None) -> DataFrame:
    """The store's score sets with validity: of an execution and scope the latest is valid."""
    return superseded(store.read("score_sets", state))


def backbone(store: Store, state: State | None = None) -> DataFrame:
    """The store's observations with their runs: what rankings, facets and statistics read."""
    runs = executions(store, state).drop("seq").join(store.read("pipeline_dags", state).select("pipeline_dag_hash", "label", "main_model", "is_linear"), "pipeline_dag_hash", "left")
    runs = runs.join(datasets(store, state).select("dataset_fingerprint", "dataset_name", "domain"), "dataset_fingerprint", "left")
    sets = current_score_sets(store, state).select("score_set_id", "execution_hash", F.col("scope").alias("score_scope"), F.col("validity").alias("score_validity"))
    return runs.join(sets, "execution_hash").join(store.read("observations", state).drop(*_OF_RUN), "score_set_id")


#: What an observation says of its run and set, beside the set's id.
_OF_RUN = "execution_hash", "score_spec_hash", "scope", "run_condition_hash", "execution_validity"


def _replaced(store: Store, state: State) -> DataFrame | None:
    """The ids of score sets that aren't valid any more, if any: short hashes of execution and scope are counted, and sets looked at where those are equal.
    A batch has one set of an execution and scope at most, so that sets of one batch needn't be looked at."""
    if len({f.get("batch", p) for p, f in state.of("score_sets").items()}) < 2:
        return None
    sets = store.read("score_sets", state).withColumn("_short", F.xxhash64("execution_hash", "scope"))
    with short_shuffles(store.spark):
        again = written(sets.groupBy("_short").agg(F.count("*").alias("n")).where("n > 1").select("_short"))
        if again.isEmpty():
            return None
        return written(superseded(sets.join(again, "_short", "left_semi").drop("_short")).where("validity = 'superseded'").select("score_set_id", F.lit("superseded").alias("score_validity")))


def named_conditions(store: Store | Snapshot, state: State | None = None) -> DataFrame:
    """Run conditions with the names of their pipeline and dataset: label, main_model, is_linear, dataset_name, domain."""
    of = store.read("run_conditions", state).join(store.read("pipeline_dags", state).select("pipeline_dag_hash", "label", "main_model", "is_linear"), "pipeline_dag_hash", "left")
    return _few(store, "run_conditions", of.join(datasets(store, state).select("dataset_fingerprint", "dataset_name", "domain"), "dataset_fingerprint", "left"), state)


def scores(store: Store | Snapshot, state: State | None = None) -> DataFrame:
    """backbone() without the columns that only executions have, such as times and ids: observations name their run, so that
    they meet conditions, which are far fewer, and neither executions nor score sets. Where files of older formats don't name it, or runs or sets are hidden, backbone()'s rows."""
    state = store.state() if state is None and isinstance(store, Store) else state
    gone = [c for c in TABLES["executions"].split(", ") if c.split()[0] not in ("execution_hash", "run_condition_hash", "execution_validity", "collection_id")]
    if not isinstance(store, Store) or any(f["format"] < 3 for f in state.of("observations").values()) or any(f.get("hidden") for t in ("executions", "score_sets") for f in state.of(t).values()):
        return backbone(store, state).drop(*[c.split()[0] for c in gone])
    rows = store.read("observations", state).drop("score_spec_hash").withColumnRenamed("scope", "score_scope")
    old = _replaced(store, state)
    rows = rows.withColumn("score_validity", F.lit("valid")) if old is None else rows.join(old, "score_set_id", "left").fillna("valid", "score_validity")
    return rows.join(named_conditions(store, state), "run_condition_hash")


def overview(store: Store) -> DataFrame:
    """(name, n): how much the store has, all of one state."""
    state = store.state()
    t = {name: store.read(name, state) for name in TABLES}
    counted = {"datasets": "dataset_fingerprints", "dataset_cards": "dataset_cards", "tasks": "task_specs", "pipelines": "pipeline_dags", "operators": "operator_specs", "parameters": "parameter_values", "run_conditions": "run_conditions", "executions": "executions", "score_sets": "score_sets", "metric_observations": "observations", "residual_sets": "residual_sets", "collections": "collections"}
    runs = {f"{v}_executions": t["executions"].where(F.col("execution_validity") == v) for v in ("valid", "quarantined")}
    return catalogue.overview(**{name: t[table] for name, table in counted.items()}, **runs, metrics=t["observations"].select("metric_name").distinct())
