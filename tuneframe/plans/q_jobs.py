"""Job-state queries over ``job_events``, ``models``, ``requests`` and dataset verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tuneframe import constants as K
from tuneframe.operators import jobs as J
from tuneframe.operators import validation as V
from tuneframe.plans import fixtures as FX
from tuneframe.plans.catalog import query
from tuneframe.plans.oracle_views import with_views
from tuneframe.plans.q_validation import _CLS, _PER_FILE, EXPECTED, REQUIRED

_STATE = """
SELECT job_id, arg_max_null(status, seq) AS status, arg_max_null(step, seq) AS step,
       arg_max_null(loss, seq) FILTER (WHERE loss_named) AS loss,
       arg_max_null(error, seq) FILTER (WHERE error IS NOT NULL) AS error,
       arg_max_null(model_id, seq) AS model_id, arg_min_null(ts, seq) AS created_at
FROM job_events GROUP BY job_id"""
_ACTIVE = "(" + ", ".join(f"'{s}'" for s in K.ACTIVE_STATUSES) + ")"
_NAME = "coalesce(nullif(m.repo_id, ''), nullif(m.model_type, ''), 'Trained model')"


def _state_sql(body: str) -> str:
    return _state_sql_with(body)


def _state_sql_with(body: str, *extra) -> str:
    return with_views(body, "job_events", "models", extra=(("state", _STATE),) + tuple(extra))


def _state(spark, d):
    # The fold needs the event order, not dense numbers: order by (ts, event_id).
    return J.fold_state(FX.job_events(spark, d, numbered=False), seq=["ts", "event_id"], codes={"status": K.STATUSES})


@query("job_state", _state_sql("SELECT job_id, status, loss, step FROM state"))
def q_job_state(spark, d):
    return _state(spark, d).select("job_id", "status", "loss", "step")


@query("job_progress", with_views(
    "SELECT job_id, seq, cast(CASE WHEN status = 'completed' THEN 100 "
    "ELSE least(99, (step * 100) // greatest(total_steps, 1)) END AS BIGINT) AS progress FROM job_events", "job_events"))
def q_job_progress(spark, d):
    return J.job_progress(FX.job_events(spark, d)).select("job_id", "seq", "progress")


@query("failure_classes", with_views(
    f"SELECT CASE WHEN lower(error) LIKE '%{K.OOM_MARKER}%' THEN '{K.OOM_ADVICE}' ELSE error END AS message, "
    "count(*) AS count FROM job_events WHERE status = 'failed' GROUP BY 1", "job_events"))
def q_failure_classes(spark, d):
    return J.failure_classes(FX.job_events(spark, d, numbered=False))


@query("active_guard", _state_sql(
    f"SELECT coalesce(bool_or(status IN {_ACTIVE}), false) AS any_active, "
    f"count(*) FILTER (WHERE status IN {_ACTIVE}) AS n_active FROM state"))
def q_active_guard(spark, d):
    return J.active_guard(_state(spark, d))


_ALLOWED = "(" + ", ".join(f"'{a}>{b}'" for a, b in K.ALLOWED_TRANSITIONS) + ")"


@query("status_transitions", with_views(
    f"SELECT from_status, to_status, from_status || '>' || to_status IN {_ALLOWED} AS allowed, count(*) AS count "
    "FROM (SELECT lag(status) OVER (PARTITION BY job_id ORDER BY seq) AS from_status, status AS to_status "
    "FROM job_events) t WHERE from_status IS NOT NULL GROUP BY from_status, to_status", "job_events"))
def q_status_transitions(spark, d):
    events = FX.job_events(spark, d, numbered=False)
    return J.status_transitions(events, seq=["ts", "event_id"]).select("from_status", "to_status", "allowed", "count")


@query("interrupted_jobs", _state_sql(
    f"SELECT job_id, CASE WHEN status IN {_ACTIVE} AND job_id % 2 <> 0 THEN 'failed' ELSE status END AS status, "
    f"CASE WHEN status IN {_ACTIVE} AND job_id % 2 <> 0 THEN '{K.INTERRUPTED_ERROR}' ELSE error END AS error "
    "FROM state"))
def q_interrupted_jobs(spark, d):
    state = _state(spark, d)
    live = state.where(F.col("job_id") % 2 == 0).select("job_id")
    return J.interrupted_jobs(state, live).select("job_id", "status", "error")


@query("apply_deletes", _state_sql(
    "SELECT job_id, CASE WHEN job_id % 5 = 0 THEN 'deleted' ELSE 'kept' END AS outcome FROM state "
    "UNION ALL SELECT -1 AS job_id, 'not_found' AS outcome"))
def q_apply_deletes(spark, d):
    state = _state(spark, d)
    unknown = spark.range(-1, 0).select(F.col("id").alias("job_id"))
    deletes = state.where(F.col("job_id") % 5 == 0).select("job_id").unionByName(unknown)
    return J.apply_deletes(state, deletes)


@query("trained_models", _state_sql(
    f"SELECT s.job_id, s.model_id, {_NAME} AS model_name, strftime(s.created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at "
    "FROM state s LEFT JOIN models m ON s.model_id = m.model_id WHERE s.status = 'completed' "
    "ORDER BY s.created_at DESC, s.job_id"))
def q_trained_models(spark, d):
    return J.trained_models(_state(spark, d), FX.models(spark, d))


@query("run_labels", _state_sql(
    f"SELECT s.job_id, {_NAME} || ' · run ' || left(cast(s.job_id AS VARCHAR), 8) || "
    "coalesce(' · ' || strftime(s.created_at, '%Y-%m-%d %H:%M'), '') AS label "
    "FROM state s LEFT JOIN models m ON s.model_id = m.model_id WHERE s.status = 'completed'"))
def q_run_labels(spark, d):
    return J.run_labels(_state(spark, d), FX.models(spark, d))


#: Job ids as they are: 32 hexadecimal digits.
_HEX = ("hexed", "SELECT s.* REPLACE (md5(cast(job_id AS VARCHAR)) AS job_id) FROM state s")


@query("default_model", _state_sql_with(
    f"SELECT c.job_id, {_NAME} AS model_name FROM chosen c LEFT JOIN models m ON c.model_id = m.model_id "
    "WHERE c.job_id IS NOT NULL",
    _HEX, ("latest", "SELECT job_id, status, model_id FROM hexed ORDER BY created_at DESC, job_id DESC LIMIT 1"),
    ("newest", "SELECT job_id, model_id FROM hexed WHERE status = 'completed' ORDER BY created_at DESC, job_id LIMIT 1"),
    ("chosen", "SELECT CASE WHEN l.status = 'completed' THEN l.job_id ELSE n.job_id END AS job_id, "
               "CASE WHEN l.status = 'completed' THEN l.model_id ELSE n.model_id END AS model_id "
               "FROM latest l LEFT JOIN newest n ON true")))
def q_default_model(spark, d):
    return J.default_model(_state(spark, d).withColumn("job_id", F.md5(F.col("job_id").cast("string"))), FX.models(spark, d))


@query("exportable_jobs", _state_sql_with(
    "SELECT r.job_id, CASE WHEN s.job_id IS NULL THEN 'not_found' WHEN s.status <> 'completed' THEN 'not_completed' "
    "WHEN s.job_id % 3 <> 0 THEN 'folder_missing' ELSE 'ok' END AS outcome "
    "FROM req r LEFT JOIN state s ON r.job_id = s.job_id",
    ("req", "SELECT unnest(generate_series(0, (SELECT max(job_id) + 5 FROM state))) AS job_id")))
def q_exportable_jobs(spark, d):
    state = _state(spark, d)
    top = state.agg(F.coalesce(F.max("job_id"), F.lit(-1)).alias("m"))
    requested = top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") + 5)).alias("job_id"))
    folders = state.where(F.col("job_id") % 3 == 0).select("job_id")
    return J.exportable_jobs(requested, state, folders)


_RESOLVE = with_views(
    "SELECT r.request_id, CASE WHEN r.dataset_id IS NULL OR r.dataset_id < 0 THEN 'bad_dataset_id' "
    "WHEN p.file_id IS NULL THEN 'dataset_not_found' "
    f"WHEN NOT (p.n_bad = 0 AND p.record_count > 0 AND NOT p.miss_k AND p.record_count = {EXPECTED}) "
    "THEN 'dataset_not_valid' "
    "WHEN r.model_id IS NULL OR r.model_id < 0 THEN 'bad_model_id' WHEN m.model_id IS NULL THEN 'model_not_found' "
    "WHEN m.model_type IS NULL THEN 'no_config' ELSE 'ok' END AS outcome "
    "FROM requests r LEFT JOIN per p ON r.dataset_id = p.file_id LEFT JOIN models m ON r.model_id = m.model_id",
    "raw_lines", "requests", "models", extra=(("cls", _CLS), ("per", _PER_FILE)))


@query("request_resolution", _RESOLVE)
def q_request_resolution(spark, d):
    classified = V.classify_lines(FX.raw_lines(spark, d, numbered=False), "line", REQUIRED)
    verdicts = V.file_verdicts(classified, "file_id", "line_no", REQUIRED, EXPECTED)
    datasets = verdicts.select("file_id", (F.col("valid") & (F.col("n_bad") == 0)).alias("valid"))
    return J.resolve_requests(FX.requests(spark, d), datasets, FX.models(spark, d))

