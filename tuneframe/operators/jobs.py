"""Training-job state: fold of progress events, listings, joins (C21-C24, C26,
D1, D3-D6, D8, E7, E8, F2, S1, S4, T2).

Events are ``(job_id, seq, ts, status, step, total_steps, loss, loss_named,
error, model_id)``; one event overwrites only the keys it names. The fold is
one grouped aggregation with ``max_by`` (partial + final), so a job with a
huge event history is combined map-side rather than in one task.
"""

from __future__ import annotations

import decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneframe import constants as K
from tuneframe.functions.numeric import progress_pct
from tuneframe.functions.text import classify_failure, display_name
from tuneframe.operators.ordering import neighbor_values

TS_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


_WORD = decimal.Decimal(1 << 65)


def fold_rank(events: DataFrame, seq) -> Column:
    """What orders the events: the column, or for several a value that orders
    like the struct of them. A time or a 32-bit number followed by an integer
    is packed into one fixed-width decimal (nulls first), which a hash
    aggregation can keep in place; anything else stays a struct."""
    if isinstance(seq, str):
        return F.col(seq)
    kinds = [events.schema[c].dataType for c in seq]
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if len(seq) != 2 or not isinstance(kinds[0], (T.TimestampType, T.TimestampNTZType, *whole[:3])) or not isinstance(kinds[1], whole):
        return F.struct(*seq)
    first = F.col(seq[0])
    if isinstance(kinds[0], T.TimestampType):
        first = F.unix_micros(first)
    elif isinstance(kinds[0], T.TimestampNTZType):
        first = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), first)
    high = F.coalesce(first.cast("bigint"), F.lit(-(10 ** 18))).cast("decimal(18,0)")
    low = F.coalesce(F.col(seq[1]).cast("decimal(20,0)") + F.lit(decimal.Decimal((1 << 63) + 1)), F.lit(decimal.Decimal(0)))
    return (high * F.lit(_WORD).cast("decimal(20,0)") + low).cast("decimal(38,0)")


def fold_state(events: DataFrame, key: str = "job_id", seq="seq", fields: dict[str, Column | None] | None = None,
               codes: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Current value of each field: the value at the highest ``seq`` among
    events that name it (``None`` = named by every event). A named null
    overwrites, as an update with ``loss=None`` does. ``seq`` may be a column
    name or a list of columns ordering the events.

    ``codes`` lists all values that a string field may have: the field is then
    folded as its place in the list, a number of fixed width, so that the
    aggregation hashes instead of sorting (a string in a buffer makes Spark
    sort). A value outside its list stops the query rather than being lost."""
    if fields is None:
        fields = {"status": None, "step": None, "total_steps": None, "model_id": None,
                  "loss": F.col("loss_named"), "error": F.col("error").isNotNull()}
    codes = codes or {}
    rank = fold_rank(events, seq)
    aggs = []
    for name, named in fields.items():
        order = rank if named is None else F.when(named, rank)
        aggs.append(F.max_by(_coded(name, codes[name]) if name in codes else F.col(name), order).alias(name))
    aggs += [F.min_by(F.col("ts"), rank).alias("created_at"), F.max_by(F.col("ts"), rank).alias("updated_at")]
    if isinstance(seq, str):
        aggs.append(F.max(F.col(seq)).alias("last_seq"))
    folded = events.groupBy(key).agg(*aggs)
    return folded.withColumns({n: F.get(F.array(*map(F.lit, values)), F.col(n) - 1) for n, values in codes.items()
                               if n in fields})


def _coded(name: str, values: tuple[str, ...]) -> Column:
    place = F.array_position(F.array(*map(F.lit, values)), F.col(name)).cast("int")
    unknown = F.raise_error(F.concat(F.lit(f"{name} has a value outside its list: "), F.col(name))).cast("int")
    return F.when(place == 0, unknown).otherwise(place)


def fold_json_updates(updates: DataFrame, fields: dict[str, str], key: str = "job_id", seq="seq",
                      doc: str = "doc") -> DataFrame:
    """Fold update documents like ``dict.update``: each JSON object in
    ``doc`` overwrites exactly the keys it contains, a key given as JSON null
    included. ``fields`` maps field name to its Spark type; values are
    cast from their JSON text. One grouped ``max_by`` per field."""
    from tuneframe.functions.jsonl import JSON_OPTS
    rank = F.col(seq) if isinstance(seq, str) else F.struct(*seq)
    m = F.from_json(F.col(doc), "map<string,string>", JSON_OPTS)
    parsed = updates.select(key, rank.alias("_tf_rank"), m.alias("_tf_m"))
    aggs = []
    for name, dtype in fields.items():
        named = F.array_contains(F.map_keys(F.col("_tf_m")), F.lit(name))
        value = F.element_at(F.col("_tf_m"), F.lit(name))
        aggs.append(F.max_by(value, F.when(named, F.col("_tf_rank"))).alias(f"_tf_{name}"))
    folded = parsed.groupBy(key).agg(*aggs)
    return folded.select(key, *[F.col(f"_tf_{n}").cast(t).alias(n) for n, t in fields.items()])


def job_progress(events: DataFrame) -> DataFrame:
    return events.withColumn("progress", progress_pct("step", "total_steps", "status"))


def failure_classes(events: DataFrame) -> DataFrame:
    failed = events.where(F.col("status") == "failed")
    return failed.groupBy(classify_failure("error").alias("message")).agg(F.count(F.lit(1)).alias("count"))


def active_guard(state: DataFrame) -> DataFrame:
    """One row: is any job queued/loading/running, and how many."""
    active = F.col("status").isin(*K.ACTIVE_STATUSES)
    return state.agg(F.coalesce(F.bool_or(active), F.lit(False)).alias("any_active"),
                     F.count_if(active).cast("bigint").alias("n_active"))


def status_transitions(events: DataFrame, key: str = "job_id", seq="seq",
                       allowed=K.ALLOWED_TRANSITIONS) -> DataFrame:
    """Counts of consecutive status pairs per job, flagged against the allowed
    pairs. ``seq`` is the ordering column (or columns). The previous status
    comes from the skew-safe ``neighbor_values`` (a ``lag`` inside quantile
    ranges of the order, edges patched from a small table), so a job with a
    huge history is never one task and rows are shuffled once."""
    order = [seq] if isinstance(seq, str) else list(seq)
    prev = neighbor_values(events.select(key, *order, "status"), [key], order, ["status"], -1, "prev_")
    pairs = prev.where(F.col("prev_exists"))
    counts = pairs.groupBy(F.col("prev_status").alias("from_status"), F.col("status").alias("to_status")) \
        .agg(F.count(F.lit(1)).alias("count"))
    pair_text = F.concat(F.col("from_status"), F.lit(">"), F.col("to_status"))
    return counts.withColumn("allowed", pair_text.isin(*[f"{a}>{b}" for a, b in allowed]))


def interrupted_jobs(state: DataFrame, live: DataFrame, key: str = "job_id") -> DataFrame:
    """Active jobs absent from the live set become ``failed`` with a fixed
    error and message; others keep their values. One left join, no union."""
    flags = live.select(F.col(key).alias("_live")).distinct()
    j = state.join(flags, F.col(key) == F.col("_live"), "left")
    orphan = F.col("status").isin(*K.ACTIVE_STATUSES) & F.col("_live").isNull()
    return j.select(
        *[c for c in state.columns if c not in ("status", "error")],
        F.when(orphan, F.lit("failed")).otherwise(F.col("status")).alias("status"),
        F.when(orphan, F.lit(K.INTERRUPTED_ERROR)).otherwise(F.col("error")).alias("error"),
        F.when(orphan, F.lit(K.INTERRUPTED_MESSAGE)).alias("message"))


def apply_deletes(state: DataFrame, deletes: DataFrame, key: str = "job_id") -> DataFrame:
    """``kept`` / ``deleted`` per job, and ``not_found`` per unknown delete id."""
    d = deletes.select(F.col(key).alias("_del")).distinct()
    marked = state.select(key).join(d, F.col(key) == F.col("_del"), "left") \
        .select(key, F.when(F.col("_del").isNull(), "kept").otherwise("deleted").alias("outcome"))
    unknown = d.join(state.select(key), F.col("_del") == F.col(key), "left_anti") \
        .select(F.col("_del").alias(key), F.lit("not_found").alias("outcome"))
    return marked.unionByName(unknown)


def trained_models(state: DataFrame, models: DataFrame, key: str = "job_id") -> DataFrame:
    """Completed jobs with a display name from their base model, newest first
    (ties by job id)."""
    m = models.select(F.col("model_id").alias("_m_id"), "repo_id", "model_type")
    done = state.where(F.col("status") == "completed")
    j = done.join(m, F.col("model_id") == F.col("_m_id"), "left")
    return j.select(key, "model_id", display_name("repo_id", "model_type").alias("model_name"),
                    F.date_format("created_at", TS_TEXT).alias("created_at"), F.col("created_at").alias("_created")) \
        .orderBy(F.col("_created").desc(), F.col(key)).drop("_created")


def run_labels(state: DataFrame, models: DataFrame, key: str = "job_id") -> DataFrame:
    """``<name> · run <first 8 chars of id> · <UTC date and time>``."""
    m = models.select(F.col("model_id").alias("_m_id"), "repo_id", "model_type")
    j = state.where(F.col("status") == "completed").join(m, F.col("model_id") == F.col("_m_id"), "left")
    when = F.when(F.col("created_at").isNotNull(),
                  F.concat(F.lit(" · "), F.date_format("created_at", "yyyy-MM-dd HH:mm"))).otherwise(F.lit(""))
    label = F.concat(display_name("repo_id", "model_type"), F.lit(" · run "),
                     F.substring(F.col(key).cast("string"), 1, 8), when)
    return j.select(key, label.alias("label"))


def default_model(state: DataFrame, models: DataFrame, key: str = "job_id") -> DataFrame:
    """The job a chat page opens with: the latest job if it completed, else
    the newest completed one. One global aggregation, then a join of one row."""
    done = F.col("status") == "completed"
    # Newest first, no time last; among equal times the smallest id, of any type.
    age = F.coalesce(-F.unix_micros(F.col("created_at").cast("timestamp")), F.lit((1 << 63) - 1))
    pick = state.agg(
        F.max_by(F.struct(F.col(key).alias("j"), F.col("status").alias("s"), F.col("model_id").alias("m")),
                 F.struct("created_at", key)).alias("latest"),
        F.min_by(F.struct(F.col(key).alias("j"), F.col("model_id").alias("m")),
                 F.when(done, F.struct(age, F.col(key)))).alias("newest_done"))
    chosen = pick.select(
        F.when(F.col("latest.s") == "completed", F.col("latest.j")).otherwise(F.col("newest_done.j")).alias(key),
        F.when(F.col("latest.s") == "completed", F.col("latest.m")).otherwise(F.col("newest_done.m")).alias("model_id")
    ).where(F.col(key).isNotNull())
    m = models.select(F.col("model_id").alias("_m_id"), "repo_id", "model_type")
    return chosen.join(m, F.col("model_id") == F.col("_m_id"), "left") \
        .select(key, display_name("repo_id", "model_type").alias("model_name"))


def exportable_jobs(requested: DataFrame, state: DataFrame, folders: DataFrame, key: str = "job_id") -> DataFrame:
    """Per requested id: ``not_found`` / ``not_completed`` / ``folder_missing``
    / ``ok``, checked in that order."""
    s = state.select(F.col(key).alias("_s_id"), "status")
    f = folders.select(F.col(key).alias("_f_id")).distinct()
    j = requested.join(s, F.col(key) == F.col("_s_id"), "left").join(f, F.col(key) == F.col("_f_id"), "left")
    outcome = (F.when(F.col("_s_id").isNull(), "not_found").when(F.col("status") != "completed", "not_completed")
               .when(F.col("_f_id").isNull(), "folder_missing").otherwise("ok"))
    return j.select(key, outcome.alias("outcome"))


def resolve_requests(requests: DataFrame, datasets: DataFrame, models: DataFrame,
                     id_ok=lambda c: c.isNotNull() & (c >= 0)) -> DataFrame:
    """Per training request, the first failing check in order:
    ``bad_dataset_id``, ``dataset_not_found``, ``dataset_not_valid``,
    ``bad_model_id``, ``model_not_found``, ``no_config``, else ``ok``.

    ``datasets``: ``(file_id, valid)``, one row per stored dataset file.
    ``models``: ``(model_id, model_type)``; a null ``model_type`` means the
    model folder has no config."""
    ds = datasets.select(F.col("file_id").alias("_d_id"), F.col("valid").alias("_d_valid"))
    ms = models.select(F.col("model_id").alias("_m_id"), F.col("model_type").alias("_m_type"))
    j = requests.join(ds, F.col("dataset_id") == F.col("_d_id"), "left") \
        .join(ms, F.col("model_id") == F.col("_m_id"), "left")
    outcome = (F.when(~F.coalesce(id_ok(F.col("dataset_id")), F.lit(False)), "bad_dataset_id")
               .when(F.col("_d_id").isNull(), "dataset_not_found")
               .when(~F.coalesce(F.col("_d_valid"), F.lit(False)), "dataset_not_valid")
               .when(~F.coalesce(id_ok(F.col("model_id")), F.lit(False)), "bad_model_id")
               .when(F.col("_m_id").isNull(), "model_not_found")
               .when(F.col("_m_type").isNull(), "no_config").otherwise("ok"))
    return j.select("request_id", outcome.alias("outcome"))


def latest_job(state: DataFrame, key: str = "job_id", created: str = "created_at") -> DataFrame:
    """The job with the latest creation time (ties: the larger id), as one
    row with all state columns; no row when there are no jobs (E8). A single
    global aggregation: partial maxima per task, one tiny final merge."""
    cols = [c for c in state.columns]
    best = state.agg(F.max_by(F.struct(*cols), F.struct(created, key)).alias("_j"))
    return best.where(F.col("_j").isNotNull()).select("_j.*")


def restore_jobs(spark, runs_dir: str) -> DataFrame:
    """Persisted job states as a service restart sees them (A5 + D4): every
    job still queued, loading or running has no live worker, so it becomes
    ``failed`` with the fixed interruption error and message."""
    from tuneframe.sources.files import read_job_states
    jobs = read_job_states(spark, runs_dir)
    orphan = F.col("status").isin(*K.ACTIVE_STATUSES)
    out = jobs.withColumn("error", F.when(orphan, F.lit(K.INTERRUPTED_ERROR)).otherwise(F.col("error"))) \
        .withColumn("message", F.when(orphan, F.lit(K.INTERRUPTED_MESSAGE)).otherwise(F.col("message")))
    return out.withColumn("status", F.when(orphan, F.lit("failed")).otherwise(F.col("status")))
