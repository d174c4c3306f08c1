"""Queries over files: written from the test tables, then read by the library.

Every query writes its files into the shared checkpoint folder and reads them
with the library's own readers, so the rows show what comes out of real files.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tuneframe import constants as K
from tuneframe import sinks
from tuneframe.functions.text import split_stored_name
from tuneframe.operators import artifacts as A
from tuneframe.operators import jobs as J
from tuneframe.operators import models as M
from tuneframe.operators import render as RO
from tuneframe.operators import validation as V
from tuneframe.plans import fixtures as FX
from tuneframe.plans.catalog import query
from tuneframe.plans.files import kept, put_files, work_folder
from tuneframe.plans.oracle_views import with_views
from tuneframe.plans.q_jobs import _STATE, _state
from tuneframe.plans.q_validation import _KIND, EXPECTED, REQUIRED, UTF8_HEX
from tuneframe.plans.sqltext import strip
from tuneframe.sources import files as S
from tuneframe.sources import weights as W

def none():
    return F.lit(None).cast("binary")


# --- lines of files (A1, A2) -------------------------------------------------------------

FILE_ROWS = 2000
#: Input splits this small part every file, so numbers must carry over from split to split.
SPLIT_BYTES = 16_384


@query("file_lines",
       f"SELECT event_id // {FILE_ROWS} AS file, cast(row_number() OVER (PARTITION BY event_id // {FILE_ROWS} ORDER BY event_id) "
       "AS BIGINT) AS line_no, CASE WHEN event_id % 61 = 3 THEN '' ELSE event_id || ' ' || event_type || ' ' || props END AS line "
       "FROM events")
def q_file_lines(spark, d):
    e = F.col("event_id")
    text = F.when(e % 61 == 3, "").otherwise(F.concat_ws(" ", e.cast("string"), "event_type", "props"))
    rows = FX.table(spark, d, "events").select(F.floor(e / FILE_ROWS).alias("part"), e, F.concat(
        # some files begin with a byte-order mark, some lines end as they do elsewhere
        F.when((e % FILE_ROWS == 0) & (e % 3 == 0), S.BOM).otherwise(""), text, F.when(e % 50 == 7, "\r").otherwise("")).alias("value"))
    folder = work_folder(spark, "lines")
    rows.repartition("part").sortWithinPartitions("part", "event_id").select("part", "value") \
        .write.partitionBy("part").text(folder)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(SPLIT_BYTES))
    try:
        lines = kept(S.read_lines(spark, folder))
    finally:
        spark.conf.set(key, before)
    return lines.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("file"), "line_no", "line")


# --- stored datasets (A3, C5, E1) ----------------------------------------------------------

_BAD_BYTE = "CASE WHEN event_id % 211 = 1 THEN 'C3' WHEN event_id % 223 = 2 THEN 'EDA080' WHEN event_id % 19 = 3 THEN 'C3A9' ELSE '' END"
_STORED = (("numbered", "SELECT event_id, user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line_no FROM events"),
           ("bytes", f"SELECT file_id, line_no, line, hex(encode(line)) || {_BAD_BYTE} AS h, event_id % 19 = 3 AS longer FROM raw_lines "
                     "JOIN numbered USING (file_id, line_no)"),
           ("checked", f"SELECT file_id, line_no, h, regexp_full_match(h, '{UTF8_HEX}') AS sound, line || CASE WHEN longer THEN 'é' ELSE '' END AS line FROM bytes"),
           ("kinds", f"SELECT file_id, line_no, sound, length(h) // 2 + 1 AS size, CASE WHEN length({strip('line')}) = 0 THEN NULL ELSE {_KIND} END AS kind, line FROM checked"),
           ("files", "SELECT file_id, bool_and(sound) AS utf8_ok, cast(sum(size) AS BIGINT) AS size_bytes, count(*) FILTER (WHERE kind = 'ok') AS n, "
                     "count(*) FILTER (WHERE kind <> 'ok') AS n_bad, arg_min(kind, line_no) FILTER (WHERE kind <> 'ok') AS first_kind, "
                     "min(line_no) FILTER (WHERE kind <> 'ok') AS first_line, "
                     "bool_or(kind = 'ok' AND NOT list_contains(json_keys(CASE WHEN kind = 'ok' THEN line ELSE '{}' END), 'k')) AS no_k "
                     "FROM kinds GROUP BY file_id"))


def stored_files(spark, d):
    """A dataset folder: one file a user, some lines broken, some with bytes
    that are no UTF-8, some files under names that are not stored datasets."""
    e, line = F.col("event_id"), F.col("line")
    extra = F.when(e % 211 == 1, F.unhex(F.lit("C3"))).when(e % 223 == 2, F.unhex(F.lit("EDA080"))) \
        .when(e % 19 == 3, F.unhex(F.lit("C3A9"))).otherwise(F.unhex(F.lit("")))
    lines = FX.raw_lines(spark, d, numbered=False, keep=("event_id",)).select(
        "file_id", F.struct(e, F.concat(line.cast("binary"), extra, F.unhex(F.lit("0A"))).cast("string").alias("line")).alias("x"))
    k = F.col("file_id")
    name = F.concat(F.when(k % 10 == 7, "draft").otherwise(F.md5(k.cast("string"))), F.lit("_set "), k.cast("string"),
                    F.lit(".jsonl"), F.when(k % 10 == 3, ".part").otherwise(""))
    files = lines.groupBy("file_id").agg(F.array_join(F.sort_array(F.collect_list("x"))["line"], "").cast("binary").alias("body"))
    return put_files(files.select(name.alias("path"), none().alias("head"), "body"), work_folder(spark, "datasets"))


_VERDICT_SQL = (
    "SELECT md5(cast(file_id AS VARCHAR)) AS upload_id, 'set ' || file_id || '.jsonl' AS filename, {size}"
    "CASE WHEN NOT utf8_ok THEN 'utf8' WHEN n_bad > 0 THEN first_kind END AS error, "
    "CASE WHEN utf8_ok AND n_bad > 0 THEN first_line END AS error_line, CASE WHEN utf8_ok THEN n END AS record_count, "
    "CASE WHEN utf8_ok THEN CASE WHEN no_k THEN 'k' ELSE '' END END AS missing_fields, "
    f"utf8_ok AND n_bad = 0 AND n > 0 AND NOT no_k AND n = {EXPECTED} AS valid FROM files WHERE file_id % 10 NOT IN (3, 7)")


def _shown(v, *more):
    sound = F.col("error").isNull() | (F.col("error") != "utf8")
    return v.select("upload_id", "filename", *more, "error", F.when(sound, F.col("error_line")).alias("error_line"),
                    F.when(sound, F.col("record_count")).alias("record_count"),
                    F.when(sound, F.col("missing_fields")).alias("missing_fields"),
                    (F.col("valid") & F.col("error").isNull()).alias("valid"))


@query("dataset_files", with_views(_VERDICT_SQL.format(size="size_bytes, "), "raw_lines", extra=_STORED))
def q_dataset_files(spark, d):
    return _shown(V.validate_files(spark, stored_files(spark, d), REQUIRED, EXPECTED), "size_bytes")


@query("dataset_stream", with_views(_VERDICT_SQL.format(size=""), "raw_lines", extra=_STORED))
def q_dataset_stream(spark, d):
    from tuneframe.streaming.validate import stream_validate
    out = work_folder(spark, "stream-verdicts")
    stream_validate(spark, stored_files(spark, d), f"{out}/out", f"{out}/checkpoint", REQUIRED, EXPECTED).awaitTermination()
    v = spark.read.parquet(f"{out}/out/verdicts")
    name = split_stored_name(F.substring_index("file_id", "/", -1))[1]
    return _shown(v.withColumn("filename", name).withColumn("error_line", F.when(F.col("utf8_ok"), F.col("first_bad_line"))))


# --- model folders (A6 to A9, C13, C14, D2, E4) --------------------------------------------

_T = '{{"{}": {{"dtype": "F32", "shape": [4, 4], "data_offsets": [0, {}]}}, "__metadata__": {{"format": "pt"}}}}'


def model_folders(spark, d):
    """One upload folder a supplier, by its number sound or broken in one way."""
    k, kind = F.col("s_suppkey"), F.col("s_suppkey") % 13
    nation = FX.table(spark, d, "nation").select(F.col("n_nationkey").alias("nk"), F.lower("n_name").alias("model_type"))
    s = FX.table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("nk"))

    def file(path, text, when=None, head=None):
        row = F.struct(path if not isinstance(path, str) else F.lit(path),
                       (head if head is not None else F.lit(None).cast("string")).cast("binary").alias("head"),
                       (text if not isinstance(text, str) else F.lit(text)).cast("binary").alias("body"))
        row = F.struct(row["col1"].alias("path"), row["head"], row["body"])
        return row if when is None else F.when(when, row)

    data = F.repeat(F.lit("x"), 64)
    config = F.when(kind == 1, "[1, 2").when(kind == 2, '{"architectures": ["AForCausalLM"]}').otherwise(F.concat(
        F.lit('{"model_type": "'), "model_type", F.lit('", "architectures": ["'), F.when(kind == 3, "BertModel").otherwise("AForCausalLM"),
        F.lit('"]}')))
    tensors = F.when(kind == 9, F.lit(_T.format("w", 65))).otherwise(F.lit(_T.format("w", 64)))
    index = F.when(kind == 7, '{"weight_map": {}}').when(kind == 8, F.concat(
        F.lit('{"weight_map": {"a": "model.safetensors", "b": "gone-'), k.cast("string"), F.lit('.bin", "c": "away.bin"}}'))) \
        .otherwise('{"weight_map": {"a": "model.safetensors"}}')
    files = F.array_compact(F.array(
        file("README.md", "read me"), file("sub/config.json", config, kind != 0),
        file("sub/Model.safetensors", data, kind == 11, tensors),
        file("sub/model.safetensors", data, (kind != 4) & (kind != 11), tensors),
        file("sub/extra.bin", F.when(kind == 10, "GARBAGE").otherwise("PK\x03\x04rest"), kind >= 10),
        file("sub/tokenizer.json", F.when(kind == 6, "[]").otherwise('{"version": 1}'), (kind != 5) & (kind != 12)),
        file("sub/vocab.json", "{}", kind == 12), file("sub/merges.txt", "a b", kind == 12),
        file("sub/model.safetensors.index.json", index, (kind == 7) | (kind == 8) | (kind == 12))))
    rows = s.select(F.md5(k.cast("string")).alias("u"), F.explode(files).alias("f"))
    return put_files(rows.select(F.concat("u", F.lit("/"), "f.path").alias("path"), "f.head", "f.body"), work_folder(spark, "models"))


_FOLDER_SQL = (
    "SELECT md5(cast(s_suppkey AS VARCHAR)) AS upload_id, CASE k WHEN 0 THEN 'no_config' WHEN 1 THEN 'config_invalid' "
    "WHEN 2 THEN 'no_model_type' WHEN 3 THEN 'not_causal_lm' WHEN 4 THEN 'no_weights' WHEN 5 THEN 'no_tokenizer' "
    "WHEN 6 THEN 'tokenizer_invalid' WHEN 7 THEN 'index_invalid' WHEN 8 THEN 'missing_shards' WHEN 9 THEN 'weight_invalid' "
    "WHEN 10 THEN 'weight_invalid' END AS error, CASE k WHEN 8 THEN 'away.bin, gone-' || s_suppkey || '.bin' "
    "WHEN 9 THEN 'model.safetensors' WHEN 10 THEN 'extra.bin' END AS detail, "
    "CASE WHEN k NOT IN (0, 1, 2) THEN lower(n_name) END AS model_type, "
    "cast(CASE WHEN k = 0 THEN NULL WHEN k = 4 THEN 0 WHEN k >= 10 THEN 2 ELSE 1 END AS BIGINT) AS weight_file_count, "
    "CASE WHEN k IN (0, 5, 12) THEN '' ELSE 'tokenizer.json' END AS tokenizer_files, k IN (7, 8, 12) AS sharded "
    "FROM (SELECT *, s_suppkey % 13 AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey) t")


@query("model_folders", _FOLDER_SQL)
def q_model_folders(spark, d):
    v = M.validate_model_dirs(spark, model_folders(spark, d))
    return v.select("upload_id", "error", "detail", "model_type", "weight_file_count", "tokenizer_files", "sharded")


@query("folder_listing",
       "SELECT md5(cast(s_suppkey AS VARCHAR)) || '/' || f.path AS rel_path, f.name, cast(f.size AS BIGINT) AS size FROM "
       "(SELECT s_suppkey, s_suppkey % 13 AS k, length(n_name) AS t FROM supplier JOIN nation ON s_nationkey = n_nationkey) s, LATERAL "
       "(SELECT unnest([{'path': 'README.md', 'name': 'readme.md', 'size': 7, 'ok': true}, "
       "{'path': 'sub/config.json', 'name': 'config.json', 'size': CASE k WHEN 1 THEN 5 WHEN 2 THEN 35 "
       "ELSE 38 + t + CASE WHEN k = 3 THEN 9 ELSE 12 END + 3 END, 'ok': k <> 0}, "
       "{'path': 'sub/merges.txt', 'name': 'merges.txt', 'size': 3, 'ok': k = 12}]) AS f) x WHERE f.ok")
def q_folder_listing(spark, d):
    files = S.list_artifacts(spark, model_folders(spark, d))
    return files.where(F.col("name").isin("readme.md", "config.json", "merges.txt")).select("rel_path", "name", "size")


HEADER_TENSORS = 500  # tensors declared by one file


@query("tensor_headers",
       f"SELECT vec_id // {HEADER_TENSORS} AS file, 'layer.' || vec_id || '.weight' AS name, "
       "CASE WHEN vec_id % 7 <> 1 THEN vec_id * 4 END AS off_begin, CASE WHEN vec_id % 7 <> 1 THEN vec_id * 4 + len(embedding) END AS off_end, "
       "CASE WHEN vec_id % 11 <> 2 THEN '2,' || len(embedding) END AS shape FROM embeddings "
       f"WHERE vec_id // {HEADER_TENSORS} NOT IN (SELECT vec_id // {HEADER_TENSORS} FROM embeddings WHERE vec_id = {HEADER_TENSORS + 7})")
def q_tensor_headers(spark, d):
    v, n = F.col("vec_id"), F.size("embedding").cast("string")
    entry = F.concat(F.lit('"layer.'), v.cast("string"), F.lit('.weight": {"dtype": "F16", "shape": '),
                     F.when(v % 11 == 2, F.lit("[2, 3.0]")).otherwise(F.concat(F.lit("[2, "), n, F.lit("]"))), F.lit(', "data_offsets": '),
                     F.when(v % 7 == 1, F.lit("[0, true, 1]")).otherwise(F.concat(
                         F.lit("["), (v * 4).cast("string"), F.lit(", "), (v * 4 + F.size("embedding")).cast("string"), F.lit("]"))),
                     # one header breaks off behind its first tensors: none of them counts
                     F.when(v == HEADER_TENSORS + 7, F.lit("")).otherwise(F.lit("}")))
    rows = FX.table(spark, d, "embeddings").select(F.floor(v / HEADER_TENSORS).alias("file"), F.struct(v, entry.alias("e")).alias("x"))
    head = F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list("x"))["e"], ", "), F.lit("}  "))
    files = rows.groupBy("file").agg(head.cast("binary").alias("head")).select(
        F.concat(F.lit("m/"), F.col("file").cast("string"), F.lit(".safetensors")).alias("path"), "head", F.lit("data").cast("binary").alias("body"))
    heads = kept(W.read_weight_heads(spark, put_files(files, work_folder(spark, "headers"))))
    return W.tensor_rows(heads).select(F.regexp_extract("path", r"(\d+)\.safetensors$", 1).cast("long").alias("file"), "name",
                                       "off_begin", "off_end", F.array_join(F.col("shape").cast("array<string>"), ",").alias("shape"))


# --- manifests and job documents (A4, A5, B1) ----------------------------------------------

_LISTED = ("SELECT upload_id, count(*) AS file_count, cast(sum(size) AS BIGINT) AS size_bytes, "
           "CASE WHEN count(*) <= 4000 THEN array_to_string(list(path ORDER BY path), ',') END AS files FROM artifacts GROUP BY upload_id")


@query("manifest_sink", with_views(f"SELECT upload_id, file_count, size_bytes, files FROM ({_LISTED}) t", "artifacts"))
def q_manifest_sink(spark, d):
    folder = work_folder(spark, "manifests")
    out = A.upload_manifests(FX.artifacts(spark, d)).withColumn("source", F.when(F.col("upload_id") < "src5", "hub").otherwise("upload"))
    sinks.write_manifests(out, folder)
    return spark.read.schema(S.MANIFEST_SCHEMA).json(folder).select("upload_id", "file_count", "size_bytes",
                                                                      F.array_join("files", ",").alias("files"))


@query("manifest_documents",
       "SELECT md5(cast(s_suppkey AS VARCHAR)) AS folder, CASE WHEN s_suppkey % 9 <> 4 THEN s_name END AS repo_id, "
       "CASE WHEN s_suppkey % 9 <> 4 THEN cast(s_nationkey AS BIGINT) END AS file_count, s_suppkey % 9 = 4 AS unreadable "
       "FROM supplier WHERE s_suppkey % 9 <> 5")
def q_manifest_documents(spark, d):
    k = F.col("s_suppkey")
    text = F.to_json(F.struct(F.md5(k.cast("string")).alias("upload_id"), F.col("s_name").alias("repo_id"),
                              F.col("s_nationkey").cast("long").alias("file_count"), F.array(F.lit("a"), F.lit("b")).alias("files")), {"pretty": "true"})
    body = F.when(k % 9 == 4, F.concat(text, F.lit("}{"))).when(k % 9 == 5, F.lit("other")).otherwise(text)
    body = F.when(k % 9 == 4, F.concat(F.lit("["), F.substring(text, 1, 12))).otherwise(body)
    name = F.when(k % 9 == 5, "notes.json").otherwise("upload-manifest.json")
    files = FX.table(spark, d, "supplier").select(F.concat_ws("/", F.md5(k.cast("string")), name).alias("path"), none().alias("head"),
                                                  body.cast("binary").alias("body"))
    m = S.read_manifests(spark, put_files(files, work_folder(spark, "uploads")))
    return m.select(F.element_at(F.split("manifest_path", "/"), -2).alias("folder"), "repo_id", "file_count",
                    F.col("error").isNotNull().alias("unreadable"))


@query("job_documents", with_views(
    "SELECT md5(cast(job_id AS VARCHAR)) AS job_id, CASE WHEN status IN ('queued', 'loading', 'running') THEN 'failed' ELSE status END AS status, "
    "cast(step AS BIGINT) AS step, loss, CASE WHEN status IN ('queued', 'loading', 'running') "
    f"THEN '{K.INTERRUPTED_ERROR}' ELSE error END AS error FROM state WHERE job_id % 8 NOT IN (1, 2, 3)", "job_events", extra=(("state", _STATE),)))
def q_job_documents(spark, d):
    k, uid = F.col("job_id"), F.md5(F.col("job_id").cast("string"))
    state = _state(spark, d)
    text = F.to_json(F.struct(F.when(k % 8 == 1, F.md5(F.lit("other"))).otherwise(uid).alias("job_id"), "status",
                              F.col("step").cast("long").alias("step"), "loss", "error"), {"ignoreNullFields": "false"})
    text = F.when(k % 8 == 2, F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    folder = F.when(k % 8 == 3, F.concat(F.lit("run-"), k.cast("string"))).otherwise(uid)
    files = state.select(F.concat(folder, F.lit("/job.json")).alias("path"), none().alias("head"), text.cast("binary").alias("body"))
    return J.restore_jobs(spark, put_files(files, work_folder(spark, "runs"))).select("job_id", "status", "step", "loss", "error")


@query("training_shards", with_views("SELECT count(*) AS texts, cast(sum(length(input)) AS BIGINT) AS chars, 4 AS shards, true AS in_order FROM records",
                                     "records"))
def q_training_shards(spark, d):
    """The training table as four files of ascending key ranges."""
    rows = FX.records(spark, d)
    folder = work_folder(spark, "training")
    sinks.write_training_text(rows.select("record_id", F.concat(F.lpad(F.col("record_id").cast("string"), 20, "0"), F.lit(" "), "input").alias("text")),
                              folder, 4)
    got = spark.read.parquet(folder).select(F.col("_metadata.file_name").alias("file"), F.substring("text", 1, 20).alias("key"),
                                            (F.length("text") - 21).alias("n"))
    per = got.groupBy("file").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    # One row a file, in the order of the files' numbers.
    after = F.col("low") > F.lag("high").over(Window.orderBy("file"))
    return per.withColumn("after", F.coalesce(after, F.lit(True))).agg(
        F.sum("rows").alias("texts"), F.sum("n").cast("long").alias("chars"), F.count(F.lit(1)).cast("int").alias("shards"),
        F.bool_and("after").alias("in_order"))


# --- job events as streams (T1 with B2, T2, T4) --------------------------------------------

def event_stream(spark, d, files: int = 4):
    """The job events as a stream of JSON files, and a last event far behind
    all others, which lets the watermark pass them."""
    from tuneframe.streaming.jobs import EVENT_SCHEMA
    folder = work_folder(spark, "events")
    ev = FX.job_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).drop("event_id")
    ev.repartition(files).write.json(folder)
    end = spark.range(1).select(F.lit(-1).cast("long").alias("job_id"), F.lit(1).cast("long").alias("seq"),
                                F.lit("2099-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit("completed").alias("status"))
    end.coalesce(1).write.mode("append").json(folder)
    return spark.readStream.schema(EVENT_SCHEMA).json(folder)


def _drained(stream, spark, name):
    """All rows of a finite stream, through a Parquet sink."""
    folder = work_folder(spark, name)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows") \
        .trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


@query("stream_job_table", with_views("SELECT job_id, status, loss, step, error FROM state", "job_events", extra=(("state", _STATE),)))
def q_stream_job_table(spark, d):
    from tuneframe.streaming.jobs import sink_job_state
    folder = work_folder(spark, "job-table")
    sink_job_state(event_stream(spark, d), f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    sinks.compact(spark, f"{folder}/rows", f"{folder}/compacted")
    return sinks.read_latest(spark, f"{folder}/compacted").where("job_id >= 0").select("job_id", "status", "loss", "step", "error")


_ALLOWED = "(" + ", ".join(f"'{a}>{b}'" for a, b in K.ALLOWED_TRANSITIONS) + ")"


@query("stream_transitions", with_views(
    f"SELECT job_id, from_status, to_status, from_status || '>' || to_status IN {_ALLOWED} AS allowed, count(*) AS count "
    "FROM (SELECT job_id, lag(status) OVER (PARTITION BY job_id ORDER BY seq) AS from_status, status AS to_status "
    "FROM job_events) t WHERE from_status IS NOT NULL GROUP BY job_id, from_status, to_status", "job_events"))
def q_stream_transitions(spark, d):
    from tuneframe.streaming.jobs import stream_transitions
    rows = _drained(stream_transitions(event_stream(spark, d)), spark, "transitions")
    return rows.groupBy("job_id", "from_status", "to_status", "allowed").agg(F.count(F.lit(1)).alias("count"))


_ACTIVE = "(" + ", ".join(f"'{s}'" for s in K.ACTIVE_STATUSES) + ")"


@query("stream_interrupted", with_views(
    f"SELECT job_id, 'failed' AS status, '{K.INTERRUPTED_ERROR}' AS error FROM state WHERE status IN {_ACTIVE}",
    "job_events", extra=(("state", _STATE),)))
def q_stream_interrupted(spark, d):
    from tuneframe.streaming.jobs import stream_interrupted
    return _drained(stream_interrupted(event_stream(spark, d)), spark, "interrupted").select("job_id", "status", "error")
