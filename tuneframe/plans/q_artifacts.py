"""Artifact queries over ``artifacts``, ``shard_index``/``shard_files`` and ``tensors``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tuneframe import constants as K
from tuneframe.operators import artifacts as A
from tuneframe.operators import validation as V
from tuneframe.plans import fixtures as FX
from tuneframe.plans.catalog import query
from tuneframe.plans.oracle_views import with_views

_NAME = "lower(regexp_extract(path, '([^/]*)$', 1))"
_W = "(name LIKE '%.safetensors' OR name LIKE '%.bin')"


@query("listing_filter", with_views(
    "SELECT upload_id, files, CASE WHEN files = 0 THEN 'empty' WHEN files > 4000 THEN 'too_many' ELSE 'ok' END AS status "
    "FROM (SELECT upload_id, count(*) FILTER (WHERE type = 'file' AND NOT starts_with(path, '.git/')) AS files FROM ("
    "SELECT upload_id, CASE WHEN pos % 11 = 0 THEN 'directory' ELSE 'file' END AS type, "
    "CASE WHEN pos % 13 = 0 THEN '.git/' || path ELSE path END AS path FROM artifacts) e GROUP BY upload_id) t",
    "artifacts"))
def q_listing_filter(spark, d):
    art = FX.artifacts(spark, d)
    pos = F.col("pos")
    entries = art.select("upload_id", F.when(pos % 11 == 0, "directory").otherwise("file").alias("type"),
                         F.when(pos % 13 == 0, F.concat(F.lit(".git/"), F.col("path"))).otherwise(F.col("path")).alias("path"))
    return V.filter_listing(entries, "upload_id")


@query("artifact_listing", with_views(
    f"SELECT upload_id, pos, name, CASE WHEN {_W} THEN 'weights' WHEN name LIKE '%.json' THEN 'json' ELSE 'other' END "
    f"AS suffix_class FROM (SELECT upload_id, pos, {_NAME} AS name FROM artifacts) t", "artifacts"))
def q_artifact_listing(spark, d):
    return A.artifact_listing(FX.artifacts(spark, d)).select("upload_id", "pos", "name", "suffix_class")


UPLOAD_CAP = 100_000


@query("upload_sizes", with_views(
    "SELECT upload_id, files, bytes, round(cast(bytes AS DOUBLE) / 1073741824.0, 2) AS gib, "
    f"bytes > {UPLOAD_CAP} AS over_cap FROM (SELECT upload_id, count(*) AS files, "
    "cast(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM artifacts GROUP BY upload_id) t", "artifacts"))
def q_upload_sizes(spark, d):
    return A.upload_totals(FX.artifacts(spark, d), byte_cap=UPLOAD_CAP).select("upload_id", "files", "bytes", "gib",
                                                                              "over_cap")


BUDGET_CAP = 50_000


@query("byte_budget", with_views(
    f"SELECT upload_id, min(pos) FILTER (WHERE running > {BUDGET_CAP}) AS first_over_pos, "
    f"cast(arg_min(running, pos) FILTER (WHERE running > {BUDGET_CAP}) AS BIGINT) AS running_bytes FROM ("
    "SELECT upload_id, pos, sum(size) OVER (PARTITION BY upload_id ORDER BY pos "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM artifacts) r GROUP BY upload_id", "artifacts"))
def q_byte_budget(spark, d):
    return A.byte_budget(FX.artifacts(spark, d), cap=BUDGET_CAP)


_TOK = "(" + ", ".join(f"'{t}'" for t in K.TOKENIZER_FILES) + ")"


@query("model_manifest", with_views(
    f"SELECT upload_id, count(*) FILTER (WHERE {_W}) AS weight_count, bool_or(name LIKE '%.json') AS has_json, "
    f"bool_or(pos % 17 = 0) AS sharded, bool_or(name IN {_TOK}) OR (bool_or(name = '{K.TOKENIZER_PAIR[0]}') AND "
    f"bool_or(name = '{K.TOKENIZER_PAIR[1]}')) AS tokenizer_ok, "
    f"coalesce(array_to_string(list_sort(list(DISTINCT name) FILTER (WHERE name IN {_TOK})), ','), '') AS tokenizer_files "
    f"FROM (SELECT upload_id, pos, {_NAME} AS name FROM named) t GROUP BY upload_id", "artifacts",
    extra=(("named", "SELECT upload_id || '-' || cast(pos % 40 AS VARCHAR) AS upload_id, pos, path || CASE "
                     "WHEN pos % 19 = 0 THEN '/Tokenizer.json' WHEN pos % 23 = 1 THEN '/spiece.model' "
                     "WHEN pos % 3 = 0 THEN '/vocab.json' WHEN pos % 4 = 1 THEN '/merges.txt' ELSE '' END AS path "
                     "FROM artifacts"),)))
def q_model_manifest(spark, d):
    pos = F.col("pos")
    extra = (F.when(pos % 19 == 0, "/Tokenizer.json").when(pos % 23 == 1, "/spiece.model")
             .when(pos % 3 == 0, "/vocab.json").when(pos % 4 == 1, "/merges.txt").otherwise(""))
    files = FX.artifacts(spark, d).select(
        F.concat("upload_id", F.lit("-"), (pos % 40).cast("string")).alias("upload_id"), "pos",
        F.concat("path", extra).alias("path"))
    return A.model_manifest(files, is_index=(F.col("pos") % 17 == 0))


# Uploads made of order lines: a supplier's lines are some hundred files, a
# return flag's some thousand, more than an upload may have.
_LINES = ("SELECT CASE WHEN l_linenumber <= 2 THEN 'flag ' || l_returnflag ELSE 'supplier ' || l_suppkey END AS upload_id, "
          "l_orderkey || '/' || l_partkey || '-' || l_linenumber || '.bin' AS path, cast(l_quantity * 4000000 AS BIGINT) AS size FROM lineitem")


@query("upload_manifests", (
    "SELECT upload_id, count(*) AS file_count, cast(sum(size) AS BIGINT) AS size_bytes, "
    f"CASE WHEN count(*) <= {K.MAX_MODEL_FILES} THEN array_to_string(list(path ORDER BY path), ',') END AS files, "
    f"sum(size) > {K.MAX_MODEL_BYTES} AS over_cap, count(*) > {K.MAX_MODEL_FILES} AS too_many_files FROM ({_LINES}) t GROUP BY upload_id"))
def q_upload_manifests(spark, d):
    line = FX.table(spark, d, "lineitem")
    upload = F.when(F.col("l_linenumber") <= 2, F.concat(F.lit("flag "), "l_returnflag")).otherwise(
        F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")))
    path = F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_partkey").cast("string"), F.lit("-"),
                    F.col("l_linenumber").cast("string"), F.lit(".bin"))
    files = line.select(upload.alias("upload_id"), path.alias("path"), (F.col("l_quantity") * 4_000_000).cast("bigint").alias("size"))
    return A.upload_manifests(files).withColumn("files", F.array_join("files", ","))


_PAIRED = with_views(
    "SELECT f.upload_id, cast(f.ordinal AS BIGINT) AS ordinal, f.file, p.path, "
    "coalesce(nf.n = np.n, false) AS lengths_match "
    "FROM f LEFT JOIN p ON f.upload_id = p.upload_id AND f.ordinal = p.ordinal "
    "JOIN nf ON f.upload_id = nf.upload_id LEFT JOIN np ON f.upload_id = np.upload_id", "artifacts",
    extra=(("f", "SELECT upload_id, row_number() OVER (PARTITION BY upload_id ORDER BY pos) AS ordinal, "
                 "'blob-' || cast(pos AS VARCHAR) AS file FROM artifacts"),
           ("p0", "SELECT * FROM artifacts WHERE NOT (upload_id = 'src0' AND pos = "
                  "(SELECT max(pos) FROM artifacts WHERE upload_id = 'src0'))"),
           ("p", "SELECT upload_id, row_number() OVER (PARTITION BY upload_id ORDER BY pos) AS ordinal, path FROM p0"),
           ("nf", "SELECT upload_id, count(*) AS n FROM f GROUP BY upload_id"),
           ("np", "SELECT upload_id, count(*) AS n FROM p GROUP BY upload_id")))


@query("paired_files", _PAIRED)
def q_paired_files(spark, d):
    art = FX.artifacts(spark, d)
    files = art.select("upload_id", "pos", F.concat(F.lit("blob-"), F.col("pos").cast("string")).alias("file"))
    last_src0 = art.where(F.col("upload_id") == "src0").groupBy("upload_id").agg(F.max("pos").alias("pos"))
    paths = art.select("upload_id", "pos", "path").join(last_src0, ["upload_id", "pos"], "left_anti")
    return A.pair_files(files, paths).select("upload_id", "ordinal", "file", "path", "lengths_match")


@query("archive_members", with_views(
    f"SELECT upload_id, '{K.ADAPTER_ARCHIVE_PREFIX}' || path AS member, "
    "cast(row_number() OVER (PARTITION BY upload_id ORDER BY path) AS BIGINT) AS ordinal FROM artifacts", "artifacts"))
def q_archive_members(spark, d):
    return A.archive_members(FX.artifacts(spark, d))


@query("missing_shards", with_views(
    "SELECT index_dir, count(*) AS n_missing, array_to_string(list_slice(list_sort(list(shard)), 1, 5), ', ') "
    "AS first_missing FROM m GROUP BY index_dir", "shard_index", "shard_files",
    extra=(("m", "SELECT DISTINCT index_dir, shard FROM shard_index EXCEPT SELECT dir, name FROM shard_files"),)))
def q_missing_shards(spark, d):
    return A.missing_shards(FX.shard_index(spark, d), FX.shard_files(spark, d))


_PROBLEM = ("CASE WHEN off_begin IS NULL OR off_end IS NULL THEN 'bad_offsets' WHEN off_begin < 0 THEN 'negative_begin' WHEN off_end < off_begin THEN 'end_before_begin' "
            "WHEN off_end > data_size THEN 'end_past_data' WHEN dims < 0 THEN 'bad_shape' ELSE 'ok' END")


def _checked(spark, d):
    v = F.col("vec_id")
    t = FX.tensors(spark, d).withColumns({
        "off_begin": F.when(v % 43 == 1, F.lit(-5)).when(v % 47 != 2, F.col("off_begin")),
        "data_size": F.col("data_size") - 20_000,
        "shape": F.array(F.when(v % 37 == 3, F.lit(-1)).otherwise(F.col("dims")))})
    return V.check_tensors(t)


_FLAWED = (("flawed", "SELECT file_id, vec_id, name, CASE WHEN vec_id % 43 = 1 THEN -5 WHEN vec_id % 47 <> 2 THEN off_begin END "
                      "AS off_begin, off_end, data_size - 20000 AS data_size, CASE WHEN vec_id % 37 = 3 THEN -1 ELSE dims END AS dims FROM tensors"),)


@query("tensor_checks", with_views(f"SELECT vec_id, {_PROBLEM} AS problem FROM flawed", "tensors", extra=_FLAWED))
def q_tensor_checks(spark, d):
    return _checked(spark, d).select("vec_id", "problem")


@query("tensor_rollup", with_views(
    "SELECT file_id, count(*) AS tensors, count(*) FILTER (WHERE problem <> 'ok') AS invalid, "
    "arg_min(name, vec_id) FILTER (WHERE problem <> 'ok') AS first_invalid "
    f"FROM (SELECT file_id, vec_id, name, {_PROBLEM} AS problem FROM flawed) t GROUP BY file_id", "tensors",
    extra=_FLAWED))
def q_tensor_rollup(spark, d):
    return A.tensor_rollup(_checked(spark, d))


_LEAF = "regexp_extract(regexp_replace(name, '\\.(weight|bias)$', ''), '([^.]*)$', 1)"


@query("adapter_targets", with_views(
    "SELECT file_id, concat_ws(',', " + ", ".join(f"CASE WHEN bool_or(leaf = '{c}') THEN '{c}' END"
                                                  for c in K.ADAPTER_CANDIDATES) +
    f") AS targets FROM (SELECT file_id, {_LEAF} AS leaf FROM tensors) t GROUP BY file_id", "tensors"))
def q_adapter_targets(spark, d):
    return A.adapter_targets(FX.tensors(spark, d))
