"""Model-folder validation over many uploads at once (A4-A9, C13, C14, D2,
E4-E6), with the reference's error priority: config, architecture, weights,
tokenizer, tokenizer.json, shard indexes, weight contents.

Each check is a per-file expression or a per-upload aggregation; the folders
are never walked file by file on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tuneframe import constants as K
from tuneframe.functions.paths import is_safe_path, normalise_path
from tuneframe.operators.artifacts import has_suffix, upload_manifests
from tuneframe.operators.validation import check_architecture, check_tensors
from tuneframe.session import ensure_checkpoint_dir
from tuneframe.sources.files import list_artifacts, model_roots, read_json_assets, relative
from tuneframe.sources.weights import header_problems, read_weight_heads, tensor_rows

ERRORS = ("no_config", "config_invalid", "no_model_type", "bad_architectures", "not_causal_lm", "no_weights",
          "no_tokenizer", "tokenizer_invalid", "index_invalid", "missing_shards", "weight_invalid")


def _upload_of(spark: SparkSession, path_col, models_dir: str):
    return F.substring_index(relative(spark, path_col, models_dir), "/", 1)


def validate_model_dirs(spark: SparkSession, models_dir: str) -> DataFrame:
    """One row per upload folder under ``models_dir``: ``upload_id, error,
    detail, model_type, architectures, weight_file_count, tokenizer_files,
    sharded``."""
    # The JSON assets and the weight headers feed several checks: each is read
    # once and kept as a reliable checkpoint in the shared checkpoint folder.
    ensure_checkpoint_dir(spark)
    files = list_artifacts(spark, models_dir).withColumn("upload_id", _upload_of(spark, F.col("path"), models_dir))
    uploads = files.select("upload_id").distinct()
    assets = read_json_assets(spark, models_dir).checkpoint()
    roots = model_roots(assets)

    # config.json: readable object with a string model_type, then architectures
    cfg = assets.where(F.col("asset") == "config").select(F.col("path").alias("config_path"), "utf8_ok", "is_object",
                                                            F.col("doc").alias("config"))
    cfg = roots.join(cfg, "config_path", "left")
    cfg = check_architecture(cfg.withColumn("config", F.coalesce("config", F.parse_json(F.lit("null")))),
                             "config", "arch_problem", "architectures")
    cfg = cfg.select("upload_id", "model_dir", "architectures",
                     F.when(~F.col("is_object"), "config_invalid").otherwise(F.col("arch_problem")).alias("cfg_error"),
                     F.variant_get("config", "$.model_type", "string").alias("model_type"))

    # files under the model folder (the config's parent)
    inside = files.join(roots.select("upload_id", "model_dir"), "upload_id") \
        .where(F.col("path").startswith(F.concat(F.col("model_dir"), F.lit("/"))))
    name = F.col("name")
    a, b = K.TOKENIZER_PAIR
    per = inside.groupBy("upload_id").agg(
        F.count_if(has_suffix(name, K.WEIGHT_SUFFIXES)).cast("bigint").alias("weight_file_count"),
        F.coalesce(F.bool_or(name.isin(*K.TOKENIZER_FILES)), F.lit(False)).alias("_any_tok"),
        F.coalesce(F.bool_or(name == a) & F.bool_or(name == b), F.lit(False)).alias("_pair"),
        F.array_sort(F.collect_set(F.when(name.isin(*K.TOKENIZER_FILES), name))).alias("tokenizer_files"),
        F.coalesce(F.bool_or(name.isin(*K.SHARD_INDEX_FILES)), F.lit(False)).alias("sharded"))

    # tokenizer.json must be an object; shard indexes need a safe, non-empty weight map
    docs = assets.join(roots.select("upload_id", "model_dir"), "upload_id") \
        .where(F.col("path").startswith(F.concat(F.col("model_dir"), F.lit("/"))))
    tok_bad = docs.where((F.col("asset") == "tokenizer") & ~F.col("is_object")).select("upload_id").distinct() \
        .withColumn("tok_bad", F.lit(True))
    idx = docs.where(F.col("asset") == "shard_index")
    entries = idx.select("upload_id", "dir", "path",
                         F.explode_outer(F.try_variant_get(F.col("doc"), "$.weight_map", "map<string,variant>"))
                         .alias("tensor", "v"))
    shard = F.try_variant_get(F.col("v"), "$", "string")
    entries = entries.withColumn("shard", F.when(F.schema_of_variant(F.col("v")) == "STRING", shard))
    idx_bad = entries.groupBy("upload_id", "path").agg(
        F.count("tensor").alias("_n"),
        F.count_if(F.col("tensor").isNotNull() & (F.col("shard").isNull() | ~is_safe_path(F.col("shard"), False)))
        .alias("_unsafe")) \
        .where((F.col("_n") == 0) | (F.col("_unsafe") > 0)).groupBy("upload_id").agg(F.lit(True).alias("idx_bad"))
    wanted = entries.where(F.col("shard").isNotNull() & is_safe_path(F.col("shard"), False)).select(
        "upload_id", F.concat(F.col("dir"), F.lit("/"), normalise_path(F.col("shard"), False)).alias("want"),
        F.col("shard")).distinct()
    have = files.select(F.col("path").alias("want"))
    missing = wanted.join(have, "want", "left_anti")
    first = missing.withColumn("_r", F.row_number().over(Window.partitionBy("upload_id").orderBy("shard"))) \
        .where(F.col("_r") <= K.MISSING_SHARDS_SHOWN).groupBy("upload_id") \
        .agg(F.array_join(F.array_sort(F.collect_list("shard")), ", ").alias("missing_first"))

    # weight contents: headers and magic bytes, read by offset
    heads = read_weight_heads(spark, models_dir).checkpoint()
    tens = check_tensors(tensor_rows(heads))
    bad_tensor = tens.where(F.col("problem") != "ok").select("path").distinct().withColumn("_t_bad", F.lit(True))
    weights = header_problems(heads).join(bad_tensor, "path", "left").withColumn("upload_id", _upload_of(spark, F.col("path"), models_dir)) \
        .join(roots.select("upload_id", "model_dir"), "upload_id") \
        .where(F.col("path").startswith(F.concat(F.col("model_dir"), F.lit("/"))))
    w_bad = weights.where(F.col("problem").isNotNull() | F.coalesce(F.col("_t_bad"), F.lit(False))) \
        .groupBy("upload_id").agg(F.min(F.substring_index(F.col("path"), "/", -1)).alias("weight_bad"))

    out = uploads.join(cfg, "upload_id", "left").join(per, "upload_id", "left").join(tok_bad, "upload_id", "left") \
        .join(idx_bad, "upload_id", "left").join(first, "upload_id", "left").join(w_bad, "upload_id", "left")
    error = (F.when(F.col("model_dir").isNull(), "no_config")
             .when(F.col("cfg_error").isNotNull(), F.col("cfg_error"))
             .when(F.coalesce(F.col("weight_file_count"), F.lit(0)) == 0, "no_weights")
             .when(~(F.col("_any_tok") | F.col("_pair")), "no_tokenizer")
             .when(F.col("tok_bad"), "tokenizer_invalid")
             .when(F.col("idx_bad"), "index_invalid")
             .when(F.col("missing_first").isNotNull(), "missing_shards")
             .when(F.col("weight_bad").isNotNull(), "weight_invalid"))
    detail = F.when(error == "missing_shards", F.col("missing_first")) \
        .when(error == "weight_invalid", F.col("weight_bad"))
    return out.select("upload_id", error.alias("error"), detail.alias("detail"), "model_type", "architectures",
                      "weight_file_count", F.array_join(F.coalesce("tokenizer_files", F.array()), ",")
                      .alias("tokenizer_files"), F.coalesce("sharded", F.lit(False)).alias("sharded"))


def build_manifests(spark: SparkSession, models_dir: str) -> DataFrame:
    """The manifest of every upload folder (input of ``write_manifests``):
    totals and file list of ``upload_manifests`` with what validation found.
    Refused folders keep their row, with the ``error``."""
    files = list_artifacts(spark, models_dir)
    upload = F.substring_index("rel_path", "/", 1)
    files = files.where(F.col("rel_path").contains("/")).select(
        upload.alias("upload_id"), F.substr("rel_path", F.length(upload) + 2).alias("path"), "size")
    info = validate_model_dirs(spark, models_dir).withColumn(
        "tokenizer_files", F.filter(F.split("tokenizer_files", ","), lambda x: x != ""))
    totals = upload_manifests(files)
    caps = F.when(F.col("too_many_files"), "too_many_files").when(F.col("over_cap"), "too_large")
    return totals.join(info, "upload_id", "left").select(
        "upload_id", F.coalesce(caps, "error").alias("error"), "file_count", "size_bytes",
        F.concat(F.lit(models_dir.rstrip("/") + "/"), "upload_id").alias("model_path"), "files", "model_type",
        "architectures", "weight_file_count", "tokenizer_files", "sharded")
