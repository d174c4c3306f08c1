"""Adapters from the driver's test tables to the operators' input shapes.

They only reshape test data (the mapping is fixed in FIXTURES.md); they are
not capabilities. Row numbers use the skew-safe ``number_rows``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneframe.operators.ordering import neighbor_values, number_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction records: each user turn answered by the next assistant turn."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = neighbor_values(conv, ["conv_id"], ["turn"], ["role", "text"], 1, "next_")
    pairs = turns.where((F.col("role") == "user") & (F.col("next_role") == "assistant"))
    system = (conv.where(F.col("role") == "system").groupBy("conv_id")
              .agg(F.max("text").alias("sys")).withColumnRenamed("conv_id", "s_conv"))
    pairs = pairs.join(system, F.col("conv_id") == F.col("s_conv"), "left")
    return pairs.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("record_id"),
        "conv_id", "turn",
        F.coalesce(F.col("sys"), F.lit("Answer the message.")).alias("instruction"),
        F.col("text").alias("input"),
        F.col("next_text").alias("output"),
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("workflow"),
        F.lit("The reply follows the message.").alias("success_condition"))


def raw_lines(spark: SparkSession, sf_dir: str, numbered: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """JSONL lines per file, with some lines broken on purpose. With
    ``numbered=False`` (for results that never show a line number) the
    numbering pass is skipped and ``line_no`` is null."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "props")
    numbered = number_rows(ev, ["user_id"], ["event_id"], "line_no") if numbered else \
        ev.withColumn("line_no", F.lit(None).cast("bigint"))
    eid, props = F.col("event_id"), F.col("props")
    line = (F.when(eid % 97 == 5, F.substring(props, 1, 4))
            .when(eid % 89 == 7, F.concat(F.lit("["), props, F.lit("]")))
            .when(eid % 83 == 9, F.lit("  "))
            .when(eid % 79 == 11, F.replace(props, F.lit('"k"'), F.lit('"q"')))
            .when(eid % 73 == 3, F.concat(props, F.lit(" x")))
            .otherwise(props))
    return numbered.select(F.col("user_id").alias("file_id"), F.col("line_no").cast("bigint").alias("line_no"),
                           line.alias("line"), *keep)


def job_events(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """Training-job progress events. ``seq`` is the rank of ``(ts, event_id)``
    inside a job; with ``numbered=False`` it is left null and consumers order
    by ``(ts, event_id)`` directly, which gives the same order."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    numbered = number_rows(ev, ["user_id"], ["ts", "event_id"], "seq") if numbered else \
        ev.withColumn("seq", F.lit(None).cast("bigint"))
    et, eid = F.col("event_type"), F.col("event_id")
    status = (F.when(et == "view", "queued").when(et == "signup", "loading").when(et == "click", "running")
              .when(et == "purchase", "completed").otherwise("failed"))
    error = (F.when((et == "error") & (eid % 2 == 0), F.lit("CUDA Out of Memory"))
             .when(et == "error", F.lit("bad input")))
    return numbered.select(
        F.col("user_id").alias("job_id"), F.col("seq").cast("bigint").alias("seq"), "ts",
        status.alias("status"), (eid % 50).cast("int").alias("step"), F.lit(50).alias("total_steps"),
        F.when((et == "click") & (F.col("value") < 30), F.col("value")).alias("loss"),
        (et == "click").alias("loss_named"), error.alias("error"),
        (F.col("user_id") % 30).alias("model_id"), "event_id")


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    repo = F.when(k % 5 == 0, F.lit("")).when(k % 3 == 0, F.lit(None).cast("string")) \
        .otherwise(F.concat(F.lit("org/"), F.col("n_name")))
    return n.select(k.alias("model_id"), repo.alias("repo_id"),
                    F.when(k % 2 == 0, F.lower(F.col("n_name"))).alias("model_type"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    suffix = F.when(i % 3 == 0, ".safetensors").when(i % 3 == 1, ".BIN").otherwise(".json")
    return d.select(F.col("source").alias("upload_id"), i.alias("pos"),
                    F.concat(F.col("lang"), F.lit("/"), i.cast("string"), suffix).alias("path"),
                    F.col("n_chars").alias("size"))


def shard_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("index_dir"),
                    F.concat(F.lit("tensor."), F.col("doc_id").cast("string")).alias("tensor"),
                    F.col("doc_id").cast("string").alias("shard"))


def shard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return labels.join(docs, "doc_id").select(F.col("source").alias("dir"),
                                              F.col("doc_id").cast("string").alias("name"))


def upload_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    pid = F.col("page_id")
    lead = (F.when(pid % 6 == 0, "../").when(pid % 6 == 1, "./").when(pid % 6 == 2, "/")
            .when(pid % 6 == 3, "a//").when(pid % 6 == 4, "a\\").otherwise(""))
    host_path = F.replace(F.replace(F.col("url"), F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return p.select(pid, F.concat(lead, host_path).alias("path"),
                    F.concat(F.md5(pid.cast("string")), F.lit("_"),
                             F.replace(F.col("url"), F.lit("/"), F.lit("_"))).alias("stored_name"))


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    proj = F.when(v % 3 == 0, "v_proj").when(v % 3 == 1, "q_proj").otherwise("norm")
    return e.select(
        F.col("label").alias("file_id"), v,
        F.concat(F.lit("model.layers."), v.cast("string"), F.lit(".self_attn."), proj, F.lit(".weight")).alias("name"),
        (v * 100).alias("off_begin"),
        (v * 100 + F.when(v % 41 == 0, F.lit(-1)).otherwise(F.lit(100))).alias("off_end"),
        F.lit(50000).cast("bigint").alias("data_size"),
        F.size("embedding").cast("bigint").alias("dims"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = F.col("o_orderstatus")
    return o.select(
        k.alias("request_id"), F.col("o_custkey").alias("dataset_id"), (k % 30).alias("model_id"),
        F.when(status == "F", "lora").when(status == "O", "qlora").otherwise("full").alias("method"),
        (k % 25).cast("int").alias("epochs"), (F.col("o_totalprice") / F.lit(10000000.0)).alias("learning_rate"),
        (k % 70).cast("int").alias("adapter_rank"), (k % 3).cast("int").alias("batch_size"))
