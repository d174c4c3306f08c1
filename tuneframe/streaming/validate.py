"""Datasets arriving as files, validated per micro-batch.

A file source never splits one file across micro-batches, so the per-file
verdicts computed inside ``foreachBatch`` are whole. Each batch runs the same
line numbering, classification and aggregation as the batch pipeline, writes
its verdicts, and publishes or quarantines the lines.

A batch has a fixed price (plans, commits, a listing of the folder for its
empty files), so a run over what is there takes it in a bounded number of
batches, whose jobs grow with the folder, and lists it for empty files once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneframe import constants as K
from tuneframe.operators import validation as V
from tuneframe.sinks import publish_if_wellformed
from tuneframe.functions.text import split_stored_name
from tuneframe.sources.files import file_listing, file_path, is_dataset, list_datasets, number_scanned_lines


#: Files of a batch, unless a backlog has more than BACKLOG_BATCHES times as many.
BATCH_FILES = 1000
#: Batches that a run over what is there takes, at most.
BACKLOG_BATCHES = 16
#: Tasks that look up the files of a batch.
LOOKUPS = 64


def _batch_files(spark: SparkSession, in_dir: str, available_now: bool) -> int:
    """Files of a batch: BATCH_FILES, or the share of the folder that lets a
    run over what is there end after BACKLOG_BATCHES batches."""
    files = file_listing(spark, in_dir, recursive=False).count() if available_now else 0
    return max(BATCH_FILES, -(-files // BACKLOG_BATCHES))


def _bounded_lookups(spark: SparkSession) -> None:
    """Fewer tasks for this session that look up given files, of which Spark
    has up to 10,000, one a file; the source reads the setting in every batch.
    A session that changed Spark's default keeps its own."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(LOOKUPS))


def _report_empty_files(spark: SparkSession, in_dir: str, out_dir: str, batch_id: int) -> None:
    """Zero-byte files never reach a file stream (they have no rows). A batch
    that reports lists the folder (as the stream source itself does) and writes the
    empty files that no earlier batch reported, as verdicts with count 0.
    Output goes to ``empty/batch_id=<n>`` (overwritten), and "earlier" means
    batch ids below ``n``, so a replayed batch writes the same rows."""
    from pyspark.errors import AnalysisException

    empties = list_datasets(spark, in_dir).where(F.col("size_bytes") == 0) \
        .select(F.col("file").alias("file_id"), "upload_id")
    try:
        seen = spark.read.parquet(f"{out_dir}/empty").where(F.col("batch_id") < batch_id).select("file_id")
        empties = empties.join(seen, "file_id", "left_anti")
    except AnalysisException:
        pass
    empties.select(
        "file_id", "upload_id", F.lit(0).cast("bigint").alias("record_count"), F.lit(0).cast("bigint").alias("n_bad"),
        F.lit(None).cast("bigint").alias("first_bad_line"), F.lit(None).cast("string").alias("first_bad_kind"),
        F.lit("").alias("missing_fields"), F.lit(False).alias("schema_valid"), F.lit(False).alias("valid"),
        F.lit(True).alias("utf8_ok"), F.lit(None).cast("string").alias("error")) \
        .write.mode("overwrite").parquet(f"{out_dir}/empty/batch_id={batch_id}")


def stream_validate(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                    required=K.REQUIRED_FIELDS, expected: int = K.EXPECTED_RECORDS,
                    max_files_per_trigger: int | None = None, available_now: bool = True, report_empty: bool = True):
    """Start the validating stream; returns the ``StreamingQuery``.
    A batch takes ``max_files_per_trigger`` files, without it BATCH_FILES or,
    of a large backlog, a BACKLOG_BATCHES-th (``_batch_files``).
    Verdicts go to ``out_dir/verdicts/batch_id=<id>``, lines to
    ``out_dir/lines/batch=<id>/state=...`` and, with ``report_empty``,
    zero-byte files to ``out_dir/empty/batch_id=<id>``; all are overwritten
    when a batch is replayed, so the output is exactly-once per batch.

    Empty files are looked for by every batch of a running stream. A run over
    what is there (``available_now``) looks once, in its first batch: what
    comes later is the next run's, as for the files that have rows."""
    files = _batch_files(spark, in_dir, available_now) if max_files_per_trigger is None else max_files_per_trigger
    listed: list[int] = []
    _bounded_lookups(spark)
    raw = (spark.readStream.format("text").option("maxFilesPerTrigger", files)
           .option("pathGlobFilter", V.STORED_GLOB).load(in_dir)
           .select(file_path().alias("file"), F.col("_metadata.file_block_start").alias("block"),
                   F.col("value").alias("line"))
           .where(is_dataset(F.col("file"))))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # The files are opened once: what is kept are the lines as scanned.
        scanned = batch.withColumn("_pos", F.monotonically_increasing_id()).persist()
        lines = number_scanned_lines(scanned).withColumnRenamed("file", "file_id")
        verdicts = V.file_verdicts(V.classify_lines(lines, "line", required, keep_blank=True), "file_id", "line_no",
                                   required, expected, extra_aggs=[F.bool_and("utf8_ok").alias("utf8_ok")])
        verdicts = verdicts \
            .withColumn("error", F.when(~F.col("utf8_ok"), "utf8").when(F.col("n_bad") > 0, F.col("first_bad_kind"))) \
            .withColumn("upload_id", split_stored_name(F.substring_index("file_id", "/", -1))[0])
        # One folder per batch, overwritten: a batch replayed after a failure
        # (foreachBatch is at-least-once) replaces its own output.
        verdicts.write.mode("overwrite").parquet(f"{out_dir}/verdicts/batch_id={batch_id}")
        states = verdicts.select("file_id", F.when(F.col("error").isNull(), "published").otherwise("quarantined")
                                 .alias("state"))
        publish_if_wellformed(lines.select("file_id", "line_no", "line"), states,
                              f"{out_dir}/lines/batch={batch_id}")
        scanned.unpersist()
        if report_empty and not (available_now and listed):
            _report_empty_files(spark, in_dir, out_dir, batch_id)
            listed.append(batch_id)

    writer = raw.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
