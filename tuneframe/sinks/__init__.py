"""Sinks (B1-B4). All writes go through Spark's commit protocol: a job's
output appears as a whole or not at all, marked by ``_SUCCESS``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_manifests(df: DataFrame, path: str, partition_by: str | None = "source", mode: str = "append") -> None:
    """One JSON row per model upload, nested lists kept (B1)."""
    w = df.write.mode(mode)
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    w.json(path)


def write_training_text(df: DataFrame, path: str, shards: int, key: str = "record_id", text: str = "text",
                        mode: str = "overwrite") -> None:
    """The training table, one ``text`` column, in ``shards`` files split by
    key range (each file holds a contiguous, sorted key range) (B3)."""
    df.select(key, F.col(text).alias("text")).repartitionByRange(shards, key).sortWithinPartitions(key) \
        .select("text").write.mode(mode).parquet(path)


def publish_if_wellformed(lines: DataFrame, states: DataFrame, out_dir: str, file_col: str = "file_id",
                          mode: str = "overwrite") -> None:
    """Lines of files without syntax errors go to ``state=published``, the
    others to ``state=quarantined`` (B4). Files that fail only the schema or
    count checks are published, as the reference stores them with
    ``valid=false``."""
    s = states.select(F.col(file_col).alias("_s_file"), "state")
    lines.join(s, F.col(file_col) == F.col("_s_file"), "inner").drop("_s_file") \
        .write.mode(mode).partitionBy("state").parquet(out_dir)


# --- last-write-wins table (B2) -------------------------------------------------------
#
# A plain Parquet folder that writers append to. Every row carries the writer
# and the batch it came with; which row of a key is current is settled when the
# table is read. So writers need no knowledge of each other, and a batch that
# is appended twice changes nothing.

WRITER, BATCH = "_writer", "_batch"


def append_rows(batch: DataFrame, table_dir: str, writer: str, batch_id: int) -> None:
    """Append ``batch`` to the table under its writer's name (a stream: the
    query's id) and batch number."""
    batch.withColumn(WRITER, F.lit(writer)).withColumn(BATCH, F.lit(batch_id).cast("bigint")) \
        .write.mode("append").parquet(table_dir)


def read_latest(spark: SparkSession, table_dir: str, key: str = "job_id", order: str = "last_seq") -> DataFrame:
    """The current row of every key: the one with the highest ``order``, of
    equal ones the one of the latest batch (then of the later writer by name).
    One grouped aggregation with map-side combine; columns that came in later
    are null in older rows."""
    rows = spark.read.option("mergeSchema", "true").parquet(table_dir)
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, BATCH, WRITER)).alias("_r")) \
        .select(key, "_r.*").drop(WRITER, BATCH)


def compact(spark: SparkSession, table_dir: str, new_dir: str, key: str = "job_id", order: str = "last_seq") -> None:
    """Write the current rows as a new table, which readers and writers then
    turn to; the old one is left as it is."""
    append_rows(read_latest(spark, table_dir, key, order), new_dir, "compaction", -1)
