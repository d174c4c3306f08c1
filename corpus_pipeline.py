"""The corpus pipeline: five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
applies them one after the other, each written as Parquet in the shared
checkpoint folder and read back as the next one's input. All stages but the
last return the columns of ``documents``; the last one adds where a document
stands in the mix, so the result holds the cleaned texts themselves.

Every stage takes null, empty and very long texts, null and repeated ids,
repeated rows, empty tables and extra columns of any name, which stay as they
are; what it does with such rows is said at the stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneframe.llm import decontaminate, langid, mixing, pii, similarity_join
from tuneframe.llm.common import bounded_batches, table
from tuneframe.session import ensure_checkpoint_dir, remove_folders


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID; documents that it rejects go. Null and empty texts, and
    texts without a letter, are in no language and go. Where no row has a
    language there is nothing to learn, and every document goes. Repeated rows
    stay or go together."""
    bounded_batches(spark)
    return langid.keep_known(docs, langid.train(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five-word shingles at a similarity of 0.8 and
    above; one document of each group stays, the one with the smallest id
    (null comes last). Rows that repeat an id are told apart by their text;
    those that repeat both are one. Null and empty texts have no copies."""
    bounded_batches(spark)
    return similarity_join.keep_representatives(docs, k=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go. Null and empty texts have none."""
    bounded_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text. A null
    text stays null, and so does its n_chars."""
    bounded_batches(spark)
    out = pii.redact(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with their source's weight, how often each is
    in it (copies) and its place in the source's order; documents left out go.
    A null source is a source of its own. Texts without words cost nothing and
    are in every pass. Equal rows are taken or left together."""
    bounded_batches(spark)
    return mixing.mixed_documents(docs)


STAGES = [("language_id", language), ("jaccard_join", near_copies), ("decontamination", benchmark),
          ("pii", personal_data), ("mixing", mixture)]

#: SQL cannot express the learned stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table. What a stage has read is removed once
    its own result is written; the last one's stays."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, read = table(spark, sf_dir, "documents"), []
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        remove_folders(spark, read)
        read = [path]
    return docs
