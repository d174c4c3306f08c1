"""From a folder of JSONL datasets to sharded training text.

    python scripts/prepare_training_text.py DATASETS_DIR OUT_DIR [--expected N]

Validates every stored dataset, keeps the files that pass, renders each record
as training text (values printed as the original prints them), cuts to the
token budget, writes the text in key-range shards and writes the batch plan.
Every step is a Spark job; nothing but counts reaches the driver.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tuneframe import constants as K  # noqa: E402
from tuneframe import sinks  # noqa: E402
from tuneframe.operators import batches as B  # noqa: E402
from tuneframe.operators import render as RO  # noqa: E402
from tuneframe.operators import validation as V  # noqa: E402
from tuneframe.session import ensure_checkpoint_dir  # noqa: E402
from tuneframe.sources.files import read_lines  # noqa: E402


def prepare(spark: SparkSession, datasets_dir: str, out_dir: str, expected: int = K.EXPECTED_RECORDS,
            token_limit: int = K.TRAIN_MAX_TOKENS, epochs: int = 3, batch_size: int = 1, shards: int = 8) -> dict:
    # Used three times below: cut the lineage with a reliable checkpoint in the
    # shared folder the session names (spark.checkpoint.dir), so a lost
    # executor does not mean re-reading every dataset.
    ensure_checkpoint_dir(spark)
    verdicts = V.validate_files(spark, datasets_dir, K.REQUIRED_FIELDS, expected).checkpoint()
    verdicts.write.mode("overwrite").parquet(f"{out_dir}/verdicts")
    valid = verdicts.where(F.col("valid")).select(F.col("file").alias("file_id"))
    lines = read_lines(spark, datasets_dir).withColumnRenamed("file", "file_id").join(valid, "file_id", "left_semi")
    ok = V.classify_lines(lines, "line", K.REQUIRED_FIELDS).where(F.col("kind") == "ok")
    records = RO.records_from_lines(ok).withColumn(
        "record_id", F.concat_ws(":", "file_id", F.lpad(F.col("line_no").cast("string"), 15, "0")))
    text = B.token_budget(RO.training_texts(records), "text", token_limit)
    sinks.write_training_text(text.select("record_id", F.col("kept_text").alias("text")), f"{out_dir}/text", shards)
    B.batch_plan(records, "record_id", epochs, batch_size).write.mode("overwrite").parquet(f"{out_dir}/batches")
    summary = verdicts.agg(F.count(F.lit(1)).alias("files"), F.count_if("valid").alias("valid_files")).first()
    return {"files": summary["files"], "valid_files": summary["valid_files"]}


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("datasets_dir")
    ap.add_argument("out_dir")
    ap.add_argument("--expected", type=int, default=K.EXPECTED_RECORDS)
    a = ap.parse_args()
    spark = SparkSession.builder.getOrCreate()
    print(prepare(spark, a.datasets_dir, a.out_dir, a.expected))


if __name__ == "__main__":
    main()
