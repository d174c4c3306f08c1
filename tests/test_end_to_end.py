"""Datasets folder -> verdicts -> records -> training text shards and batch plan."""

import json
import os
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from prepare_training_text import prepare  # noqa: E402

REQ = ("instruction", "input", "output", "workflow", "success_condition")


def test_prepare_training_text(spark, tmp_path):
    src = tmp_path / "datasets"
    src.mkdir()
    good = [json.dumps({k: f"{k} {i}" for k in REQ}) for i in range(4)]
    (src / ("a" * 32 + "_good.jsonl")).write_text("\n".join(good) + "\n")
    (src / ("b" * 32 + "_short.jsonl")).write_text("\n".join(good[:2]) + "\n")
    (src / ("c" * 32 + "_broken.jsonl")).write_text(good[0] + "\n{oops\n")
    out = str(tmp_path / "out")
    assert prepare(spark, str(src), out, expected=4, token_limit=6, epochs=2, batch_size=2, shards=2) == \
        {"files": 3, "valid_files": 1}
    text = spark.read.parquet(f"{out}/text").collect()
    assert sorted(r.text for r in text) == [f"### Instruction\ninstruction {i}\n\n### Input" for i in range(4)]
    assert text[0].text.startswith("### Instruction")
    plan = spark.read.parquet(f"{out}/batches")
    assert plan.count() == 8 and plan.agg(F.max("batch_no")).first()[0] == 1
