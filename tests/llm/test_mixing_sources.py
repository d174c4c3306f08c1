"""Mixing with more sources than the driver took before."""

import pytest
from pyspark.sql import functions as F

from tuneframe.llm import mixing


def test_more_than_100_000_sources(spark):
    n = 100_010
    ids = spark.range(n)
    docs = ids.select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"),
                      F.when(F.col("id") < 5, F.repeat(F.lit("w "), 300_000)).otherwise(F.lit("one two")).alias("text"))
    got = mixing.mix(docs)
    assert got.count() == n
    tokens = [300_000.0] * 5 + [2.0] * (n - 5)
    want = mixing.tempered(tokens, mixing.solve(tokens, sum(tokens)))
    some = {r.doc_id: r.weight for r in got.where("doc_id in (0, 4, 5, 100009)").collect()}
    assert some == pytest.approx({i: want[i] for i in (0, 4, 5, n - 1)}, rel=1e-9)
    assert got.agg(F.sum("weight")).first()[0] == pytest.approx(1.0)
