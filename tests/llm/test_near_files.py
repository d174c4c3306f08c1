"""Steps on few rows make few files; hashes travel in few bytes."""

import numpy as np
from pyspark.sql import functions as F

from tuneframe.llm import components as CO
from tuneframe.llm import similarity_join as SJ


def test_steps_on_few_links_write_from_few_tasks(spark, monkeypatch):
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(k) for k in keys]
    wrote = []
    saved = CO.saved
    monkeypatch.setattr(CO, "saved", lambda df: wrote.append(saved(df)) or wrote[-1])
    try:
        spark.conf.set(keys[0], "23")
        spark.conf.set(keys[1], "false")
        chain = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        got = {r.node: r.root for r in CO.components(chain).collect()}
        parts = [df.rdd.getNumPartitions() for df in wrote[1:]]
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
    assert got == dict.fromkeys(range(41), 0)
    assert parts and max(parts) == 1


def test_many_links_keep_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(CO, "TASK_LINKS", 10)
    wrote = []
    saved = CO.saved
    monkeypatch.setattr(CO, "saved", lambda df: wrote.append(saved(df)) or wrote[-1])
    pairs = spark.range(200).select((F.col("id") * 2).alias("a"), (F.col("id") * 2 + 1).alias("b"))
    got = {r.node: r.root for r in CO.components(pairs).collect()}
    assert got == {n: n - n % 2 for n in range(400)}
    assert all(1 <= df.rdd.getNumPartitions() <= 4 for df in wrote[1:])


def test_counted_hashes_travel_in_three_bytes_and_come_back():
    low = np.array([0, 1, 255, 256, (1 << 24) - 1], dtype=np.uint64)
    blob = SJ.short_keys(low | np.uint64(5 << 24))
    assert len(blob) == 3 * len(low)
    assert SJ.long_keys(blob).tolist() == low.tolist()
    assert SJ.long_keys(b"").tolist() == []


def test_frequent_shingles_are_counted_by_documents(spark):
    docs = spark.createDataFrame([(i, f"a b c own{i} own{i} x{i}") for i in range(9)], "doc_id long, text string")
    bits, keys, levels = SJ.frequent_shingles(docs, "text")
    shared = SJ.shingle_set("a b c")
    assert keys.tolist() == (shared >> np.uint64(64 - bits)).tolist()
    assert levels.tolist() == [3]
