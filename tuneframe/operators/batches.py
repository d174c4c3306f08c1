"""Token budgets, padding, answer slicing and the epoch/batch plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tuneframe import constants as K
from tuneframe.functions.numeric import int_div
from tuneframe.functions.text import count_tokens, non_space_tokens, token_prefix
from tuneframe.session import ensure_checkpoint_dir, shuffle_partitions


def token_budget(df: DataFrame, text: str = "text", limit: int = K.TRAIN_MAX_TOKENS,
                 tokenizer_factory: Callable[[], Callable[[list[str]], list[list[int]]]] | None = None) -> DataFrame:
    """Cut each text to ``limit`` tokens, keeping the first ones.

    Default tokenizer (native, whole text): runs of non-whitespace; adds
    ``n_tokens``, ``kept_text`` (the text unchanged, or its exact prefix up to
    the end of the last kept token) and ``cut``. The tokens are counted, never
    gathered; the search for the prefix ends at token ``limit``.
    With ``tokenizer_factory`` (called once per task, e.g. to load a
    tokenizer) ids come from an iterator Pandas UDF: adds ``token_ids``
    (kept ids), ``n_tokens`` and ``cut``."""
    if tokenizer_factory is None:
        n, kept = count_tokens(text), token_prefix(text, limit)
        return df.withColumn("n_tokens", n.cast("bigint")).withColumn("cut", F.col("n_tokens") > limit) \
            .withColumn("kept_text", F.when(F.col("cut"), kept).otherwise(F.col(text)))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = tokenizer_factory()
        for s in batches:
            yield pd.Series(fn([x if x is not None else "" for x in s.tolist()]))

    out = df.withColumn("_tf_ids", encode(F.col(text)))
    return out.withColumn("n_tokens", F.size("_tf_ids").cast("bigint")) \
        .withColumn("token_ids", F.slice("_tf_ids", 1, limit)) \
        .withColumn("cut", F.col("n_tokens") > limit).drop("_tf_ids")


#: Rows that a numbering bucket of ``batch_plan`` holds on average, at most.
BUCKET_ROWS = 1 << 16


def bucket_bits(rows: int, partitions: int) -> int:
    """Leading hash bits that name a bucket: as many as make a bucket of a
    uniform key at most ``BUCKET_ROWS`` rows on average, whatever the input
    size, and give every shuffle partition a bucket."""
    least = max(-(-rows // BUCKET_ROWS), min(partitions, rows), 1)
    return min((least - 1).bit_length(), 32)


def batch_plan(records: DataFrame, id_col: str = "record_id", epochs: int = 3, batch_size: int = 1,
               seed: int = K.TRAIN_SEED) -> DataFrame:
    """Epoch, batch and optimizer step of every record.

    The order inside an epoch is ``md5("<seed>:<epoch>:<id>")`` (a declared
    stand-in for the trainer's shuffle). The digest is uniform, so its leading
    bits deal every epoch into buckets of even size that follow the order:
    rows are numbered inside their bucket and moved by the summed sizes of the
    buckets before it. Nothing is sampled; the ids are written once, and their
    count sets the number of buckets. Gradient accumulation is ``max(1, 4 // batch_size)``."""
    accumulation = max(1, 4 // batch_size)
    ensure_checkpoint_dir(records.sparkSession)
    ids = records.select(id_col).checkpoint()
    bits = bucket_bits(ids.count(), shuffle_partitions(records.sparkSession))
    per_epoch = ids.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    keyed = per_epoch.withColumn("_tf_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col("epoch").cast("string"),
                                                         F.lit(":"), F.col(id_col).cast("string"))))
    head = F.conv(F.substring("_tf_key", 1, 8), 16, 10).cast("bigint")
    keyed = keyed.withColumn("_tf_bucket", F.shiftright(head, 32 - bits).cast("bigint"))
    sizes = keyed.groupBy(F.col("epoch").alias("_tf_e"), F.col("_tf_bucket").alias("_tf_b")).agg(F.count(F.lit(1)).alias("_tf_n"))
    before = Window.partitionBy("_tf_e").orderBy("_tf_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_tf_e", "_tf_b", F.coalesce(F.sum("_tf_n").over(before), F.lit(0)).alias("_tf_start"))
    inside = Window.partitionBy("epoch", "_tf_bucket").orderBy("_tf_key", id_col)
    numbered = keyed.withColumn("_tf_no", F.row_number().over(inside))
    placed = numbered.join(starts, (F.col("epoch") == F.col("_tf_e")) & (F.col("_tf_bucket") == F.col("_tf_b")))
    batch_no = int_div(F.col("_tf_start") + F.col("_tf_no") - 1, F.lit(batch_size))
    return placed.select(F.col("epoch").cast("bigint").alias("epoch"), batch_no.alias("batch_no"), id_col,
                         int_div(batch_no, F.lit(accumulation)).alias("step"))


def word_length_ids(text: str = "text"):
    """Test stand-in for token ids: the length of every whitespace token."""
    return F.transform(non_space_tokens(text), lambda w: F.length(w))
