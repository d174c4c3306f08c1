"""Line numbering that never puts a whole file in one task (A2).

A file is read in blocks (input splits). Lines are numbered inside each block,
block sizes are prefix-summed per file, and the offsets are joined back. The
block table has one row per block, so it is bounded by the number of input
splits, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tuneframe.operators.ordering import number_rows


def number_in_blocks(df: DataFrame, file_col: str, block_col: str, pos_col: str,
                     out: str = "line_no") -> DataFrame:
    """1-based number of each row inside its file, ordered by (block, pos).

    Inside a block rows are numbered by ``number_rows`` (skew-safe even when a
    block is large); blocks are then shifted by the sizes of earlier blocks."""
    inner = number_rows(df, [file_col, block_col], [pos_col], "_tf_in_block")
    sizes = df.groupBy(file_col, block_col).agg(F.count(F.lit(1)).alias("_tf_bsize"))
    before = Window.partitionBy(file_col).orderBy(block_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(file_col).alias("_tf_f"), F.col(block_col).alias("_tf_b"),
                           F.coalesce(F.sum("_tf_bsize").over(before), F.lit(0)).alias("_tf_boff"))
    cond = F.col(file_col).eqNullSafe(F.col("_tf_f")) & F.col(block_col).eqNullSafe(F.col("_tf_b"))
    return inner.join(offsets, cond, "inner") \
        .withColumn(out, (F.col("_tf_boff") + F.col("_tf_in_block")).cast("bigint")) \
        .drop("_tf_f", "_tf_b", "_tf_boff", "_tf_in_block")
