"""The skew path on inputs larger than its sample."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tuneframe.operators import ordering as O


def test_two_million_rows_with_a_hot_group(spark):
    n = 2_000_000
    df = spark.range(0, n, numPartitions=16).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 5000).alias("g"),
        ((F.col("id") * 2654435761) % 1000003).alias("o"), F.col("id"))
    ranged = O._with_ranges(df, ["g"], ["o", "id"], None)
    assert ranged.where(O._HEAVY).select("g").distinct().count() == 1
    got = O.number_rows(df, ["g"], ["o", "id"], "rn").select("id", F.col("rn").alias("a"))
    want = df.select("id", F.row_number().over(Window.partitionBy("g").orderBy("o", "id")).alias("b"))
    bad = got.join(want, "id").where(F.col("a") != F.col("b")).count()
    assert bad == 0 and got.count() == n


def test_two_million_rows_running_sum_and_lag(spark):
    n = 2_000_000
    df = spark.range(0, n, numPartitions=16).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 5000).alias("g"),
        ((F.col("id") * 2654435761) % 1000003).alias("o"), F.col("id"), (F.col("id") % 7).alias("v"))
    w = Window.partitionBy("g").orderBy("o", "id")
    got = O.running_sum(df, ["g"], ["o", "id"], "v", "s").select("id", "s")
    lag = O.neighbor_values(df, ["g"], ["o", "id"], ["v"], -1).select("id", "prev_v")
    want = df.select("id", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s2"),
                     F.lag("v").over(w).alias("p2"))
    j = got.join(lag, "id").join(want, "id")
    assert j.where((F.col("s") != F.col("s2")) | ~F.col("prev_v").eqNullSafe(F.col("p2"))).count() == 0
    assert j.count() == n
