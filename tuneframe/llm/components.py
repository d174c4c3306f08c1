"""Connected components of a link table, by alternating stars.

Every step replaces links so that nodes hang on ever smaller neighbours, until
every node hangs on its component's smallest id. Steps are joins and grouped
minima on the link table; nothing is collected but counts. As links are few
beside the documents, every step writes from as many tasks as their number
asks for (``_few``), not from as many as the session's shuffles have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneframe.session import shuffle_partitions

from .common import let_go, saved

MAX_STEPS = 60
#: Links that one task of a step holds, about.
TASK_LINKS = 100_000


def components(links: DataFrame) -> DataFrame:
    """``links`` has columns a and b. Returns (node, root) of every node that
    has a link, root being the smallest node of the component."""
    edges = saved(_ordered(links.select("a", "b")))
    tasks = min(shuffle_partitions(edges.sparkSession), 1 + edges.count() // TASK_LINKS)
    before = None
    for _ in range(MAX_STEPS):
        edges = saved(_small_star(_large_star(_few(edges, tasks), tasks), tasks))
        # The table is stable when its rows are: compare count and an order-free sum.
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if tuple(now) == before:
            let_go(edges.sparkSession)
            nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = tuple(now)
    raise RuntimeError("components did not settle")


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links from the larger to the smaller node."""
    return links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _few(df: DataFrame, tasks: int) -> DataFrame:
    """``df`` from ``tasks`` tasks: every task that writes for a shuffle makes files of its own."""
    return df.coalesce(tasks)


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Of every node, the larger neighbours move to its smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _few(both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")), tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Of every node, the smaller neighbours and itself move to the smallest of them."""
    down = _few(_ordered(edges), tasks)
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    moved = moved.union(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b"))
    return _few(_few(moved, tasks).distinct(), tasks)
