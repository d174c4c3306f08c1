"""Ordered computations inside groups that may be very large.

``Window.partitionBy(g).orderBy(o)`` sends every row of a group to one task,
so a group holding a third of the data becomes a third of the job on one
core. Here the ordering key of hot groups is first cut into quantile ranges:
one planning job counts the rows of every group and sketches their order keys
(mergeable quantile sketches, built map-side), and brings back the largest
groups' cut points. The window then runs over ``(group, range)``, which splits a hot group across many tasks,
and a small table of per-range totals, prefix-summed inside each group, is
joined back to shift every range by what came before it. The plan is the same
for every input size.

Order keys must be unique inside a group for a deterministic result (add a tie
breaker such as an id as the last order column).
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tuneframe.session import shuffle_partitions

__all__ = ["number_rows", "running_sum", "order_surrogate"]

_KEY = "_tf_okey"
_BKT = "_tf_obkt"
_GK = "_tf_gkey"


def _bytes_surrogate(b: Column, start: int = 1, n: int = 6) -> Column:
    """``n`` bytes from ``start`` (1-based) as a big-endian number, zero
    padded: never decreases with byte-wise order, and exact in a double
    (6 bytes = 48 bits), so equal numbers mean equal padded bytes."""
    return F.conv(F.rpad(F.hex(F.substring(b, start, n)), 2 * n, "0"), 16, 10).cast("double")


def _string_surrogate(c: Column, start: int = 1) -> Column:
    return _bytes_surrogate(F.encode(c, "UTF-8"), start)


def order_surrogate(df: DataFrame, col: str) -> Column:
    """A double that never decreases as ``col`` increases."""
    dtype = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                          T.DecimalType)):
        return c.cast("double")
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        # Difference of two wall-clock values: no time zone involved.
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(dtype, T.StringType):
        return _string_surrogate(c)
    if isinstance(dtype, T.BinaryType):
        return _bytes_surrogate(c)
    raise TypeError(f"cannot order-bucket a column of type {dtype.simpleString()}")


def _bucketable(df: DataFrame, col: str) -> bool:
    try:
        order_surrogate(df, col)
        return True
    except TypeError:
        return False


_EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType,
          T.TimestampType, T.TimestampNTZType)


#: Size of a group's quantile sketch: ranks are off by about 1 / SKETCH of its rows.
SKETCH = 1024
_HEAVY = "_tf_heavy"


def _levels(df: DataFrame, order_cols: list[str]) -> list[Column] | None:
    """Surrogates to cut on: the first order column and, for rows tied on it,
    the next 6 bytes of a string key or else the second order column."""
    first_type = df.schema[order_cols[0]].dataType
    if not _bucketable(df, order_cols[0]):
        return None
    levels = [order_surrogate(df, order_cols[0])]
    if isinstance(first_type, T.StringType):
        levels.append(_string_surrogate(F.col(order_cols[0]), 7))
    elif isinstance(first_type, T.BinaryType):
        levels.append(_bytes_surrogate(F.col(order_cols[0]), 7))
    elif len(order_cols) > 1 and isinstance(first_type, _EXACT) and _bucketable(df, order_cols[1]):
        levels.append(order_surrogate(df, order_cols[1]))
    return levels


def _plan_split(keyed: DataFrame, keys: list[str], n_ranges: int):
    """Hot groups (a frame of their keys) and, for each of ``keys``, cut points
    of the hot groups' rows, from one job over all rows.

    The job aggregates a count and a quantile sketch a group; the n_ranges
    largest come back. A group is hot when it holds at least 1/n_ranges of the
    rows, so all hot ones are among them. The i-th largest group holds at most
    1/i of the rows and needs n_ranges/i cut points at most, which bounds what
    the driver gets whatever the input. Both only steer the balance of work;
    any answer gives the same numbers."""
    groups = keyed.groupBy(_GK).agg(F.count(F.lit(1)).alias("_tf_c"), *[
        c for i, k in enumerate(keys) for c in (F.kll_sketch_agg_double(k, SKETCH).alias(f"_tf_s{i}"), F.count(k).alias(f"_tf_d{i}"))])
    seen = Observation()
    largest = groups.observe(seen, F.sum("_tf_c").alias("total")).where(F.col("_tf_c") >= 2) \
        .orderBy(F.desc("_tf_c")).limit(n_ranges)
    placed = largest.withColumn("_tf_m", F.row_number().over(Window.orderBy(F.desc("_tf_c"))))
    ranks = F.lit([i / n_ranges for i in range(1, max(n_ranges, 2))])
    got = placed.select(_GK, "_tf_c", *[
        # a group without any value has no quantiles
        F.when(F.col(f"_tf_d{i}") > 0, F.filter(F.kll_sketch_get_quantile_double(f"_tf_s{i}", ranks), _every("_tf_m"))).alias(f"_tf_q{i}")
        for i in range(len(keys))]).collect()
    total = seen.get["total"] if got else 0
    hot = [r for r in got if r["_tf_c"] * n_ranges >= total]
    hot_df = keyed.sparkSession.createDataFrame([(r[_GK],) for r in hot], T.StructType([
        T.StructField(_GK, keyed.schema[_GK].dataType, False)]))
    cuts: list[list[float]] = []
    for i in range(len(keys)):
        found: set[float] = set()
        for r in hot:
            q = r[f"_tf_q{i}"] or []
            # of the points that its place allows, as many as its share of the rows asks for
            step = max(1, len(q) * total // max(1, n_ranges * r["_tf_c"]))
            found.update(x for x in q[::step] if x is not None)
        cuts.append(sorted(found))
    return hot_df, cuts


def _every(step: str):
    """Keeps every ``step``-th element."""
    return lambda x, i: (i + 1) % F.col(step) == 0


def _with_ranges(df: DataFrame, group_cols: list[str], order_cols: list[str], n_ranges: int | None):
    """Add the group struct ``_tf_gkey``, a hot-group flag and a range id that
    never decreases along ``order_cols``.

    Only hot groups are cut into ranges: quantile ranges of the first order
    column and, for rows holding exactly the lower cut point of their range
    (a value so frequent it fills whole ranges, say one timestamp for a bulk
    import), quantile ranges of the second level, with the other rows of
    that range placed after them. The tie split is used only where the first
    surrogate is exact (integers and times below 2**53, floats; 6 bytes of a
    string), so equal surrogates mean equal values. Light groups keep range 0:
    each is at most about 1/n_ranges of the rows, the size of one range."""
    spark = df.sparkSession
    if n_ranges is None:
        n_ranges = max(8, min(4096, 4 * shuffle_partitions(spark)))
    keyed = df.withColumn(_GK, F.struct(*group_cols))
    light = keyed.withColumn(_BKT, F.lit(0).cast("bigint")).withColumn(_HEAVY, F.lit(False))
    levels = _levels(df, order_cols)
    if levels is None:
        return light
    keys = [f"{_KEY}{i}" for i in range(len(levels))]
    for k, lv in zip(keys, levels):
        keyed = keyed.withColumn(k, lv)
    hot, cuts = _plan_split(keyed, keys, n_ranges)
    marked = _marked(keyed, hot)
    splits = [[float("-inf")] + (sorted({c for c in cs if c == c}) or [0.0]) + [float("inf")] for cs in cuts]
    outs = [f"{_BKT}{i}" for i in range(len(keys))]
    bucketed = Bucketizer(splitsArray=splits, inputCols=keys, outputCols=outs, handleInvalid="keep").transform(marked)
    # Spark sorts nulls first: a null key gets range 0, values 1..n.
    parts = [F.when(F.col(k).isNull(), F.lit(0)).otherwise(F.col(o).cast("bigint") + 1) for k, o in zip(keys, outs)]
    rid = parts[0]
    if len(keys) == 2:
        lower = F.element_at(F.array(*[F.lit(x) for x in splits[0]]), F.col(outs[0]).cast("int") + 1)
        tied = F.col(keys[0]).isNull() | ((F.col(keys[0]) == lower) & (F.abs(lower) < float(2 ** 53)))
        width = len(splits[1]) + 1
        sub = F.when(F.coalesce(tied, F.lit(False)), parts[1]).otherwise(F.lit(width - 1))
        rid = parts[0] * width + sub
    # Never null; saying so keeps the planner from adding an inferred
    # ``isnotnull`` filter that would compute the range id a second time.
    rid = F.coalesce(F.when(F.col(_HEAVY), rid).otherwise(F.lit(0)), F.lit(0)).cast("bigint")
    return bucketed.withColumn(_BKT, rid).drop(*keys, *outs)


def _marked(keyed: DataFrame, hot: DataFrame) -> DataFrame:
    """``keyed`` with the hot-group flag. At most n_ranges keys are hot, so
    they are broadcast; struct equality treats null fields as equal."""
    flags = hot.select(F.col(_GK).alias("_tf_hk"), F.lit(True).alias("_tf_hot"))
    return keyed.join(F.broadcast(flags), F.col(_GK) == F.col("_tf_hk"), "left") \
        .withColumn(_HEAVY, F.coalesce(F.col("_tf_hot"), F.lit(False))).drop("_tf_hk", "_tf_hot")


def _ordered(df: DataFrame, group_cols: list[str], order_cols: list[str], out_col: str,
             local: Column, total: Column, n_ranges: int | None) -> DataFrame:
    ranged = _with_ranges(df, group_cols, order_cols, n_ranges)
    # The group travels as one struct column: struct equality treats null
    # fields as equal (null groups stay groups), and the join below is on the
    # very columns the window is partitioned by, so the rows are shuffled
    # once, for the window, and never again for the join.
    w = Window.partitionBy(_GK, _BKT).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = ranged.withColumn("_tf_local", local.over(w))
    # range totals of hot groups only: at most (hot groups) x (ranges) rows
    totals = ranged.where(F.col(_HEAVY)).groupBy(_GK, _BKT).agg(total.alias("_tf_n"))
    before = Window.partitionBy(_GK).orderBy(_BKT).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(_GK).alias("_tf_gk2"), F.col(_BKT).alias("_tf_b"),
                            F.coalesce(F.sum("_tf_n").over(before), F.lit(0)).alias("_tf_off"))
    joined = within.join(offsets, (F.col(_GK) == F.col("_tf_gk2")) & (F.col(_BKT) == F.col("_tf_b")), "left")
    result = joined.withColumn(out_col, (F.coalesce(F.col("_tf_off"), F.lit(0)) + F.col("_tf_local")).cast("bigint"))
    return result.drop("_tf_local", "_tf_off", "_tf_b", "_tf_gk2", _BKT, _GK, _HEAVY)


def number_rows(df: DataFrame, group_cols, order_cols, out_col: str = "rn",
                n_ranges: int | None = None) -> DataFrame:
    """``row_number() over (partition by group order by order)`` (1-based,
    ``bigint``) without putting a whole group in one task."""
    group_cols, order_cols = list(group_cols), list(order_cols)
    return _ordered(df, group_cols, order_cols, out_col,
                    F.count(F.lit(1)), F.count(F.lit(1)), n_ranges)


def running_sum(df: DataFrame, group_cols, order_cols, value_col: str, out_col: str = "running",
                n_ranges: int | None = None) -> DataFrame:
    """``sum(value) over (partition by group order by order rows between
    unbounded preceding and current row)`` without a per-group task. Null
    values count as 0 (SQL would give null while every value so far is null).
    If the first order column cannot be bucketed (a struct, say), each group
    is one range: still correct, not split."""
    group_cols, order_cols = list(group_cols), list(order_cols)
    v = F.coalesce(F.col(value_col), F.lit(0)).cast("bigint")
    return _ordered(df, group_cols, order_cols, out_col, F.sum(v), F.sum(v), n_ranges)


def neighbor_values(df: DataFrame, group_cols, order_cols, cols, step: int = -1, prefix: str | None = None,
                    n_ranges: int | None = None) -> DataFrame:
    """``lag(c)`` (``step=-1``) or ``lead(c)`` (``step=1``) over ``partition
    by group order by order`` for each of ``cols``, added as ``<prefix><c>``,
    without a per-group task.

    Inside each (group, range) window the neighbour comes from ``lag``/``lead``.
    Only the edge row of a hot group's range (its first row for ``lag``, last
    for ``lead``) needs the neighbouring range: a small table holds each such
    range's last (or first) row, shifted by one range inside the group, and is
    joined on the window's own keys. ``<prefix>exists`` tells a real
    neighbour with null values from no neighbour."""
    group_cols, order_cols, cols = list(group_cols), list(order_cols), list(cols)
    if step not in (-1, 1):
        raise ValueError("step must be -1 or 1")
    prefix = prefix or ("prev_" if step < 0 else "next_")
    shift = F.lag if step < 0 else F.lead
    ranged = _with_ranges(df, group_cols, order_cols, n_ranges)
    carried = cols + ["_tf_one"]
    ranged = ranged.withColumn("_tf_one", F.lit(True))
    w = Window.partitionBy(_GK, _BKT).orderBy(*order_cols)
    within = ranged
    for c in carried:
        within = within.withColumn(f"_tf_nb_{c}", shift(c).over(w))

    row = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(carried)])
    key = F.struct(*order_cols)
    edge_row = F.max_by(row, key) if step < 0 else F.min_by(row, key)
    # edge rows of hot groups only: at most (hot groups) x (ranges) rows
    edges = ranged.where(F.col(_HEAVY)).groupBy(_GK, _BKT).agg(edge_row.alias("_tf_edge"))
    across = Window.partitionBy(_GK).orderBy(_BKT)
    bounds = edges.select(F.col(_GK).alias("_tf_gk2"), F.col(_BKT).alias("_tf_b"),
                          shift("_tf_edge").over(across).alias("_tf_other"))

    joined = within.join(bounds, (F.col(_GK) == F.col("_tf_gk2")) & (F.col(_BKT) == F.col("_tf_b")), "left")
    at_edge = F.col("_tf_nb__tf_one").isNull()
    out = joined
    for i, c in enumerate(carried):
        name = f"{prefix}exists" if c == "_tf_one" else f"{prefix}{c}"
        out = out.withColumn(name, F.when(at_edge, F.col("_tf_other")[f"v{i}"]).otherwise(F.col(f"_tf_nb_{c}")))
    out = out.withColumn(f"{prefix}exists", F.coalesce(F.col(f"{prefix}exists"), F.lit(False)))
    return out.drop("_tf_gk2", "_tf_b", "_tf_other", "_tf_one", _BKT, _GK, _HEAVY,
                    *[f"_tf_nb_{c}" for c in carried])
