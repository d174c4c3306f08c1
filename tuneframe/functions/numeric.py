"""Small numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tuneframe.functions.text import col_of

__all__ = ["size_gib", "progress_pct", "int_div"]


def size_gib(c) -> Column:
    """Bytes in GiB rounded to two places (Spark rounds half up)."""
    return F.round(col_of(c).cast("double") / F.lit(float(1024 ** 3)), 2)


def int_div(a, b) -> Column:
    """Integer floor division of non-negative longs (SQL ``div``)."""
    a, b = col_of(a).cast("bigint"), col_of(b).cast("bigint")
    return ((a - F.pmod(a, b)) / b).cast("bigint")


def progress_pct(step, max_steps, status=None, done_status: str = "completed") -> Column:
    """``min(99, step*100 // max(max_steps, 1))``; 100 once completed."""
    steps = F.greatest(col_of(max_steps).cast("bigint"), F.lit(1).cast("bigint"))
    pct = F.least(F.lit(99).cast("bigint"), int_div(col_of(step).cast("bigint") * 100, steps))
    if status is not None:
        pct = F.when(col_of(status) == done_status, F.lit(100).cast("bigint")).otherwise(pct)
    return pct
