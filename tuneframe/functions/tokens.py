"""Token-id array helpers (native array functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tuneframe.functions.text import col_of

__all__ = ["answer_tokens", "pad_tokens", "join_ints"]


def answer_tokens(output_ids, prompt_len) -> Column:
    """Drop the first ``prompt_len`` ids of a generated sequence (empty when
    the prompt is at least as long as the output)."""
    ids = col_of(output_ids)
    n = F.greatest(col_of(prompt_len).cast("int"), F.lit(0))
    return F.when(n >= F.size(ids), F.slice(ids, 1, 0)).otherwise(F.slice(ids, n + 1, F.size(ids) - n))


def pad_tokens(ids, width: int, pad_id, left, eos_id=None) -> Column:
    """Pad to ``width`` with ``pad_id`` on the left where ``left`` is true
    (inference), else on the right (training). Longer sequences are left
    unchanged. A tokenizer without a pad id pads with its end id: give
    ``pad_id=None`` (or a null column) and ``eos_id``."""
    a = col_of(ids)

    def as_col(v):
        return F.lit(v) if v is None or isinstance(v, int) else col_of(v)
    pad_value = F.coalesce(as_col(pad_id), as_col(eos_id)) if eos_id is not None else as_col(pad_id)
    pad = F.array_repeat(pad_value, F.greatest(F.lit(width) - F.size(a), F.lit(0)))
    left_c = col_of(left) if not isinstance(left, bool) else F.lit(left)
    return F.when(left_c, F.concat(pad, a)).otherwise(F.concat(a, pad))


def join_ints(c, sep: str = ",") -> Column:
    return F.array_join(col_of(c).cast("array<string>"), sep)
