"""Relative-path normalisation and safety checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tuneframe.functions.text import col_of, is_blank

__all__ = ["path_parts", "normalise_path", "is_absolute_path", "is_safe_path"]


def path_parts(c, backslash_is_separator: bool = True) -> Column:
    """Path components with empty and ``.`` parts dropped (``..`` kept)."""
    s = col_of(c)
    if backslash_is_separator:
        s = F.regexp_replace(s, r"\\", "/")
    return F.array_remove(F.array_remove(F.split(s, "/"), ""), ".")


def is_absolute_path(c, backslash_is_separator: bool = True) -> Column:
    s = col_of(c)
    if backslash_is_separator:
        s = F.regexp_replace(s, r"\\", "/")
    return F.coalesce(s.startswith("/"), F.lit(False))


def normalise_path(c, backslash_is_separator: bool = True) -> Column:
    """POSIX form: one leading ``/`` for absolute paths, parts joined by ``/``."""
    parts = F.array_join(path_parts(c, backslash_is_separator), "/")
    return F.when(is_absolute_path(c, backslash_is_separator), F.concat(F.lit("/"), parts)).otherwise(parts)


def is_safe_path(c, backslash_is_separator: bool = True) -> Column:
    """Not blank, not absolute, at least one part and no ``..`` part."""
    parts = path_parts(c, backslash_is_separator)
    return (~is_blank(c)) & (~is_absolute_path(c, backslash_is_separator)) \
        & (F.size(parts) > 0) & ~F.array_contains(parts, "..")
