"""Strict one-object-per-line JSON checks without Python rows.

``from_json`` alone accepts trailing text and single quotes, so a line is
parsed twice, wrapped once as a one-element array and once as the value of a
one-key object. Both wrappers must see exactly one well-formed value, and the
line must open with ``{``. The same double wrap over ``variant`` tells a
well-formed non-object from broken JSON.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneframe.functions.text import col_of

__all__ = ["JSON_OPTS", "parsed_map", "is_json_object", "is_json_value", "line_kind", "missing_keys",
           "KIND_OK", "KIND_INVALID", "KIND_NOT_OBJECT", "object_wrappers", "object_from_wrappers",
           "kind_from_wrappers", "json_document"]

JSON_OPTS = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
KIND_OK = "ok"
KIND_INVALID = "invalid_json"
KIND_NOT_OBJECT = "not_object"


def _as_array(c: Column, element: str) -> Column:
    return F.from_json(F.concat(F.lit("["), c, F.lit("]")), f"array<{element}>", JSON_OPTS)


def _as_member(c: Column, value: str) -> Column:
    return F.from_json(F.concat(F.lit('{"r":'), c, F.lit("}")), f"map<string,{value}>", JSON_OPTS)


def parsed_map(c) -> Column:
    """The object as ``map<string,string>`` (null unless one object); keys with
    JSON null stay present, so presence tests match ``key in record``."""
    return F.get(_as_array(col_of(c), "map<string,string>"), 0)


def object_wrappers(c) -> tuple[Column, Column]:
    """The two wrapped parses; select them once as columns and pass them to
    ``object_from_wrappers``/``kind_from_wrappers`` so each line is parsed
    once per wrapper."""
    s = col_of(c)
    return _as_array(s, "map<string,string>"), _as_member(s, "map<string,string>")


def object_from_wrappers(a, b, c) -> Column:
    a, b, s = col_of(a), col_of(b), col_of(c)
    return F.coalesce(
        (F.size(a) == 1) & F.get(a, 0).isNotNull() & (F.size(b) == 1) & s.rlike(r"^[ \t\r\n]*\{"),
        F.lit(False))


def kind_from_wrappers(a, b, c) -> Column:
    """Like ``line_kind``; the variant parses run only for non-objects."""
    return (F.when(object_from_wrappers(a, b, c), F.lit(KIND_OK))
            .when(is_json_value(c), F.lit(KIND_NOT_OBJECT))
            .otherwise(F.lit(KIND_INVALID)))


def is_json_object(c) -> Column:
    a, b = object_wrappers(c)
    return object_from_wrappers(a, b, c)


def is_json_value(c) -> Column:
    s = col_of(c)
    return F.coalesce((F.size(_as_array(s, "variant")) == 1) & (F.size(_as_member(s, "variant")) == 1),
                      F.lit(False))


def line_kind(c) -> Column:
    """``ok`` / ``not_object`` / ``invalid_json`` for a non-blank line."""
    return (F.when(is_json_object(c), F.lit(KIND_OK))
            .when(is_json_value(c), F.lit(KIND_NOT_OBJECT))
            .otherwise(F.lit(KIND_INVALID)))


def missing_keys(fields_map, required) -> Column:
    """Required keys absent from the parsed object, in the given order."""
    req = F.array(*[F.lit(r) for r in required])
    return F.array_except(req, F.coalesce(F.map_keys(col_of(fields_map)), F.array().cast("array<string>")))


def _finite(text: str) -> float:
    x = float(text)
    return x if math.isfinite(x) else 1.5


@F.pandas_udf(T.StringType())
def _plain_json(texts: pd.Series) -> pd.Series:
    """The same document with the last of repeated keys, and 1.5 in place of
    numbers that a variant cannot hold (none of the checks tells them apart)."""
    def one(t):
        try:
            return None if t is None else json.dumps(json.loads(t, parse_float=_finite, parse_constant=lambda _: 1.5))
        except (ValueError, RecursionError):
            return None
    return texts.map(one)


def json_document(c) -> Column:
    """The text as a variant, null unless it is one JSON object. Documents with
    NaN, infinities or repeated keys are accepted, as Python accepts them; only
    those are handed to Python."""
    text = col_of(c)
    ok = F.is_valid_utf8(text) & is_json_object(text)
    native = F.when(ok, F.try_parse_json(text))
    return F.coalesce(native, F.try_parse_json(_plain_json(F.when(ok & native.isNull(), text))))
