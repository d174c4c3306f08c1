"""Rendering instruction records into training and inference text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneframe import constants as K
from tuneframe.functions import render as R
from tuneframe.functions.text import py_strip

FIELDS = ("instruction", "input", "output", "workflow", "success_condition")


def _f(df: DataFrame, name: str, cols: dict | None):
    return F.col((cols or {}).get(name, name))


def user_messages(df: DataFrame, cols: dict | None = None, out: str = "text") -> DataFrame:
    return df.withColumn(out, R.user_message(_f(df, "instruction", cols), _f(df, "input", cols),
                                             _f(df, "workflow", cols), _f(df, "success_condition", cols)))


def training_texts(df: DataFrame, cols: dict | None = None, out: str = "text") -> DataFrame:
    return df.withColumn(out, R.training_text(_f(df, "instruction", cols), _f(df, "input", cols),
                                              _f(df, "workflow", cols), _f(df, "success_condition", cols),
                                              _f(df, "output", cols)))


def chat_texts(df: DataFrame, cols: dict | None = None, out: str = "text", template=None,
               add_generation_prompt: bool = False) -> DataFrame:
    """Chat rendering. ``template`` is ``None`` for the built-in role-tag
    template, or a function ``list[list[dict]] -> list[str]`` (for example a
    tokenizer's chat template) run per Arrow batch."""
    msgs = R.chat_messages(_f(df, "instruction", cols), _f(df, "input", cols), _f(df, "workflow", cols),
                           _f(df, "success_condition", cols), _f(df, "output", cols))
    if template is None:
        return df.withColumn(out, R.role_tag_template(msgs, add_generation_prompt))
    return df.withColumn(out, _templated(template, add_generation_prompt)(msgs))


def _templated(template, add_generation_prompt: bool):
    @F.pandas_udf(T.StringType())
    def apply_template(batch: pd.Series) -> pd.Series:
        convs = [[{"role": m["role"], "content": m["content"]} for m in row] for row in batch]
        return pd.Series(template(convs, add_generation_prompt), index=batch.index)
    return apply_template


def clean_commands(df: DataFrame, command: str = "command", out: str = "command_clean",
                   max_chars: int = K.COMMAND_MAX_CHARS) -> DataFrame:
    """Every row, with the stripped command in ``out`` and in ``problem`` why
    a command is refused, else null: ``empty`` (null or no character) and
    ``too_long`` are tested before stripping, as the server does, ``blank``
    after it, as the page does. ``out`` is null where there is a problem."""
    raw = F.col(command)
    stripped = py_strip(raw)
    size = F.coalesce(F.length(raw), F.lit(0))
    problem = (F.when(size == 0, "empty").when(size > max_chars, "too_long")
               .when(F.length(stripped) == 0, "blank"))
    return df.withColumn("problem", problem).withColumn(out, F.when(F.col("problem").isNull(), stripped))


def inference_prompts(df: DataFrame, command: str = "command", out: str = "prompt", **texts) -> DataFrame:
    """Every row, with its prompt, or null and the ``problem`` of its command."""
    prompt = F.when(F.col("problem").isNull(), R.inference_prompt(F.col(command), **texts))
    return clean_commands(df, command).withColumn(out, prompt).drop("command_clean")


def chat_inference_prompts(df: DataFrame, command: str = "command", out: str = "prompt", template=None,
                           **texts) -> DataFrame:
    """``inference_prompts`` for models with a chat template: one user message
    (the four sections around the command) and an open assistant turn.
    ``template`` is as in ``chat_texts``."""
    msg = F.array(F.struct(F.lit("user").alias("role"),
                           R.inference_message(F.col("command_clean"), **texts).alias("content")))
    checked = clean_commands(df, command)
    if template is None:
        text = R.role_tag_template(msg, True)
    else:
        text = _templated(template, True)(msg)
    return checked.withColumn(out, F.when(F.col("problem").isNull(), text)).drop("command_clean")


def clean_responses(df: DataFrame, response: str = "response", out: str = "response") -> DataFrame:
    return df.withColumn(out, R.clean_response(F.col(response)))


def records_from_lines(lines: DataFrame, line: str = "line", fields=FIELDS, keep=("file_id", "line_no")) -> DataFrame:
    """Records of well-formed object lines with each field rendered as Python
    ``str`` prints it (C25): a duplicated key takes its last value, null prints
    as ``None``, a missing field is null. Strings, booleans, null and 64-bit
    integers are rendered natively; a line with any other value goes to Python
    once, as a whole, since only its own text keeps key order, number forms,
    NaN and long integers."""
    from tuneframe.functions.jsonl import JSON_OPTS
    entries = F.map_entries(F.from_json(F.col(line), "map<string,variant>", JSON_OPTS))
    kept = [k for k in keep if k in lines.columns]
    out = lines.select(*kept, F.col(line).alias("_tf_line"), entries.alias("_tf_e"))
    simple, known = [], F.col("_tf_e").isNotNull()
    for f in fields:
        hits = F.filter(F.col("_tf_e"), _key_is(f))
        out = out.withColumn(f"_tf_v_{f}", F.when(F.size(hits) > 0, F.element_at(hits, -1)["value"])) \
            .withColumn(f"_tf_has_{f}", F.size(hits) > 0)
        v, has = F.col(f"_tf_v_{f}"), F.col(f"_tf_has_{f}")
        kind = F.schema_of_variant(v)
        native = (F.when(v.isNull() | (kind == "VOID"), "None").when(kind == "STRING", F.variant_get(v, "$", "string"))
                  .when(kind == "BOOLEAN", F.when(F.variant_get(v, "$", "boolean"), "True").otherwise("False"))
                  .when(kind == "BIGINT", F.variant_get(v, "$", "bigint").cast("string")))
        simple.append(F.when(has, native).alias(f))
        known = known & (~has | native.isNotNull())
    names = list(fields)

    @F.pandas_udf(T.StructType([T.StructField(f, T.StringType()) for f in names]))
    def by_python(texts: pd.Series) -> pd.DataFrame:
        docs = [{} if t is None else json.loads(t) for t in texts]
        return pd.DataFrame({f: [str(d[f]) if f in d else None for d in docs] for f in names}, columns=names,
                            index=texts.index, dtype=object)

    out = out.select(*kept, "_tf_line", F.coalesce(known, F.lit(False)).alias("_tf_known"),
                     F.struct(*simple).alias("_tf_simple"))
    out = out.withColumn("_tf_py", by_python(F.when(~F.col("_tf_known"), F.col("_tf_line"))))
    return out.select(*kept, *[F.when(F.col("_tf_known"), F.col("_tf_simple")[f]).otherwise(F.col("_tf_py")[f]).alias(f)
                               for f in names])


def _key_is(name: str):
    return lambda e: e["key"] == name
