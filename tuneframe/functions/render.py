"""Prompt rendering: user message, training text, chat messages, inference prompt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tuneframe import constants as K
from tuneframe.functions.text import col_of, py_strip

__all__ = ["as_text", "user_message", "training_text", "chat_messages", "role_tag_template",
           "inference_message", "inference_prompt", "clean_response"]


def as_text(c) -> Column:
    """String form of a field value as Python ``str`` prints the common cases:
    strings unchanged, null as ``None``. Non-string JSON values are handled by
    ``tuneframe.operators.render.records_from_lines``."""
    return F.coalesce(col_of(c).cast("string"), F.lit("None"))


def _sections(pairs, heading_prefix: str) -> Column:
    parts = []
    for i, (heading, value) in enumerate(pairs):
        if i:
            parts.append(F.lit("\n\n"))
        parts.append(F.lit(f"{heading_prefix}{heading}\n"))
        parts.append(as_text(value))
    return F.concat(*parts)


def user_message(instruction, input_text, workflow, success_condition) -> Column:
    h = K.USER_HEADINGS
    return _sections(list(zip(h, (instruction, input_text, workflow, success_condition))), "")


def training_text(instruction, input_text, workflow, success_condition, output) -> Column:
    h = K.USER_HEADINGS + (K.RESPONSE_HEADING,)
    return _sections(list(zip(h, (instruction, input_text, workflow, success_condition, output))), "### ")


def chat_messages(instruction, input_text, workflow, success_condition, output) -> Column:
    """``[user, assistant]`` as ``array<struct<role,content>>``."""
    user = F.struct(F.lit("user").alias("role"),
                    user_message(instruction, input_text, workflow, success_condition).alias("content"))
    assistant = F.struct(F.lit("assistant").alias("role"), as_text(output).alias("content"))
    return F.array(user, assistant)


def role_tag_template(messages, add_generation_prompt: bool = False) -> Column:
    """Built-in template: ``<role>`` line, content, newline, per message."""
    body = F.array_join(
        F.transform(col_of(messages), lambda m: F.concat(F.lit("<"), m["role"], F.lit(">\n"), m["content"], F.lit("\n"))),
        "")
    if add_generation_prompt:
        body = F.concat(body, F.lit("<assistant>\n"))
    return body


def inference_message(command, instruction: str = K.INFERENCE_INSTRUCTION, workflow: str = K.INFERENCE_WORKFLOW,
                      success: str = K.INFERENCE_SUCCESS) -> Column:
    """The user message around a stripped command, for chat templates."""
    return user_message(F.lit(instruction), py_strip(command), F.lit(workflow), F.lit(success))


def inference_prompt(command, instruction: str = K.INFERENCE_INSTRUCTION, workflow: str = K.INFERENCE_WORKFLOW,
                     success: str = K.INFERENCE_SUCCESS) -> Column:
    """Training-format prompt around a stripped command with an open response."""
    pairs = list(zip(K.USER_HEADINGS, (F.lit(instruction), py_strip(command), F.lit(workflow), F.lit(success))))
    return F.concat(_sections(pairs, "### "), F.lit(f"\n\n### {K.RESPONSE_HEADING}\n"))


def clean_response(c, notice: str = K.EMPTY_RESPONSE_NOTICE) -> Column:
    return F.coalesce(F.nullif(py_strip(c), F.lit("")), F.lit(notice))
