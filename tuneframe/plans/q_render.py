"""Rendering queries: user_message, training_text, chat_text, inference_prompt, clean_response."""

from __future__ import annotations

from pyspark.sql import functions as F

from tuneframe import constants as K
from tuneframe.operators import render as RO
from tuneframe.plans import fixtures as FX
from tuneframe.plans.catalog import query
from tuneframe.plans.oracle_views import with_views
from tuneframe.plans.sqltext import NL, sections, strip

_H = K.USER_HEADINGS
_USER = sections(list(zip(_H, ("instruction", "input", "workflow", "success_condition"))), "")
_TRAIN = sections(list(zip(_H + (K.RESPONSE_HEADING,),
                           ("instruction", "input", "workflow", "success_condition", "output"))), "### ")


@query("user_message", with_views(f"SELECT record_id, {_USER} AS text FROM records", "records"))
def q_user_message(spark, d):
    return RO.user_messages(FX.records(spark, d)).select("record_id", "text")


@query("training_text", with_views(f"SELECT record_id, {_TRAIN} AS text FROM records", "records"))
def q_training_text(spark, d):
    return RO.training_texts(FX.records(spark, d)).select("record_id", "text")


_CHAT = (f"'<user>' || {NL} || {_USER} || {NL} || '<assistant>' || {NL} || "
         f"coalesce(output, 'None') || {NL}")


@query("chat_text", with_views(f"SELECT record_id, {_CHAT} AS text FROM records", "records"))
def q_chat_text(spark, d):
    return RO.chat_texts(FX.records(spark, d)).select("record_id", "text")


_PROMPT = sections(list(zip(_H, (f"'{K.INFERENCE_INSTRUCTION}'", strip("input"), f"'{K.INFERENCE_WORKFLOW}'",
                                 f"'{K.INFERENCE_SUCCESS}'"))), "### ") + \
    f" || {NL} || {NL} || '### {K.RESPONSE_HEADING}' || {NL}"


_PROBLEM = (f"CASE WHEN coalesce(length(input), 0) = 0 THEN 'empty' WHEN length(input) > {K.COMMAND_MAX_CHARS} "
            f"THEN 'too_long' WHEN length({strip('input')}) = 0 THEN 'blank' END")


@query("inference_prompt", with_views(
    f"SELECT record_id, {_PROBLEM} AS problem, CASE WHEN {_PROBLEM} IS NULL THEN {_PROMPT} END AS prompt "
    f"FROM records", "records"))
def q_inference_prompt(spark, d):
    cmds = FX.records(spark, d).select("record_id", F.col("input").alias("command"))
    return RO.inference_prompts(cmds).select("record_id", "problem", "prompt")


_BLANKS = " \n\t\u3000 "
_BLANK_SQL = f"' ' || chr(10) || chr(9) || chr(12288) || ' '"


@query("clean_response",
       f"SELECT doc_id, coalesce(nullif({strip(f'CASE WHEN doc_id % 50 = 0 THEN {_BLANK_SQL} ELSE text END')}, ''), "
       f"'{K.EMPTY_RESPONSE_NOTICE}') AS response FROM documents")
def q_clean_response(spark, d):
    docs = FX.table(spark, d, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 50 == 0, F.lit(_BLANKS)).otherwise(F.col("text")).alias("response"))
    return RO.clean_responses(docs).select("doc_id", "response")
