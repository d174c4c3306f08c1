"""Token, batch and inference queries over ``records`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tuneframe import constants as K
from tuneframe.functions.text import PIECE_PATTERN, TOKEN_PATTERN
from tuneframe.functions.tokens import answer_tokens, join_ints, pad_tokens
from tuneframe.operators import batches as B
from tuneframe.operators import infer as I
from tuneframe.operators import render as RO
from tuneframe.plans import fixtures as FX
from tuneframe.plans.catalog import query
from tuneframe.plans.oracle_views import with_views
from tuneframe.plans.q_render import _PROBLEM
from tuneframe.plans.sqltext import strip

EPOCHS, BATCH, SEED = 2, 2, 3407
ACCUM = max(1, 4 // BATCH)
BUDGET = 64
PAD_WIDTH = 24

_TOKS = f"regexp_extract_all(text, '{TOKEN_PATTERN}')"
_IDS = f"list_transform({_TOKS}, lambda w: length(w))"


@query("batch_plan", with_views(
    f"SELECT cast(epoch AS BIGINT) AS epoch, cast((rn - 1) // {BATCH} AS BIGINT) AS batch_no, record_id, "
    f"cast(((rn - 1) // {BATCH}) // {ACCUM} AS BIGINT) AS step FROM ("
    f"SELECT epoch, record_id, row_number() OVER (PARTITION BY epoch ORDER BY "
    f"md5('{SEED}:' || cast(epoch AS VARCHAR) || ':' || cast(record_id AS VARCHAR)), record_id) AS rn FROM ("
    f"SELECT record_id, unnest(range(1, {EPOCHS + 1})) AS epoch FROM records) e) t", "records"))
def q_batch_plan(spark, d):
    return B.batch_plan(FX.records(spark, d), "record_id", EPOCHS, BATCH, SEED)


@query("token_budget",
       f"SELECT doc_id, cast(len(toks) AS BIGINT) AS n_tokens, CASE WHEN len(toks) > {BUDGET} THEN "
       f"array_to_string(list_slice(pieces, 1, {BUDGET}), '') ELSE text END AS kept_text, len(toks) > {BUDGET} AS cut "
       f"FROM (SELECT doc_id, text, {_TOKS} AS toks, regexp_extract_all(text, '{PIECE_PATTERN}') AS pieces FROM documents) t")
def q_token_budget(spark, d):
    docs = FX.table(spark, d, "documents").select("doc_id", "text")
    return B.token_budget(docs, "text", BUDGET).select("doc_id", "n_tokens", "kept_text", "cut")


@query("answer_tokens",
       "SELECT doc_id, array_to_string(list_slice(ids, doc_id % 25 + 1, len(ids)), ',') AS answer "
       f"FROM (SELECT doc_id, {_IDS} AS ids FROM documents) t")
def q_answer_tokens(spark, d):
    docs = FX.table(spark, d, "documents").select("doc_id", B.word_length_ids("text").alias("ids"))
    return docs.select("doc_id", join_ints(answer_tokens("ids", F.col("doc_id") % 25)).alias("answer"))


_PAD = f"list_resize([0], greatest({PAD_WIDTH} - len(ids), 0), 0)"


@query("padded_tokens",
       f"SELECT doc_id, array_to_string(CASE WHEN doc_id % 2 = 0 THEN list_concat({_PAD}, ids) "
       f"ELSE list_concat(ids, {_PAD}) END, ',') AS padded FROM (SELECT doc_id, {_IDS} AS ids FROM documents) t")
def q_padded_tokens(spark, d):
    docs = FX.table(spark, d, "documents").select("doc_id", B.word_length_ids("text").alias("ids"))
    padded = pad_tokens("ids", PAD_WIDTH, 0, F.col("doc_id") % 2 == 0)
    return docs.select("doc_id", join_ints(padded).alias("padded"))


#: Tokens of the prompt before the command; a cut prompt leaves the command this many fewer.
_BEFORE = len(f"### Instruction {K.INFERENCE_INSTRUCTION} ### Input".split())
#: Commands whose prompts are longer than a model takes: the first letters of the
#: record's words, over and over, up to the longest command that is let in.
_WS = TOKEN_PATTERN[2:-2]
_LONG = (f"SELECT record_id, CASE WHEN record_id % 3 = 0 AND length(input) > 0 THEN "
         f"left(repeat(regexp_replace(input, '([^{_WS}])[^{_WS}]*', '\\1', 'g') || ' ', 4000), {K.COMMAND_MAX_CHARS - 1}) "
         "ELSE input END AS input FROM records")
_ECHO = (f"array_to_string(list_slice(list_reverse(list_slice(regexp_extract_all({strip('input')}, '{TOKEN_PATTERN}'), 1, "
         f"{K.INFER_MAX_TOKENS - _BEFORE})), 1, {K.MAX_NEW_TOKENS}), ' ')")


@query("batch_infer", with_views(
    f"SELECT record_id, problem, CASE WHEN problem IS NULL THEN "
    f"coalesce(nullif({strip(_ECHO)}, ''), '{K.EMPTY_RESPONSE_NOTICE}') END AS response "
    f"FROM (SELECT record_id, input, {_PROBLEM} AS problem FROM long) t",
    "records", extra=(("long", _LONG),)))
def q_batch_infer(spark, d):
    letters = F.concat(F.regexp_replace("input", f"([^{_WS}])[^{_WS}]*", "$1"), F.lit(" "))
    long = F.substring(F.repeat(letters, 4000), 1, K.COMMAND_MAX_CHARS - 1)
    cmds = FX.records(spark, d).select("record_id", F.when((F.col("record_id") % 3 == 0) & (F.length("input") > 0), long)
                                       .otherwise(F.col("input")).alias("command"))
    prompts = RO.inference_prompts(cmds)
    answered = I.batch_infer(prompts.where("problem IS NULL"), I.echo_model, "prompt", keep=("record_id", "problem"))
    refused = prompts.where("problem IS NOT NULL").select("record_id", "problem", F.lit(None).cast("string").alias("response"))
    return answered.unionByName(refused)
