"""Validation queries over ``raw_lines``, ``requests``, ``pages`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tuneframe import constants as K
from tuneframe.functions import paths as P
from tuneframe.functions import text as TX
from tuneframe.operators import render as RO
from tuneframe.operators import validation as V
from tuneframe.plans import fixtures as FX
from tuneframe.plans.catalog import query
from tuneframe.plans.oracle_views import with_views
from tuneframe.plans.sqltext import strip
from tuneframe.sources.lines import number_in_blocks

REQUIRED = ("k",)
EXPECTED = 60


def _verdicts(spark, d, numbered=True):
    classified = V.classify_lines(FX.raw_lines(spark, d, numbered), "line", REQUIRED)
    return V.file_verdicts(classified, "file_id", "line_no", REQUIRED, EXPECTED)


# DuckDB: json_valid matches Python's json.loads on "one value, nothing after".
_KIND = ("CASE WHEN NOT coalesce(json_valid(line), false) THEN 'invalid_json' "
         "WHEN json_type(CASE WHEN json_valid(line) THEN line ELSE 'null' END) <> 'OBJECT' THEN 'not_object' "
         "ELSE 'ok' END")
_CLS = f"SELECT file_id, line_no, line, {_KIND} AS kind FROM raw_lines WHERE length({strip('line')}) > 0"
_MISS_K = "(kind = 'ok' AND NOT list_contains(json_keys(CASE WHEN kind = 'ok' THEN line ELSE '{}' END), 'k'))"
_PER_FILE = (f"SELECT file_id, count(*) FILTER (WHERE kind = 'ok') AS record_count, "
             f"count(*) FILTER (WHERE kind <> 'ok') AS n_bad, bool_or({_MISS_K}) AS miss_k FROM cls GROUP BY file_id")


def _lines_sql(body: str) -> str:
    return with_views(body, "raw_lines", extra=(("cls", _CLS), ("per", _PER_FILE)))


@query("record_check", _lines_sql("SELECT file_id, line_no, kind FROM cls"))
def q_record_check(spark, d):
    return V.classify_lines(FX.raw_lines(spark, d), "line", REQUIRED).select("file_id", "line_no", "kind")


@query("missing_fields", _lines_sql(f"SELECT file_id, line_no, CASE WHEN {_MISS_K} THEN 'k' ELSE '' END AS missing "
                                    "FROM cls WHERE kind = 'ok'"))
def q_missing_fields(spark, d):
    return V.missing_fields(V.classify_lines(FX.raw_lines(spark, d), "line", REQUIRED))


@query("dataset_verdict", _lines_sql(
    f"SELECT file_id, record_count, CASE WHEN miss_k THEN 'k' ELSE '' END AS missing_fields, "
    f"record_count > 0 AND NOT miss_k AS schema_valid, "
    f"record_count > 0 AND NOT miss_k AND record_count = {EXPECTED} AS valid FROM per WHERE n_bad = 0"))
def q_dataset_verdict(spark, d):
    return V.dataset_verdict(_verdicts(spark, d, numbered=False))


@query("first_error", _lines_sql(
    "SELECT file_id, min(line_no) AS line_no, arg_min(kind, line_no) AS kind FROM cls WHERE kind <> 'ok' GROUP BY file_id"))
def q_first_error(spark, d):
    return V.first_error(_verdicts(spark, d))


@query("quarantine_split", _lines_sql(
    "SELECT file_id, CASE WHEN n_bad = 0 THEN 'published' ELSE 'quarantined' END AS state, record_count FROM per"))
def q_quarantine_split(spark, d):
    return V.publish_state(_verdicts(spark, d, numbered=False))


# --- dataset upload gate -------------------------------------------------------------

GATE_BYTES = 700  # between the sizes of the test files
_GATE = ("SELECT file_id, filename, size_bytes, CASE WHEN file_id % 5 IN (0, 1) THEN 'bad_suffix' "
         f"WHEN size_bytes > {GATE_BYTES} THEN 'too_large' ELSE coalesce(kind, 'stored') END AS outcome FROM ("
         "SELECT file_id, CASE file_id % 5 WHEN 0 THEN 'dir/.jsonl' WHEN 1 THEN 'a.jsonl.txt' WHEN 2 THEN 'a.JSON' "
         "ELSE 'a b.jsonl' END AS filename, cast(sum(strlen(raw_lines.line) + 1) AS BIGINT) AS size_bytes, "
         "arg_min(kind, raw_lines.line_no) FILTER (WHERE kind <> 'ok') AS kind "
         "FROM raw_lines LEFT JOIN cls USING (file_id, line_no) GROUP BY file_id) t")


@query("upload_gate", _lines_sql(_GATE))
def q_upload_gate(spark, d):
    c = V.classify_lines(FX.raw_lines(spark, d), "line", REQUIRED, keep_blank=True)
    size = F.sum(F.octet_length("line") + 1).cast("bigint").alias("size_bytes")
    files = V.file_verdicts(c, "file_id", "line_no", REQUIRED, EXPECTED, extra_aggs=[size])
    k = F.col("file_id") % 5
    name = F.when(k == 0, "dir/.jsonl").when(k == 1, "a.jsonl.txt").when(k == 2, "a.JSON").otherwise("a b.jsonl")
    return V.upload_gate(files.withColumn("filename", name), error="first_bad_kind", max_bytes=GATE_BYTES) \
        .select("file_id", "filename", "size_bytes", "outcome")


# --- UTF-8, architectures, field values (C5, C13, C25) ---------------------------------

#: Well-formed UTF-8, over upper-case hexadecimal digits.
UTF8_HEX = ("([0-7].|(C[2-9A-F]|D.)[89AB].|E0[AB].[89AB].|(E[1-9A-CEF])([89AB].){2}|ED[89].[89AB].|F0[9AB].([89AB].){2}|"
            "F[1-3]([89AB].){3}|F48.([89AB].){2})*")


@query("utf8_check",
       f"SELECT doc_id, regexp_full_match(h, '{UTF8_HEX}') AS utf8_ok FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) || CASE doc_id % 9 "
       "WHEN 1 THEN 'FF' WHEN 2 THEN 'E282' WHEN 3 THEN 'EDA080' WHEN 4 THEN 'E282AC' WHEN 5 THEN 'C080' WHEN 6 THEN 'F4908080' "
       "WHEN 7 THEN 'F09F9880' ELSE '' END AS h FROM documents) t")
def q_utf8_check(spark, d):
    docs = FX.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    k = F.col("doc_id") % 9
    # A byte that never occurs, a cut-off sequence, half a surrogate pair, an overlong form, a code point
    # beyond the last; and two sound letters.
    ends = {1: "FF", 2: "E282", 3: "EDA080", 4: "E282AC", 5: "C080", 6: "F4908080", 7: "F09F9880"}
    end = F.coalesce(*[F.when(k == i, F.unhex(F.lit(h))) for i, h in ends.items()], F.unhex(F.lit("")))
    return docs.select("doc_id", TX.is_utf8(F.concat("b", end)).alias("utf8_ok"))


_CONFIGS = ('{"model_type": "llama", "architectures": ["LlamaForCausalLM"]}', '{"model_type": "x", "architectures": "GPT2LMHeadModel"}',
            '{"model_type": "x", "architectures": ["BertModel", "Other"]}', '{"model_type": "x", "architectures": []}',
            '{"model_type": "x"}', '{"model_type": 3, "architectures": ["AForCausalLM"]}', '["model_type"]',
            '{"model_type": "x", "architectures": ["AForCausalLM", 1]}', '{"model_type": "x", "architectures": {"a": 1}}',
            '{"model_type": "x", "architectures": ""}', '{"architectures": ["AForCausalLM"]}')
_CONFIG_SQL = "CASE c_custkey % 11 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CONFIGS)) + " END"
# The names in them are a customer's segment and number.
_CONFIG_SQL = f"replace(replace({_CONFIG_SQL}, 'llama', lower(c_mktsegment)), 'AForCausalLM', c_mktsegment || c_custkey || 'ForCausalLM')"
_ARCH = "json_extract(config, '$.architectures')"
_NAMES = f"CASE WHEN json_type({_ARCH}) = 'VARCHAR' THEN [json_extract_string(config, '$.architectures')] ELSE " \
         f"coalesce(json_extract_string({_ARCH}, '$[*]'), []) END"


@query("architecture_check",
       "SELECT c_custkey, CASE WHEN json_type(config) <> 'OBJECT' OR coalesce(json_type(config, '$.model_type'), '') <> 'VARCHAR' "
       f"THEN 'no_model_type' WHEN {_ARCH} IS NULL OR cast({_ARCH} AS VARCHAR) IN ('[]', '\"\"') THEN NULL "
       f"WHEN json_type({_ARCH}) NOT IN ('ARRAY', 'VARCHAR') OR (json_type({_ARCH}) = 'ARRAY' AND "
       f"len(list_filter(json_extract({_ARCH}, '$[*]'), lambda x: json_type(x) <> 'VARCHAR')) > 0) THEN 'bad_architectures' "
       f"WHEN len(list_filter({_NAMES}, lambda x: contains(x, 'ForCausalLM') OR contains(x, 'LMHeadModel'))) = 0 "
       f"THEN 'not_causal_lm' END AS problem FROM (SELECT c_custkey, {_CONFIG_SQL} AS config FROM customer) t")
def q_architecture_check(spark, d):
    k = F.col("c_custkey") % 11
    text = F.coalesce(*[F.when(k == i, F.lit(c)) for i, c in enumerate(_CONFIGS)])
    text = F.replace(F.replace(text, F.lit("llama"), F.lower("c_mktsegment")), F.lit("AForCausalLM"),
                     F.concat("c_mktsegment", F.col("c_custkey").cast("string"), F.lit("ForCausalLM")))
    configs = FX.table(spark, d, "customer").select("c_custkey", F.parse_json(text).alias("config"))
    return V.check_architecture(configs).select("c_custkey", "problem")


# Values by kind, as JSON and as Python's str prints them; {} is the number in props.
_VALUES = (("{}", "{}"), ("{}.0", "{}.0"), ("-0.0", "-0.0"), ("NaN", "nan"), ("true", "True"), ("null", "None"),
           ('"text {}"', "text {}"), ('{{"b": {}, "a": [null, "x"]}}', "{{''b'': {}, ''a'': [None, ''x'']}}"),
           ("1{}00000000000000000000000000000", "1{}00000000000000000000000000000"))
_K_SQL = "json_extract_string(props, '$.k')"


def _value_sql(shown: str) -> str:
    left, mid, right = shown.replace("{{", "\x01").replace("}}", "\x02").partition("{}")
    text = f"'{left}'" + (f" || {_K_SQL} || '{right}'" if mid else "")
    return text.replace("\x01", "{").replace("\x02", "}")


@query("rendered_values", "SELECT event_id, CASE event_id % 10 " + " ".join(
    f"WHEN {i} THEN {_value_sql(shown)}" for i, (_, shown) in enumerate(_VALUES)) + " END AS input FROM events")
def q_rendered_values(spark, d):
    ev = FX.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    parts = [js.replace("{{", "\x01").replace("}}", "\x02").partition("{}") for js, _ in _VALUES]
    value = F.coalesce(*[
        F.when(F.col("event_id") % 10 == i, F.concat(
            F.lit(a.replace("\x01", "{").replace("\x02", "}")), F.col("k") if m else F.lit(""),
            F.lit(b.replace("\x01", "{").replace("\x02", "}")))) for i, (a, m, b) in enumerate(parts)])
    line = F.when(value.isNull(), F.lit('{"other": 1}')).otherwise(F.concat(F.lit('{"input": "old", "input": '), value, F.lit("}")))
    return RO.records_from_lines(ev.select("event_id", line.alias("line")), fields=("input",), keep=("event_id",))


# --- training requests ------------------------------------------------------------

def _request_sql() -> str:
    cols = {"rank": "adapter_rank", "epochs": "epochs", "learning_rate": "learning_rate", "batch_size": "batch_size",
            "alpha": "CASE WHEN request_id % 6 > 0 THEN request_id % 140 END", "dropout": "(request_id % 60) / 100.0",
            "sequence_length": "(100 + request_id % 2100)"}
    parts = ["CASE WHEN coalesce(CASE WHEN request_id % 13 > 0 THEN method END, 'lora') NOT IN ('lora', 'qlora') THEN 'method' END"]
    for name, default, lo, lo_incl, hi in K.REQUEST_RULES:
        v = f"coalesce({cols[name]}, {default})" if name in cols else f"{default}"
        op = ">=" if lo_incl else ">"
        parts.append(f"CASE WHEN NOT ({v} {op} {lo} AND {v} <= {hi}) THEN '{name}' END")
    return with_views(f"SELECT request_id, concat_ws(',', {', '.join(parts)}) AS violations FROM requests",
                      "requests")


@query("request_check", _request_sql())
def q_request_check(spark, d):
    k = F.col("request_id")
    requests = FX.requests(spark, d).withColumns({
        "method": F.when(k % 13 > 0, F.col("method")), "alpha": F.when(k % 6 > 0, k % 140),
        "dropout": (k % 60) / F.lit(100.0), "sequence_length": 100 + k % 2100})
    return V.check_requests(requests, cols={"rank": "adapter_rank"}).select("request_id", "violations")


# --- ids, stored names, safe names, paths, repo refs -------------------------------

_ID_SQL = ("SELECT page_id, upload_id, coalesce(regexp_full_match(upload_id, '[0-9a-f]{32}'), false) AS ok FROM ("
           "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN left(u, 31) ELSE u END AS upload_id FROM ("
           "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN upper(md5(cast(page_id AS VARCHAR))) "
           "ELSE md5(cast(page_id AS VARCHAR)) END AS u FROM pages) a) b")


@query("id_check", _ID_SQL)
def q_id_check(spark, d):
    pages = FX.table(spark, d, "pages").select("page_id")
    pid = F.col("page_id")
    u = F.md5(pid.cast("string"))
    u = F.when(pid % 2 == 0, F.upper(u)).otherwise(u)
    u = F.when(pid % 3 == 0, F.substring(u, 1, 31)).otherwise(u)
    return pages.select(pid, u.alias("upload_id")).withColumn("ok", TX.is_upload_id("upload_id"))


@query("stored_names", with_views(
    "SELECT page_id, CASE WHEN strpos(stored_name, '_') > 0 THEN substr(stored_name, 1, strpos(stored_name, '_') - 1) "
    "ELSE stored_name END AS upload_id, "
    "CASE WHEN strpos(stored_name, '_') > 0 THEN substr(stored_name, strpos(stored_name, '_') + 1) ELSE '' END "
    "AS filename FROM upload_paths", "upload_paths"))
def q_stored_names(spark, d):
    up = FX.upload_paths(spark, d)
    uid, fname = TX.split_stored_name("stored_name")
    return up.select("page_id", uid.alias("upload_id"), fname.alias("filename"))


_PARTS = "list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda p: p <> '' AND p <> '.')"


@query("safe_names", with_views(
    f"SELECT page_id, coalesce(nullif(left(trim(regexp_replace(coalesce({_PARTS}[-1], ''), "
    f"'[^A-Za-z0-9._-]+', '_', 'g'), '._'), 160), ''), 'upload.jsonl') AS safe_name FROM upload_paths",
    "upload_paths"))
def q_safe_names(spark, d):
    return FX.upload_paths(spark, d).select("page_id", TX.safe_name("path").alias("safe_name"))


@query("path_check", with_views(
    f"SELECT page_id, CASE WHEN starts_with(replace(path, chr(92), '/'), '/') THEN '/' ELSE '' END "
    f"|| array_to_string({_PARTS}, '/') AS normal_path, "
    f"length({strip('path')}) > 0 AND NOT starts_with(replace(path, chr(92), '/'), '/') AND len({_PARTS}) > 0 "
    f"AND NOT list_contains({_PARTS}, '..') AS is_safe FROM upload_paths", "upload_paths"))
def q_path_check(spark, d):
    up = FX.upload_paths(spark, d)
    return up.select("page_id", P.normalise_path("path").alias("normal_path"), P.is_safe_path("path").alias("is_safe"))


@query("repo_refs",
       "SELECT doc_id, repo, coalesce(regexp_full_match(repo, '[A-Za-z0-9][A-Za-z0-9_.-]*/[A-Za-z0-9][A-Za-z0-9_.-]*') "
       "AND length(repo) BETWEEN 3 AND 200, false) AS ok FROM (SELECT doc_id, lang || '/' || source || "
       "CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END AS repo FROM documents) t")
def q_repo_refs(spark, d):
    docs = FX.table(spark, d, "documents")
    repo = F.concat(F.col("lang"), F.lit("/"), F.col("source"),
                    F.when(F.col("doc_id") % 7 == 0, F.lit("!")).otherwise(F.lit("")))
    return docs.select("doc_id", repo.alias("repo")).withColumn("ok", TX.is_repo_ref("repo"))


# --- line numbers (A2) -----------------------------------------------------------------

@query("line_numbers",
       "SELECT source, doc_id, cast(row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) AS BIGINT) AS line_no "
       "FROM documents")
def q_line_numbers(spark, d):
    docs = FX.table(spark, d, "documents").select("source", "lang", "doc_id")
    return number_in_blocks(docs, "source", "lang", "doc_id", "line_no").select("source", "doc_id", "line_no")
