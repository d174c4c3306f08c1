"""Dataset and request validation (C1-C5, C12-C14, C29, E1, E2, B4 split).

A dataset is a set of lines ``(file, line_no, line)``. Everything is a
per-line expression followed by one partial+final aggregation per file, so a
huge file is spread over all tasks (map-side combine) instead of one.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneframe import constants as K
from tuneframe.functions.jsonl import KIND_OK, kind_from_wrappers, object_wrappers
from tuneframe.functions.text import is_blank


def _field_flag(name: str) -> str:
    return f"_miss_{name}"


def classify_lines(lines: DataFrame, line: str = "line", required=K.REQUIRED_FIELDS,
                   keep_blank: bool = False) -> DataFrame:
    """Drop blank lines (or, with ``keep_blank``, keep them with a null
    ``kind``); add ``kind`` and, for objects, one ``_miss_<field>`` flag per
    required field plus ``missing`` (array, in required order).

    Each line is parsed once per wrapper (the parses are selected as columns
    and reused); the variant parses run only for lines that are not objects."""
    blank = is_blank(F.col(line))
    body = lines if keep_blank else lines.where(~blank)
    a, b = object_wrappers(F.col(line))
    parsed = body.withColumn("_tf_a", a).withColumn("_tf_b", b)
    kind = kind_from_wrappers("_tf_a", "_tf_b", F.col(line))
    kinded = parsed.withColumn("kind", F.when(~blank, kind) if keep_blank else kind)
    keys = F.map_keys(F.get(F.col("_tf_a"), 0))
    kinded = kinded.select(*[c for c in kinded.columns if c not in ("_tf_a", "_tf_b")], *[
        F.coalesce((F.col("kind") == KIND_OK) & ~F.coalesce(F.array_contains(keys, F.lit(r)), F.lit(False)),
                   F.lit(False)).alias(_field_flag(r))
        for r in required])
    missing = F.array_compact(F.array(*[F.when(F.col(_field_flag(r)), F.lit(r)) for r in required])) \
        if required else F.array().cast("array<string>")
    return kinded.withColumn("missing", missing)


def file_verdicts(classified: DataFrame, file_col: str = "file_id", line_no: str = "line_no",
                  required=K.REQUIRED_FIELDS, expected: int = K.EXPECTED_RECORDS, extra_aggs=()) -> DataFrame:
    """One row per file seen in ``classified``:
    ``record_count, n_bad, first_bad_line, first_bad_kind, missing_fields
    (sorted, comma-joined), schema_valid, valid``.

    Files without any non-blank line do not appear here; join to the file
    listing (``with_empty_files``) to report them."""
    ok = F.col("kind") == KIND_OK
    bad = F.col("kind") != KIND_OK  # null (blank line) counts as neither
    aggs = [F.count_if(ok).cast("bigint").alias("record_count"),
            F.count_if(bad).cast("bigint").alias("n_bad"),
            F.min(F.when(bad, F.struct(F.col(line_no).alias("l"), F.col("kind").alias("k")))).alias("_first")]
    aggs += [F.max(F.col(_field_flag(r)).cast("int")).alias(_field_flag(r)) for r in required]
    per_file = classified.groupBy(file_col).agg(*aggs, *extra_aggs)
    extra = per_file.columns[len(per_file.columns) - len(extra_aggs):] if extra_aggs else []
    ordered = sorted(required)
    missing = F.concat_ws(",", *[F.when(F.col(_field_flag(r)) == 1, F.lit(r)) for r in ordered]) \
        if ordered else F.lit("")
    schema_valid = (F.col("record_count") > 0) & (missing == "")
    return per_file.select(
        file_col, "record_count", "n_bad",
        F.col("_first.l").alias("first_bad_line"), F.col("_first.k").alias("first_bad_kind"),
        missing.alias("missing_fields"), schema_valid.alias("schema_valid"),
        (schema_valid & (F.col("record_count") == expected)).alias("valid"), *extra)


def with_empty_files(verdicts: DataFrame, listing: DataFrame, file_col: str = "file_id") -> DataFrame:
    """Add files of the listing that have no non-blank line: count 0, not valid."""
    empty = listing.select(file_col).join(verdicts.select(file_col), file_col, "left_anti")
    filler = empty.select(
        file_col, F.lit(0).cast("bigint").alias("record_count"), F.lit(0).cast("bigint").alias("n_bad"),
        F.lit(None).cast("bigint").alias("first_bad_line"), F.lit(None).cast("string").alias("first_bad_kind"),
        F.lit("").alias("missing_fields"), F.lit(False).alias("schema_valid"), F.lit(False).alias("valid"))
    return verdicts.unionByName(filler)


def dataset_verdict(verdicts: DataFrame, file_col: str = "file_id") -> DataFrame:
    """Verdicts of well-formed files (the reference raises on the others)."""
    return verdicts.where(F.col("n_bad") == 0).select(
        file_col, "record_count", "missing_fields", "schema_valid", "valid")


def first_error(verdicts: DataFrame, file_col: str = "file_id") -> DataFrame:
    """Lowest bad line and its kind, per file with a syntax error."""
    return verdicts.where(F.col("n_bad") > 0).select(
        file_col, F.col("first_bad_line").alias("line_no"), F.col("first_bad_kind").alias("kind"))


def publish_state(verdicts: DataFrame, file_col: str = "file_id") -> DataFrame:
    """``published`` for files without syntax errors (even when not valid),
    ``quarantined`` otherwise."""
    return verdicts.select(
        file_col, F.when(F.col("n_bad") == 0, "published").otherwise("quarantined").alias("state"),
        "record_count")


def missing_fields(classified: DataFrame, file_col: str = "file_id", line_no: str = "line_no") -> DataFrame:
    """Missing required fields (comma-joined) of every object line. ``inline``
    stands between the parse and the filter, so the filter is not pushed below
    the parse, where it would parse each line again."""
    fields = F.struct("kind", F.array_join("missing", ",").alias("missing"))
    return classified.select(file_col, line_no, F.inline(F.array(fields))).where(F.col("kind") == KIND_OK).drop("kind")


# --- dataset uploads --------------------------------------------------------------

def upload_gate(uploads: DataFrame, name: str = "filename", size: str = "size_bytes", error: str = "error",
                suffixes=K.DATASET_SUFFIXES, max_bytes: int = K.MAX_DATASET_BYTES, out: str = "outcome") -> DataFrame:
    """Every upload with what becomes of it, checked in this order:
    ``bad_suffix`` (of the name's last part, in any case), ``too_large``, the
    error of its validation (see ``validate_files``), else ``stored``."""
    dotted = "|".join(s.lstrip(".") for s in suffixes)
    # A suffix needs a name before it: ".jsonl" is a name without a suffix.
    fits = F.coalesce(F.col(name).rlike(rf"(?i)(?:^|/)[^/]*[^./][^/]*\.(?:{dotted})(?:/+\.?)*\z"), F.lit(False))
    return uploads.withColumn(out, F.when(~fits, "bad_suffix").when(F.col(size) > max_bytes, "too_large")
                              .otherwise(F.coalesce(F.col(error), F.lit("stored"))))


# --- training requests (C12) ------------------------------------------------------

def check_requests(df: DataFrame, cols: dict | None = None, rules=K.REQUEST_RULES,
                   methods=K.METHODS, out: str = "violations") -> DataFrame:
    """Names of violated rules, comma-joined ('' when none). Absent columns
    take the rule default; ``cols`` maps rule names to column names."""
    cols = cols or {}
    present = set(df.columns)
    checks: list[Column] = []
    mcol = cols.get("method", "method")
    m = F.coalesce(F.col(mcol), F.lit("lora")) if mcol in present else F.lit("lora")
    checks.append(F.when(~F.coalesce(m.isin(*methods), F.lit(False)), F.lit("method")))
    for name, default, lo, lo_incl, hi in rules:
        c = cols.get(name, name)
        v = F.coalesce(F.col(c), F.lit(default)) if c in present else F.lit(default)
        low_ok = (v >= lo) if lo_incl else (v > lo)
        checks.append(F.when(~(low_ok & (v <= hi)), F.lit(name)))
    return df.withColumn(out, F.concat_ws(",", *checks))


# --- model architecture (C13) -----------------------------------------------------

def check_architecture(df: DataFrame, config: str = "config", out: str = "problem",
                       names_out: str | None = None) -> DataFrame:
    """``config`` is a variant holding the parsed config.json. Problems, in
    order: not an object / no string model_type; architectures not a name or
    list of names; a non-empty list with no causal-LM name. Empty passes.
    ``names_out`` also adds the list of names."""
    v = F.col(config)
    kind = F.coalesce(F.schema_of_variant(v), F.lit("NULL"))
    mt_kind = F.coalesce(F.schema_of_variant(F.variant_get(v, "$.model_type", "variant")), F.lit("NULL"))
    arch = F.variant_get(v, "$.architectures", "variant")
    arch_kind = F.coalesce(F.schema_of_variant(arch), F.lit("VOID"))
    elems = F.try_variant_get(arch, "$", "array<variant>")
    as_one = F.try_variant_get(arch, "$", "string")
    # "architectures or []": every falsy JSON value counts as an empty list.
    false_bool = (arch_kind == "BOOLEAN") & ~F.coalesce(F.try_variant_get(arch, "$", "boolean"), F.lit(True))
    falsy = ((arch_kind == "VOID") | false_bool
             | (arch_kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)") &
                (F.try_variant_get(arch, "$", "double") == 0))
             | ((arch_kind == "STRING") & (as_one == "")) | (arch_kind.startswith("ARRAY") & (F.size(elems) == 0))
             | ((arch_kind == "OBJECT<>")))
    all_strings = F.forall(F.coalesce(elems, F.array()), lambda x: F.schema_of_variant(x) == "STRING")
    list_of_names = falsy | (arch_kind == "STRING") | (arch_kind.startswith("ARRAY") & all_strings)
    names = F.when(falsy, F.array().cast("array<string>")).when(arch_kind == "STRING", F.array(as_one)) \
        .otherwise(F.transform(F.coalesce(elems, F.array()), lambda x: F.try_variant_get(x, "$", "string")))
    causal = F.exists(names, lambda x: _any_contains(x, K.CAUSAL_MARKERS))
    if names_out:
        df = df.withColumn(names_out, names)
    return df.withColumn(out, F.when(~kind.startswith("OBJECT") | (mt_kind != "STRING"), F.lit("no_model_type"))
                         .when(~list_of_names, F.lit("bad_architectures"))
                         .when((F.size(names) > 0) & ~causal, F.lit("not_causal_lm")))


def _any_contains(x: Column, markers) -> Column:
    c = x.contains(markers[0])
    for m in markers[1:]:
        c = c | x.contains(m)
    return c


# --- tensor headers (C14) ---------------------------------------------------------

def check_tensors(df: DataFrame, begin: str = "off_begin", end: str = "off_end", data_size: str = "data_size",
                  shape: str = "shape", out: str = "problem") -> DataFrame:
    """First failing check per tensor, in the reference order, or ``ok``:
    ``bad_offsets`` (not two integers), ``negative_begin``,
    ``end_before_begin``, ``end_past_data``, ``bad_shape``."""
    b, e, n = F.col(begin), F.col(end), F.col(data_size)
    s = F.col(shape)
    bad_shape = s.isNull() | F.exists(s, lambda d: d.isNull() | (d < 0))
    return df.withColumn(out, F.when(b.isNull() | e.isNull(), "bad_offsets")
                         .when(b < 0, "negative_begin").when(e < b, "end_before_begin")
                         .when(e > n, "end_past_data").when(bad_shape, "bad_shape").otherwise("ok"))


# --- repository listings (C29) ----------------------------------------------------

def filter_listing(entries: DataFrame, listing_col: str, type_col: str = "type", path_col: str = "path",
                   max_files: int = K.MAX_MODEL_FILES) -> DataFrame:
    """Per listing: downloadable files (type ``file``, string path, not under
    ``.git/``) and a status: ``ok``, ``empty`` or ``too_many``."""
    keep = (F.col(type_col) == "file") & F.col(path_col).isNotNull() & ~F.col(path_col).startswith(".git/")
    per = entries.groupBy(listing_col).agg(F.count_if(F.coalesce(keep, F.lit(False))).cast("bigint").alias("files"))
    return per.withColumn("status", F.when(F.col("files") == 0, "empty")
                          .when(F.col("files") > max_files, "too_many").otherwise("ok"))


# --- whole files (A1-A3 + C1-C5 + E1 + E2) ---------------------------------------

def validate_files(spark, dataset_dir: str, required=K.REQUIRED_FIELDS, expected: int = K.EXPECTED_RECORDS):
    """Verdict per stored dataset file: the listing joined to per-file
    aggregates of its lines. ``error`` is ``utf8`` (reported before any line
    error), ``invalid_json`` or ``not_object`` with ``error_line``; files
    with no error carry ``record_count, missing_fields, schema_valid, valid``.
    Empty files are rows: count 0, not schema-valid."""
    from tuneframe.sources.files import list_datasets

    return validate_listed(spark, list_datasets(spark, dataset_dir), dataset_dir, required, expected,
                           pathGlobFilter=STORED_GLOB)


#: Names of stored datasets: 32 characters of id, ``_``, the file name.
STORED_GLOB = "?" * 32 + "_*"


def validate_listed(spark, listing: DataFrame, folder: str, required=K.REQUIRED_FIELDS,
                    expected: int = K.EXPECTED_RECORDS, **options) -> DataFrame:
    """``validate_files`` for the files of ``listing``, all in ``folder``;
    ``options`` (a name pattern, a time) tell the text source which of its
    files it need not read."""
    from tuneframe.sources.files import read_lines

    lines = read_lines(spark, folder, recursive=False, **options).withColumnRenamed("file", "file_id")
    # Blank lines stay (kind null) so UTF-8 validity of every line rides in
    # the same per-file aggregation: the text is scanned once for verdicts.
    verdicts = file_verdicts(classify_lines(lines, "line", required, keep_blank=True), "file_id", "line_no",
                             required, expected, extra_aggs=[F.bool_and("utf8_ok").alias("utf8_ok")])
    # One left join from the listing: the verdicts are computed once, and a
    # file without any line (empty) finds no row and gets the defaults.
    j = listing.join(verdicts, listing["file"] == verdicts["file_id"], "left")
    n_bad = F.coalesce(F.col("n_bad"), F.lit(0).cast("bigint"))
    bad_utf8 = ~F.coalesce(F.col("utf8_ok"), F.lit(True))
    error = F.when(bad_utf8, "utf8").when(n_bad > 0, F.col("first_bad_kind"))
    keep = [c for c in ("modified",) if c in listing.columns]
    return j.select("file", "upload_id", "filename", "size_bytes", *keep, error.alias("error"),
                    F.when(~bad_utf8 & (n_bad > 0), F.col("first_bad_line")).alias("error_line"),
                    F.coalesce(F.col("record_count"), F.lit(0).cast("bigint")).alias("record_count"),
                    F.coalesce(F.col("missing_fields"), F.lit("")).alias("missing_fields"),
                    F.coalesce(F.col("schema_valid"), F.lit(False)).alias("schema_valid"),
                    F.coalesce(F.col("valid"), F.lit(False)).alias("valid"))


def refresh_verdicts(spark, dataset_dir: str, table_dir: str, required=K.REQUIRED_FIELDS,
                     expected: int = K.EXPECTED_RECORDS) -> int:
    """Keep a verdict table for a dataset folder without re-reading unchanged
    files: files whose ``(path, size, mtime)`` already has a verdict are
    skipped (anti join), only new or changed files are read, and their verdicts
    are appended. Returns how many were read; ``current_verdicts`` reads the
    table."""
    from tuneframe.sources.files import list_datasets

    listing = list_datasets(spark, dataset_dir)
    known = _verdict_table(spark, table_dir)
    todo = (listing if known is None else listing.join(known.select(*_FILE_STATE), _FILE_STATE, "left_anti")).persist()
    try:
        n, oldest = todo.agg(F.count(F.lit(1)), F.unix_seconds(F.min("modified"))).first()
        if n:
            # Files older than every new or changed one are not opened.
            since = datetime.fromtimestamp(oldest - 1, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
            validate_listed(spark, todo, dataset_dir, required, expected, pathGlobFilter=STORED_GLOB, modifiedAfter=since,
                            timeZone="UTC").write.mode("append").parquet(table_dir)
        return n
    finally:
        todo.unpersist()


_FILE_STATE = ["file", "size_bytes", "modified"]


def _verdict_table(spark, table_dir: str) -> DataFrame | None:
    """The table's verdicts, one for each state of a file; None before the first."""
    try:
        return spark.read.parquet(table_dir).dropDuplicates(_FILE_STATE)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current_verdicts(spark, dataset_dir: str, table_dir: str) -> DataFrame | None:
    """The verdicts of the files that the folder holds now, as they are now."""
    from tuneframe.sources.files import list_datasets

    known = _verdict_table(spark, table_dir)
    return None if known is None else known.join(list_datasets(spark, dataset_dir).select(*_FILE_STATE), _FILE_STATE, "left_semi")
