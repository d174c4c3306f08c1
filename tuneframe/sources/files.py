"""File readers.

Folders are listed in tasks (name, size and time of each file, empty ones
included; contents are never read). Paths have one form everywhere, the plain
one: Spark's ``_metadata.file_path`` is unescaped (``file_path``). Text is read with the
line-oriented ``text`` source (``\\n``, ``\\r\\n`` and ``\\r`` all end a line,
as in Python's universal newlines); whole JSON documents with ``wholetext``.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tuneframe import constants as K
from tuneframe.functions.jsonl import JSON_OPTS, is_json_object, json_document
from tuneframe.functions.text import is_upload_id, is_utf8, split_stored_name
from tuneframe.session import shuffle_partitions

BOM = "\ufeff"
#: Rows that a listing task hands over at a time.
LIST_ROWS = 10_000
_ENTRY = "path string, is_dir boolean, length bigint, millis bigint"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, as file paths in Spark's frames begin."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toString()


def file_path() -> Column:
    """The plain path of the file a row was read from."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def relative(spark: SparkSession, path_col, root: str) -> Column:
    """The part of a file path below ``root``."""
    return F.substr(path_col, F.lit(len(qualified(spark, root).rstrip("/")) + 2))


#: Tasks that share the listing of one folder, at most.
LIST_SHARES = 256


def _children(folder: str, share: int = 0, of: int = 1) -> Iterator[tuple]:
    """``(path, is_dir, length, millis)`` of the entries of one folder, or of
    one share of them: names are dealt by hash, so every task reads the names
    and looks up only its own files. (Elsewhere than on file systems a listing
    brings sizes and times along; there the first share has all of it.)
    Entries that vanish meanwhile and links to folders are left out."""
    if folder.startswith("file:"):
        with os.scandir("/" + folder[5:].lstrip("/")) as entries:
            for e in entries:
                if of > 1 and zlib.crc32(os.fsencode(e.name)) % of != share:
                    continue
                try:
                    st = e.stat()
                except FileNotFoundError:
                    continue
                is_dir = e.is_dir(follow_symlinks=False)
                if is_dir or not e.is_dir():
                    name = os.fsencode(e.name).decode("utf-8", "replace")
                    yield f"{folder}/{name}", is_dir, st.st_size, st.st_mtime_ns // 1_000_000
        return
    if share:
        return
    from pyarrow import fs as pafs
    fs, inner = pafs.FileSystem.from_uri(quote(folder, safe="/:@"))
    for info in fs.get_file_info(pafs.FileSelector(inner)):
        yield (f"{folder}/{info.base_name}", info.type == pafs.FileType.Directory, info.size or 0,
               (info.mtime_ns or 0) // 1_000_000)


def _handed(entries: Iterator[tuple]) -> Iterator:
    import pandas as pd
    columns = ["path", "is_dir", "length", "millis"]
    rows: list[tuple] = []
    for entry in entries:
        rows.append(entry)
        if len(rows) >= LIST_ROWS:
            yield pd.DataFrame(rows, columns=columns)
            rows = []
    yield pd.DataFrame(rows, columns=columns)


def _list_shares(folder: str, of: int):
    def run(batches):
        yield from _handed(e for pdf in batches for share in pdf["id"] for e in _children(folder, int(share), of))
    return run


def _walk_folders(batches):
    """Files of all given folders and of those below them; files among the
    input as they are."""
    def walk(folder: str) -> Iterator[tuple]:
        open_folders = [folder]
        while open_folders:
            for entry in _children(open_folders.pop()):
                if entry[1]:
                    open_folders.append(entry[0])
                else:
                    yield entry

    given = (g for pdf in batches for g in pdf[["path", "is_dir", "length", "millis"]].itertuples(index=False, name=None))
    yield from _handed(e for g in given for e in (walk(g[0]) if g[1] else [g]))


def file_listing(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    """``path, length, modificationTime`` of every file, empty ones included.

    The entries of ``path`` itself are dealt over tasks by a hash of their
    names; with ``recursive`` the folders among them are dealt out again, and
    each task walks its own. All are streams of rows."""
    folder = qualified(spark, path).rstrip("/")
    shares = min(shuffle_partitions(spark), LIST_SHARES) if folder.startswith("file:") else 1
    entries = spark.range(0, shares, 1, shares).mapInPandas(_list_shares(folder, shares), _ENTRY)
    if recursive:
        entries = entries.repartition(shuffle_partitions(spark), "path").mapInPandas(_walk_folders, _ENTRY)
    return entries.where(~F.col("is_dir")).select("path", "length",
                                                  F.timestamp_millis("millis").alias("modificationTime"))


def read_lines(spark: SparkSession, path, recursive: bool = True, **options) -> DataFrame:
    """Every physical line of every file under ``path`` with its 1-based line
    number inside its file (A1, A2): ``file, line_no, line, utf8_ok``.

    Lines are numbered inside each input split from the scan position, and
    splits are shifted by the line counts of earlier splits of the same file.
    The split table has one row per input split, never one per line. A
    byte-order mark is removed from the first line of a file only. ``options``
    go to the text source."""
    raw = spark.read.format("text").options(recursiveFileLookup=str(recursive).lower(), **options).load(path)
    return number_scanned_lines(raw.select(
        file_path().alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"), F.monotonically_increasing_id().alias("_pos")))


def number_scanned_lines(scanned: DataFrame) -> DataFrame:
    """``file, block, line, _pos`` (scan order) -> ``file, line_no, line, utf8_ok``.

    The split table has one row per input split; the planner picks the join."""
    splits = scanned.groupBy("file", "block").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(F.col("file").alias("_o_file"), F.col("block").alias("_o_block"), "_first",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = scanned.join(offsets, (F.col("file") == F.col("_o_file")) & (F.col("block") == F.col("_o_block")))
    line_no = (F.col("_before") + F.col("_pos") - F.col("_first") + 1).cast("bigint")
    first = (line_no == 1) & (F.col("block") == 0)
    line = F.when(first & F.col("line").startswith(BOM), F.substr(F.col("line"), F.lit(len(BOM) + 1))).otherwise(F.col("line"))
    return numbered.select("file", line_no.alias("line_no"), line.alias("line"),
                           is_utf8("line").alias("utf8_ok"))


def is_dataset(path_col) -> Column:
    """Whether a file is a stored dataset: ``<32 hex>_<name>``, not ``.part``."""
    name = F.substring_index(path_col, "/", -1)
    return is_upload_id(split_stored_name(name)[0]) & ~name.endswith(".part")


def list_datasets(spark: SparkSession, path: str) -> DataFrame:
    """Stored datasets: ``<32 hex>_<name>`` files, ``.part`` files skipped (A3):
    ``file, upload_id, filename, size_bytes, modified``."""
    files = file_listing(spark, path, recursive=False).where(is_dataset(F.col("path")))
    uid, fname = split_stored_name(F.substring_index(F.col("path"), "/", -1))
    return files.select(F.col("path").alias("file"), uid.alias("upload_id"), fname.alias("filename"),
                        F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def list_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """Every file under a model folder (A6): ``path, rel_path, size, modified,
    name`` (lower case)."""
    files = file_listing(spark, root, recursive=True)
    return files.select("path", relative(spark, F.col("path"), root).alias("rel_path"), F.col("length").alias("size"),
                        F.col("modificationTime").alias("modified"),
                        F.lower(F.substring_index(F.col("path"), "/", -1)).alias("name"))


MANIFEST_SCHEMA = T.StructType([
    T.StructField("upload_id", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("repo_id", T.StringType()), T.StructField("revision", T.StringType()),
    T.StructField("file_count", T.LongType()), T.StructField("size_bytes", T.LongType()),
    T.StructField("model_path", T.StringType()), T.StructField("files", T.ArrayType(T.StringType())),
    T.StructField("model_type", T.StringType()), T.StructField("architectures", T.ArrayType(T.StringType())),
    T.StructField("weight_file_count", T.LongType()), T.StructField("tokenizer_files", T.ArrayType(T.StringType())),
    T.StructField("sharded", T.BooleanType()),
])


def read_manifests(spark: SparkSession, models_dir: str, manifest_name: str = "upload-manifest.json") -> DataFrame:
    """One JSON manifest per model folder; folders without one are absent (A4).
    A manifest that cannot be read keeps its row, with its text in ``error``."""
    schema = T.StructType([*MANIFEST_SCHEMA.fields, T.StructField("error", T.StringType())])
    return (spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", manifest_name).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "error").json(models_dir)
            .withColumn("manifest_path", file_path()))


def read_documents(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Whole JSON documents matching ``glob`` under ``root``: ``path, dir,
    name, text, utf8_ok, is_object, doc`` (``doc`` is a variant, null unless
    the text is one JSON object)."""
    raw = (spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true")
           .option("pathGlobFilter", glob).load(root))
    path = file_path()
    text = F.col("value")
    ok_obj = is_utf8(text) & is_json_object(text)
    return raw.select(path.alias("path"),
                      F.regexp_replace(path, "/[^/]*$", "").alias("dir"),
                      F.lower(F.substring_index(path, "/", -1)).alias("name"),
                      text.alias("text"), is_utf8(text).alias("utf8_ok"), ok_obj.alias("is_object"),
                      json_document(text).alias("doc"))


JOB_SCHEMA = ("struct<job_id:string,status:string,progress:bigint,step:bigint,total_steps:bigint,loss:double,"
              "message:string,model_upload_id:string,created_at:double,updated_at:double,error:string,"
              "output_path:string>")


def read_job_states(spark: SparkSession, runs_dir: str, doc_name: str = "job.json") -> DataFrame:
    """Persisted job states (A5): one document per run folder, epoch seconds
    also given as timestamps (``created_ts``, ``updated_ts``). Dropped: folders
    not named by a 32-hex id, unreadable or non-object documents, and
    documents whose ``job_id`` differs from the folder name."""
    docs = read_documents(spark, runs_dir, doc_name)
    folder = F.element_at(F.split(F.col("path"), "/"), -2)
    parsed = docs.where(F.col("is_object")).select(
        folder.alias("folder"), F.from_json(F.col("text"), JOB_SCHEMA, JSON_OPTS).alias("j"))
    return parsed.where(is_upload_id("folder") & (F.col("j.job_id") == F.col("folder"))).select(
        "j.*", F.timestamp_seconds("j.created_at").alias("created_ts"),
        F.timestamp_seconds("j.updated_at").alias("updated_ts"))


def read_json_assets(spark: SparkSession, models_dir: str, upload_of=None) -> DataFrame:
    """config.json, tokenizer.json and shard-index documents of model
    folders (A7): ``upload_id, path, dir, name, asset, depth, utf8_ok,
    is_object, doc``. ``upload_id`` is the first folder below ``models_dir``."""
    docs = read_documents(spark, models_dir, "*.[jJ][sS][oO][nN]")
    rel = relative(spark, F.col("path"), models_dir)
    # config.json is wanted by its exact name, the others in any case
    asset = (F.when(F.col("path").endswith("/config.json"), "config").when(F.col("name") == "tokenizer.json", "tokenizer")
             .when(F.col("name").isin(*K.SHARD_INDEX_FILES), "shard_index"))
    # tokenizer.json can be large and only its shape matters: no parsed copy
    return docs.withColumn("_rel", rel).where(asset.isNotNull()).select(
        F.substring_index(F.col("_rel"), "/", 1).alias("upload_id"), "path", "dir", "name", asset.alias("asset"),
        (F.size(F.split(F.col("_rel"), "/")) - 1).alias("depth"), "utf8_ok", "is_object",
        F.when(asset != "tokenizer", F.col("doc")).alias("doc"))


def model_roots(assets: DataFrame) -> DataFrame:
    """The folder of each upload's config.json. The reference takes whichever
    a recursive search meets first (unspecified order); we take the
    shallowest, then the lexically first path."""
    cfg = assets.where(F.col("asset") == "config")
    return cfg.groupBy("upload_id").agg(F.min(F.struct("depth", "path", "dir")).alias("_c")) \
        .select("upload_id", F.col("_c.path").alias("config_path"), F.col("_c.dir").alias("model_dir"))


def read_repo_listings(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """Repository listings (C29 input): each document is a JSON array of
    entries such as ``{"type": "file", "path": "a/b.bin"}``. One row per
    entry: ``listing, type, path``; ``path`` is null unless it is a JSON
    string (a number or list is not a path)."""
    docs = read_documents(spark, root, glob).where(F.col("utf8_ok"))
    entries = docs.select(F.col("path").alias("listing"),
                          F.explode(F.try_variant_get(F.try_parse_json(F.col("text")), "$", "array<variant>"))
                          .alias("e"))

    def str_at(field):
        v = F.try_variant_get(F.col("e"), f"$.{field}", "variant")
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return entries.select("listing", str_at("type").alias("type"), str_at("path").alias("path"))
