"""Model-artifact inventory: listings, totals, byte budgets, manifests, shard
indexes, tensor rollups (A6, A10, D2, D7, E3-E6, F1, U2, U3, S2, S3).

Inputs are file listings ``(upload_id, pos, path, size)`` and tensor rows.
Per-upload results are grouped aggregations with map-side combine; ordered
results use the skew-safe ``number_rows``/``running_sum``; nothing collects
an upload's files into one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tuneframe import constants as K
from tuneframe.functions.numeric import size_gib
from tuneframe.operators.ordering import number_rows, running_sum


def file_name(path) -> Column:
    """Lower-cased last path part."""
    p = F.col(path) if isinstance(path, str) else path
    return F.lower(F.substring_index(p, "/", -1))


def has_suffix(name: Column, suffixes) -> Column:
    """Case-insensitive suffix test against a set (A10)."""
    low = F.lower(name)
    c = F.lit(False)
    for s in suffixes:
        c = c | low.endswith(s.lower())
    return c


def suffix_class(name: Column) -> Column:
    return (F.when(has_suffix(name, K.WEIGHT_SUFFIXES), "weights")
            .when(has_suffix(name, (".json",)), "json").otherwise("other"))


def artifact_listing(files: DataFrame, path: str = "path") -> DataFrame:
    return files.withColumn("name", file_name(path)).withColumn("suffix_class", suffix_class(F.col("name")))


def upload_totals(files: DataFrame, upload: str = "upload_id", size: str = "size",
                  byte_cap: int = K.MAX_MODEL_BYTES, file_cap: int = K.MAX_MODEL_FILES) -> DataFrame:
    """File count and bytes per upload, checked against the caps."""
    per = files.groupBy(upload).agg(F.count(F.lit(1)).alias("files"),
                                    F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"))
    return per.withColumn("gib", size_gib("bytes")).withColumn("over_cap", F.col("bytes") > byte_cap) \
        .withColumn("too_many_files", F.col("files") > file_cap)


def upload_manifests(files: DataFrame, upload: str = "upload_id", path: str = "path", size: str = "size",
                     order: str | None = None, byte_cap: int = K.MAX_MODEL_BYTES,
                     file_cap: int = K.MAX_MODEL_FILES) -> DataFrame:
    """Per upload: ``file_count, size_bytes, over_cap, too_many_files, files``
    (paths in the given order, or sorted). Uploads of more than ``file_cap``
    files are refused as a whole and have no list, so no list is unbounded."""
    totals = upload_totals(files, upload, size, byte_cap, file_cap).withColumnsRenamed(
        {"files": "file_count", "bytes": "size_bytes"}).drop("gib")
    small = totals.where(~F.col("too_many_files")).select(upload)
    item = F.struct(F.col(order or path).alias("o"), F.col(path).alias("p"))
    lists = files.join(small, upload, "left_semi").groupBy(upload).agg(F.sort_array(F.collect_list(item))["p"].alias("files"))
    return totals.join(lists, upload, "left")


def byte_budget(files: DataFrame, upload: str = "upload_id", pos: str = "pos", size: str = "size",
                cap: int = K.MAX_MODEL_BYTES) -> DataFrame:
    """Files in upload order share a byte cap: the first position whose
    running total exceeds it, and that running total (null when never)."""
    running = running_sum(files.select(upload, pos, size), [upload], [pos], size, "running")
    over = F.col("running") > cap
    first = F.min(F.when(over, F.struct(F.col(pos).alias("p"), F.col("running").alias("r"))))
    per = running.groupBy(upload).agg(first.alias("_first"))
    return per.select(upload, F.col("_first.p").alias("first_over_pos"), F.col("_first.r").alias("running_bytes"))


def model_manifest(files: DataFrame, upload: str = "upload_id", path: str = "path",
                   is_index: Column | None = None) -> DataFrame:
    """Per model upload: weight-file count, any JSON, sharded (has a shard
    index), tokenizer present (one of five names, or both halves of a BPE
    pair) and the sorted tokenizer names. Every aggregate is bounded: flags,
    counts and a set drawn from five fixed names (E4, E5, U2)."""
    name = file_name(path)
    idx = name.isin(*K.SHARD_INDEX_FILES) if is_index is None else is_index
    a, b = K.TOKENIZER_PAIR
    per = files.groupBy(upload).agg(
        F.count_if(has_suffix(name, K.WEIGHT_SUFFIXES)).cast("bigint").alias("weight_count"),
        F.coalesce(F.bool_or(has_suffix(name, (".json",))), F.lit(False)).alias("has_json"),
        F.coalesce(F.bool_or(idx), F.lit(False)).alias("sharded"),
        F.coalesce(F.bool_or(name.isin(*K.TOKENIZER_FILES)), F.lit(False)).alias("_any_tok"),
        F.coalesce(F.bool_or(name == a), F.lit(False)).alias("_pair_a"),
        F.coalesce(F.bool_or(name == b), F.lit(False)).alias("_pair_b"),
        F.collect_set(F.when(name.isin(*K.TOKENIZER_FILES), name)).alias("_tok"))
    return per.select(upload, "weight_count", "has_json", "sharded",
                      (F.col("_any_tok") | (F.col("_pair_a") & F.col("_pair_b"))).alias("tokenizer_ok"),
                      F.array_join(F.array_sort("_tok"), ",").alias("tokenizer_files"))


def pair_files(files: DataFrame, paths: DataFrame, upload: str = "upload_id", order: str = "pos",
               max_files: int = K.MAX_MODEL_FILES) -> DataFrame:
    """Positional zip of two lists held as rows (D7): both sides are numbered
    inside each upload and joined on ``(upload, ordinal)``, a unique key.
    ``lengths_match`` flags uploads whose lists differ in length; ``ok`` adds
    the 1..max_files bound."""
    f = number_rows(files, [upload], [order], "ordinal").drop(order)
    p = number_rows(paths, [upload], [order], "ordinal").drop(order)
    p = p.select(*[F.col(c).alias(f"_p_{c}") if c in (upload, "ordinal") else F.col(c) for c in p.columns])
    zipped = f.join(p, (F.col(upload) == F.col(f"_p_{upload}")) & (F.col("ordinal") == F.col("_p_ordinal")), "left") \
        .drop(f"_p_{upload}", "_p_ordinal")
    nf = files.groupBy(upload).agg(F.count(F.lit(1)).alias("_nf"))
    np_ = paths.groupBy(F.col(upload).alias("_np_u")).agg(F.count(F.lit(1)).alias("_np"))
    sizes = nf.join(np_, F.col(upload) == F.col("_np_u"), "left") \
        .select(F.col(upload).alias("_s_u"),
                F.coalesce(F.col("_nf") == F.col("_np"), F.lit(False)).alias("lengths_match"),
                F.col("_nf").between(1, max_files).alias("_in_bounds"))
    out = zipped.join(sizes, F.col(upload) == F.col("_s_u"), "inner")
    return out.withColumn("ok", F.col("lengths_match") & F.col("_in_bounds")).drop("_s_u", "_in_bounds")


def pair_request_lists(requests: DataFrame, files: str = "files", paths: str = "paths",
                       max_files: int = K.MAX_MODEL_FILES) -> DataFrame:
    """D7 for request rows holding both lists: ``problem`` is
    ``length_mismatch`` or ``count_out_of_range`` (checked first, per row),
    else the pairs are exploded with their ordinal (1-based). The cap keeps
    each row's explosion bounded."""
    n_f, n_p = F.size(F.col(files)), F.size(F.col(paths))
    problem = (F.when(F.col(files).isNull() | F.col(paths).isNull() | (n_f != n_p), "length_mismatch")
               .when(~n_f.between(1, max_files), "count_out_of_range"))
    checked = requests.withColumn("problem", problem)
    ok = checked.where(F.col("problem").isNull()).select(
        *[c for c in requests.columns if c not in (files, paths)],
        F.posexplode(F.arrays_zip(F.col(files).alias("file"), F.col(paths).alias("path"))).alias("_pos", "_pair"))
    pairs = ok.select(*[c for c in requests.columns if c not in (files, paths)],
                      (F.col("_pos") + 1).cast("bigint").alias("ordinal"),
                      F.col("_pair.file").alias("file"), F.col("_pair.path").alias("path"), F.lit(None).cast("string")
                      .alias("problem"))
    bad = checked.where(F.col("problem").isNotNull()).select(
        *[c for c in requests.columns if c not in (files, paths)], F.lit(None).cast("bigint").alias("ordinal"),
        F.lit(None).cast("string").alias("file"), F.lit(None).cast("string").alias("path"), "problem")
    return pairs.unionByName(bad)


def archive_members(files: DataFrame, upload: str = "upload_id", path: str = "path",
                    prefix: str = K.ADAPTER_ARCHIVE_PREFIX) -> DataFrame:
    """Archive member names relative to the adapter folder's parent, with
    their position in path order (S3)."""
    ranked = number_rows(files.select(upload, path), [upload], [path], "ordinal")
    return ranked.select(upload, F.concat(F.lit(prefix), F.col(path)).alias("member"), "ordinal")


def missing_shards(index: DataFrame, present: DataFrame, index_dir: str = "index_dir", shard: str = "shard",
                   dir_col: str = "dir", name_col: str = "name", shown: int = K.MISSING_SHARDS_SHOWN) -> DataFrame:
    """Distinct shard names an index refers to that have no file in the
    index's own folder: their number and the first ``shown`` in sorted order
    (D2, S2). The anti join is on ``(folder, name)``; the first few come from
    ``row_number() <= shown``, which Spark limits per task before the shuffle."""
    wanted = index.select(index_dir, shard).distinct()
    have = present.select(F.col(dir_col).alias("_h_dir"), F.col(name_col).alias("_h_name")).distinct()
    missing = wanted.join(have, (F.col(index_dir) == F.col("_h_dir")) & (F.col(shard) == F.col("_h_name")), "left_anti")
    counts = missing.groupBy(index_dir).agg(F.count(F.lit(1)).alias("n_missing"))
    w = Window.partitionBy(index_dir).orderBy(shard)
    top = missing.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= shown) \
        .groupBy(F.col(index_dir).alias("_t_dir")) \
        .agg(F.array_join(F.array_sort(F.collect_list(shard)), ", ").alias("first_missing"))
    return counts.join(top, F.col(index_dir) == F.col("_t_dir"), "inner").drop("_t_dir")


def tensor_rollup(checked: DataFrame, file_col: str = "file_id", order: str = "vec_id", name: str = "name",
                  problem: str = "problem") -> DataFrame:
    """Per weight file: tensors, invalid tensors, the first invalid by position."""
    bad = F.col(problem) != "ok"
    return checked.groupBy(file_col).agg(
        F.count(F.lit(1)).alias("tensors"), F.count_if(bad).cast("bigint").alias("invalid"),
        F.min(F.when(bad, F.struct(F.col(order).alias("o"), F.col(name).alias("n")))).alias("_f")) \
        .select(file_col, "tensors", "invalid", F.col("_f.n").alias("first_invalid"))


def module_leaf(name) -> Column:
    """Last dotted part of a tensor's module (``.weight``/``.bias`` dropped)."""
    n = F.col(name) if isinstance(name, str) else name
    return F.regexp_extract(F.regexp_replace(n, r"\.(weight|bias)$", ""), r"([^.]*)$", 1)


def adapter_targets(tensors: DataFrame, file_col: str = "file_id", name: str = "name",
                    candidates=K.ADAPTER_CANDIDATES) -> DataFrame:
    """Candidate projection modules present in each file, in candidate order
    (U3). One boolean aggregate per candidate: bounded whatever the file size."""
    leaf = module_leaf(name)
    per = tensors.groupBy(file_col).agg(*[F.coalesce(F.bool_or(leaf == c), F.lit(False)).alias(f"_has_{c}")
                                          for c in candidates])
    targets = F.concat_ws(",", *[F.when(F.col(f"_has_{c}"), F.lit(c)) for c in candidates])
    return per.select(file_col, targets.alias("targets"))
