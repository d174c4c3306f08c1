"""N-gram Jaccard join: grouped prefix join on word shingles.

A document's set holds its distinct 3-word shingles as 64-bit hashes. Two
documents link when 100 * intersection >= 90 * union. The join is exact (but
for hash collisions) and runs in these steps:

1. Shingles are counted over all documents (hashes in binary rows, dealt by
   hash). The most frequent ones, exactly counted, make a table of at most
   MAX_FREQUENT rows, whose size bounds the broadcast. The order of shingles
   is: rare ones by hash, then frequent ones from less to more frequent.
2. Each set is sorted in that order; its prefix is its first
   n - ceil(0.9 n) + 1 shingles. Sets that link share a prefix shingle.
   Documents with equal prefix and size make a group, and within it those
   with equal sets a class.
3. Groups are listed under their prefix shingles. Lists are cut into blocks
   of about BLOCK rows ordered by size; block pairs are compared in one task each.
   Group pairs are filtered by what all members share, size and the place of the
   common shingle; groups that pass nowhere are done with others, and only the
   rest are expanded to their classes. Class pairs are filtered by a parity
   bitmap of the set, whose bits give a lower bound of the symmetric
   difference. None of these filters loses a link.
4. The sets of the others are read again. Within each block, pairs that pass
   are verified on the whole sets, unless known links join the two already: a
   block emits a spanning forest of its links, never all pairs of a cluster.
   The same then happens across the blocks of long lists, between different
   components. So every link lies inside one component.

Null and empty texts and texts of blanks have empty sets and link with
nothing. Fewer than 3 words make one shingle. Repeated rows are equal sets.
Ids may repeat; a row belongs to the component of its own text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuneframe.session import shuffle_partitions

from .common import fresh, let_go, mixed, saved, unit_hash, word_hashes
from .components import components

SHINGLE = 3
#: Link: 100 * intersection >= PERCENT * union.
PERCENT = 90
MAX_FREQUENT = 1 << 20
#: Shingles with fewer documents than this are never counted as frequent.
MIN_FREQUENT = 4
BLOCK = 512
#: Shingles of 2 ** HOT_LEVEL documents or more skip the neighbour test, whose window holds a whole list.
HOT_LEVEL = 10
#: Hashes that one group of the count holds, about.
BUCKET = 1 << 22
#: Bytes of a hash in the count, beside its bucket: a bucket of BUCKET hashes takes a quarter of their values.
KEY_BYTES = 3
#: Hashes that a task gathers before it deals them out.
GATHER = 1 << 20
#: Bits of the document filter when sets are read again.
FILTER_BITS = 25


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    if not isinstance(text, str):
        return np.zeros(0, dtype=np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    return np.unique(word_hashes(b" ".join(words), min(k, len(words))))


def min_overlap(n: np.ndarray | int, m: np.ndarray | int, percent: int = PERCENT):
    """Least intersection of sets of n and m elements that link."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


# ------------------------------------------------------- order of shingles


def frequent_shingles(docs: DataFrame, text_col: str, k: int = SHINGLE) -> tuple[int, np.ndarray, np.ndarray]:
    """Key bits, sorted keys and levels (floor of log2 of the documents
    that have the shingle) of the most frequent shingles. A key is the top
    bits of the hash: its bucket and KEY_BYTES more bytes. Shingles of equal
    keys count as one, which orders them alike in every set."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    # Buckets by the corpus' size: a word takes some 5 bytes, so no bucket outgrows BUCKET hashes by much.
    bits = max(6, (shuffle_partitions(docs.sparkSession) - 1).bit_length(), (size // (5 * BUCKET)).bit_length())

    width = bits + 8 * KEY_BYTES

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held) >> np.uint64(64 - width))
            cut = np.searchsorted(keys >> np.uint64(8 * KEY_BYTES), np.arange((1 << bits) + 1, dtype=np.uint64))
            used = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(
                [short_keys(keys[cut[i] : cut[i + 1]]) for i in used], pa.binary())], ["bucket", "keys"])

        for b in batches:
            for t in b.column(0):
                held.append(shingle_set(t.as_py(), k))
                size += len(held[-1])
                if size >= GATHER:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        keys, n = np.unique(np.concatenate([long_keys(x) for x in rows["keys"]]), return_counts=True)
        keys, level = keys[n >= MIN_FREQUENT], np.log2(n[n >= MIN_FREQUENT]).astype(np.int32)
        found = np.unique(level)
        return pd.DataFrame({"bucket": rows["bucket"].iloc[0], "level": found, "n": [int((level == x).sum()) for x in found],
                             "keys": [keys[level == x].tobytes() for x in found]},
                            columns=["bucket", "level", "n", "keys"])

    dealt = docs.select(text_col).mapInArrow(deal, "bucket int, keys binary")
    counted = saved(dealt.groupBy("bucket").applyInPandas(count, "bucket int, level int, n long, keys binary"))
    least, total = 99, 0
    for r in counted.groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect():
        total += r["n"]
        if total > MAX_FREQUENT:
            break
        least = r["level"]
    keys, levels = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint8)]
    for r in counted.where(F.col("level") >= least).collect():
        x = np.frombuffer(r["keys"], dtype=np.uint32).astype(np.uint64) | np.uint64(r["bucket"] << 8 * KEY_BYTES)
        keys.append(x)
        levels.append(np.full(len(x), r["level"], dtype=np.uint8))
    keys, levels = np.concatenate(keys), np.concatenate(levels)
    order = np.argsort(keys)
    del dealt, counted
    let_go(docs.sparkSession)
    return width, keys[order], levels[order]


def short_keys(keys: np.ndarray) -> bytes:
    """The low KEY_BYTES bytes of 64-bit keys, one after the other."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def long_keys(blob: bytes) -> np.ndarray:
    """``short_keys`` as 32-bit numbers."""
    out = np.zeros((len(blob) // KEY_BYTES, 4), dtype=np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u4").ravel()


# --------------------------------------------------- sets, prefixes, bitmaps


def parity_bits(s: np.ndarray) -> bytes:
    """Bit i: whether an odd number of elements falls into bucket i. The
    number of buckets is the first power of two from max(64, 4 * size): few
    differing elements cancel out, so few pairs pass that do not link."""
    bits = max(6, (4 * len(s) - 1).bit_length())
    odd = np.bincount((mixed(s) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def prefix_of(s: np.ndarray, bits: int, keys: np.ndarray, levels: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """The set's first elements in the order of shingles; how many come before
    those of HOT_LEVEL."""
    p = prefix_size(len(s), percent)
    if not len(keys):
        return s[:p], p
    x = s >> np.uint64(64 - bits)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    level = np.where(keys[at] == x, levels[at], 0)
    first = np.argsort(level, kind="stable")[:p]
    return s[first], int((level[first] < HOT_LEVEL).sum())


SET = "fp binary, n int, parity binary, prefix array<long>, cool int"


def with_sets(docs: DataFrame, text_col: str, order: tuple[int, np.ndarray, np.ndarray], name: str, k: int, percent: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(order)

    @F.pandas_udf(SET)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                s = shingle_set(t, k)
                if not len(s):
                    out.append((None, 0, None, None, 0))
                    continue
                prefix, cool = prefix_of(s, *shared.value, percent)
                out.append((fingerprint(s), len(s), parity_bits(s), prefix.view(np.int64), cool))
            yield pd.DataFrame(out, columns=["fp", "n", "parity", "prefix", "cool"])

    return docs.withColumn(name, run(F.col(text_col)))


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.md5(s.tobytes()).digest()


# ------------------------------------------------------------- block pairs


def passing(n: np.ndarray, pos: np.ndarray, parity: list[bytes], percent: int = PERCENT):
    """Rows (in order of size) of one block pair -> for each row with later
    partners that may link, its number and theirs."""
    if len(n) < 2:
        return
    width = np.array([len(x) for x in parity])
    for w in np.unique(width):
        rows = np.flatnonzero((width == w) | (width == 2 * w))
        sizes, places = n[rows], pos[rows]
        bits = np.array([np.frombuffer(parity[i] if width[i] == w else folded(parity[i]), dtype=np.uint8) for i in rows])
        for at, i in enumerate(rows):
            end = int(np.searchsorted(sizes, 100 * n[i] // percent, side="right"))
            if width[i] != w or at + 1 >= end:
                continue
            m, p = sizes[at + 1 : end], places[at + 1 : end]
            need = min_overlap(n[i], m, percent)
            ok = np.flatnonzero(np.minimum(pos[i], p) + np.minimum(n[i] - pos[i], m - p) >= need)
            if ok.size:
                apart = np.bitwise_count(bits[at + 1 + ok] ^ bits[at]).sum(axis=1, dtype=np.int64)
                js = rows[at + 1 + ok[apart <= n[i] + m[ok] - 2 * need[ok]]]
                if js.size:
                    yield int(i), js


def forest(n: np.ndarray, pos: np.ndarray, parity: list[bytes], comp: np.ndarray, sets: list[np.ndarray],
           percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (as row numbers) that join all rows of one block pair that are
    linked, beyond what the components ``comp`` join already."""
    out: list[tuple[int, int]] = []
    labels = comp.copy()
    for i, js in passing(n, pos, parity, percent):
        for j in js[labels[js] != labels[i]].tolist():
            if labels[j] != labels[i] and links(sets[i], sets[j], percent):
                out.append((i, j))
                labels[labels == labels[j]] = labels[i]
    return out


def links(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets link."""
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def folded(parity: bytes) -> bytes:
    """The bitmap with half as many buckets."""
    odd = np.unpackbits(np.frombuffer(parity, dtype=np.uint8)).reshape(-1, 2)
    return np.packbits(odd[:, 0] ^ odd[:, 1]).tobytes()


def _fitting(percent: int):
    """The list and group of every group of a task that some other one fits by
    size and place of their common shingle."""
    def compare(t: dict) -> list[tuple[int, int]]:
        n, pos, found = t["n"].astype(np.int64), t["pos"].astype(np.int64), np.zeros(len(t["n"]), dtype=bool)
        for i in range(len(n) - 1):
            end = int(np.searchsorted(n, 100 * n[i] // percent, side="right"))
            m, p = n[i + 1 : end], pos[i + 1 : end]
            ok = np.minimum(pos[i], p) + np.minimum(n[i] - pos[i], m - p) >= min_overlap(n[i], m, percent)
            found[i] |= ok.any()
            found[i + 1 : end] |= ok
        return [(int(t["token"][i]), int(t["cls"][i])) for i in np.flatnonzero(found)]

    return compare


TASK = ["token", "c1", "c2"]


def _by_task(compare):
    """mapInPandas function that calls ``compare`` on the rows of every task
    (shingle and block pair). Rows come sorted by task, size and class; a task
    of about 2 * BLOCK rows may begin in one batch and end in the next."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            if not len(b):
                continue
            rows = b if rest is None else pd.concat([rest, b], ignore_index=True)
            key = rows[TASK].to_numpy()
            last = int(np.flatnonzero((key == key[-1]).all(axis=1))[0])
            rest = rows.iloc[last:]
            yield _tasks(rows.iloc[:last], compare)
        if rest is not None:
            yield _tasks(rest, compare)

    return run


def _tasks(rows: pd.DataFrame, compare) -> pd.DataFrame:
    key = rows[TASK].to_numpy()
    change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1 if len(rows) else []
    cols = {c: rows[c].to_numpy() for c in rows.columns}
    cuts = [0, *change, len(rows)]
    a, b = [], []
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        if e - s > 1:
            for x, y in compare({c: v[s:e] for c, v in cols.items()}):
                a.append(x)
                b.append(y)
    return pd.DataFrame({"a": a, "b": b}, dtype="int64")


# -------------------------------------------------------------------- join


def linked(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id, text_hash, n_shingles, class_id
    (smallest id with the same set), component_id (smallest id reachable by
    links) and kept (whether the row is its component's first by id, then
    text_hash; rows without words always are). Null ids come last."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = with_sets(rows, "text", frequent_shingles(rows, "text", k), "s", k, percent)
    sets = saved(sets.select("id", F.xxhash64("text").alias("text_hash"), "s.*").withColumn(
        "grp", F.xxhash64("prefix", "n")))
    full = sets.where(F.col("n") > 0)
    # Documents of equal prefix and size: one group. Within it, equal sets: one class.
    groups = full.groupBy("grp", "n").agg(F.first("prefix").alias("prefix"), F.first("cool").alias("cool"),
                                          (F.min("fp") != F.max("fp")).alias("mixed"))
    classes = saved(full.groupBy("grp", "n", "fp").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("least"),
        F.first("parity").alias("parity")).withColumn("cls", F.xxhash64("fp")))
    # Groups under their prefix shingles, by size. A row whose neighbours in
    # its list are too far in size links with none there; a group that is
    # alone in all lists stays in one of them if its classes differ. The long
    # lists of hot shingles, which no task may hold, keep all their rows.
    by_size = Window.partitionBy("token").orderBy("n", "grp")
    every = groups.select("grp", "n", "mixed", "cool", F.posexplode("prefix").alias("pos", "token"))
    cool, slim = F.col("pos") < F.col("cool"), ["token", "grp", "pos"]
    lists = every.where(cool).select("*", F.lag("n").over(by_size).alias("less"), F.lead("n").over(by_size).alias("more"))
    near = (100 * F.col("less") >= percent * F.col("n")) | (percent * F.col("more") <= 100 * F.col("n"))
    lists = lists.where(F.coalesce(near, F.lit(False)) | (F.col("mixed") & (F.col("pos") == 0))).select(*slim)
    lists = _one_of_equal(lists.union(every.where(~cool).select(*slim)), "grp")
    let_go(docs.sparkSession)  # the shuffle of all prefixes
    # Group pairs, by size and place alone; a group of several classes has pairs of its own.
    fit = _blocks(lists.join(groups.select("grp", "n"), "grp").withColumnRenamed("grp", "cls"))
    fit = _sorted(_dealt(fit.withColumn("comp", F.col("cls")), percent, across=None)).mapInPandas(_by_task(_fitting(percent)), "a long, b long")
    fit = fit.select(F.col("a").alias("token"), F.col("b").alias("grp")).union(
        lists.join(groups.where("mixed").select("grp"), "grp", "left_semi").select("token", "grp")).distinct()
    # The groups left are expanded to their classes, and lists cut into blocks.
    lists = lists.join(fit, ["token", "grp"], "left_semi")
    lists = _blocks(lists.join(classes.select("grp", "n", "cls"), "grp").drop("grp"))
    let_go(docs.sparkSession)
    shapes = classes.select("cls", "parity")

    def hopeful(t: dict) -> list[tuple[int, int]]:
        found = set()
        for i, js in passing(t["n"].astype(np.int64), t["pos"].astype(np.int64), list(t["parity"]), percent):
            found.add(int(t["cls"][i]))
            found.update(t["cls"][js].tolist())
        return [(c, c) for c in found]

    def joins(t: dict) -> list[tuple[int, int]]:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in t["items"]]
        got = forest(t["n"].astype(np.int64), t["pos"].astype(np.int64), list(t["parity"]), t["comp"].astype(np.int64), sets, percent)
        return [(int(t["cls"][i]), int(t["cls"][j])) for i, j in got]

    pair = "a long, b long"
    every = _dealt(lists.withColumn("comp", F.col("cls")), percent, across=None).join(shapes, "cls")
    hope = saved(_sorted(every).mapInPandas(_by_task(hopeful), pair).select(F.col("a").alias("cls")).distinct())
    wanted = hope.join(classes, "cls").select("cls", F.col("least.id").alias("id"), "parity")
    sets_of = saved(_sets_again(rows, saved(wanted), k))
    lists = _blocks(_one_of_equal(lists.drop("chunk").join(hope, "cls"), "cls"))
    let_go(docs.sparkSession)
    within = _dealt(lists.withColumn("comp", F.col("cls")), percent, across=False).join(sets_of, "cls")
    found = saved(_sorted(within).mapInPandas(_by_task(joins), pair).distinct())
    comps = saved(components(found))
    known = lists.join(comps.withColumnsRenamed({"node": "cls", "root": "r"}), "cls", "left")
    known = known.withColumn("comp", F.coalesce("r", "cls")).drop("r")
    more = saved(_sorted(_dealt(known, percent, across=True).join(sets_of, "cls")).mapInPandas(_by_task(joins), pair).distinct())
    comps = components(saved(comps.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)))
    roots = classes.select("cls", "fp", "least").join(comps.withColumnsRenamed({"node": "cls", "root": "r"}), "cls", "left")
    roots = roots.withColumn("root", F.coalesce("r", "cls"))
    least = roots.groupBy("root").agg(F.min("least").alias("first"))
    roots = roots.join(least, "root").select("fp", F.col("least.id").alias("class_id"), "first")
    out = sets.select("id", "text_hash", "n", "fp").join(roots, "fp", "left")
    mine = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    return out.select(
        F.col("id").alias(id_col), "text_hash", F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("class_id", "id").alias("class_id"), F.coalesce("first.id", "id").alias("component_id"),
        F.coalesce(F.col("first") == mine, F.lit(True)).alias("kept"))


def _one_of_equal(lists: DataFrame, member: str) -> DataFrame:
    """Near copies share many shingles: of lists with equal members, one.
    Lists are compared by sums made before the shuffle, so none is gathered."""
    lists = saved(lists)
    sums = lists.groupBy("token").agg(F.count("*").alias("m0"), F.sum(F.pmod(F.xxhash64(member), F.lit(1 << 40))).alias("m1"),
                                      F.bit_xor(F.xxhash64(member, F.lit(1))).alias("m2"))
    one = sums.groupBy("m0", "m1", "m2").agg(F.min("token").alias("token")).select("token")
    return lists.join(one, "token", "left_semi")


def _blocks(lists: DataFrame) -> DataFrame:
    """``lists`` with ``chunk``: blocks of about BLOCK rows in order of size.
    Rows of one list and size are spread by hash over the places that their
    number takes, so only counts by size are ordered, never the rows."""
    lists = saved(lists)
    sizes = lists.groupBy("token", "n").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("token").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("start", F.coalesce(before, F.lit(0)))
    place = F.col("start") + F.floor(unit_hash("cls", "token") * F.col("rows"))
    return saved(lists.join(sizes, ["token", "n"]).withColumn("chunk", F.floor(place / BLOCK).cast("int")).drop("rows", "start"))


def _dealt(rows: DataFrame, percent: int, across: bool | None) -> DataFrame:
    """``rows`` with the block pairs (c1, c2) they take part in: within blocks,
    across blocks, or both (None). Pairs of blocks whose rows are all in one
    component, or too far in size, are left out."""
    blocks = rows.groupBy("token", "chunk").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                                F.min("n").alias("n0"), F.max("n").alias("n1"), F.count("*").alias("k"))
    alone = blocks.where((F.col("lo") != F.col("hi")) & (F.col("k") > 1)).select(
        "token", F.col("chunk").alias("c1"), F.col("chunk").alias("c2"))
    x, y = blocks.alias("x"), blocks.where(F.col("chunk") > 0).alias("y")
    cross = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.chunk") < F.col("y.chunk"))).where(
        (100 * F.col("x.n1") >= percent * F.col("y.n0"))
        & ((F.least("x.lo", "y.lo") != F.greatest("x.hi", "y.hi")))).select(
        "x.token", F.col("x.chunk").alias("c1"), F.col("y.chunk").alias("c2"))
    tasks = alone if across is False else cross if across else alone.union(cross)
    tasks = tasks.select("token", "c1", "c2", F.explode(F.array_distinct(F.array("c1", "c2"))).alias("chunk"))
    return rows.join(tasks, ["token", "chunk"]).drop("chunk")


def _sorted(work: DataFrame) -> DataFrame:
    return work.repartition(*TASK).sortWithinPartitions(*TASK, "n", "cls")


def _sets_again(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``wanted`` classes (cls, id, parity) with the hashes of their sets,
    from the texts. Which rows to read, a filter of 2 ** FILTER_BITS bits
    tells; it may let others in, which the join then drops."""
    h, page = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS)), 1 << 15
    got = wanted.select(h.alias("h")).groupBy(F.floor(F.col("h") / page).alias("k")).agg(
        F.bitmap_construct_agg(F.pmod("h", F.lit(page))).alias("m")).collect()
    bitmap = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for r in got:
        bitmap[r["k"] * (page // 8) : (r["k"] + 1) * (page // 8)] = np.frombuffer(bytes(r["m"]), dtype=np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_numpy()
            keep = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            fps, blobs = [], []
            for t in b.column(1).filter(pa.array(keep)):
                s = shingle_set(t.as_py(), k)
                if len(s):
                    fps.append(fingerprint(s))
                    blobs.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(blobs, pa.binary())], ["fp", "items"])

    sets = rows.select(h.alias("h"), "text").mapInArrow(read, "fp binary, items binary")
    sets = sets.withColumn("cls", F.xxhash64("fp")).drop("fp").join(wanted.select("cls", "parity"), "cls")
    return sets.groupBy("cls").agg(F.first("parity").alias("parity"), F.first("items").alias("items"))


def keep_representatives(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """Of every component of ``docs`` the first row by id, then text; rows
    without words stay. Rows that repeat both id and text count as one."""
    i, h = fresh(docs, "id_kept"), fresh(docs, "text_hash_of_row")
    kept = linked(docs, text_col, id_col, **options).where("kept").select(F.col(id_col).alias(i), F.col("text_hash").alias(h + "_"))
    rows = docs.withColumn(h, F.xxhash64(text_col))
    mine = F.col(id_col).eqNullSafe(F.col(i)) & (F.col(h) == F.col(h + "_"))
    return rows.join(kept.distinct().hint("shuffle_hash"), mine, "left_semi").dropDuplicates([id_col, h]).drop(h)
