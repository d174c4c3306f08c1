"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct 3-word shingles as 64-bit hashes. Two
documents link when 100 * intersection >= 85 * union; of every component of
links one document stays. The steps:

1. Every set gets a sketch of REGISTERS registers. Register i is the least of
   an exponential hash over the set, put on a scale of powers of BASE and
   truncated to 16 bits: ``clip(floor(1 - log_BASE(min h)), 0, TOP)``. Sketches
   of two sets merge into that of their union by the larger register.
2. Documents of equal sets make a class. Only classes are compared.
3. BAND register values in a row make a band; classes that agree on a band
   share a list. At the link threshold two sets agree on a register with
   probability 0.85 at least, so a link shares no band with probability
   (1 - 0.85 ** 4) ** 32 < 1e-10.
4. Inside the lists, pairs are tried by the joint likelihood of their registers
   (smaller, equal, larger), given the known sizes: a pair goes on unless the
   registers are exp(SURE) times likelier at the best intersection than at any
   that links, which loses a link with a probability of about exp(-SURE).
5. What goes on is verified, first by parity bitmaps of the sets, which bound
   their difference from below, then on the full sets, each pair in the list of the first
   band it shares. Lists are cut into blocks of
   about BLOCK rows by size, and a task holds one pair of blocks; it emits a
   spanning forest of the links that join different components, never all
   pairs. The lists of the first bands are verified first, then the rest, so
   that later rounds meet components that are mostly known.

Null and empty texts and texts of blanks have empty sets and link with
nothing. Fewer than 3 words make one shingle. Repeated rows are equal sets;
ids may repeat or be null (null ids come last). Extra columns of any name do
not matter, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneframe.session import shuffle_partitions

from .common import bounded_batches, fresh, let_go, saved
from .components import components
from .similarity_join import _blocks, _dealt, _sets_again, fingerprint, folded, links, min_overlap, parity_bits, shingle_set

SHINGLE = 3
#: Bands whose lists are verified first.
FIRST_BANDS = 4
#: Link: 100 * intersection >= PERCENT * union.
PERCENT = 85
REGISTERS = 128
BAND = 4
#: Scale of the registers; close to 1, so sets of different elements seldom agree.
BASE = 1.001
RATE = 20.0
TOP = (1 << 16) - 1
#: Natural logarithm of the likelihood ratio beyond which a pair is given up.
SURE = 30.0
#: Shingles that one numpy step handles; a longer set is a step of its own.
STEP = 1 << 16

_KEYS = np.random.default_rng(1313).integers(0, 1 << 63, size=(2, REGISTERS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# ----------------------------------------------------------------- sketches


def registers_of(least: np.ndarray) -> np.ndarray:
    """Registers from the least of 64-bit uniform hashes: the hash becomes an
    exponential one (its order stays), then a step of the scale."""
    u = (least.astype(np.float64) + 0.5) * 2.0**-64
    h = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP).astype(np.uint16)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for every set; none may be empty."""
    least = np.empty((REGISTERS, len(sets)), dtype=np.uint64)
    sizes = np.array([len(s) for s in sets])
    step = np.cumsum(sizes) // STEP
    cuts = [0, *(np.flatnonzero(step[1:] != step[:-1]) + 1).tolist(), len(sets)] if len(sets) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        x = np.concatenate(sets[a:b])
        starts = np.cumsum(sizes[a:b]) - sizes[a:b]
        for i in range(REGISTERS):
            least[i, a:b] = np.minimum.reduceat((x ^ _KEYS[0, i]) * _KEYS[1, i], starts)
    return registers_of(least.T)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


# --------------------------------------------------------------- likelihood


def _log_chance(x: np.ndarray) -> np.ndarray:
    """Logarithm of the chance that one register beats the other, ``x`` being
    the difference of the sets as a share of the sum of their sizes."""
    p = -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    return np.log(np.maximum(p, 1e-300))


def log_likelihood(jaccard: np.ndarray, u: np.ndarray, larger: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """Of pairs with ``larger`` (``smaller``) registers above (below) the
    partner's, ``u`` being the first size as a share of both."""
    a, b = _log_chance(u - (1 - u) * jaccard), _log_chance(1 - u - u * jaccard)
    even = np.log(np.maximum(1 - np.exp(a) - np.exp(b), 1e-300))
    # A count of 0 takes no part, whatever the chance is.
    return np.where(larger > 0, larger * a, 0) + np.where(smaller > 0, smaller * b, 0) + np.where(
        larger + smaller < REGISTERS, (REGISTERS - larger - smaller) * even, 0)


def estimate(u: np.ndarray, larger: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity; the likelihood is concave, so a
    golden-section search finds it."""
    low, high = np.zeros_like(u), np.minimum(u / (1 - u), (1 - u) / u)
    g = (np.sqrt(5) - 1) / 2
    x, y = high - g * (high - low), low + g * (high - low)
    fx, fy = log_likelihood(x, u, larger, smaller), log_likelihood(y, u, larger, smaller)
    for _ in range(26):
        left = fx > fy
        high, low = np.where(left, y, high), np.where(left, low, x)
        x, y = high - g * (high - low), low + g * (high - low)
        fx, fy = log_likelihood(x, u, larger, smaller), log_likelihood(y, u, larger, smaller)
    return (low + high) / 2


def may_link(n: np.ndarray, m: np.ndarray, larger: np.ndarray, smaller: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Of pairs of sets (sizes, registers above and below the partner's):
    whether they may link."""
    need = min_overlap(n, m, percent)
    out = np.zeros(len(n), dtype=bool)
    # Where far fewer registers agree than at any similarity that passes, nothing is computed.
    rows = np.flatnonzero((need <= np.minimum(n, m)) & (larger + smaller <= REGISTERS * 0.6))
    u, least = n[rows] / (n + m)[rows], need[rows] / (n + m - need)[rows]
    larger, smaller = larger[rows], smaller[rows]
    at = log_likelihood(least, u, larger, smaller)
    step = np.minimum(least + 1e-4, np.minimum(u / (1 - u), (1 - u) / u))
    likely = log_likelihood(step, u, larger, smaller) >= at  # the likeliest value links
    out[rows[likely]] = True
    rest = np.flatnonzero(~likely)
    u, larger, smaller = u[rest], larger[rest], smaller[rest]
    top = log_likelihood(estimate(u, larger, smaller), u, larger, smaller)
    out[rows[rest[top - at[rest] <= SURE]]] = True
    return out


# ------------------------------------------------------------- block pairs

TASK = ["token", "c1", "c2"]
#: Pairs of rows that one numpy step tries, and bytes of their bitmaps that it holds.
TRIED = 1 << 16
BITMAP_BYTES = 1 << 24


def _each_task(compare, columns: list[str], percent: int):
    """mapInPandas function that tries the pairs inside every task (list and
    block pair) and calls ``compare`` on the rows at hand, the pairs that may
    link, by row number, and the tasks' first rows. Rows come sorted by task
    and size; a task begins in one batch and may end in a later one."""

    def tried(rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame([], columns=columns)
        key = rows[TASK].to_numpy()
        cuts = np.array([0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(rows)])
        t = {c: rows[c].to_numpy() for c in rows.columns}
        return pd.DataFrame(compare(t, *_pairs(t, cuts, percent), cuts), columns=columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            key = b[TASK].to_numpy()
            if held and (held[0][TASK].to_numpy()[0] == key[-1]).all():
                held.append(b)
                continue
            first = int(np.flatnonzero((key == key[-1]).all(axis=1))[0])
            yield tried(pd.concat([*held, b.iloc[:first]], ignore_index=True))
            held = [b.iloc[first:]]
        if held:
            yield tried(pd.concat(held, ignore_index=True))

    return run


def _pairs(t: dict, cuts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one task and of different components that may link. Of
    all lists that a pair shares, that of its first band in common has it."""
    n, comp, band = t["n"].astype(np.int64), t["comp"], t["band"]
    regs = np.frombuffer(b"".join(t["sketch"]), dtype=np.uint16).reshape(len(n), REGISTERS)
    bands = regs.view(np.uint64)
    ends = np.concatenate([a + np.searchsorted(n[a:b], 100 * n[a:b] // percent, side="right")
                           for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    partners = ends - np.arange(len(n)) - 1
    step = np.cumsum(partners) // TRIED
    bounds = [0, *(np.flatnonzero(step[1:] != step[:-1]) + 1).tolist(), len(n)]
    out = [np.zeros((2, 0), dtype=np.int64)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        firsts = np.repeat(np.arange(a, b), partners[a:b])
        before = np.cumsum(partners[a:b]) - partners[a:b]
        seconds = np.arange(len(firsts)) - np.repeat(before, partners[a:b]) + firsts + 1
        apart = comp[firsts] != comp[seconds]
        firsts, seconds = firsts[apart], seconds[apart]
        here = (bands[firsts] == bands[seconds]).argmax(axis=1) == band[firsts]
        firsts, seconds = firsts[here], seconds[here]
        x, y = regs[firsts], regs[seconds]
        ok = may_link(n[firsts], n[seconds], (x > y).sum(axis=1), (x < y).sum(axis=1), percent)
        out.append(np.stack([firsts[ok], seconds[ok]]))
    firsts, seconds = np.concatenate(out, axis=1)
    return firsts, seconds


def _close(t: dict, firsts: np.ndarray, seconds: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs' bitmaps allow a link: they bound the number of elements in
    which the sets differ from below, so no link is lost."""
    n, width = t["n"].astype(np.int64), np.array([len(x) for x in t["parity"]])
    room = n[firsts] + n[seconds] - 2 * min_overlap(n[firsts], n[seconds], percent)
    common = np.minimum(width[firsts], width[seconds])
    out = np.zeros(len(firsts), dtype=bool)

    def bitmap(i: int, w: int) -> np.ndarray:
        x = t["parity"][i]
        while len(x) > w:
            x = folded(x)
        return np.frombuffer(x, dtype=np.uint8)

    for w in np.unique(common):
        pairs = np.flatnonzero(common == w)
        step = max(1, BITMAP_BYTES // int(w))
        for k in range(0, len(pairs), step):
            some = pairs[k : k + step]
            rows, at = np.unique(np.concatenate([firsts[some], seconds[some]]), return_inverse=True)
            bits = np.array([bitmap(int(i), int(w)) for i in rows])
            x, y = at[: len(some)], at[len(some) :]
            out[some] = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= room[some]
    return out


def _hopeful(percent: int):
    def compare(t: dict, firsts: np.ndarray, seconds: np.ndarray, cuts: np.ndarray) -> dict:
        """The rows that may link with another of their task."""
        near = _close(t, firsts, seconds, percent)
        found = np.unique(np.concatenate([firsts[near], seconds[near]]))
        return {c: t[c][found] for c in (*TASK, "cls", "n", "comp", "band")}

    return compare


def _verified(percent: int):
    def compare(t: dict, firsts: np.ndarray, seconds: np.ndarray, cuts: np.ndarray) -> list[tuple]:
        """Links (of components) that join all that is linked inside each task."""
        sets: dict[int, np.ndarray] = {}

        def set_of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = np.frombuffer(t["items"][i], dtype=np.uint64)
            return sets[i]

        out, at = [], np.searchsorted(firsts, cuts)
        for a, b, p, q in zip(cuts[:-1], cuts[1:], at[:-1], at[1:], strict=True):
            x, y, label = firsts[p:q] - a, seconds[p:q] - a, t["comp"][a:b].copy()
            while (left := np.flatnonzero(label[x] != label[y])).size:
                # Up to the next link: rows that it joins need no more tries.
                for k in left:
                    i, j = x[k], y[k]
                    if links(set_of(a + i), set_of(a + j), percent):
                        out.append((t["comp"][a + i], t["comp"][a + j]))
                        label[label == label[j]] = label[i]
                        break
                x, y = x[k + 1 :], y[k + 1 :]
            sets.clear()
        return out

    return compare


def _dealt_rows(work: DataFrame) -> DataFrame:
    """Every task whole in one partition, sorted; as many partitions as the
    session's shuffles have, since the work is far more than its bytes."""
    return work.repartition(shuffle_partitions(work.sparkSession), *TASK).sortWithinPartitions(*TASK, "n", "cls")


# -------------------------------------------------------------------- join


def with_sketches(docs: DataFrame, text_col: str, name: str, k: int = SHINGLE) -> DataFrame:
    """``docs`` with a struct ``name`` of n (size of the set), fp (its digest),
    sketch and parity (a bitmap); all but n are null for empty sets."""

    @F.pandas_udf("n int, fp binary, sketch binary, parity binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingle_set(t, k) for t in texts]
            n = [len(s) for s in sets]
            full = [s for s in sets if len(s)]
            rows = iter([r.tobytes() for r in np.ascontiguousarray(sketches(full))] if full else [])
            yield pd.DataFrame({"n": n, "fp": [fingerprint(s) if len(s) else None for s in sets],
                                "sketch": [next(rows) if x else None for x in n],
                                "parity": [parity_bits(s) if len(s) else None for s in sets]})

    return docs.withColumn(name, run(F.col(text_col)))


def linked(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, class_id (smallest id with
    the same set), component_id (smallest id reachable by links) and kept
    (whether the id is the component's)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    every = saved(with_sketches(rows, "text", "s", k).select("id", "s.*"))
    classes = saved(every.where(F.col("n") > 0).groupBy("fp").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("least"), F.first("n").alias("n"),
        F.first("sketch").alias("sketch"), F.first("parity").alias("parity")).withColumn("cls", F.xxhash64("fp")))
    width = 2 * BAND
    bands = F.posexplode(F.array(*[F.expr(f"substring(sketch, {1 + width * i}, {width})") for i in range(REGISTERS // BAND)]))

    def lists(members: DataFrame) -> DataFrame:
        """The bands of classes with known components, which joins have met before they are listed."""
        return members.select("cls", "n", "comp", bands.alias("band", "part")).select(
            F.xxhash64("band", "part").alias("token"), "cls", "n", "band", "comp")

    shapes = classes.select("cls", "sketch", "parity")
    roots = classes.select("cls", F.col("cls").alias("root"))
    first = lists(classes.withColumn("comp", F.col("cls"))).where(F.col("band") < FIRST_BANDS)
    roots = _round(first, roots, rows, classes, shapes, k, percent, across=False)
    known = classes.select("cls", "n", "sketch").join(roots.withColumnRenamed("root", "comp"), "cls")
    roots = _round(lists(known), roots, rows, classes, shapes, k, percent, across=None)
    roots = classes.select("cls", "fp", "least").join(roots, "cls")
    first = roots.groupBy("root").agg(F.min("least").alias("first"))
    roots = roots.join(first, "root").select("fp", F.col("least.id").alias("class_id"), F.col("first.id").alias("first_id"))
    out = every.join(roots, "fp", "left").withColumn("component", F.when(F.col("n") > 0, F.col("first_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
                      F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def _round(lists: DataFrame, roots: DataFrame, rows: DataFrame, classes: DataFrame, shapes: DataFrame, k: int, percent: int,
           across: bool | None) -> DataFrame:
    """``roots`` (cls, root of its component) with the links of ``lists``
    (token, cls, n, band, comp) added: those inside blocks (``across`` false)
    or all (None)."""
    # Lists of several components; near copies share many bands, so of lists
    # with equal members the lowest band's, told by sums made before the shuffle.
    sums = lists.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("band").alias("band"), F.count("*").alias("m0"),
                                      F.sum(F.pmod(F.xxhash64("cls"), F.lit(1 << 40))).alias("m1"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("m2"))
    one = sums.where("lo != hi").groupBy("m0", "m1", "m2").agg(F.min(F.struct("band", "token")).alias("low")).select("low.token")
    lists = lists.join(one, "token", "left_semi")
    dealt = _dealt(_blocks(lists), percent, across=across).join(shapes, "cls")
    found = "token long, c1 int, c2 int, cls long, n int, comp long, band int"
    hope = saved(_dealt_rows(dealt).mapInPandas(_each_task(_hopeful(percent), [*TASK, "cls", "n", "comp", "band"], percent), found))
    let_go(rows.sparkSession)
    wanted = saved(classes.join(hope.select("cls").distinct(), "cls", "left_semi").select(
        "cls", F.col("least.id").alias("id"), F.col("sketch").alias("parity")))
    sets = _sets_again(rows, wanted, k).withColumnRenamed("parity", "sketch")
    found = _dealt_rows(hope.join(sets, "cls")).mapInPandas(_each_task(_verified(percent), ["a", "b"], percent), "a long, b long")
    moved = components(found).withColumnsRenamed({"node": "comp", "root": "to"})
    roots = roots.withColumnRenamed("root", "comp").join(moved, "comp", "left")
    return saved(roots.select("cls", F.coalesce("to", "comp").alias("root")))


def keep_representatives(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """Of every component of ``docs`` the rows with the smallest id."""
    i = fresh(docs, "id_kept")
    kept = linked(docs, text_col, id_col, **options).where("kept").select(F.col(id_col).alias(i)).distinct()
    return docs.join(kept.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(i)), "left_semi")
