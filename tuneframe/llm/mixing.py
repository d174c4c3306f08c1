"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent, normalised.
Exponent 1 keeps the shares, exponent 0 makes all sources equal. The exponent
is found by bisection: the largest that reaches a target entropy of the
weights (a share of the greatest possible), or, if that would repeat a small
source too often, the smallest that keeps every source within a repetition
limit. The weights are then realised in a token budget: every source gets its
weight's part of the budget as whole passes over its documents plus the first
part of a pseudo-random permutation. The permutation is made of blocks: the
hash of a document names its place, level by level, FANOUT places to a level.
On each level the running token sums of at most FANOUT blocks a source find
the block in which the budget ends; only that block goes to the next level.
So no source, however large, passes through one task.

The sums of the bisection are aggregates over a table of one row a source, in
decimals, so their order does not matter; only they reach the driver. What holds
for a source is joined to its rows by source and salt, SALTS rows a source, so
that the rows of a source that has a third of them all are spread; the tables
are written first, so the planner knows their size and broadcasts small ones.
A null source is a source of its own. Documents without tokens are taken in
every pass and cost nothing. Equal rows have equal places and are taken or
left together, as are documents that collide on all levels. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, saved, tabled

#: Share of the greatest possible entropy that the weights must reach.
TARGET_ENTROPY = 0.95
#: Passes over one source that the mix may need at most.
MAX_PASSES = 4.0
#: Tokens of the mix as a multiple of the corpus.
BUDGET = 1.0
#: Parts into which the rows of a source are dealt.
SALTS = 32
#: Halvings of the exponent's range that one job decides, and jobs of a bisection.
HALVINGS, ROUNDS = 4, 15
FANOUT = 1024
LEVELS = 3
SEED = 17


def tempered(tokens: list[float], exponent: float) -> list[float]:
    top = max(tokens)
    powers = [(t / top) ** exponent if t > 0 else 0.0 for t in tokens]
    total = sum(powers)
    return [p / total for p in powers]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def passes(tokens: list[float], exponent: float, budget: float) -> float:
    """Most passes that any source needs."""
    return max(w * budget / t for w, t in zip(tempered(tokens, exponent), tokens, strict=True) if t > 0)


def solve(tokens: list[float], budget: float, target_entropy: float = TARGET_ENTROPY,
          max_passes: float = MAX_PASSES) -> float:
    """The exponent in [0, 1]. Entropy falls and passes fall as it grows."""
    real = [t for t in tokens if t > 0]
    return exponent_of(len(real), lambda some: [(entropy(tempered(real, a)), passes(real, a, budget)) for a in some],
                       target_entropy, max_passes)


def exponent_of(n: int, measure: Callable[[list[float]], list[tuple[float, float]]], target_entropy: float,
                max_passes: float) -> float:
    """The exponent for ``n`` sources with tokens. ``measure`` gives the
    entropy and the most passes at each of some exponents."""
    if n < 2:
        return 1.0

    def bisect(good_low: bool, holds) -> float:
        low, high, parts = 0.0, 1.0, 1 << HALVINGS
        for _ in range(ROUNDS):
            step = (high - low) / parts
            got = measure([low + step * i for i in range(1, parts)])
            i, j = 0, parts
            while j - i > 1:
                mid = (i + j) // 2
                if holds(*got[mid - 1]) == good_low:
                    i = mid
                else:
                    j = mid
            low, high = low + step * i, low + step * j
        return low if good_low else high

    goal = target_entropy * math.log(n)
    flat = 1.0 if measure([1.0])[0][0] >= goal else bisect(True, lambda h, _: h >= goal)
    if measure([flat])[0][1] <= max_passes:
        return flat
    # At exponent 1 every source needs budget / corpus passes, the least there is.
    return bisect(False, lambda _, most: most <= max_passes)


def planned(sizes: DataFrame, budget: float, target_entropy: float, max_passes: float) -> DataFrame:
    """Sources (source, tokens) with weight, whole passes and the rest of their
    budget."""
    t = F.col("tokens").cast("double")
    k = F.col("k")  # sources of equal size are summed as one row
    real = saved(sizes.where(F.col("tokens") > 0).groupBy("tokens").agg(F.count("*").alias("k")))
    have = real.agg(F.sum(k).alias("n"), F.max("tokens").alias("top"), F.sum(k * F.col("tokens")).alias("total")).first()
    if not have["n"]:
        return sizes.select("source", F.lit(0.0).alias("weight"), F.lit(1).alias("whole"), F.lit(0.0).alias("rest"))
    total, share = budget * have["total"], t / F.lit(float(have["top"]))
    power = lambda a: F.pow(share, F.lit(a))

    def sums(some: list[float]) -> list[tuple[float, float, float]]:
        exact = lambda x: F.sum(x.cast("decimal(38,20)")).cast("double")
        row = real.agg(*[c for a in some for c in (
            exact(k * power(a)), exact(k * power(a) * F.log(power(a))), F.max(power(a) / t))]).first()
        return [tuple(row[3 * i : 3 * i + 3]) for i in range(len(some))]

    def measure(some: list[float]) -> list[tuple[float, float]]:
        return [(math.log(p) - q / p, m * total / p) for p, q, m in sums(some)]

    a = exponent_of(have["n"], measure, target_entropy, max_passes)
    weight = F.when(t > 0, power(a) / F.lit(sums([a])[0][0])).otherwise(0.0)
    part = F.col("weight") * F.lit(total)
    plan = sizes.withColumn("weight", weight).withColumn("rest", F.when(t > 0, part % t).otherwise(0.0))
    whole = F.when(t > 0, F.round((part - F.col("rest")) / t)).otherwise(1).cast("int")
    return plan.select("source", "weight", whole.alias("whole"), "rest")


def token_count(text: str | Column) -> Column:
    """Words of the contracts' kind; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _place(key: Column, level: int) -> Column:
    return F.pmod(F.shiftright(key, 10 * level), F.lit(FANOUT)).cast("int")


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
        budget: float = BUDGET, target_entropy: float = TARGET_ENTROPY, max_passes: float = MAX_PASSES,
        seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: id, source, n_tokens, weight (of the
    source), copies (times the document is in the mix; 0: left out) and place
    (order of the source's pass). Sizes and choices are made on slim rows in
    the shared checkpoint folder; texts are read once."""
    slim, chosen = _chosen(docs, source_col, id_col, text_col, budget, target_entropy, max_passes, seed)
    return _with_choice(slim, chosen, "source", "place", ["weight", "copies", "place"]).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "n_tokens", "weight", "copies", "place")


def mixed_documents(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
                    budget: float = BUDGET, target_entropy: float = TARGET_ENTROPY, max_passes: float = MAX_PASSES,
                    seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, all columns, that are in the mix, with weight,
    copies and place (or longer free names)."""
    _, chosen = _chosen(docs, source_col, id_col, text_col, budget, target_entropy, max_passes, seed)
    names = [fresh(docs, c) for c in ("weight", "copies", "place")]
    key, source = fresh(docs, "place_of_row"), fresh(docs, "source_of_row")
    rows = docs.withColumn(key, _row_place(seed, id_col, text_col)).withColumn(source, F.col(source_col).cast("string"))
    return _with_choice(rows, chosen, source, key, names).where(F.col(names[1]) > 0).select(*docs.columns, *names)


def _row_place(seed: int, id_col: str, text_col: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(1 << 40))


def _salt(place: str) -> Column:
    """Bits of the place that name no block."""
    return F.pmod(F.shiftright(F.col(place), 10 * LEVELS), F.lit(SALTS))


def _salted(table: DataFrame) -> DataFrame:
    """``table`` once for every salt, written so that its size is known."""
    return tabled(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))


def _chosen(docs: DataFrame, source_col: str, id_col: str, text_col: str, budget: float, target_entropy: float,
            max_passes: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Slim rows of ``docs``; for every source and salt the weight, the whole
    passes, the rest of the budget, and the place where it ends (cut)."""
    slim = saved(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        token_count(F.col(text_col)).alias("n_tokens"), _row_place(seed, id_col, text_col).alias("place")))
    sizes = saved(slim.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    plan = saved(planned(sizes, budget, target_entropy, max_passes)).withColumnRenamed("source", "s")
    # Ends: of each source the digits of the place where its rest of the budget runs out.
    ends = plan.select("s", F.col("rest").alias("left"))
    for level in range(LEVELS):
        digit, known = f"d{level}", [f"d{i}" for i in range(level)]
        inside = slim.select("source", "n_tokens", _salt("place").alias("salt_of_row"),
                             *[_place(F.col("place"), LEVELS - 1 - i).alias(f"p{i}") for i in range(level + 1)])
        on = [F.col("source").eqNullSafe(F.col("s")), F.col("salt_of_row") == F.col("salt")]
        on += [F.col(f"p{i}") == F.col(d) for i, d in enumerate(known)]
        sums = inside.join(_salted(ends), on).groupBy("s", "left", *known, f"p{level}").agg(F.sum("n_tokens").alias("t"))
        by = Window.partitionBy("s").orderBy(f"p{level}")
        run = F.sum("t").over(by.rowsBetween(Window.unboundedPreceding, 0))
        # The first block that the rest does not cover; none: all blocks are taken.
        reached = sums.withColumn("run", run).where(F.col("run") > F.col("left")).groupBy("s", *known).agg(
            F.min(F.struct(f"p{level}", (F.col("left") - F.col("run") + F.col("t")).alias("left"))).alias("m"))
        ends = saved(reached.select("s", *known, F.col(f"m.p{level}").alias(digit), F.col("m.left").alias("left")))
    cut = F.lit(0).cast("long")
    for level in range(LEVELS):
        cut = cut * FANOUT + F.col(f"d{level}")
    ends = ends.select(F.col("s").alias("s2"), cut.alias("cut"))
    return slim, _salted(plan.join(ends, F.col("s").eqNullSafe(F.col("s2")), "left").drop("s2"))


def _with_choice(rows: DataFrame, chosen: DataFrame, source: str, place: str, names: list[str]) -> DataFrame:
    """``rows`` with weight, copies and place: whole passes, plus one for the
    rows before the place where a source's remaining budget ends."""
    table = chosen.select(*[F.col(c).alias(f"chosen_{c}") for c in chosen.columns])
    clash = {c: fresh(rows, c) for c in table.columns}
    table, c = table.withColumnsRenamed(clash), {k[len("chosen_"):]: F.col(v) for k, v in clash.items()}
    out = rows.join(table, F.col(source).eqNullSafe(c["s"]) & (_salt(place) == c["salt"]), "left")
    low = F.pmod(F.col(place), F.lit(FANOUT**LEVELS))
    extra = F.when(c["rest"] <= 0, 0).when(c["cut"].isNull() | (low < c["cut"]), 1).otherwise(0)
    values = (c["weight"], F.coalesce(c["whole"] + extra, F.lit(0)), low)
    return out.withColumns(dict(zip(names, values, strict=True))).drop(*clash.values())
