"""Spelling variants by permuterm rotations.

Words are counted over all documents first (``count_words``). A word marked
with a terminator has one rotation more than letters: ``w[i:] + "$" + w[:i]``.
The rotations of all words are sorted. Words that differ in one replaced code
point have rotations that agree but for their last code point, the edited one:
they are the range of a common prefix P, with that one skipped. A word that
lacks the edited code point has P itself as a rotation, which stands before the
range. So one scan over the sorted rotations meets all near words, group by
group. A group holds one word a letter and one shorter word at most, and words
are read back from their rotations, so a rotation and a count are all that is
shuffled.

A pair of words that a replacement parts is in one group only. A deletion inside
a run of equal letters gives the same word wherever it happens; only that of the
run's first letter counts, so pairs joined by an indel are counted once too.

``variants`` gives every word its near words' number, its form (the near word of
largest count, of ties the smallest in code-point order, if that count is at
least RATIO times its own) and its root (the end of the chain of forms; counts
grow RATIO-fold along it, so it is short).

Null and empty texts have no words; a null id counts as an empty one. Repeated
rows count again. Texts may be of any length, an empty table gives an empty
result, and columns other than the two named do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bounded_batches, saved

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
#: One run in this many, by hash, loses a code point (the contract's own noise).
NOISE = 31
MARK = "$"
#: Distinct words that a counting task holds before it passes their counts on.
HELD = 1 << 18


def noisy(run: bytes, at: int, noise: int | None) -> str:
    """The run as a word; ``at`` is the CRC-32 of what stands before it."""
    word = run.decode()
    if noise:
        h = zlib.crc32(run, at)
        if h % noise == 0:
            cut = h % len(word)
            return word[:cut] + word[cut + 1 :]
    return word


def count_words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, noise: int | None = NOISE) -> DataFrame:
    """word and n of the words of all texts: runs of letters (A-Z lower-cased)
    of at least ``min_length`` code points that occur ``min_count`` times."""
    bounded_batches(docs.sparkSession)
    letters = re.compile(f"[a-zÀ-ÿ]{{{min_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                              ["word", "n"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = zlib.crc32(f"{doc or ''}:".encode())
                for run, n in Counter(letters.findall(ascii_lower(text))).items() if text else ():
                    held[noisy(run.encode(), at, noise)] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    words = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.where((F.col("n") >= min_count) & (F.length("word") >= min_length))


# ----------------------------------------------------------------- rotations


def rotations(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """All rotations of the marked words, sorted inside partitions dealt by the
    first ``min_length`` code points, which every group's members share."""
    i, w = F.col("i"), F.col("word")
    turned = F.concat(F.substr(w, i + 1), F.lit(MARK), F.substr(w, F.lit(1), i))
    every = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i")).select(turned.alias("turned"), "n")
    return every.repartition(F.substring("turned", 1, min_length)).sortWithinPartitions("turned")


def word_of(turned: str) -> str:
    tail, _, head = turned.partition(MARK)
    return head + tail


NEAR = "word string, n_near long, best_n long, best string"


def near_in_group(whole: tuple[str, int] | None, edited: list[tuple[str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """The word, its near words' number and the best of them for every word of
    a group that has one. ``edited`` holds the rotations of the prefix's range,
    ``whole`` the rotation that is the prefix."""
    first = [r[-1] != r[-2] for r, _ in edited]
    ranked = sorted((-n, word_of(r), k) for k, (r, n) in enumerate(edited))
    if whole and any(first):
        short = (-whole[1], word_of(whole[0]))
        n, word = next((n, word) for n, word, k in ranked if first[k])
        yield short[1], sum(first), -n, word
    else:
        short = None
    for k, (r, _) in enumerate(edited):
        best = next(((n, word) for n, word, x in ranked[:2] if x != k), None)
        joined = short is not None and first[k]
        if joined and (best is None or short < best):
            best = short
        if best:
            yield word_of(r), len(edited) - 1 + joined, -best[0], best[1]


def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Near words from sorted rotations. Open groups are kept on a stack: each
    prefix on it is a prefix of the next, and of the rotation at hand."""
    stack: list[tuple[str, tuple[str, int] | None, list[tuple[str, int]]]] = []
    out: list[tuple[str, int, int, str]] = []

    def close() -> None:
        _, whole, edited = stack.pop()
        if len(edited) > 1 or (whole and edited):
            out.extend(near_in_group(whole, edited))

    for b in batches:
        for turned, n in zip(b["turned"].tolist(), b["n"].tolist(), strict=True):
            while stack and not turned.startswith(stack[-1][0]):
                close()
            if turned[-1] != MARK:
                prefix = turned[:-1]
                if not stack or stack[-1][0] != prefix:
                    stack.append((prefix, None, []))
                stack[-1][2].append((turned, n))
            stack.append((turned, (turned, n), []))
        yield pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"])
        out.clear()
    while stack:
        close()
    yield pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Of every word of ``words`` (word, n) that has near words: how many, and
    the best one with its count."""
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    found = rotations(words, min_length).mapInPandas(scan, NEAR).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best"))


def variants(words: DataFrame, ratio: int = RATIO, min_length: int = MIN_LENGTH) -> DataFrame:
    """``words`` (word, n) with n_near, form, form_n and root."""
    words = saved(words.select("word", "n"))
    near = words.join(near_words(words, min_length), "word", "left")
    has = F.col("best_n") >= ratio * F.col("n")
    formed = saved(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")))
    steps = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    return formed.join(_ends(steps), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _ends(steps: DataFrame) -> DataFrame:
    """(word, root) of ``steps``, each followed to its chain's end. Every pass
    doubles the reach; as counts grow along a chain, it soon ends."""
    steps = saved(steps)
    while True:
        after = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = saved(steps.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                               F.col("next").isNotNull().alias("moved")))
        if not steps.where("moved").limit(1).count():
            return steps.select("word", "root")
        steps = steps.select("word", "root")


def group_spellings(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_length: int = MIN_LENGTH,
                    min_count: int = MIN_COUNT, ratio: int = RATIO, noise: int | None = NOISE) -> DataFrame:
    """The words of ``docs`` with their counts, near words, forms and roots."""
    return variants(count_words(docs, text_col, id_col, min_length, min_count, noise), ratio, min_length)
