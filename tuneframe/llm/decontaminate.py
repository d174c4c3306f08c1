"""Benchmark decontamination with one Aho-Corasick automaton.

Test items (questions and answers) are normalised to lower-case words joined
by one space; every window of ``window`` words, or the whole of a shorter
item, becomes a pattern with a space at either end. Each document is scanned
once; matches give word positions, and word positions map back to offsets in
the original text.

The automaton is built from one hash shard of the items at a time, so that
what is sent to executors stays below SHARD_CHARS however large the benchmark
is; with more than one shard the documents are scanned once per shard and the
hit words are united. An item larger than a shard makes a shard of its own.

Null and empty texts have no words and no hits. Equal items are all reported.
An item without an id marks words but adds nothing to ``items``. Repeated rows
get equal results; an empty benchmark hits nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, code_points, fresh

#: Words after lower-casing A-Z: digits, a-z and all that is not ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: UTF-8 bytes: A-Z to a-z, the rest of ASCII but digits and a-z to a space.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WINDOW = 10
#: Characters of items whose patterns one broadcast automaton may hold.
SHARD_CHARS = 4_000_000

RESULT = "n_words long, n_hit long, items array<string>, starts array<long>, ends array<long>"


def words_of(text: str | None) -> list[str]:
    flat = normalised(text)
    return flat[1:-1].split(" ") if flat else []


def normalised(text: str | None) -> str:
    """The words, with one space before, between and after them."""
    words = text.encode("utf-8", "surrogatepass").translate(_CLEAN).split() if isinstance(text, str) else []
    return (b" %s " % b" ".join(words)).decode("utf-8", "surrogatepass") if words else ""


def patterns_of(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> dict[str, list[str]]:
    """Pattern -> ids of the items that hold it."""
    out: dict[str, dict[str, None]] = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            ids = out.setdefault(" " + " ".join(w[i : i + window]) + " ", {})
            if item is not None:
                ids[item] = None
    return {k: list(v) for k, v in out.items()}


def automaton_of(patterns: dict[str, list[str]]) -> ahocorasick.Automaton | None:
    if not patterns:
        return None
    a = ahocorasick.Automaton()
    for p, ids in patterns.items():
        a.add_word(p, (len(p), ids))
    a.make_automaton()
    return a


def scan(text: str | None, automaton: ahocorasick.Automaton | None) -> tuple[int, int, list[str], list[int], list[int]]:
    """Words, hit words, items found, and the original offsets of hit runs."""
    flat = normalised(text)
    n = max(0, flat.count(" ") - 1)
    found = list(automaton.iter(flat)) if flat and automaton is not None else []
    if not found:
        return n, 0, [], [], []
    gaps = np.flatnonzero(code_points(flat) == 32)  # word i lies between gaps i and i + 1
    last = np.searchsorted(gaps, [end for end, _ in found])
    first = np.searchsorted(gaps, [end - size + 1 for end, (size, _) in found])
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, last, -1)
    items = dict.fromkeys(i for _, (_, ids) in found for i in ids)
    hit = np.cumsum(change[:-1]) > 0
    # Lower-casing A-Z keeps every offset, so the words lie at the same places.
    spans = [m.span() for m in WORD.finditer(ascii_lower(text))]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return (n, int(hit.sum()), list(items), [spans[i][0] for i in edge[::2]], [spans[i - 1][1] for i in edge[1::2]])


def _scanner(spark, items: list[tuple[str | None, str | None]], window: int):
    shared = spark.sparkContext.broadcast(patterns_of(items, window))

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = automaton_of(shared.value)
        for texts in batches:
            yield pd.DataFrame([scan(t, automaton) for t in texts],
                               columns=["n_words", "n_hit", "items", "starts", "ends"])

    return run


def _union_length(texts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for t, starts, ends in texts:
        out = []
        for text, s, e in zip(t, starts, ends, strict=True):
            text = ascii_lower(text) if isinstance(text, str) else ""
            spans = sorted((int(a), int(b)) for x, y in zip(s, e, strict=True) for a, b in zip(x, y, strict=True))
            runs: list[list[int]] = []
            for a, b in spans:
                if runs and not WORD.search(text, runs[-1][1], max(a, runs[-1][1])):
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            hit = sum(len(WORD.findall(text[a:b])) for a, b in runs)
            out.append((hit, [a for a, _ in runs], [b for _, b in runs]))
        yield pd.DataFrame(out, columns=["n_hit", "starts", "ends"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", window: int = WINDOW, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``docs`` with a struct column (``leak``, or a longer free name): n_words,
    n_hit, items (ids as strings, sorted as strings), starts and ends (offsets
    of hit runs in the original text)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t")).distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    shards = max(1, -(-int(chars) // max(1, shard_chars // 2)))
    name, out, parts = fresh(docs, "leak"), docs, []
    for k in range(shards):
        mine = items if shards == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == k)
        part = fresh(out, f"{name}_{k}")
        out = out.withColumn(part, _scanner(spark, [(r["i"], r["t"]) for r in mine.collect()], window)(F.col(text_col)))
        parts.append(part)
    if shards == 1:
        one = F.col(parts[0])
        merged = F.struct(one["n_words"].alias("n_words"), one["n_hit"].alias("n_hit"),
                          F.array_sort(one["items"]).alias("items"), one["starts"].alias("starts"),
                          one["ends"].alias("ends"))
    else:
        union = F.pandas_udf(_union_length, "n_hit long, starts array<long>, ends array<long>")(
            F.col(text_col), F.array(*[F.col(p)["starts"] for p in parts]), F.array(*[F.col(p)["ends"] for p in parts]))
        out = out.withColumn(fresh(out, f"{name}_u"), union)
        u = F.col(out.columns[-1])
        merged = F.struct(F.col(parts[0])["n_words"].alias("n_words"), u["n_hit"].alias("n_hit"),
                          F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(p)["items"] for p in parts]))))
                          .alias("items"), u["starts"].alias("starts"), u["ends"].alias("ends"))
        parts.append(out.columns[-1])
    return out.withColumn(name, merged).drop(*parts)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any benchmark window."""
    name = fresh(docs, "leak")
    return find_contamination(docs, benchmark, text_col, **options).where(F.col(f"{name}.n_hit") == 0).drop(name)
