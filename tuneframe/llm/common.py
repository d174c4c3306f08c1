"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneframe.session import ensure_checkpoint_dir

#: Words of the contracts that split on ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Characters of text that one numpy step handles at a time.
STEP_CHARS = 2_000_000


#: Rows that Spark hands to a Python worker at a time, unless the session says otherwise.
BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, so that a batch of long texts or
    of whole shingle sets takes little memory in the executor and its Python
    workers. A session that changed Spark's default of 10,000 keeps its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: later
    steps do not repeat its work and survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Called where steps behind a ``saved`` result are done with: Spark removes
    the shuffle files of frames that nothing refers to, but only learns of them
    from the driver's garbage collector, which a small driver load seldom runs."""
    spark.sparkContext._jvm.System.gc()


def tabled(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: like
    ``saved``, and the planner knows its size."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(id_col: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")),
                  F.lit(parts))


class Kept:
    """``build`` with its results kept for the life of the process, by
    arguments; beyond ``limit`` of them it starts anew. Functions go to Python
    workers by value, so that these need no install of the package, and a
    worker unpickles them anew for every task: results stay with the
    interpreter, and never travel."""

    def __init__(self, build: Callable, limit: int = 1 << 14):
        self.build, self.limit = build, limit

    def __call__(self, *args):
        known = self.__dict__.get("known")
        if known is None:
            every = sys.__dict__.setdefault("_tuneframe_kept", {})
            known = self.known = every.setdefault((self.build.__module__, self.build.__qualname__), {})
        if args not in known:
            if len(known) >= self.limit:
                known.clear()
            known[args] = self.build(*args)
        return known[args]

    def __getstate__(self) -> dict:
        return {"build": self.build, "limit": self.limit}


def unit_hash(*cols: str) -> Column:
    """A hash of the columns, spread evenly over [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_steps(texts: Iterable[str | None], limit: int = STEP_CHARS) -> Iterator[list[str]]:
    """Texts (null: empty) in lists of about ``limit`` characters; a longer
    text makes a list of its own."""
    step: list[str] = []
    size = 0
    for t in texts:
        t = t if isinstance(t, str) else ""
        if step and size + len(t) > limit:
            yield step
            step, size = [], 0
        step.append(t)
        size += len(t)
    if step:
        yield step


def ascii_lower(text: str) -> str:
    """A-Z to a-z and nothing else; every offset stays."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def rank_auc(score: np.ndarray, label: np.ndarray) -> float:
    """Area under the ROC curve (ties count half)."""
    order = np.argsort(score, kind="stable")
    s, y = score[order], label[order].astype(bool)
    _, first, count = np.unique(s, return_index=True, return_counts=True)
    ranks = np.repeat(first + (count + 1) / 2, count)
    pos, neg = int(y.sum()), int((~y).sum())
    return float((ranks[y].sum() - pos * (pos + 1) / 2) / (pos * neg)) if pos and neg else float("nan")


_BYTE = np.random.default_rng(101).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xD1342543DE82EF95)
_POWERS = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 (at least) of the odd base and of its inverse modulo 2**64."""
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit hashes spread evenly (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(flat: bytes, k: int) -> np.ndarray:
    """64-bit hash of every run of ``k`` words of ``flat`` (words joined by one
    space): differences of one running sum, so the cost is that of the bytes."""
    if not flat:
        return np.zeros(0, dtype=np.uint64)
    raw = np.frombuffer(flat, dtype=np.uint8)
    up, down = _powers(len(raw))
    total = np.empty(len(raw) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    gaps = np.flatnonzero(raw == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(raw)]))
    if len(starts) < k:
        return np.zeros(0, dtype=np.uint64)
    starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
    return mixed((total[ends] - total[starts]) * down[starts] + np.uint64(k))
