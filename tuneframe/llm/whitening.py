"""Whitening of embeddings from a pivoted Cholesky factor.

Entries become integers ``floor(256 * c)`` (those beyond a long saturate). The
fit list holds each distinct integer vector once. Its exact sums, then its
scatter, centred before multiplying, are summed per task and then in Spark; the
driver sees one (dimensions x dimensions) matrix. Pivoted Cholesky splits the
scatter into a triangular factor and its transpose, up to its rank; one-sided
Jacobi rotates the factor's columns until they are orthogonal. Their squared
norms are the eigenvalues (times n), the normalised columns the components.

Rows whose vector is null, or holds null or non-finite entries, are left out.
So are vectors of another length than the commonest one (of ties, the longest):
they have no place in the space. Where the fit list has a lower rank than
components are asked for, there are only as many components; an empty table, or
one of equal vectors, gives none. Ties between eigenvalues keep the order of
Jacobi's columns. Repeated rows get equal results. A deviation that does not
fit a long is null. Extra columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, saved

COMPONENTS = 4
SCALE = 256.0
#: Task sums that are added up in one group, before the sums of these.
FAN_IN = 256
#: Columns count as orthogonal when their cosine is below this.
ORTHOGONAL = 1e-15
MAX_SWEEPS = 60

LONG = 1 << 63


def integers(vectors: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have ``width`` finite entries; these as integers."""
    good = np.array([v is not None and len(v) == width for v in vectors], dtype=bool)
    if not good.any():
        return good, np.zeros((0, width), dtype=np.int64)
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors[good]])
    finite = np.isfinite(x).all(axis=1)
    good[good] = finite
    x = np.floor(SCALE * x[finite])
    out = np.clip(x, -2.0**63, 2.0**63 - 1024).astype(np.int64)
    out[x >= 2.0**63] = LONG - 1
    return good, out


def packed(x: np.ndarray) -> list[bytes]:
    """Each vector in the narrowest integers that hold it."""
    top = np.maximum(x.max(axis=1), -(x.min(axis=1) + 1)) if len(x) else np.zeros(0)
    kind = np.searchsorted([1 << 7, 1 << 15, 1 << 31], top, side="right")
    out: list[bytes] = [b""] * len(x)
    for k, dtype in enumerate((np.int8, np.int16, np.int32, np.int64)):
        for i in np.flatnonzero(kind == k):
            out[i] = x[i].astype(dtype).tobytes()
    return out


def unpacked(vectors: pd.Series, width: int) -> np.ndarray:
    kinds = {width * 2**k: dtype for k, dtype in enumerate((np.int8, np.int16, np.int32, np.int64))}
    return np.array([np.frombuffer(v, dtype=kinds[len(v)]).astype(np.int64) for v in vectors]).reshape(len(vectors), width)


# ---------------------------------------------------------------- factoring


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """Factor of a positive semidefinite matrix, one column a pivot: ``a`` is
    the factor times its transpose. Rows stay in place (they are triangular in
    the order of the pivots); pivots lost in rounding end it."""
    left = a.astype(np.float64).copy()
    size = len(a)
    least = size * np.finfo(np.float64).eps * max(float(np.diag(left).max(initial=0.0)), 0.0)
    columns: list[np.ndarray] = []
    open_rows = np.ones(size, dtype=bool)
    while len(columns) < size:
        diagonal = np.where(open_rows, np.diag(left), -np.inf)
        p = int(diagonal.argmax())
        if not diagonal[p] > least:
            break
        column = np.where(open_rows, left[:, p], 0.0) / np.sqrt(diagonal[p])
        left -= np.outer(column, column)
        open_rows[p] = False
        columns.append(column)
    return np.array(columns).T.reshape(size, len(columns))


def rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of n columns once, in rounds of disjoint pairs."""
    m = n + n % 2
    ring = np.arange(m)
    out = []
    for _ in range(m - 1):
        a, b = ring[: m // 2], ring[m // 2 :][::-1]
        real = (a < n) & (b < n)
        out.append((a[real], b[real]))
        ring = np.concatenate(([ring[0]], [ring[-1]], ring[1:-1]))
    return out


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms of the rotated columns, largest first, and the columns
    normalised."""
    g = factor.copy()
    pairs = rounds(g.shape[1]) if g.shape[1] > 1 else []
    for _ in range(MAX_SWEEPS):
        worst = 0.0
        for a, b in pairs:
            x, y = g[:, a], g[:, b]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            cosine = np.abs(xy) / np.sqrt(np.maximum(xx * yy, 1e-300))
            worst = max(worst, float(cosine.max(initial=0.0)))
            turn = cosine > ORTHOGONAL
            tau = np.where(turn, (yy - xx) / np.where(turn, 2 * xy, 1.0), 0.0)
            t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1.0, tau))
            c = np.where(turn, 1 / np.hypot(1.0, t), 1.0)
            s = np.where(turn, c * t, 0.0)
            g[:, a], g[:, b] = c * x - s * y, s * x + c * y
        if worst <= ORTHOGONAL * max(1, len(g)):
            break
    norms = (g * g).sum(axis=0)
    order = np.argsort(-norms, kind="stable")
    return norms[order], g[:, order] / np.sqrt(norms[order])


# ---------------------------------------------------------------------- fit


@dataclass
class Whitening:
    n: int  # vectors of the fit list
    sums: list[int]  # exact, by dimension
    variances: np.ndarray  # eigenvalues, largest first
    components: np.ndarray  # one column each
    explained: np.ndarray
    identity_error: float | None = None

    def apply(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.sums])
        return (x - mean) @ (self.components / np.sqrt(self.variances))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Of every row the sum of ``(n * x - S) ** 2``, exact; null beyond a long."""
        top = self.n * float(np.abs(x.astype(np.float64)).max(initial=0.0)) + max(map(abs, self.sums))
        if len(self.sums) * top * top < 2.0**62:
            d = self.n * x - np.array(self.sums, dtype=np.int64)
            return (d * d).sum(axis=1).tolist()
        out = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v < LONG else None for v in out]


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (part, i, row) -> the sum of each i's rows of doubles. Sums of
    FAN_IN tasks are added up first, so no group grows with the tasks."""

    def add(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": b["part"][:1], "i": b["i"][:1], "row": [sum(np.frombuffer(r) for r in b["row"]).tobytes()]})

    schema = "part int, i int, row binary"
    some = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("part", "i").applyInPandas(add, schema)
    return some.withColumn("part", F.lit(0)).groupBy("i").applyInPandas(add, schema).select(*keys)


def _scatter(xs: DataFrame, width: int, rows_of) -> np.ndarray:
    """Sum over all rows x of ``z z^T`` where z is a row of ``rows_of(x)``."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0.0
        for b in batches:
            if len(b):
                z = rows_of(unpacked(b["x"], width))
                total = total + z.T @ z
        if isinstance(total, np.ndarray):
            yield pd.DataFrame({"part": TaskContext.get().partitionId(), "i": np.arange(len(total), dtype=np.int32),
                                "row": [r.tobytes() for r in total]})

    got = _summed(xs.mapInPandas(parts, "part int, i int, row binary"), ["i", "row"]).collect()
    return np.array([np.frombuffer(r["row"]) for r in sorted(got, key=lambda r: r["i"])])


def width_of(df: DataFrame, vec_col: str) -> int:
    """The commonest length of a vector (of ties, the longest); 0 without any."""
    sizes = df.where(F.size(vec_col) > 0).groupBy(F.size(vec_col).alias("d")).count()
    got = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return got["d"] if got else 0


def fit(df: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of ``df``; None if they have no
    variance."""
    bounded_batches(df.sparkSession)
    width = width_of(df, vec_col)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": packed(integers(b["v"], width)[1])})

    xs = saved(df.select(F.col(vec_col).alias("v")).mapInPandas(pack, "x binary").distinct())

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # High and low halves apart: no sum leaves a long.
        high, low, n = np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64), 0
        for b in batches:
            x = unpacked(b["x"], width)
            high, low, n = high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0), n + len(x)
        if n:
            yield pd.DataFrame({"i": np.arange(width), "high": high, "low": low, "n": n})

    got = xs.mapInPandas(sums, "i int, high long, low long, n long").groupBy("i").agg(
        F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).orderBy("i").collect()
    if not got:
        return None
    n, total = got[0]["n"], [(r["high"] << 32) + r["low"] for r in got]
    mean = np.array([s / n for s in total])
    scatter = _scatter(xs, width, lambda x: x - mean)
    norms, columns = jacobi(pivoted_cholesky(scatter))
    if not len(norms):
        return None
    k = min(components, len(norms))
    model = Whitening(n, total, norms[:k] / n, columns[:, :k], norms[:k] / np.trace(scatter))
    # Covariance of what the rows become: their mean is taken out with a column of ones.
    both = _scatter(xs, width, lambda x: np.hstack([model.apply(x), np.ones((len(x), 1))])) / n
    centred = both[:k, :k] - np.outer(both[:k, k], both[:k, k])
    model.identity_error = float(np.abs(centred - np.eye(k)).max())
    return model


def whiten(df: DataFrame, model: Whitening | None, vec_col: str = "embedding") -> DataFrame:
    """The rows of ``df`` that have a whitened vector, with a struct column
    ``white`` (or a longer free name) of deviation and whitened (an array)."""
    name = fresh(df, "white")
    if model is None:
        return df.withColumn(name, F.lit(None).cast("struct<deviation: bigint, whitened: array<double>>")).where("false")
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vars(model))  # plain values: workers need no install

    @F.pandas_udf("deviation long, whitened array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Whitening(**shared.value)
        for vectors in batches:
            good, x = integers(vectors, len(m.sums))
            deviation, white = np.full(len(good), None, dtype=object), np.full(len(good), None, dtype=object)
            for i, d, w in zip(np.flatnonzero(good), m.deviations(x), m.apply(x), strict=True):
                deviation[i], white[i] = d, w
            yield pd.DataFrame({"deviation": pd.array(deviation, dtype="Int64"), "whitened": white})

    return df.withColumn(name, run(F.col(vec_col))).where(F.col(name)["whitened"].isNotNull())
