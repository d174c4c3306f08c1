"""Quality classifier: ridge regression on random Fourier features.

Each text becomes a fixed list of document statistics; standardised, they are
mapped to random Fourier features that approximate a Gaussian kernel. Ridge
scores come from normal equations whose parts are summed per partition and
then over partitions in Spark, so all labelled training rows count and the
driver sees one (features x features) matrix only. Isotonic regression on the
training scores, gathered in score bins, turns a score into a probability.

Only the text enters a score. Null and empty texts have all statistics 0 and
are scored like any text. Conflicting labels of one id count by their mean.
Without training labels every score is 0.5. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Kept, code_points, fresh, saved

N_FOURIER = 256
BANDWIDTH = 3.0
RIDGE = 1e-3
#: Bins of the training score for isotonic calibration.
BINS = 512
MARKS = "#*$%&|<>!?.,;:-_=\"'()/\\@"

N_STATS = 18


def _class_table() -> np.ndarray:
    """Of every code point: 1 ASCII white space, 2 upper, 4 other letter or
    digit, 8 mark."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        x = chr(c)
        out[c] = 2 if x.isupper() else 4 if x.isalnum() else 8 if x in MARKS else 0
    out[[9, 10, 11, 12, 13, 32]] = 1
    return out


_classes = Kept(_class_table)


def statistics(text: str | None) -> list[float]:
    """N_STATS figures of the whole text."""
    if not text:
        return [0.0] * N_STATS
    words = text.encode("utf-8", "surrogatepass").split()
    n, k = len(text), max(1, len(words))
    c = code_points(text)
    kind = _classes()[c]
    white, upper, mark = kind == 1, kind == 2, kind == 8
    solid = np.concatenate(([False], ~white, [False]))
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edge[::2], edge[1::2]
    letters = upper | (kind == 4)
    count = np.concatenate(([0], np.cumsum(letters)))
    caps = np.concatenate(([0], np.cumsum(upper)))
    alnum = count[ends] - count[starts]
    shouted = (alnum > 0) & (caps[ends] - caps[starts] == alnum)
    full = [x for x in text.split("\n") if x.strip()]
    return [float(x) for x in (
        np.log1p(n), np.log1p(len(words)), (n - white.sum()) / k, len(set(words)) / k, mark.mean(),
        sum(map(text.count, "#*$%&|<>")) / n * 10, text.count("|") / k, text.count("!") / k, shouted.sum() / k,
        upper.mean(), ((c >= 48) & (c <= 57)).mean() * 10, (alnum == 0).sum() / k, (~letters[ends - 1]).sum() / k,
        ((c[1:] == c[:-1]) & mark[1:]).sum() / k, sum(map(text.count, ".!?")) / k, np.log1p(len(full)),
        1 - len(set(full)) / max(1, len(full)), np.log1p(len(words) / max(1, len(full))))]


def with_statistics(docs: DataFrame, text_col: str = "text", name: str = "stats") -> DataFrame:
    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return docs.withColumn(name, stats(F.col(text_col)))


@dataclass
class Model:
    center: np.ndarray
    spread: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps_x: np.ndarray  # isotonic steps: raw score -> probability
    steps_y: np.ndarray

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.center) / self.spread, -8, 8)
        wave = np.cos(z @ self.omega + self.phase) * np.sqrt(2 / self.omega.shape[1])
        return np.hstack([wave, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.fourier(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.steps_x):
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), self.steps_x, self.steps_y), 0, 1)


def _stack(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), dtype=np.float64).reshape(len(col), -1)


def train(stats: DataFrame, labels: DataFrame, allowed: Column | None = None, id_col: str = "doc_id",
          label_col: str = "quality", stats_col: str = "stats") -> Model:
    """Fits on every row of ``stats`` whose id is labelled and ``allowed``."""
    marks = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
             .where(F.col("id").isNotNull() & F.col("label").isNotNull()).groupBy("id").agg(F.avg("label").alias("label")))
    rows = stats.where(F.lit(True) if allowed is None else allowed)
    rows = rows.select(F.col(id_col).alias("id"), F.col(stats_col).alias("s")).join(marks, "id").select(
        "s", F.when(F.col("label") >= 0.5, 1.0).otherwise(0.0).alias("y"))
    got = rows.select(*[F.struct(F.avg(F.col("s")[i]).alias("m"), F.stddev_pop(F.col("s")[i]).alias("d")).alias(f"c{i}")
                        for i in range(N_STATS)]).first()
    rng = np.random.default_rng(3)
    omega, phase = rng.normal(size=(N_STATS, N_FOURIER)) / BANDWIDTH, rng.uniform(0, 2 * np.pi, N_FOURIER)
    none = np.zeros(0)
    model = Model(np.zeros(N_STATS), np.ones(N_STATS), omega, phase, np.zeros(N_FOURIER + 1), none, none)
    if got[0]["m"] is None:
        return model
    model.center = np.array([c["m"] for c in got])
    model.spread = np.array([c["d"] if c["d"] > 1e-9 else 1.0 for c in got])
    width = N_FOURIER + 1

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            z = model.fourier(_stack(b["s"]))
            part = np.hstack([z.T @ z, z.T @ b["y"].to_numpy()[:, None]])
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(width), "row": [r.tobytes() for r in total]})

    def summed(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": b["i"][:1], "row": [sum(np.frombuffer(r) for r in b["row"]).tobytes()]})

    sums = rows.mapInPandas(parts, "i int, row binary").groupBy("i").applyInPandas(summed, "i int, row binary").toPandas()
    if sums.empty:
        return model
    normal = np.array([np.frombuffer(r) for r in sums.sort_values("i")["row"]])
    left, right = normal[:, :width], normal[:, width]
    model.weights = np.linalg.solve(left + RIDGE * left[-1, -1] / N_FOURIER * np.eye(width), right)

    @F.pandas_udf("double")
    def raw(s: pd.Series) -> pd.Series:
        return pd.Series(np.clip(model.raw(_stack(s)), -1, 2))

    bins = (rows.select(raw("s").alias("r"), "y").groupBy(F.floor((F.col("r") + 1) * (BINS / 3)).alias("bin"))
            .agg(F.avg("r").alias("r"), F.sum("y").alias("good"), F.count("*").alias("n")).toPandas().sort_values("r"))
    model.steps_x, model.steps_y = isotonic(bins["r"].to_numpy(), bins["good"].to_numpy(), bins["n"].to_numpy())
    return model


def isotonic(x: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points in order of x; the pools' means."""
    pools: list[list[float]] = []  # sum of x * n, good, n
    for xi, gi, ni in zip(x, good, n, strict=True):
        pools.append([xi * ni, gi, ni])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def with_score(stats: DataFrame, model: Model, stats_col: str = "stats", name: str = "score") -> DataFrame:
    shared = stats.sparkSession.sparkContext.broadcast(vars(model))  # plain values: workers need no install

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return pd.Series(Model(**shared.value).score(_stack(s)) if len(s) else [], dtype="float64")

    return stats.withColumn(name, score(F.col(stats_col)))


def classify(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, text_col: str = "text",
             id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """id and score of every row of ``docs``; trained on labelled rows for
    which ``allowed`` (a condition on the id) holds. The statistics are
    computed once, in the shared checkpoint folder."""
    name = fresh(docs.select(id_col), "stats")
    stats = saved(with_statistics(docs.select(id_col, text_col), text_col, name).select(id_col, name))
    return with_score(stats, train(stats, labels, allowed, id_col, label_col, name), name, fresh(stats, "score")).drop(name)
