"""Quality rules: countable base rules, then a calibrated n-gram classifier.

Base figures come from the whole text (see ``base_figures``). The verdict is a
logistic regression on hashed word 1- and 2-grams and character
3-grams (log counts, unit length), trained on labelled quality rows, made a
probability by Platt scaling on rows kept out of the fit, and compared with a
fixed threshold in Arrow batches.

The classifier is fitted on a bounded sample (MAX_TRAIN_ROWS rows by hash of
the id) of labelled documents. Null and empty texts have no words: base_failed
holds and kept is false. Conflicting labels of one id count by their mean.
Without labels of both kinds every probability is 1 (the base rules decide
alone). Repeated rows get equal results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, fresh, unit_hash, word_hashes

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document is kept if its calibrated probability is at least this.
KEEP_PROBABILITY = 0.5

FEATURE_BITS = 14
WORD_ORDERS = (1, 2)
#: Of UTF-8 bytes.
CHAR_ORDERS = (3,)
#: Bound of the classifier's training sample.
MAX_TRAIN_ROWS = 3000
CALIBRATION_FOLDS = 4
EPOCHS = 12
L2 = 1e-6

RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "probability double")


def base_figures(text: str | None) -> tuple[tuple[int, int, int, int, int], list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; the words."""
    if not text:
        return (0, 0, 0, 0, 0), []
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split on ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words)), words


def repeated_words(words: list) -> int:
    """Words inside 3-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    again = np.fromiter((count[w] > 1 for w in windows), dtype=bool, count=len(windows))
    hit = np.zeros(len(words), dtype=bool)
    hit[:-2] |= again
    hit[1:-1] |= again
    hit[2:] |= again
    return int(hit.sum())


def features(text: str | None, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids (sorted) and values of the hashed features, of unit length."""
    if not words:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
    flat = b" ".join(words)
    found = [word_hashes(flat, k) for k in WORD_ORDERS]
    c = np.frombuffer(flat, dtype=np.uint8).astype(np.uint64)
    for k in CHAR_ORDERS:
        if len(c) >= k:
            h = np.full(len(c) - k + 1, np.uint64(k))
            for i in range(k):
                h = h * np.uint64(1_000_003) + c[i : len(c) - k + 1 + i]
            found.append(h * np.uint64(0x9E3779B97F4A7C15))
    buckets = (np.concatenate(found) >> np.uint64(64 - FEATURE_BITS)).astype(np.uint16)
    ids, counts = np.unique(buckets, return_counts=True)
    values = np.log1p(counts).astype(np.float32)
    return ids.astype(np.int32), values / np.sqrt(values @ values)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    scale: float  # Platt scaling: probability = 1 / (1 + exp(-(scale * margin + shift)))
    shift: float

    def probability(self, ids: np.ndarray, values: np.ndarray) -> float:
        z = self.scale * (float(values @ self.weights[ids]) + self.bias) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


KEEP_ALL = Model(np.zeros(1 << FEATURE_BITS, dtype=np.float32), 0.0, 0.0, 35.0)


def labelled(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str) -> DataFrame:
    """id, text and label of labelled documents; one label (the mean) an id."""
    marks = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
             .where(F.col("id").isNotNull() & F.col("label").isNotNull()).groupBy("id").agg(F.avg("label").alias("label")))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(marks, "id")


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
          label_col: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fits on at most ``max_rows`` labelled rows, the first by hash of the id."""
    marks = labels.where(F.col(label_col).isNotNull()).select(id_col, label_col)
    some = marks.withColumn("h_", unit_hash(id_col)).orderBy("h_", id_col, label_col).limit(max_rows).drop("h_")
    rows = labelled(docs, some, text_col, id_col, label_col).select(
        "text", "label", F.coalesce(fold("id", CALIBRATION_FOLDS), F.lit(0)).alias("part"),
        F.struct(unit_hash("id"), F.xxhash64("text")).alias("at")).orderBy("at", "label").limit(max_rows)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, y, p in zip(b["text"], b["label"], b["part"], strict=True):
                ids, values = features(t, base_figures(t)[1])
                out.append((ids.tobytes(), values.tobytes(), y >= 0.5, p))
            yield pd.DataFrame(out, columns=["ids", "vals", "good", "part"])

    got = rows.mapInPandas(hashed, "ids binary, vals binary, good boolean, part int").toPandas()
    xs = [(np.frombuffer(i, dtype=np.int32), np.frombuffer(v, dtype=np.float32))
          for i, v in zip(got["ids"], got["vals"], strict=True)]
    ys, out = got["good"].to_numpy(dtype=bool), (got["part"] == 0).to_numpy()
    if not len(ys) or ys.all() or not ys.any():
        return KEEP_ALL
    fit = np.flatnonzero(~out)
    if not fit.size or ys[fit].all() or not ys[fit].any():
        fit = np.arange(len(ys))
    weights, bias = _descend([xs[i] for i in fit], ys[fit])
    margins = np.array([float(v @ weights[i]) + bias for i, v in xs])
    held = np.flatnonzero(out) if out.any() and ys[out].any() and not ys[out].all() else fit
    return Model(weights.astype(np.float32), bias, *platt(margins[held], ys[held]))


def _descend(xs: list, ys: np.ndarray) -> tuple[np.ndarray, float]:
    """Adagrad over single rows, both classes with equal total weight."""
    w = np.zeros(1 << FEATURE_BITS)
    square = np.full(1 << FEATURE_BITS, 1e-3)
    b, b_square = 0.0, 1e-3
    row_weight = np.where(ys, 0.5 / ys.mean(), 0.5 / (1 - ys.mean()))
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(ys)):
            ids, v = xs[i]
            z = float(v @ w[ids]) + b
            g = row_weight[i] * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - ys[i])
            grad = g * v + L2 * w[ids]
            square[ids] += grad * grad
            w[ids] -= 0.3 * grad / np.sqrt(square[ids])
            b_square += g * g
            b -= 0.3 * g / np.sqrt(b_square)
    return w, b


def platt(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Scale and shift by Newton steps, with Platt's smoothed targets."""
    pos, neg = int(good.sum()), int((~good).sum())
    target = np.where(good, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(theta[0], 1e-6)), float(theta[1])


def scorer(spark, model: Model):
    shared = spark.sparkContext.broadcast(vars(model))  # plain values: workers need no install

    @F.pandas_udf(RESULT)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Model(**shared.value)
        for texts in batches:
            out = []
            for t in texts:
                base, words = base_figures(t)
                out.append((*base, m.probability(*features(t, words))))
            yield pd.DataFrame(out, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                             "probability"])

    return score


def apply_rules(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``quality`` (or a longer free name): the
    base figures, probability, base_failed and kept."""
    name, raw = fresh(docs, "quality"), fresh(docs, "quality_raw")
    r = F.col(raw)
    failed = (r["n_words"] < MIN_WORDS) | (100 * r["n_repeat_words"] > MAX_REPEAT_PERCENT * r["n_words"])
    return docs.withColumn(raw, scorer(docs.sparkSession, model)(F.col(text_col))).withColumn(name, F.struct(
        *[r[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "probability")],
        failed.alias("base_failed"), (~failed & (r["probability"] >= KEEP_PROBABILITY)).alias("kept"))).drop(raw)
