"""Language identification with hyperdimensional profiles.

Every letter of any script has a random vector of +1 and -1 of its own, upper
and lower case the same. A letter trigram is bound into
one vector: the product of its letters' vectors, each permuted (rolled) by its
place. A document is the bundle (sum) of its trigram vectors, a language the
bundle of the unit vectors of its labelled documents. The prediction is the
language whose prototype has the highest cosine with the document.

Null and empty texts, and texts without a letter, are ``und`` with score 0.
Ties go to the smaller language name. Repeated rows get equal results. With no
labelled row at all every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, code_points, fold, fresh, unit_hash

DIM = 512
#: 0: no letter; 1-26: a-z; from PLAIN on: every other letter by code point.
PLAIN = 27
SYMBOLS = PLAIN + 0x110000
#: Vectors of letters other than a-z that a task keeps.
LETTERS = 1 << 14
UND = "und"
#: Bound of the training sample: documents expected of each language.
DOCS_PER_LANG = 1500
#: Prototype sums that a training task returns at a time.
SUMS = 256
#: A text of this many trigrams or more that is this far from every prototype
#: is in none of the learned languages.
REJECT_NGRAMS = 50
REJECT_SCORE = 0.1


def _symbol_table() -> np.ndarray:
    out = np.zeros(0x110000, dtype=np.int32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            c0 = ord(low) if len(low) == 1 else c
            out[c] = c0 - 96 if 97 <= c0 <= 122 else PLAIN + c0
    return out


_symbol_of = Kept(_symbol_table)


def _plain_table() -> np.ndarray:
    return np.random.default_rng(7).choice(np.array([-1, 1], dtype=np.int8), size=(PLAIN, DIM))


_plain_letters = Kept(_plain_table)


def _letter_vector(symbol: int) -> np.ndarray:
    """The vector of a symbol; of letters other than a-z, drawn by code point."""
    if symbol < PLAIN:
        return _plain_letters()[symbol]
    return np.random.default_rng((7, symbol)).choice(np.array([-1, 1], dtype=np.int8), size=DIM)


_letter = Kept(_letter_vector, LETTERS)


def _bind(ids: np.ndarray) -> np.ndarray:
    """Trigrams with letters other than a-z, from their letters' vectors."""
    symbols, at = np.unique(np.concatenate(_split(ids)), return_inverse=True)
    letters = np.stack([_letter(int(x)) for x in symbols])
    a, b, c = at.reshape(3, -1)
    bound = np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]
    return bound.astype(np.float32)


def _split(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return ids // SYMBOLS**2, ids // SYMBOLS % SYMBOLS, ids % SYMBOLS


def _bound_table() -> np.ndarray:
    """One row for every trigram of a-z and gaps."""
    letters = _plain_letters()
    a, b = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    bound = a[:, None, None, :] * b[None, :, None, :] * letters[None, None, :, :]
    return bound.reshape(-1, DIM).astype(np.float32)


_bound_trigrams = Kept(_bound_table)


def trigram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of the text's trigrams; a run of other characters is one
    gap, and no trigram has a gap in its middle."""
    if not text:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)
    s = np.concatenate(([0], _symbol_of()[code_points(text)], [0])).astype(np.int64)
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
    grams = ((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:])[s[1:-1] != 0]
    ids, counts = np.unique(grams, return_counts=True)
    return ids, counts.astype(np.float32)


def document_vector(text: str | None) -> tuple[np.ndarray, float]:
    """Unit bundle of the text (zeros if it has no letter), number of trigrams."""
    ids, counts = trigram_counts(text)
    table, v = _bound_trigrams(), np.zeros(DIM, dtype=np.float32)
    a, b, c = _split(ids)
    plain = (a < PLAIN) & (b < PLAIN) & (c < PLAIN)
    rows, n = ((a * PLAIN + b) * PLAIN + c)[plain], counts[plain]
    for i in range(0, len(rows), 4096):
        v += n[i : i + 4096] @ table[rows[i : i + 4096]]
    rows, n = ids[~plain], counts[~plain]
    for i in range(0, len(rows), 4096):
        v += n[i : i + 4096] @ _bind(rows[i : i + 4096])
    norm = float(np.sqrt(v @ v))
    return (v / norm if norm else v), float(counts.sum())


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          held_out_fold: int | None = 0, folds: int = 5, docs_per_lang: int = DOCS_PER_LANG) -> dict[str, np.ndarray]:
    """Language prototypes from a bounded sample: of every language about
    ``docs_per_lang`` documents, chosen by hash. Rows of the held-out fold, and
    rows without a language, are never used."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull())
    if held_out_fold is not None:
        rows = rows.where(F.coalesce(fold("id", folds), F.lit(-1)) != held_out_fold)
    # One row a language, as many as there are prototypes: texts are not dealt by language.
    share = rows.groupBy("lang").agg((F.lit(float(docs_per_lang)) / F.count("*")).alias("share"))
    sample = rows.join(F.broadcast(share), "lang").where(unit_hash("id", "text") < F.col("share")).select("lang", "text")

    def bundles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                v, _ = document_vector(text)
                sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        names = list(sums)
        for i in range(0, len(names), SUMS):
            part = names[i : i + SUMS]
            yield pd.DataFrame({"lang": part, "v": [sums[k].tolist() for k in part]})

    def summed(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": b["lang"][:1], "v": [np.sum(np.stack(b["v"].to_list()), axis=0).tolist()]})

    # A task's sum holds a document at least: of each language no more sums than sampled documents.
    sums = sample.mapInPandas(bundles, "lang string, v array<double>")
    total = {r["lang"]: np.array(r["v"]) for r in sums.groupBy("lang").applyInPandas(summed, "lang string, v array<double>").collect()}
    norms = {k: float(np.linalg.norm(v)) for k, v in total.items()}
    return {k: (total[k] / norms[k]).astype(np.float32) for k in sorted(total) if norms[k]}


def predictor(prototypes: dict[str, np.ndarray]):
    """Arrow-batched function: text -> (lang, score, n_ngrams)."""
    names = sorted(prototypes)
    matrix = np.array([prototypes[k] for k in names], dtype=np.float32).reshape(len(names), DIM)

    @F.pandas_udf("lang string, score double, n_ngrams long")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                v, n = document_vector(t)
                if not n or not names:
                    out.append((UND, 0.0, int(n)))
                    continue
                cos = matrix @ v
                k = int(np.argmax(cos))
                out.append((names[k], float(min(1.0, max(0.0, cos[k]))), int(n)))
            yield pd.DataFrame(out, columns=["lang", "score", "n_ngrams"])

    return predict


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column (``langid``, or a longer free name) of lang, score and n_ngrams."""
    return docs.withColumn(fresh(docs, "langid"), predictor(prototypes)(F.col(text_col)))


def keep_known(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text is in one of the learned languages: not
    ``und``, and not a longer text that is far from every prototype."""
    name, out = fresh(docs, "langid"), identify(docs, prototypes, text_col)
    far = (F.col(f"{name}.n_ngrams") >= REJECT_NGRAMS) & (F.col(f"{name}.score") < REJECT_SCORE)
    return out.where((F.col(f"{name}.lang") != UND) & ~far).drop(name)
