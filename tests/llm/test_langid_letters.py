"""Every letter of any script has a vector of its own."""

import numpy as np
import pytest

from tuneframe.llm import langid


@pytest.mark.parametrize("x, y", ["óé", "ñç", "èü", "ае", "αζ", "一丅"])
def test_letters_are_told_apart(x, y):
    (u, n), (v, m) = langid.document_vector(x * 3), langid.document_vector(y * 3)
    assert n == m == 3 and abs(float(u @ v)) < 0.5
    assert np.array_equal(langid.document_vector(x.upper())[0], langid.document_vector(x)[0])


def test_bound_as_the_letters_say():
    ids, counts = langid.trigram_counts("abéж éa")
    want = np.zeros(langid.DIM)
    for a, b, c, n in zip(*langid._split(ids), counts, strict=True):
        want += n * np.roll(langid._letter(int(a)), 2) * np.roll(langid._letter(int(b)), 1) * langid._letter(int(c))
    v, n = langid.document_vector("abéж éa")
    assert n == counts.sum() == 6 and np.allclose(v, want / np.linalg.norm(want), atol=1e-6)


def test_languages_of_one_script(spark):
    one, two = "абвгд", "ежзий"  # the same in code point mod 5
    rng, rows = np.random.default_rng(3), []
    for i in range(20):
        picks = rng.integers(0, 5, size=(30, 5))
        rows += [(2 * i + j, " ".join("".join(s[k] for k in w) for w in picks), lang)
                 for j, (s, lang) in enumerate([(one, "xa"), (two, "xb")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(docs, langid.train(docs)).collect()
    assert all(r.langid.lang == r.lang for r in found)
