"""Language identification learns every language of the corpus."""

import numpy as np

from tuneframe.llm import langid


def test_more_than_256_languages(spark):
    rng, rows = np.random.default_rng(5), []
    for lang in range(300):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), size=6)) for _ in range(6)]
        rows += [(len(rows) + i, " ".join(rng.permutation(words)), f"l{lang:03}") for i in range(2 if lang < 256 else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prototypes = langid.train(docs, held_out_fold=None)
    assert len(prototypes) == 300
    found = langid.identify(docs, prototypes).collect()
    assert len(found) == len(rows) and all(r.langid.lang == r.lang for r in found)
    assert langid.keep_known(docs, prototypes).count() == len(rows)
