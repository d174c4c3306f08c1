"""The pipeline's near-copy stage against brute force at five words and 0.8."""

import corpus_pipeline
from test_contracts import brute_components


def test_near_copies_five_words(spark, sf, given):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base),
             " ".join([*base, *[f"more{i}" for i in range(40)]]),  # a fifth appended: 0.83
             " ".join([*base, *[f"much{i}" for i in range(60)]]),  # 0.77 to the base
             " ".join("new" if i in (40, 80, 120, 160) else w for i, w in enumerate(base))]  # 0.82; 3-word: 0.89
    made = list(enumerate(texts, 1_000_000))
    docs = [(d["doc_id"], d["text"]) for d in given("documents")] + made
    want = brute_components(docs, 5, 80)
    assert [want[i][1] - 1_000_000 for i, _ in made] == [0, 0, 2, 0]
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), sf)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
