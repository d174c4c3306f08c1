"""Token budgets and batch plans against plain Python."""

import hashlib

from tuneframe import constants as K
from tuneframe.operators import batches as B


def test_token_budget_equals_plain_split(spark):
    ws = K.PY_WHITESPACE
    texts = [None, "", "   ", "one", " one ", "a b c", "a b c ", "　a b\x1cc\td e", "a" * 1000, ws, f"{ws}x{ws}y{ws}z{ws}",
             "word " * 200_000, "x y​z w \U0001f600 v", " ".join(map(str, range(70)))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for limit in (0, 1, 2, 3, 64, 5000):
        for r in B.token_budget(df, "text", limit).collect():
            text = texts[r.id]
            if text is None:
                assert r.kept_text is None and r.n_tokens is None
                continue
            tokens = text.split()
            assert (r.n_tokens, r.cut) == (len(tokens), len(tokens) > limit)
            if r.cut:
                assert text.startswith(r.kept_text) and r.kept_text.split() == tokens[:limit]
                assert r.kept_text == r.kept_text.rstrip()
            else:
                assert r.kept_text == text


def test_batch_plan_equals_a_sort_of_the_digests(spark, monkeypatch):
    ids = spark.range(0, 3000).selectExpr("id * 7 as record_id")
    want = {}
    for e in (1, 2):
        order = sorted(range(0, 21000, 7), key=lambda i: (hashlib.md5(f"{K.TRAIN_SEED}:{e}:{i}".encode()).hexdigest(), i))
        want |= {(e, r): (n // 2, n // 2 // 2) for n, r in enumerate(order)}
    for rows in (1 << 16, 16):
        monkeypatch.setattr(B, "BUCKET_ROWS", rows)
        got = {(r.epoch, r.record_id): (r.batch_no, r.step) for r in B.batch_plan(ids, "record_id", 2, 2).collect()}
        assert got == want
    assert B.batch_plan(ids.limit(0), "record_id", 2, 2).count() == 0


def test_bucket_size_does_not_grow_with_the_input():
    for rows in (0, 1, 1000, 1 << 20, 10**9, 10**13):
        bits = B.bucket_bits(rows, 200)
        assert rows / 2**bits <= B.BUCKET_ROWS or bits == 32
        assert 2**bits >= min(200, max(rows, 1))
