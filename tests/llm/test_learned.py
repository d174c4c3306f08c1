"""The learned operators against plain versions of the same method, row by row
over the whole tables: op2, op3's verdicts, op7 and op8."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from test_contracts import BLANK

from tuneframe.llm import langid, mixing, quality_classifier, url_filter
from tuneframe.llm.queries import QUERIES


def test_op2_against_a_plain_fit(rows, given):
    qc = quality_classifier
    label = {r["doc_id"]: r["quality"] for r in given("labels")}
    docs = given("documents")
    stats = {d["doc_id"]: np.array(qc.statistics(d["text"])) for d in docs}
    fit = [d["doc_id"] for d in docs if d["doc_id"] in label and zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2]
    x, y = np.array([stats[i] for i in fit]), np.array([float(label[i]) for i in fit])
    rng = np.random.default_rng(3)
    omega, phase = rng.normal(size=(qc.N_STATS, qc.N_FOURIER)) / qc.BANDWIDTH, rng.uniform(0, 2 * np.pi, qc.N_FOURIER)
    spread = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)

    def waves(s):
        z = np.clip((s - x.mean(axis=0)) / spread, -8, 8)
        return np.append(np.cos(z @ omega + phase) * math.sqrt(2 / qc.N_FOURIER), 1.0)

    z = np.array([waves(s) for s in x])
    w = np.linalg.solve(z.T @ z + qc.RIDGE * len(z) / qc.N_FOURIER * np.eye(z.shape[1]), z.T @ y)
    raw = np.clip(z @ w, -1, 2)
    bins = {}
    for r, good in zip(raw, y, strict=True):
        bins.setdefault(math.floor((r + 1) * (qc.BINS / 3)), []).append((r, good))
    # Isotonic means by their definition: the largest over starts of the least over ends.
    points = sorted((np.mean([r for r, _ in b]), sum(g for _, g in b), len(b)) for b in bins.values())
    good, n = np.array([p[1] for p in points]), np.array([p[2] for p in points])
    level = [max(min(good[i : k + 1].sum() / n[i : k + 1].sum() for k in range(j, len(points))) for i in range(j + 1)) for j in range(len(points))]
    pools = {}
    for p, v in zip(points, level, strict=True):
        pools.setdefault(round(v, 9), []).append(p)
    xs = [sum(p[0] * p[2] for p in ps) / sum(p[2] for p in ps) for ps in pools.values()]
    for r in rows("op2_quality_classifier"):
        want = float(np.clip(np.interp(waves(stats[r["doc_id"]]) @ w, xs, list(pools)), 0, 1))
        assert r["score"] == pytest.approx(want, abs=1e-4)


def test_op3_verdicts_against_plain_scores(spark, rows):
    weights, intercept = url_filter.train(spark)
    learned = 0
    for r in rows("op3_url_filter"):
        if r["rule"] is not None:
            continue
        text = f"^{r['host']}{r['path']}$"
        grams = [text[i : i + k] for k in url_filter.ORDERS for i in range(max(len(text) - k, 0) + 1)] if r["host"] or r["path"] else []
        total = sum(weights[xxhash.xxh64_intdigest(g.encode(), seed=42) % url_filter.BUCKETS] for g in grams)
        p = 1 / (1 + math.exp(-(total / max(len(grams), 1) + intercept)))
        assert r["probability"] == pytest.approx(p, abs=1e-9)
        assert r["verdict"] == ("block" if p >= url_filter.BLOCK_PROBABILITY else "allow")
        learned += 1
    assert learned


def test_op3_on_urls_unlike_the_table(spark):
    clean = ["https://www.theatre.org/programme/autumn", "https://bakery.net/bread/sourdough", "https://archive.org/details/old-maps",
             "https://forum.cycling.net/topic/touring", "https://en.travel.org/guides/porto", "https://university.edu.org/lessons/history"]
    spam = ["http://casino-slots.win/jackpot/free", "http://cheap-viagra.biz/pills/buy", "http://adult-dating.xyz/hot/cam",
            "http://click.ads.biz/banner/track", "http://free-keygen.ru/crack/serial", "http://payday-cash.top/loan/claim"]
    df = spark.createDataFrame([(u,) for u in clean + spam], "url string")
    verdict = {r.url: r.url_verdict.verdict for r in url_filter.judge_urls(df, rules=()).collect()}
    assert sum(verdict[u] == "allow" for u in clean) >= 5 and sum(verdict[u] == "block" for u in spam) >= 5


def test_op7_against_plain_bundles(rows, given):
    def symbols(text):
        s = [0]
        for c in text:
            low = c.lower()
            x = 0 if not c.isalpha() else (ord(low) if len(low) == 1 else ord(c))
            s.append(0 if not x else x - 96 if 97 <= x <= 122 else langid.PLAIN + x)
        return [a for a, b in zip([*s, 0], [None, *s, 0], strict=False) if a or b != 0 or b is None]

    letters = {}

    def letter(x):
        if x not in letters:
            letters[x] = langid._letter_vector(x).astype(np.float64)
        return letters[x]

    def bundle(text):
        s = symbols(text or "")
        v = np.zeros(langid.DIM)
        for (a, b, c), k in Counter(t for t in zip(s, s[1:], s[2:], strict=False) if t[1]).items():
            v += k * np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
        norm = np.linalg.norm(v)
        return v / norm if norm else v

    docs = given("documents")
    vector = {d["doc_id"]: bundle(d["text"]) for d in docs}
    sums = {}
    for d in docs:
        if d["lang"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 5:
            sums[d["lang"]] = sums.get(d["lang"], 0) + vector[d["doc_id"]]
    names = sorted(sums)
    prototypes = np.array([sums[k] / np.linalg.norm(sums[k]) for k in names])
    for r in rows("op7_language_id"):
        v = vector[r["doc_id"]]
        if not v.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        cos = prototypes @ v
        best = sorted(cos)[::-1]
        assert r["score"] == pytest.approx(max(0.0, best[0]), abs=1e-4)
        if len(best) < 2 or best[0] - best[1] > 1e-4:
            assert r["lang_pred"] == names[int(cos.argmax())]


def check_mix(got, docs):
    """copies of every row from weights, budget and places by their definition."""
    tokens = {}
    for d in docs:
        tokens[d["source"]] = tokens.get(d["source"], 0) + len(re.findall(BLANK, d["text"] or ""))
    total, names = sum(tokens.values()), list(tokens)
    a = mixing.solve([float(t) for t in tokens.values()], float(total))
    weight = dict(zip(names, mixing.tempered([float(t) for t in tokens.values()], a), strict=True))
    by_source = {}
    for r in got:
        by_source.setdefault(r["source"], []).append(r)
    for s, rs in by_source.items():
        assert all(r["weight"] == pytest.approx(weight[s], rel=1e-9) for r in rs)
        part, have = rs[0]["weight"] * total, tokens[s]
        rest = math.fmod(part, have) if have else 0.0
        whole, used, cut = round((part - rest) / have) if have else 1, 0, None
        for r in sorted(rs, key=lambda r: r["place"]):
            used += r["n_tokens"]
            if cut is None and used > rest:
                cut = r["place"]
        for r in rs:
            extra = rest > 0 and (cut is None or r["place"] < cut)
            assert r["copies"] == whole + extra, (s, r["place"], cut)


def test_op8_against_a_plain_walk(rows, given):
    check_mix(rows("op8_source_mixing"), given("documents"))


def test_mix_with_a_source_of_a_third_of_all_rows(spark):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"s{i % 40}", "w " * (i % 23)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = [r.asDict() for r in mixing.mix(df).collect()]
    assert len(got) == len(rows)
    check_mix(got, [{"source": s, "text": t} for _, s, t in rows])


def test_mixed_documents_keep_their_columns(spark):
    rows = [(1, "a", "one two", 3, "x"), (1, "a", "one two", 3, "x"), (2, None, None, 4, "y"), (None, "b", "", 5, "z"), (3, "b", "w " * 9, 6, "z")]
    schema = "doc_id long, source string, text string, copies int, salt string"
    df = spark.createDataFrame(rows, schema)
    out = mixing.mixed_documents(df)
    assert out.columns == [*df.columns, "weight", "copies_", "place"]
    plain = {(r.doc_id, r.source): r.copies for r in mixing.mix(df).collect()}
    got = out.collect()
    assert {(r.doc_id, r.source): r.copies_ for r in got} == {k: v for k, v in plain.items() if v}
    assert all((r.doc_id, r.source, r.text, r.copies, r.salt) in rows for r in got)
    assert mixing.mixed_documents(df.limit(0)).count() == 0 and QUERIES
