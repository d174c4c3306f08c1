"""SetSketch near-duplicates, spelling variants and whitening: whole queries
against brute force and SQL, then their edges."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_contracts import LOWER, brute_components

from tuneframe.llm import permuterm, setsketch, whitening

DOCS = "doc_id long, text string, white string, s string, token string, id string, text_hash string, word string"


def more(rows):
    return [(*r, *["x"] * 6) for r in rows]


# ------------------------------------------------------------ near-duplicates


def test_op13_against_brute_force(rows, given):
    want = brute_components([(d["doc_id"], d["text"]) for d in given("documents")], 3, 85)
    got = rows("op13_minhash_near_dedup")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and not all(r["kept"] for r in got)


@pytest.mark.parametrize("name", ["op5_chat_format", "op6_jaccard_join", "op11_spelling_variants", "op13_minhash_near_dedup"])
def test_sql(rows, sf, name):
    from tuneframe.llm.oracles import ORACLES

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    got = rows(name)
    assert sorted(names) == sorted(got[0])
    want = sorted(cur.fetchall(), key=str)
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == want


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(4)
    sets = []
    for jaccard in (0.3, 0.6, 0.85, 0.95):
        u = rng.integers(0, 1 << 63, size=4000, dtype=np.uint64)
        k = int(4000 * jaccard)
        sets += [u[: k + (4000 - k) // 3], np.concatenate([u[:k], u[k + (4000 - k) // 3 :]])]
    s = setsketch.sketches(sets)
    for i in range(0, 8, 2):
        union = setsketch.sketches([np.union1d(sets[i], sets[i + 1])])[0]
        assert (setsketch.merged(s[i], s[i + 1]) == union).all()
        a, b = len(sets[i]), len(sets[i + 1])
        x = np.array([a / (a + b)]), np.array([(s[i] > s[i + 1]).sum()]), np.array([(s[i] < s[i + 1]).sum()])
        true = len(np.intersect1d(sets[i], sets[i + 1])) / 4000
        found = setsketch.estimate(*x)[0]
        assert abs(found - true) < 4 * np.sqrt(true * (1 - true) / setsketch.REGISTERS)
        grid = np.linspace(0, min(a, b) / max(a, b), 2001)
        best = setsketch.log_likelihood(grid, *(np.repeat(v, 2001) for v in x)).max()
        assert setsketch.log_likelihood(np.array([found]), *x)[0] >= best - 1e-4
        if not 0.4 < true < 0.8:
            assert setsketch.may_link(np.array([a]), np.array([b]), x[1], x[2]).tolist() == [true > 0.8]


def test_near_dedup_edges(spark):
    words = [f"w{i}" for i in range(200)]
    given = [(1, None), (2, ""), (3, " \n\t"), (4, "long words go on " * 20_000), (5, "one"), (5, "one"), (None, "one two"),
             (6, "ONE"), (7, "x" * 100_000), (None, None), (20, " ".join(words)), (21, " ".join([*words[:-1], "other"])),
             (22, " ".join(words[28:])), (23, " ".join(words).upper()), (24, " ".join(words[100:]))]
    df = spark.createDataFrame(more(given), DOCS)
    got = {}
    for r in setsketch.linked(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == [(0, 1, True)] and got[2] == [(0, 2, True)] and got[3] == [(0, 3, True)]
    assert got[5] == [(1, 5, True)] * 2 and got[6] == [(1, 5, False)]
    assert sorted(got[None]) == [(0, None, True), (1, None, True)]
    assert [got[i][0][1] for i in (20, 21, 22, 23, 24)] == [20, 20, 20, 20, 24]
    kept = setsketch.keep_representatives(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 5, 7, 20, 24]
    assert setsketch.linked(df.limit(0)).count() == 0 and setsketch.keep_representatives(df.limit(0)).count() == 0


def test_near_dedup_of_a_large_group(spark, monkeypatch):
    """A cluster over many blocks, and a chain whose ends do not link."""
    from tuneframe.llm import similarity_join

    monkeypatch.setattr(similarity_join, "BLOCK", 4)
    base, texts = [f"w{i}" for i in range(120)], []
    for i in range(30):
        w = list(base)
        w[i * 4] = f"new{i}"
        texts.append(" ".join(w))
    texts += [" ".join(f"c{j}" for j in range(i * 9, i * 9 + 150)) for i in range(12)]
    texts += [" ".join(f"d{j}" for j in range(i * 30, i * 30 + 150)) for i in range(5)]
    want = brute_components(list(enumerate(texts)), 3, 85)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.linked(df).collect()} == want
    assert len({c for _, c in want.values()}) == 7


# ---------------------------------------------------------- spelling variants


def brute_variants(docs):
    count = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}
    holes = {}
    for w in n:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in n}
    for (a, b), ws in holes.items():
        for w in ws:
            near[w] |= ws - {w}
            if a + b in n:
                near[w].add(a + b)
                near[a + b].add(w)
    form = {}
    for w, ns in near.items():
        best = min(ns, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def test_op11_against_brute_force(rows, given):
    want = brute_variants([(d["doc_id"], d["text"]) for d in given("documents")])
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows("op11_spelling_variants")}
    assert got == want and any(x[0] for x in want.values())


def test_spelling_edges(spark):
    chain = "meadows " * 1000 + "meadows " * 100 + "meadowss " * 3 + "meadowws " * 9 + "meadowés " * 10 + "meadoés " * 2
    same = "aaaaaaa aaaaaaaa aaaaaaaaa " * 2 + "abaaaaa bbaaaaa cbaaaaa " * 2 + "ÀÉ×÷ÿéé " * 2
    odd = "short MEADOWS x" + "y" * 50_000 + " " + "y" * 50_000 + "\U0001f600 meado$ws dot.separated words_joined"
    given = [(1, None), (2, ""), (3, " \n"), (4, chain), (5, same), (5, same), (None, same), (6, odd), (7, odd)]
    df = spark.createDataFrame(more(given), DOCS)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in permuterm.group_spellings(df).collect()}
    assert got == brute_variants(given)
    assert got["meadoés"][1] in ("meadows", "meadowés", "meadoés") and any(x[0] for x in got.values())
    plain = permuterm.count_words(df, noise=None)
    assert {r.word: r.n for r in plain.collect()}["meadows"] == 1102
    assert permuterm.group_spellings(df.limit(0)).count() == 0


def test_spelling_random_words(spark):
    rng = np.random.default_rng(9)
    words = {"".join(rng.choice(list("abé"), size=int(rng.integers(3, 8)))) for _ in range(900)}
    n = {w: int(10 ** rng.uniform(0.4, 4)) for w in sorted(words)}
    df = spark.createDataFrame([(w, c) for w, c in n.items()], "word string, n long")
    got = {r.word: (r.n_near, r.form) for r in permuterm.variants(df, min_length=2).collect()}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    for w in n:
        ns = [x for x in n if x != w and near(w, x)]
        best = min(ns, key=lambda x: (-n[x], x), default=None)
        assert got[w] == (len(ns), best if best and n[best] >= 10 * n[w] else None)


# -------------------------------------------------------------------- whitening


def brute_white(vectors):
    """Of every usable vector: deviation and whitened (up to sign); eigenvalue shares."""
    x = {k: [int(np.floor(256 * float(c))) for c in v] for k, v in vectors.items()
         if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, dtype=np.float64) - np.array([s / n for s in sums])
    cov = centred.T @ centred / n
    e, vec = np.linalg.eigh(cov)
    e, vec = e[::-1], vec[:, ::-1]
    dev = {k: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for k, v in x.items()}
    white = {k: (np.array(v) - np.array([s / n for s in sums])) @ vec[:, :4] / np.sqrt(e[:4]) for k, v in x.items()}
    return n, dev, white, e / np.trace(cov)


def test_op12_against_eigh(rows, given):
    vectors = {r["vec_id"]: r["embedding"] for r in given("embeddings")}
    n, dev, white, share = brute_white(vectors)
    got = rows("op12_embedding_whitening")
    assert Counter(r["vec_id"] for r in got) == {k: 4 for k in dev}
    sign = {}
    for r in got:
        k, c = r["vec_id"], r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, dev[k])
        assert abs(r["explained"] / share[c] - 1) < 1e-8 and 0 <= r["identity_error"] < 1e-8
        sign.setdefault(c, np.sign(r["whitened"]) * np.sign(white[k][c]))
        assert abs(sign[c] * r["whitened"] - white[k][c]) < 1e-8
    assert set(sign) == {0, 1, 2, 3}


def test_factor_and_rotation():
    rng = np.random.default_rng(8)
    for size, rank in ((1, 1), (5, 5), (12, 4), (33, 33), (7, 0)):
        b = rng.normal(size=(size, rank)) * 10.0 ** rng.integers(-3, 4, size=rank)
        a = b @ b.T
        factor = whitening.pivoted_cholesky(a)
        assert factor.shape == (size, rank) and np.allclose(factor @ factor.T, a, rtol=1e-9, atol=1e-9 * np.abs(a).max(initial=1))
        norms, columns = whitening.jacobi(factor)
        assert np.allclose(norms, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-9)
        assert np.allclose(columns.T @ columns, np.eye(rank), atol=1e-9)
    pairs = {frozenset(p) for a, b in whitening.rounds(7) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert len(pairs) == 21


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    schema = "vec_id long, embedding array<double>, white string, i int, n long"
    rng = np.random.default_rng(2)
    good = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(40)]
    rows = [*good, (100, None), (101, []), (102, [nan, 0.0, 0.0]), (103, [inf, 0.0, 0.0]), (104, [1.0, None, 2.0]), (105, [1.0, 2.0]),
            (5, good[5][1]), (5, good[5][1]), (None, good[6][1])]
    df = spark.createDataFrame([(*r, "w", 1, 2) for r in rows], schema)
    model = whitening.fit(df)
    out = whitening.whiten(df, model)
    assert out.columns == [*df.columns, "white_"]
    n, dev, white, share = brute_white(dict(good))
    got = out.collect()
    assert len(got) == 43 and model.n == n and np.allclose(model.explained, share[:3]) and model.identity_error < 1e-9
    for r in got:
        if r.vec_id is not None:
            assert r.white_.deviation == dev[r.vec_id]
            assert np.allclose(np.abs(r.white_.whitened), np.abs(white[r.vec_id][:3]))
    assert whitening.fit(df.limit(0)) is None and whitening.whiten(df, None).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "vec_id long, embedding array<double>")
    assert whitening.fit(same) is None
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert whitening.fit(flat).components.shape == (3, 1)
    huge = spark.createDataFrame([(i, [i * 1e30, -1e17 * i, 1e15 * i]) for i in range(4)], "vec_id long, embedding array<double>")
    big = whitening.fit(huge)
    assert {r.white.deviation for r in whitening.whiten(huge, big).collect()} == {None}
    assert big.sums[0] == 3 * ((1 << 63) - 1) and big.identity_error < 1e-4
