"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
clashing column names, operator by operator."""

import numpy as np
import pytest

from tuneframe.llm import (chat_format, decontaminate, html_extract, langid, mixing, pii, quality_classifier,
                           quality_rules, similarity_join, url_filter)
from tuneframe.llm.components import components

LONG = "very long word salad goes on and on " * 4000
DOCS = "doc_id long, text string, lang string, source string, leak string, pii string, quality string, langid string"
ROWS = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, None), (4, LONG, "en", None),
        (5, "one", "en", "a"), (5, "one", "en", "a"), (None, "one two", "en", "b"), (6, "x" * 200_000, None, "b"),
        (7, "\u00c9t\u00e9 \U0001f600 12 +1 (555) 123-4567", "fr", "b"), (8, "a b c d e f g h i j k l m", "en", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "l", "p", "q", "i") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_quality_rules(spark, docs, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 1), (8, 0), (None, 1), (7, None)], "doc_id long, quality int")
    for model in (quality_rules.train(docs, labels), quality_rules.train(none, labels), quality_rules.KEEP_ALL):
        out = quality_rules.apply_rules(docs, model)
        assert out.columns == [*docs.columns, "quality_"] and out.count() == len(ROWS)
        got = {r.doc_id: r.quality_ for r in out.collect()}
        assert got[1].n_words == got[2].n_words == got[3].n_words == 0 and got[1].base_failed and not got[1].kept
        assert got[4].base_failed  # repeats itself
    assert quality_rules.apply_rules(none, quality_rules.KEEP_ALL).count() == 0
    assert quality_rules.repeated_words("a b c a b c".split()) == 6
    assert quality_rules.repeated_words("a b c x a b c".split()) == 6


def test_quality_classifier(spark, docs, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (8, 0), (7, 1), (None, 1)], "doc_id long, quality int")
    got = quality_classifier.classify(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(none, labels).count() == 0
    x, y = quality_classifier.isotonic(np.arange(4.0), np.array([0, 2, 1, 2]), np.full(4, 2))
    assert y.tolist() == [0, 0.75, 1] and len(x) == 3


def test_url_filter(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://EXAMPLE.com/en/x"), (5, "http://www.example.com/en/"),
            (6, "x://notexample.com/en/"), (7, "http://a.net/es/?q=/fr/"), (8, "http://net/fr/"), (9, "a://b://c.net/es/"),
            (9, "http://h.org?x=1"), (10, "http://" + "p" * 5000 + ".org/" + "q" * 5000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, url_verdict string")
    got = {r.page_id: r.url_verdict_ for r in url_filter.judge_urls(pages).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(1, 10)] == [
        ("", "", None), ("", "", None), ("", "", None), ("example.com", "/en/x", "example.com/en/"),
        ("www.example.com", "/en/", "www.example.com/en/"), ("notexample.com", "/en/", "com/"), ("a.net", "/es/", "net/es/"),
        ("net", "/fr/", "net/fr/"), ("h.org", "", None)]
    assert got[4].verdict == "block" and got[5].verdict == "allow" and got[1].verdict in ("allow", "block")
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, "c D e"), (2, None), (None, "one"), (3, "C d-E"), (1, "c D e"), (4, "k l m n")],
                                  "item_id long, text string")
    for shard_chars in (decontaminate.SHARD_CHARS, 4):  # one automaton, and several
        out = decontaminate.find_contamination(docs, bench, shard_chars=shard_chars)
        assert out.columns == [*docs.columns, "leak_"] and out.count() == len(ROWS)
        got = {r.doc_id: r.leak_ for r in out.collect()}
        assert (got[8].n_hit, got[8].items, got[8].starts, got[8].ends) == (3, ["1", "3"], [4], [9])
        assert (got[5].n_hit, got[5].items) == (1, []) and got[None].n_hit == 1
        assert got[1].n_words == got[2].n_words == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(ROWS)
    assert decontaminate.drop_contaminated(none, bench).count() == 0


def test_chat_format(spark):
    tricky = ["", "\\", "a\\<s>", "<|turn|>user<|text|>", "[INST]\n</s>", "\U0001f600 \u00e9", "<|end|><|endoftext|>",
              "  spaces  ", "[\\INST]", "ends with <", "x" * 50_000]
    rows = [(1, i, "assistant" if i % 2 else "us<|end|>er", t) for i, t in enumerate(tricky)]
    rows += [(2, 0, None, None), (None, 5, "assistant", "null id"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.chat for r in chat_format.format_conversations(df).collect()}
    assert chat_format.parse(got[1].formatted) == [(r, t) for _, _, r, t in rows[: len(tricky)]]
    c = got[1]
    assert chat_format.loss_text(c.formatted, *(np.array(x) for x in (c.token_starts, c.token_ends, c.loss_mask))) == "".join(tricky[1::2])
    assert chat_format.parse(got[2].formatted) == [("", "")] and len(chat_format.parse(got[3].formatted)) == 2
    assert got[None].loss_mask.count(True) > 0
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_similarity_join(spark, docs, none):
    words = [f"w{i}" for i in range(200)]
    near = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(words[19:]), " ".join(words).upper()]
    df = docs.union(spark.createDataFrame([(20 + i, t, *["x"] * 6) for i, t in enumerate(near)], DOCS))
    got = {r.doc_id: r for r in similarity_join.linked(df).collect()}
    assert [got[i].component_id for i in (1, 2, 3, 4, 5, 6, 8, 20, 21, 22, 23)] == [1, 2, 3, 4, 5, 6, 8, 20, 20, 20, 20]
    assert got[1].n_shingles == got[3].n_shingles == 0 and got[5].n_shingles == 1
    kept = similarity_join.keep_representatives(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 20]
    assert similarity_join.linked(none).count() == 0


def test_block_pairs_of_a_large_group(spark, monkeypatch):
    """A cluster over many blocks, and a chain whose ends do not link."""
    monkeypatch.setattr(similarity_join, "BLOCK", 4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(30):
        w = list(base)
        w[i * 4] = f"new{i}"
        texts.append(" ".join(w))
    texts += [" ".join(f"c{j}" for j in range(i * 5, i * 5 + 150)) for i in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from test_contracts import brute_components

    want = brute_components(list(enumerate(texts)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in similarity_join.linked(df).collect()} == want
    assert len({c for _, c in want.values()}) == 2


def test_components_of_a_long_path(spark):
    df = spark.range(300).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(900, 901), (901, 900)], "a long, b long"))
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 900: 900, 901: 900}


def test_language_id(docs, none):
    prototypes = langid.train(docs, held_out_fold=None)
    out = langid.identify(docs, prototypes)
    assert out.columns == [*docs.columns, "langid_"]
    got = {r.doc_id: r.langid_ for r in out.collect()}
    assert [got[i].lang for i in (1, 2, 3)] == ["und"] * 3 and got[8].lang in ("en", "fr")
    assert langid.train(none) == {} and langid.identify(none, prototypes).count() == 0
    assert {r.langid_.lang for r in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.keep_known(docs, prototypes).columns == docs.columns


def test_mixing(spark, docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(r.copies >= 0 for r in got)
    assert len({r.copies for r in got if r.doc_id == 5}) == 1
    assert mixing.mix(none).count() == 0
    assert mixing.solve([100.0], 100.0) == 1.0
    a = mixing.solve([900.0, 90.0, 10.0], 1000.0, 0.95, 100.0)
    assert abs(mixing.entropy(mixing.tempered([900.0, 90.0, 10.0], a)) - 0.95 * np.log(3)) < 1e-6
    b = mixing.solve([900.0, 90.0, 10.0], 1000.0, 0.95, 4.0)
    assert b > a and abs(mixing.passes([900.0, 90.0, 10.0], b, 1000.0) - 4) < 1e-6


def test_html_extraction(spark):
    rows = [(1, None), (2, ""), (3, "plain & simple"), (4, "<article><p>A&amp;B &lt;c&gt;<br>d<p>e"), (5, "<article><p>cut <b"),
            (6, "<nav>menu</nav><article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>"),
            (7, "<article><p>" + "<" * 20_000), (8, "<script>x</script><article>y<!-- z --></article>")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, html string, main_text string")
    got = {r.page_id: r.main_text_ for r in html_extract.extract(df).collect()}
    assert (got[1], got[2], got[4], got[6], got[8]) == ("", "", "A&B <c> d e", "deep", "y")
    assert got[5].startswith("cut") and html_extract.extract(df.limit(0)).count() == 0


def test_pii(docs, none):
    out = pii.find_pii(docs)
    assert out.columns == [*docs.columns, "pii_"]
    got = {r.doc_id: r.pii_ for r in out.collect()}
    assert got[7].n_phone == 1 and got[1].spans == got[2].spans == got[6].spans == ""
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[1] is None and clean[2] == "" and clean[7].endswith("12 <phone>") and clean[4] == LONG
    assert pii.find_pii(none).count() == 0
    assert pii.base_spans("a@b.c_d@e.f") == [("email", 0, 5), ("email", 5, 11)]
    assert pii.base_spans("1" * 50_000) == [] and pii.base_spans("1.2.3.4.5.6.7.8") == [("ip", 0, 7), ("ip", 8, 15)]
    assert pii.base_spans("256.1.1.1") == []
    for text in ("9" * 5000 + ".1.1.1", "1.1.1." + "9" * 5000, "1." + "9" * 5000 + ".1.1", "+" + "1" * 9000, "1 " * 9000, "(212) " * 3000):
        found = pii.crf_spans([text], pii.trained())[0]
        assert all(k in pii.MORE or k in pii.KINDS for k, *_ in pii.added_spans(text, pii.base_spans(text), found))


def test_pii_added_spans():
    def added(text):
        base = pii.base_spans(text)
        return {(k, text[a:b]) for k, a, b in pii.added_spans(text, base, pii.crf_spans([text], pii.trained())[0])}

    assert added("you can call (212) 555-1234 today") == {("phone", "(212) 555-1234")}
    assert added("his number is 078-05-1120 on file") == {("ssn", "078-05-1120")}
    key = "a94a8fe5ccb19ba61c4c0873d391e987982fbbd3"
    assert added(f'secret = "{key}"') == {("secret", key)}
    for text in (f"commit {key} broke it", key, f"checksum {key} is right", "in the years (1999) and 2001-2005"):
        assert added(text) == set()


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(1)
    emit, moves = rng.normal(size=(9, 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
    sizes = np.array([4, 1, 4])
    got, at = pii.viterbi(emit, sizes, moves), 0
    for n in sizes:
        e = emit[at : at + n]
        best = max(itertools.product(range(3), repeat=int(n)), key=lambda p: sum(e[i, y] for i, y in enumerate(p)) + sum(
            moves[a, b] for a, b in itertools.pairwise(p)))
        assert got[at : at + n].tolist() == list(best)
        at += n
