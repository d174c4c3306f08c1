"""Every registered query over its whole table, against plain brute force."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import pytest

BLANK = r"[^\x20\x09-\x0D]+"
LOWER = {65 + i: 97 + i for i in range(26)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1_base_figures(rows, given):
    want = {}
    for d in given("documents"):
        t = d["text"] or ""
        w = re.findall(BLANK, t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(BLANK, line):
                dup += line in seen
                seen.add(line)
        count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        want[d["doc_id"]] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit),
                             len(w) < 50 or 100 * len(hit) > 50 * len(w))
    got = rows("op1_quality_rules")
    assert {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                          r["base_failed"]) for r in got} == want
    assert len(got) == len(given("documents"))
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_op1_verdict_follows_labels(rows, given):
    quality = {r["doc_id"]: r["quality"] for r in given("labels")}
    judged = [(r["kept"], quality[r["doc_id"]]) for r in rows("op1_quality_rules")
              if r["doc_id"] in quality and not r["base_failed"]]
    assert sum(k == bool(q) for k, q in judged) >= 0.9 * len(judged)


def test_op2_held_out_quality(rows, given):
    from tuneframe.llm.common import rank_auc
    import numpy as np

    got = {r["doc_id"]: r for r in rows("op2_quality_classifier")}
    assert len(got) == len(given("documents"))
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    pairs = [(got[x["doc_id"]]["score"], x["quality"]) for x in given("labels") if got[x["doc_id"]]["held_out"]]
    assert rank_auc(np.array([p for p, _ in pairs]), np.array([q for _, q in pairs])) > 0.9


def test_op3_rules_and_parts(rows, given):
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    got = {r["page_id"]: r for r in rows("op3_url_filter")}
    for p in given("pages"):
        rest = (p["url"] or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = host.translate(LOWER)
        fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0]))
                and path.startswith(r[r.index("/"):])]
        rule = max(fits, key=len, default=None)
        r = got.pop(p["page_id"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == rules.get(rule, r["verdict"]) and r["verdict"] in ("allow", "block")
    assert not got


def test_op3_plan_is_native(spark, sf):
    from tuneframe.llm.queries import QUERIES

    plan = QUERIES["op3_url_filter"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_windows(docs, items, window=10):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    patterns = {}
    for item, text in items:
        w = re.findall(word, (text or "").translate(LOWER))
        for i in range(max(len(w) - window + 1, 1) if w else 0):
            patterns.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    sizes = {len(p) for p in patterns}
    for doc, text in docs:
        w = re.findall(word, (text or "").translate(LOWER))
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (ids := patterns.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    found |= ids
        yield doc, (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))


def test_op4_against_brute_force(rows, given):
    want = dict(brute_windows([(d["doc_id"], d["text"]) for d in given("documents")],
                              [(b["item_id"], b["text"]) for b in given("benchmark")]))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])
           for r in rows("op4_decontamination")}
    assert got == want
    assert any(x[-1] for x in want.values())


def test_op4_sql(rows, sf):
    from tuneframe.llm.oracles import ORACLES

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(ORACLES["op4_decontamination"])
    names = [c[0] for c in cur.description]
    want = sorted(cur.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in rows("op4_decontamination")) == want


def test_op5_round_trip(rows, given):
    convs = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(given("conversations"), key=lambda r: r["turn"]):
        convs.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in rows("op5_chat_format")}
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))


def brute_components(docs, k=3, percent=90):
    sets = {}
    for doc, text in docs:
        w = re.findall(BLANK, (text or "").translate(LOWER))
        sets[doc] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    where = {}
    for doc, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(doc)
    pairs = {(a, b) for ids in where.values() for a in ids for b in ids if a < b}
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {d: (len(s), top(d)) for d, s in sets.items()}


def test_op6_against_brute_force(rows, given):
    want = brute_components([(d["doc_id"], d["text"]) for d in given("documents")])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows("op6_jaccard_join")}
    assert got == want
    assert any(d != c for d, (_, c) in want.items())


def test_op7_held_out_accuracy(rows, given):
    lang = {d["doc_id"]: d["lang"] for d in given("documents")}
    text = {d["doc_id"]: d["text"] or "" for d in given("documents")}
    got = rows("op7_language_id")
    assert {r["doc_id"] for r in got} == set(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, text[r["doc_id"]]))) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    judged = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"] and lang[r["doc_id"]]]
    assert sum(judged) >= 0.97 * len(judged)


def test_op8_weights_and_budget(rows, given):
    import math

    got = rows("op8_source_mixing")
    assert sorted(r["doc_id"] for r in got) == sorted(d["doc_id"] for d in given("documents"))
    words = {d["doc_id"]: len(re.findall(BLANK, d["text"] or "")) for d in given("documents")}
    assert all(r["n_tokens"] == words[r["doc_id"]] for r in got)
    total, used, weight, longest, have = sum(words.values()), Counter(), {}, Counter(), Counter()
    for r in got:
        used[r["source"]] += r["copies"] * r["n_tokens"]
        have[r["source"]] += r["n_tokens"]
        weight[r["source"]] = r["weight"]
        longest[r["source"]] = max(longest[r["source"]], r["n_tokens"])
    assert abs(sum(weight.values()) - 1) < 1e-9
    for s, w in weight.items():
        assert w * total - longest[s] - 1e-6 <= used[s] <= w * total + 1e-6
        assert w * total <= 4.0 * have[s] + 1e-6
    h = -sum(w * math.log(w) for w in weight.values() if w)
    assert h >= 0.95 * math.log(len(weight)) - 1e-6
    places = {}
    for r in got:
        places.setdefault((r["source"], r["copies"]), []).append(r["place"])
    for (s, c), p in places.items():  # the part of a pass is the first part of the permutation
        if (more := places.get((s, c + 1))) is not None:
            assert max(more) < min(p)


def test_op9_article_text(rows, given):
    import html

    got = {r["page_id"]: r for r in rows("op9_html_extraction")}
    for p in given("pages"):
        m = re.search(r"<article>(.*?)(?:</article>|\Z)", p["html"] or "", re.DOTALL)
        body = re.sub(r"</?(?:h1|p|br)\b[^>]*>", " ", m.group(1)) if m else ""
        want = " ".join(html.unescape(re.sub(r"</?b>", "", body)).split())
        r = got.pop(p["page_id"])
        assert (r["url"], r["text"], r["n_chars"]) == (p["url"], want, len(want))
    assert not got


def luhn(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def brute_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                  if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_op10_base_spans(rows, given):
    got = {r["doc_id"]: r for r in rows("op10_pii")}
    for d in given("documents"):
        base = brute_base(d["text"] or "")
        r = got.pop(d["doc_id"])
        assert r["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [
            sum(x[0] == k for x in base) for k in ("email", "ip", "card", "phone")]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(","))
    assert not got


def test_op10_method_finds_secrets(rows, given):
    text = {d["doc_id"]: d["text"] for d in given("documents")}
    planted = {(d, m.start(1), m.end(1)) for d, t in text.items() for m in re.finditer(r'token = "([0-9a-f]+)"', t or "")}
    found = {(r["doc_id"], int(a), int(b)) for r in rows("op10_pii") for k, a, b in
             (s.split(":") for s in r["spans"].split(",") if s) if k == "secret"}
    assert len(planted & found) >= 0.95 * len(planted)
    assert len(found - planted) <= 0.05 * max(1, len(found)) + 1


@pytest.fixture(scope="module")
def piped(spark, sf, tmp_path_factory):
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("pipeline")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, sf)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert result.columns == docs.columns
        result.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append([r.asDict() for r in docs.collect()])
    return out


def test_pipeline_stages(spark, sf, given, rows, piped):
    docs = {d["doc_id"]: d for d in given("documents")}
    lang, near, bench, clean, mixed = piped
    und = {r["doc_id"] for r in rows("op7_language_id") if r["lang_pred"] == "und"}
    assert {r["doc_id"] for r in lang} <= docs.keys() - und and len(lang) >= len(docs) - len(und) - 2
    components = brute_components([(r["doc_id"], r["text"]) for r in lang], 5, 80)
    assert sorted(r["doc_id"] for r in near) == sorted(d for d, (_, c) in components.items() if c == d)
    leaks = dict(brute_windows([(r["doc_id"], r["text"]) for r in near], [(b["item_id"], b["text"]) for b in given("benchmark")]))
    assert sorted(r["doc_id"] for r in bench) == sorted(d for d, x in leaks.items() if not x[-1])
    assert sorted(r["doc_id"] for r in clean) == sorted(r["doc_id"] for r in bench)
    for r in clean:
        text = docs[r["doc_id"]]["text"]
        assert r["n_chars"] == len(r["text"])
        if not brute_base(text) and "token = " not in text:
            assert r["text"] == text
        assert not any(text[a:b] in r["text"] for k, a, b in brute_base(text) if k in ("email", "card"))
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in clean}
    assert all(r["copies"] > 0 for r in mixed)
