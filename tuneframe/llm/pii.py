"""Personal data: exact base patterns, and a linear-chain CRF for the rest.

The base finds e-mail addresses, IP addresses, card and phone numbers by the
patterns below, leftmost and non-overlapping per kind. The conditional random
field labels white-space tokens from word-shape features of the token and its
neighbours; it is trained here on a small labelled table and decoded by
Viterbi over many lines at once in numpy. Its spans are added where they touch
no base span: secrets (``token = "..."``; a bare hexadecimal run such as a
commit's name is none), phone numbers in forms that the base lacks
(``(212) 555-1234``) and social security numbers.

Null and empty texts have no spans. Offsets are code points, end exclusive.
Repeated rows get equal results. Long tokens and lines are handled in linear
time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Kept, code_points, fresh, text_steps

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the added spans beside these.
MORE = ("secret", "ssn")
LABELS = ("O", *KINDS, *MORE)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Digit groups are taken whole: a match can only start where a group starts,
# so a long run of digits is passed once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _byte(digits: str) -> bool:
    """At most 255, however many digits there are."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Base matches by kind, then start."""
    out: list[tuple[str, int, int]] = []
    if not text:
        return out
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(map(_byte, m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15:
                out.append(("phone", *m.span()))
    return out


# ---------------------------------------------------------------- features

#: Tokens are split by ASCII white space.
_TOKEN = re.compile(WORD)
_EDGE = "\"'`.,;:!?#*$%&|<>()[]{}"
_SECRET_NAMES = frozenset(("token", "secret", "password", "passwd", "key", "api_key", "apikey", "access_token", "pwd"))


def _feature_names() -> list[str]:
    return ["bias", "letters", "digits", "mixed", "upper", "title", "punct_only", "has_at", "has_dots3", "has_plus",
            "paren_digits", "dash_digits", "quote", "equals", "secret_name", "hex", "len1", "len2_4", "len5_8",
            "len9_15", "len16_24", "len25+", "digits1_3", "digits4_8", "digits9_12", "digits13+", "colon", "slash",
            "other_script", "ssn", "area", "local"]


_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_AREA = re.compile(r"\([0-9]{3}\)$")
_NATIONAL = re.compile(r"\([0-9]{3}\)[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}")
_LOCAL_PART = re.compile(r"[0-9]{3}[-.][0-9]{4}")


def _token_shape(token: str) -> list[float]:
    """Word-shape features of one token."""
    core = token.strip(_EDGE)
    digits = sum(c.isdigit() for c in core)
    letters = sum(c.isalpha() for c in core)
    n = len(core)
    name = core.lower().rstrip("=:").strip()
    return [float(bool(x)) for x in (
        True, letters == n > 0, digits == n > 0, letters and digits, core.isupper(), core.istitle(), n == 0,
        "@" in core[1:-1], core.count(".") == 3 and digits >= 4, token.startswith("+"),
        token.startswith("(") and digits, "-" in core and digits, token[:1] in "\"'`" and n > 0, "=" in token,
        name in _SECRET_NAMES, n >= 16 and digits and all(c in "0123456789abcdefABCDEF" for c in core),
        n == 1, 2 <= n <= 4, 5 <= n <= 8, 9 <= n <= 15, 16 <= n <= 24, n >= 25,
        1 <= digits <= 3, 4 <= digits <= 8, 9 <= digits <= 12, digits >= 13, ":" in core, "/" in core,
        not core.isascii(), _SSN.fullmatch(core), _AREA.match(token), _LOCAL_PART.fullmatch(core))]


token_features = Kept(_token_shape, 100_000)


_HEX_RUN = re.compile(rb"[0-9a-f]{16}")


def special(text: str) -> bool:
    """Whether a token may need more than its shape: a secret's name or a long
    hexadecimal run. In other texts no token has those features."""
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(x in low for x in (b"token", b"secret", b"passw", b"key", b"pwd")):
        return True
    return _DIGIT.search(text) is not None and _HEX_RUN.search(low) is not None


def _shape_table() -> np.ndarray:
    """Of every code point a Latin-1 one with the same features: letters by
    case and script, digits, ASCII marks and white space as they are."""
    out = np.full(0x110000, ord("\u00b7"), dtype=np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if c < 128:
            out[c] = ord("a" if x.islower() else "A" if x.isupper() else "9" if x.isdigit() else x)
        elif x.isalpha():
            out[c] = ord("\u00c9" if x.isupper() else "\u00e9")
    return out


_shape_of = Kept(_shape_table)


def shape_lines(text: str, exact: bool) -> list[list[bytes]]:
    """The tokens' shapes line by line, or the tokens if shapes don't do."""
    if exact:
        raw = text.encode("utf-8", "surrogatepass")
        return [x.split() for x in raw.split(b"\n")]
    return [x.split() for x in _shape_of()[code_points(text)].tobytes().split(b"\n")]


# ---------------------------------------------------------- training table


def labelled_lines() -> list[list[tuple[str, str]]]:
    """The small labelled table: (token, label) lines made from a few
    carriers and personal-data forms by a fixed rule. Numbers and hexadecimal
    runs that are no personal data stand beside them."""
    rng = np.random.default_rng(23)
    carriers = ["please send the notes to {} before noon.", "The server at {} did not answer", "call {} , or write again",
                "Paid with card {} last week.", "token = {} was left in the file", "Set api_key = {} and run it",
                "{} is what we have on record", "see line 42 of chapter 7 , then {}", "les données de {} sont là",
                "password: {} must change", "Der Wert {} steht im Text", "secret = {}", "ONLY!! CAPS!! {} HERE!!",
                "a | b | {} | c", "text~~~ with... marks??? {} and;;; more:::", "His number is {} since May", "file under {} please"]
    plain = ["the report of 2019 covers 3.5 million people , in 12 towns.", "Licensed under the Apache License, Version 2.0.",
             "GNU General Public License, version 3.", "la maison est grande ; il y a 4 pièces", "Die Straße ist lang.",
             "He scored 1,204 points ( 98% ) in 2020-21", "key ideas and the token of thanks = kindness", "x = y + 10",
             "\"quoted words\" are fine", "THE WHOLE LINE SHOUTS!!", "what### is&&& this%%% noise***", "a | few | words",
             "order 66 and room 101", "ISBN 978-3-16 is partial", "the secret garden has a door", "word " * 12,
             "between 1914-18 and (1939) the river rose 2-3 metres", "part 12-345-67 of set (204) fits", "see 555-1234 in the index"]
    # Hexadecimal runs that name a thing rather than open one.
    names = ["commit {} mends the build", "merged as {} into main", "checksum {} matches the file", "{}  archive.tar", "sha256:{}",
             "etag {} was sent", "the blob {} is gone", "build {} of branch main", "revert {}", "{}"]

    def digits(n: int) -> str:
        return "".join(str(x) for x in rng.integers(0, 10, n))

    def hexadecimal(low: int, high: int) -> str:
        return "".join("0123456789abcdef"[x] for x in rng.integers(0, 16, int(rng.integers(low, high))))

    def value(kind: str) -> str:
        if kind == "email":
            return f"user.{digits(2)}@mail{digits(1)}.example.com"
        if kind == "ip":
            return ".".join(str(x) for x in rng.integers(1, 256, 4))
        if kind == "card":
            return digits(16) if rng.random() < 0.6 else " ".join(digits(4) for _ in range(4))
        if kind == "phone":
            return (f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)} {digits(4)}",
                    f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}", f"+{digits(2)}-{digits(3)}-{digits(7)}")[int(rng.integers(0, 5))]
        if kind == "ssn":
            return f"{digits(3)}-{digits(2)}-{digits(4)}"
        return '"' + hexadecimal(24, 48) + '"'

    fits = {"secret": (4, 5, 9, 11), "email": (0, 2, 6, 7, 8, 12, 13, 14), "ip": (1, 6, 7, 8, 10, 12, 13, 14),
            "card": (3, 6, 7, 8, 10, 12, 13, 14), "phone": (2, 6, 7, 8, 10, 12, 13, 14, 15), "ssn": (6, 7, 8, 10, 13, 15, 16)}
    lines = []
    for kind, places in fits.items():
        for i in places:
            for _ in range(4 if kind == "phone" else 3):
                left, _, right = carriers[i].partition("{}")
                mark = ("", "", ";;;", "!!", "...", "??")[int(rng.integers(0, 6))]
                lines.append([(t, "O") for t in left.split()] + [(t, kind) for t in (value(kind) + mark).split()]
                             + [(t, "O") for t in right.split()])
    for x in names:
        for low, high in ((16, 20), (32, 33), (40, 41), (64, 65)):
            plain.append(x.replace("{}", hexadecimal(low, high)))
    return lines + [[(t, "O") for t in x.split()] for x in plain for _ in range(3 if "{" not in x else 1)]


# ------------------------------------------------------------------- model


class Crf:
    """Emission weights for the token, the one before and the one after, and
    label transitions."""

    def __init__(self, here: np.ndarray, before: np.ndarray, after: np.ndarray, moves: np.ndarray):
        self.here, self.before, self.after, self.moves = here, before, after, moves

    def emissions(self, feats: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = feats @ self.here
        out[1:] += np.where(first[1:, None], 0, feats[:-1] @ self.before)
        out[:-1] += np.where(last[:-1, None], 0, feats[1:] @ self.after)
        return out


def viterbi(emit: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of many lines at once. ``emit`` holds the lines' tokens one
    line after another; step t handles every line longer than t."""
    n_labels = emit.shape[1]
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    best = np.zeros((len(emit), n_labels), dtype=np.int8)
    score = emit[starts].copy() if len(starts) else emit[:0]
    active = len(sizes)
    longest = int(sizes[0]) if active else 0
    finals = np.zeros(len(sizes), dtype=np.int8)
    live = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")  # lines of at least t + 1 tokens
    for t in range(1, longest):
        k = int(live[t])
        if k < active:
            finals[k:active] = score[k:active].argmax(axis=1)
            active = k
        at = starts[:k] + t
        options = score[:k, :, None] + moves[None]
        came = options.argmax(axis=1)
        best[at] = came
        score = np.take_along_axis(options, came[:, None, :], axis=1)[:, 0, :] + emit[at]
    finals[:active] = score[:active].argmax(axis=1) if active else []
    out = np.zeros(len(emit), dtype=np.int8)
    label = finals.copy()
    for t in range(longest - 1, -1, -1):
        k = int(live[t])
        at = starts[:k] + t
        out[at] = label[:k]
        if t:
            label[:k] = best[at, label[:k]]
    return out


def _fitted() -> Crf:
    """Maximum likelihood with L2, by gradient ascent (Adam) over the whole
    small table; forward and backward sums are exact."""
    lines = [x for x in labelled_lines() if x]
    n_f, n_y, longest = len(_feature_names()), len(LABELS), max(map(len, lines))
    x = np.zeros((len(lines), longest, n_f))
    y = np.zeros((len(lines), longest), dtype=np.int64)
    real = np.zeros((len(lines), longest), dtype=bool)
    for i, line in enumerate(lines):
        for t, (token, label) in enumerate(line):
            x[i, t], y[i, t], real[i, t] = token_features(token), LABELS.index(label), True
    prev, succ = np.zeros_like(x), np.zeros_like(x)
    prev[:, 1:], succ[:, :-1] = x[:, :-1], x[:, 1:]
    succ[:, :-1][~real[:, 1:]] = 0
    full = np.concatenate([x, prev, succ], axis=2)
    onehot = np.eye(n_y)[y] * real[:, :, None]
    pair_real = real[:, 1:] & real[:, :-1]
    gold_pairs = np.einsum("nta,ntb->ab", onehot[:, :-1] * pair_real[:, :, None], onehot[:, 1:])
    w, m = np.zeros((3 * n_f, n_y)), np.zeros((n_y, n_y))
    mom = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(m), np.zeros_like(m)]

    def lse(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, 181):
        e = full @ w
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for t in range(1, longest):
            new = lse(fwd[:, t - 1, :, None] + m, 1) + e[:, t]
            fwd[:, t] = np.where(real[:, t, None], new, fwd[:, t - 1])
        z = lse(fwd[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            back = lse(m[None] + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(real[:, t + 1, None], back, 0)
        marg = np.exp(fwd + bwd - z[:, None, None]) * real[:, :, None]
        pair = np.exp(fwd[:, :-1, :, None] + m + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]) * pair_real[:, :, None, None]
        grads = (np.einsum("ntf,nty->fy", full, onehot - marg) - 0.05 * w, gold_pairs - pair.sum(axis=(0, 1)) - 0.05 * m)
        for p, g, a, b in ((w, grads[0], mom[0], mom[1]), (m, grads[1], mom[2], mom[3])):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    f32 = np.float32
    return Crf(w[:n_f].astype(f32), w[n_f : 2 * n_f].astype(f32), w[2 * n_f :].astype(f32), m.astype(f32))


trained = Kept(_fitted)


def crf_spans(texts: list[str], model: Crf) -> list[list[tuple[str, int, int]]]:
    """Spans of the labelled tokens of each text; equal neighbours in a line join."""
    lines, owner = [], []
    rows: dict[str, dict[bytes, int]] = {}
    feats_of: list[list[float]] = []
    ids: list[int] = []
    for i, text in enumerate(texts):
        exact = special(text)
        code = "utf-8" if exact else "latin-1"
        known = rows.setdefault(code, {})
        for n, tokens in enumerate(shape_lines(text, exact)):
            if not tokens:
                continue
            lines.append((n, len(tokens)))
            owner.append(i)
            for t in set(tokens).difference(known):
                known[t] = len(feats_of)
                feats_of.append(token_features(t.decode(code, "replace")))
            ids += map(known.__getitem__, tokens)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not lines:
        return out
    sizes = np.fromiter((k for _, k in lines), dtype=np.int64, count=len(lines))
    ids = np.array(ids, dtype=np.int64)
    feats = np.array(feats_of, dtype=np.float32)
    here, before, after = feats @ model.here, feats @ model.before, feats @ model.after
    emit = here[ids]
    starts = np.cumsum(sizes) - sizes
    inner = np.ones(len(ids), dtype=bool)
    inner[starts] = False
    inside = np.flatnonzero(inner)
    emit[inside] += before[ids[inside - 1]]
    emit[inside - 1] += after[ids[inside]]
    # Where O leads every token of a line by twice what moves can gain, all O is the best path.
    gain = float(model.moves.max() - model.moves[0, 0])
    lead = np.minimum.reduceat(emit[:, 0] - emit[:, 1:].max(axis=1), starts)
    open_lines = np.flatnonzero(lead < 2 * gain)
    if not open_lines.size:
        return out
    chosen = np.concatenate([np.arange(starts[k], starts[k] + sizes[k]) for k in open_lines])
    labels = viterbi(emit[chosen], sizes[open_lines], model.moves)
    at = 0
    for k in open_lines:
        got = labels[at : at + sizes[k]]
        at += sizes[k]
        if got.any():
            out[owner[k]] += _line_spans(texts[owner[k]], lines[k][0], got)
    return out


def _line_spans(text: str, line_no: int, labels: np.ndarray) -> list[tuple[str, int, int]]:
    at = 0
    for _ in range(line_no):
        at = text.index("\n", at) + 1
    end = text.find("\n", at)
    out: list[tuple[str, int, int]] = []
    last = 0
    for label, m in zip(labels, _TOKEN.finditer(text, at, len(text) if end < 0 else end), strict=True):
        if label and label == last:
            out[-1] = (out[-1][0], out[-1][1], m.end())
        elif label:
            out.append((LABELS[label], m.start(), m.end()))
        last = label
    return out


def plausible(kind: str, value: str) -> bool:
    """Whether a value of a base kind passes that kind's own checks."""
    digits = "".join(_DIGITS.findall(value))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return (value[:1] == "+" or _NATIONAL.fullmatch(value) is not None) and 9 <= len(digits) <= 15
    if kind == "ip":
        return _IP.fullmatch(value) is not None and all(map(_byte, value.split(".")))
    if kind == "ssn":
        return _SSN.fullmatch(value) is not None
    return kind != "email" or "@" in value[1:-1]


def added_spans(text: str, base: list[tuple[str, int, int]], found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """CRF spans without edge marks, where they touch no base span; of the
    base kinds only those that pass the kind's checks (a number that fails
    Luhn is no card)."""
    out = []
    for kind, a, b in found:
        core = text[a:b]
        b = a + len(core.rstrip(_EDGE))
        a += len(core) - len(core.lstrip(_EDGE if kind != "phone" else _EDGE.replace("(", "")))
        if a < b and plausible(kind, text[a:b]) and not any(a < y and x < b for _, x, y in base):
            out.append((kind, a, b))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate((*KINDS, *MORE))}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span replaced by its kind in angle brackets; where
    spans overlap, the union gets the first one's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, clean string"


def _finder(spark, with_text: bool):
    shared = spark.sparkContext.broadcast(vars(trained()))  # plain arrays: workers need no install

    @F.pandas_udf(RESULT)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Crf(**shared.value)
        for texts in batches:
            out = []
            for step in text_steps(texts):
                for t, found in zip(step, crf_spans(step, model), strict=True):
                    base = base_spans(t)
                    every = base + added_spans(t, base, found)
                    count = [sum(k == x for k, _, _ in base) for x in KINDS]
                    out.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every),
                                redacted(t, every) if with_text else None))
            yield pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "clean"])

    return find


def find_pii(docs: DataFrame, text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``docs`` with a struct column ``pii`` (or a longer free name); ``clean``
    is the redacted text if ``with_text``, else null."""
    return docs.withColumn(fresh(docs, "pii"), _finder(docs.sparkSession, with_text)(F.col(text_col)))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; null stays null."""
    name, out = fresh(docs, "pii"), find_pii(docs, text_col, with_text=True)
    return out.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.col(f"{name}.clean"))).drop(name)
