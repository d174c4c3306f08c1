"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: every turn is
``<|turn|>role<|text|>text<|end|>``. Control strings (the marks, and those of
other templates) inside roles and texts are escaped with backslashes, and can
be read back exactly. The rendered string is encoded once, with offsets; the
marks are tokens of their own, so no token crosses from a mark into a text.
The loss mask marks the tokens that meet an assistant text: both the turn
spans and the token spans are sorted, and binary search finds each turn's
first and last token.

Rows are ordered by turn, then role, then text; a null role or text is empty,
a null id is a conversation like any other. Repeated rows are turns like any
other. One conversation is one row of output, so its turns meet in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Kept

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LOSS_ROLE = "assistant"

_CONTROL = re.compile(r"\\|<\|[^|<>]*\|>|</?s>|\[/?INST\]|<</?SYS>>")
_TURNS = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)

RESULT = ("formatted string, input_ids array<int>, token_starts array<int>, token_ends array<int>, "
          "loss_mask array<boolean>")


def escape(text: str | None) -> str:
    """A backslash after the first character of every control string, and
    after every backslash."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text or "")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def render(turns: list[tuple[str | None, str | None]], loss_role: str = LOSS_ROLE) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string, and the spans of the texts that bear loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == loss_role and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns read back from a formatted string."""
    return [(unescape(r), unescape(t)) for r, t in _TURNS.findall(formatted)]


def loss_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """All text under the mask, read back from the token offsets."""
    parts = []
    at = -1
    for a, b in zip(starts[mask].tolist(), ends[mask].tolist(), strict=True):
        a = max(a, at)  # tokens that share a character
        if b > a:
            parts.append((at == a, formatted[a:b]))
            at = b
    runs: list[list[str]] = []
    for joins, piece in parts:
        if joins and runs:
            runs[-1].append(piece)
        else:
            runs.append([piece])
    return "".join(unescape("".join(r)) for r in runs)


def _tokenizer_file(path: str):
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in (TURN, TEXT, END)])
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


load_tokenizer = Kept(_tokenizer_file)


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens meet a span. Token starts and ends are sorted."""
    mask = np.zeros(len(starts), dtype=bool)
    if spans:
        s = np.array(spans)
        first = np.searchsorted(ends, s[:, 0], side="right")
        last = np.searchsorted(starts, s[:, 1], side="left")
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            mask[a:b] = True
    return mask


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", tokenizer: str = TOKENIZER, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per conversation: the id, and a struct ``chat`` of formatted,
    input_ids, token_starts, token_ends and loss_mask."""
    turns = rows.select(F.col(id_col).alias("id"), F.struct(F.col(turn_col).alias("n"), F.col(role_col).alias("r"),
                                                            F.col(text_col).alias("t")).alias("x"))
    turns = turns.groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("turns"))

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = load_tokenizer(tokenizer)
        for convs in batches:
            out = []
            for k in range(0, len(convs), 64):
                done = [render([(x["r"], x["t"]) for x in c], loss_role) for c in convs[k : k + 64]]
                for (text, spans), e in zip(done, t.encode_batch([f for f, _ in done], add_special_tokens=False), strict=True):
                    at = np.array(e.offsets, dtype=np.int32).reshape(-1, 2)
                    out.append((text, e.ids, at[:, 0], at[:, 1], loss_mask(at[:, 0], at[:, 1], spans)))
            yield pd.DataFrame(out, columns=["formatted", "input_ids", "token_starts", "token_ends", "loss_mask"])

    return turns.select(F.col("id").alias(id_col), run("turns").alias("chat"))


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def read_back(chat: str) -> Column:
    """Figures of the output struct ``chat`` alone: turns parsed from the
    formatted string, loss text taken from the offsets under the mask."""
    return F.pandas_udf(_digests, DIGEST)(chat)


def _digests(chat: pd.DataFrame) -> pd.DataFrame:
    out = []
    for f, starts, ends, mask in zip(chat["formatted"], chat["token_starts"], chat["token_ends"], chat["loss_mask"], strict=True):
        turns = parse(f)
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = loss_text(f, np.asarray(starts, dtype=np.int64), np.asarray(ends, dtype=np.int64), np.asarray(mask, dtype=bool))
        sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (said, loss)]
        out.append((len(turns), sha[0], len(loss), sha[1], len(f), len(mask)))
    return pd.DataFrame(out, columns=[c.split()[0] for c in DIGEST.split(", ")])
