"""Weight-file headers without reading the weights.

``binaryFile.content`` would load whole files, so the listing (path and size
only) is spread over tasks and each task opens its files and reads just the
first bytes: 8 bytes plus the JSON header of a ``.safetensors`` file, 4 bytes
of a ``.bin`` file. A header is parsed as it is read, twice: once to the end,
so that nothing of a broken one is used, and once for its tensors, which leave
the task as rows. A task holds a window of the text and a hash a tensor name,
never a header. Local paths are opened directly; other schemes go through
``pyarrow.fs``.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneframe import constants as K
from tuneframe.sources.files import file_listing

#: One row a file (``name`` null) and one for each tensor its header declares.
HEAD_SCHEMA = ("path string, size bigint, header_len bigint, magic binary, read_error string, header_ok boolean, "
               "tensors bigint, name string, off_begin bigint, off_end bigint, shape array<bigint>")
_HEAD_COLUMNS = [c.split()[0] for c in HEAD_SCHEMA.split(", ")]

#: Bytes read at a time, and rows handed over at a time.
CHUNK = 1 << 20
HEAD_ROWS = 10_000
METADATA = "__metadata__"
_BLANK = re.compile(r"[ \t\n\r]*")


def _open(uri: str):
    if uri.startswith("file:"):
        return open("/" + uri[5:].lstrip("/"), "rb")
    import pyarrow.fs as pafs
    fs, p = pafs.FileSystem.from_uri(quote(uri, safe="/:@"))
    return fs.open_input_file(p)


def header_entries(fh, length: int, chunk: int = CHUNK) -> Iterator[tuple[str, object]]:
    """The members of a JSON object of ``length`` bytes, one after the other as
    the file is read. ValueError (also for broken UTF-8) unless the bytes are
    one JSON object by the rules of ``json.loads``."""
    decoder, text = json.JSONDecoder(), codecs.getincrementaldecoder("utf-8")()
    window, at, left = "", 0, length

    def more() -> bool:
        nonlocal window, at, left
        if not left:
            return False
        got = fh.read(min(max(chunk, len(window) - at), left))
        if not got:
            raise ValueError("the file ends inside its header")
        left -= len(got)
        window, at = window[at:] + text.decode(got, final=not left), 0
        return True

    def mark() -> str:
        """The next character that is no white space."""
        nonlocal at
        while True:
            at = _BLANK.match(window, at).end()
            if at < len(window):
                return window[at]
            if not more():
                raise ValueError("the header ends early")

    def value() -> object:
        nonlocal at
        while True:
            try:
                found, end = decoder.raw_decode(window, at)
                # A number at the window's end may go on behind it ("1" of "1e+9").
                if end + 3 < len(window) or not more():
                    at = end
                    return found
            except json.JSONDecodeError:
                if not more():
                    raise

    if mark() != "{":
        raise ValueError("the header is no object")
    at += 1
    if mark() == "}":
        at += 1
    else:
        while True:
            if mark() != '"':
                raise ValueError("a member has no name")
            name = value()
            if mark() != ":":
                raise ValueError("a member has no value")
            at += 1
            mark()
            yield name, value()
            sep = mark()
            at += 1
            if sep == "}":
                break
            if sep != ",":
                raise ValueError("members are not parted by commas")
    while True:
        at = _BLANK.match(window, at).end()
        if at < len(window):
            raise ValueError("text behind the header")
        if not more():
            return


def _whole(x) -> int | None:
    return x if isinstance(x, int) and not isinstance(x, bool) and -(1 << 63) <= x < 1 << 63 else None


def _tensor(entry) -> tuple:
    """Offsets and shape, null where they are not a list of two integers, or of integers."""
    entry = entry if isinstance(entry, dict) else {}
    offsets, shape = entry.get("data_offsets"), entry.get("shape")
    begin, end = (_whole(x) for x in offsets) if isinstance(offsets, list) and len(offsets) == 2 else (None, None)
    whole = isinstance(shape, list) and all(_whole(x) is not None for x in shape)
    return begin, end, shape if whole else None


def _rows_of(path: str, size: int, max_header: int) -> Iterator[tuple]:
    """The file's tensors, then the file itself. Of equal names the last one
    counts, as in a dictionary."""
    header_len = magic = error = ok = None
    tensors = 0
    try:
        with _open(path) as fh:
            if not path.lower().endswith(".safetensors"):
                magic = fh.read(4)
            elif len(head := fh.read(8)) == 8:
                header_len = int.from_bytes(head, "little")
                if 0 < header_len <= min(size - 8, max_header):
                    seen: dict[int, int] = {}
                    try:
                        for i, (name, _) in enumerate(header_entries(fh, header_len)):
                            seen[hash(name)] = i
                        ok = True
                    except (ValueError, RecursionError):
                        ok = False
                    if ok:
                        fh.seek(8)
                        for i, (name, entry) in enumerate(header_entries(fh, header_len)):
                            if name != METADATA and seen[hash(name)] == i:
                                tensors += 1
                                yield path, size, header_len, None, None, None, None, name, *_tensor(entry)
    except OSError as e:
        error = type(e).__name__
    yield path, size, min(header_len, (1 << 63) - 1) if header_len is not None else None, magic, error, ok, tensors, *[None] * 4


def read_weight_heads(spark: SparkSession, root: str, max_header: int = K.SAFETENSORS_MAX_HEADER) -> DataFrame:
    """``HEAD_SCHEMA`` rows of every ``.safetensors``/``.bin`` file under
    ``root``: the file's, and one for each tensor of a readable header."""
    listing = file_listing(spark, root, recursive=True).select("path", "length")
    name = F.lower(F.col("path"))
    weights = listing.where(name.endswith(".safetensors") | name.endswith(".bin"))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        rows: list[tuple] = []
        for pdf in batches:
            for path, size in zip(pdf["path"], pdf["length"], strict=True):
                for row in _rows_of(path, int(size), max_header):
                    rows.append(row)
                    if len(rows) >= HEAD_ROWS:
                        yield pd.DataFrame(rows, columns=_HEAD_COLUMNS).astype(object)
                        rows = []
        yield pd.DataFrame(rows, columns=_HEAD_COLUMNS).astype(object)

    return weights.mapInPandas(run, HEAD_SCHEMA)


def header_problems(heads: DataFrame) -> DataFrame:
    """File-level verdict per weight file (A8/A9 order): ``empty``,
    ``unreadable``, ``header_missing``, ``header_length``, ``header_json``,
    ``no_tensors``, ``bad_magic``, else null."""
    is_st = F.lower(F.col("path")).endswith(".safetensors")
    magic_ok = F.coalesce(F.col("magic").startswith(F.lit(K.BIN_MAGICS[0])) | F.col("magic").startswith(F.lit(K.BIN_MAGICS[1])),
                          F.lit(False))
    problem = (F.when(F.col("size") == 0, "empty")
               .when(F.col("read_error").isNotNull(), "unreadable")
               .when(is_st & F.col("header_len").isNull(), "header_missing")
               .when(is_st & F.col("header_ok").isNull(), "header_length")
               .when(is_st & ~F.col("header_ok"), "header_json")
               .when(is_st & (F.col("tensors") == 0), "no_tensors")
               .when(~is_st & ~magic_ok, "bad_magic"))
    return heads.where(F.col("name").isNull()).select("path", "size", "header_len", "magic", "read_error", "tensors",
                                                      problem.alias("problem"))


def tensor_rows(heads: DataFrame) -> DataFrame:
    """One row per declared tensor of each readable header: ``path,
    data_size, name, off_begin, off_end, shape`` (nulls where a field is not
    what it must be: a list of two integers, a list of integers). Booleans
    are rejected as integers."""
    return heads.where(F.col("name").isNotNull()).select(
        "path", (F.col("size") - 8 - F.col("header_len")).alias("data_size"), "name", "off_begin", "off_end", "shape")
