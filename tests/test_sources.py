"""File readers and whole-file dataset validation against expected verdicts."""

import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from tuneframe.operators import validation as V
from tuneframe.sources import files as S
from tuneframe.sources import weights as W

REQ = ("instruction", "input", "output", "workflow", "success_condition")
HEX = "0123456789abcdef" * 2


def rec(**over):
    r = {k: f"{k} value" for k in REQ}
    r.update(over)
    return json.dumps(r)


#: Expected verdicts of the files below, by hand: an error and its line, or
#: record count, missing fields, well-formed, and valid with 3 records.
VERDICTS = {
    "good.jsonl": (3, "", True, True),
    "bom.jsonl": (3, "", True, True),
    "crlf.jsonl": (3, "", True, True),
    "blanks.jsonl": (3, "", True, True),
    "empty.jsonl": (0, "", False, False),
    "twobad.jsonl": ("invalid_json", 2),
    "notobj.jsonl": ("not_object", 3),
    "count.jsonl": (5, "", True, False),
    "nullfield.jsonl": (3, "input,output,success_condition,workflow", False, False),
    "badutf8.jsonl": ("utf8", None),
}


@pytest.fixture(scope="module")
def dataset_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("datasets")
    files = {
        "good.jsonl": "\n".join(rec() for _ in range(3)) + "\n",
        "bom.jsonl": "﻿" + rec() + "\n" + rec() + "\n" + rec(),
        "crlf.jsonl": rec() + "\r\n" + rec() + "\r" + rec() + "\r\n",
        "blanks.jsonl": "\n  \n" + rec() + "\n\t\x0b\x1c　\n" + rec() + "\n \n" + rec() + "\n",
        "empty.jsonl": "",
        "twobad.jsonl": rec() + "\n{bad\n[1]\n",
        "notobj.jsonl": rec() + "\n\n[1, 2]\n{\"a\":\n",
        "count.jsonl": "\n".join(rec() for _ in range(5)),
        "nullfield.jsonl": rec(input=None) + "\n" + json.dumps({"instruction": 1}) + "\n" + rec(),
    }
    for name, body in files.items():
        (d / f"{HEX}_{name}").write_text(body, encoding="utf-8", newline="")
    (d / f"{HEX[:31]}e_badutf8.jsonl").write_bytes(rec().encode() + b"\n" + b'{"a": "\xff\xfe"}\n')
    (d / f"{HEX}_skip.jsonl.part").write_text(rec())
    (d / "notanid_x.jsonl").write_text(rec())
    return d


def test_list_datasets_skips_part_and_bad_ids(spark, dataset_dir):
    names = {r.filename for r in S.list_datasets(spark, str(dataset_dir)).collect()}
    assert "skip.jsonl.part" not in names and "x.jsonl" not in names
    assert {"good.jsonl", "empty.jsonl", "badutf8.jsonl"} <= names


def test_validate_files_matches_python(spark, dataset_dir):
    rows = V.validate_files(spark, str(dataset_dir), REQ, 3).collect()
    assert len(rows) == 10
    for r in rows:
        local = r.file.replace("file://", "").replace("file:", "")
        want = VERDICTS[local.rsplit('_', 1)[1]]
        if isinstance(want[0], str):
            assert (r.error, r.error_line) == want, r.filename
        else:
            assert r.error is None, r.filename
            assert (r.record_count, r.missing_fields, r.schema_valid, r.valid) == want, r.filename


def test_line_numbers_do_not_depend_on_split_size(spark, tmp_path):
    body = "".join(("" if i % 7 == 0 else rec(input=str(i))) + ("\r\n" if i % 3 else "\n") for i in range(1, 400))
    f = tmp_path / f"{HEX}_big.jsonl"
    f.write_text(body, encoding="utf-8", newline="")
    base = {(r.line_no, r.line) for r in S.read_lines(spark, str(tmp_path)).collect()}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        split = {(r.line_no, r.line) for r in S.read_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    expected = {(i, line) for i, line in enumerate(body.replace("\r\n", "\n").split("\n")[:-1], start=1)}
    assert base == expected
    assert split == expected


def test_read_job_states_filters_folders_and_ids(spark, tmp_path):
    good, bad_json, mismatch = "a" * 32, "b" * 32, "c" * 32
    for folder, body in [(good, {"job_id": good, "status": "running", "created_at": 1.5}),
                         (mismatch, {"job_id": "d" * 32, "status": "completed"}),
                         ("not-hex", {"job_id": "not-hex", "status": "queued"})]:
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "job.json").write_text(json.dumps(body, indent=2))
    (tmp_path / bad_json).mkdir()
    (tmp_path / bad_json / "job.json").write_text("{not json")
    rows = S.read_job_states(spark, str(tmp_path)).collect()
    assert [(r.job_id, r.status) for r in rows] == [(good, "running")]


def _safetensors(header: dict | bytes, data: bytes = b"\0" * 64, n_override=None) -> bytes:
    h = header if isinstance(header, bytes) else json.dumps(header).encode()
    n = len(h) if n_override is None else n_override
    return struct.pack("<Q", n) + h + data


def test_weight_headers(spark, tmp_path):
    t = {"dtype": "F32", "shape": [4, 4], "data_offsets": [0, 64]}
    cases = {
        "good.safetensors": _safetensors({"w": t, "__metadata__": {"a": "b"}}),
        "short.safetensors": b"\x01\x02",
        "zero.safetensors": _safetensors(b"", n_override=0),
        "huge.safetensors": _safetensors({"w": t}, n_override=10 ** 9),
        "badjson.safetensors": _safetensors(b"{nope"),
        "meta_only.safetensors": _safetensors({"__metadata__": {}}),
        "bad_offsets.safetensors": _safetensors({"w": dict(t, data_offsets=[8, 4])}),
        "bool_offsets.safetensors": _safetensors({"w": dict(t, data_offsets=[True, 4])}),
        "past_end.safetensors": _safetensors({"w": dict(t, data_offsets=[0, 65])}),
        "bad_shape.safetensors": _safetensors({"w": dict(t, shape=[4, -1])}),
        "zip.bin": b"PK\x03\x04rest",
        "pickle.bin": b"\x80\x02rest",
        "wrong.bin": b"GARBAGE",
        "empty.bin": b"",
    }
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    heads = W.read_weight_heads(spark, str(tmp_path)).cache()
    problems = {r.path.rsplit("/", 1)[-1]: r.problem for r in W.header_problems(heads).collect()}
    assert problems == {
        "good.safetensors": None, "short.safetensors": "header_missing", "zero.safetensors": "header_length",
        "huge.safetensors": "header_length", "badjson.safetensors": "header_json",
        "meta_only.safetensors": "no_tensors", "bad_offsets.safetensors": None, "bool_offsets.safetensors": None,
        "past_end.safetensors": None, "bad_shape.safetensors": None, "zip.bin": None, "pickle.bin": None,
        "wrong.bin": "bad_magic", "empty.bin": "empty"}
    tens = V.check_tensors(W.tensor_rows(heads)).collect()
    by_file = {r.path.rsplit("/", 1)[-1]: r.problem for r in tens}
    assert by_file["good.safetensors"] == "ok"
    assert by_file["bad_offsets.safetensors"] == "end_before_begin"
    assert by_file["bool_offsets.safetensors"] == "bad_offsets"
    assert by_file["past_end.safetensors"] == "end_past_data"
    assert by_file["bad_shape.safetensors"] == "bad_shape"
    assert "meta_only.safetensors" not in by_file


def test_refresh_verdicts_reads_only_new_or_changed_files(spark, tmp_path):
    d = tmp_path / "ds"
    d.mkdir()
    (d / f"{HEX}_one.jsonl").write_text(rec() + "\n")
    (d / f"{HEX[:31]}0_two.jsonl").write_text(rec() + "\n" + rec() + "\n")
    table = str(tmp_path / "verdicts")
    assert V.current_verdicts(spark, str(d), table) is None
    assert V.refresh_verdicts(spark, str(d), table, REQ, 2) == 2
    assert V.refresh_verdicts(spark, str(d), table, REQ, 2) == 0
    (d / f"{HEX}_one.jsonl").write_text(rec() + "\n" + rec() + "\n")
    os.utime(d / f"{HEX}_one.jsonl", (1_800_000_000, 1_800_000_000))
    (d / f"{HEX[:31]}0_two.jsonl").unlink()
    assert V.refresh_verdicts(spark, str(d), table, REQ, 2) == 1
    rows = V.current_verdicts(spark, str(d), table).collect()
    assert [(r.filename, r.record_count, r.valid) for r in rows] == [("one.jsonl", 2, True)]


def test_empty_dataset_folder(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert S.list_datasets(spark, str(tmp_path / "empty")).count() == 0
    assert V.validate_files(spark, str(tmp_path / "empty"), REQ, 3).count() == 0


NAMES = ("with space", "per%20cent", "h#sh", "pl+us", "caf\u00e9 \u540d", "que?ry", "brack[et]")


def test_names_with_special_characters(spark, tmp_path):
    d = tmp_path / "a b%c"
    d.mkdir()
    for i, n in enumerate(NAMES):
        (d / f"{i:032x}_{n}.jsonl").write_text((rec() + "\n") * (i + 1))
    (d / f"{99:032x}_none here.jsonl").write_text("")
    listed = {r.filename: r for r in S.list_datasets(spark, str(d)).collect()}
    assert set(listed) == {f"{n}.jsonl" for n in NAMES} | {"none here.jsonl"}
    assert all((r.size_bytes > 0) == (r.filename != "none here.jsonl") and r.modified for r in listed.values())
    got = {r.filename: (r.error, r.record_count) for r in V.validate_files(spark, str(d), REQ, 1).collect()}
    assert got == {f"{n}.jsonl": (None, i + 1) for i, n in enumerate(NAMES)} | {"none here.jsonl": (None, 0)}
    table = str(tmp_path / "verdicts")
    assert V.refresh_verdicts(spark, str(d), table, REQ, 1) == len(NAMES) + 1
    assert V.refresh_verdicts(spark, str(d), table, REQ, 1) == 0


def test_weights_in_folders_with_special_names(spark, tmp_path):
    t = {"dtype": "F32", "shape": [4, 4], "data_offsets": [0, 64]}
    odd = {"w\"quoted\\name": t, "n": float("nan")}
    for n in NAMES:
        (tmp_path / n).mkdir()
        (tmp_path / n / f"{n} model.safetensors").write_bytes(_safetensors(odd))
    heads = W.header_problems(W.read_weight_heads(spark, str(tmp_path)))
    assert {(r.path.split("/")[-2], r.problem) for r in heads.collect()} == {(n, None) for n in NAMES}
    files = S.list_artifacts(spark, str(tmp_path)).collect()
    assert {r.rel_path for r in files} == {f"{n}/{n} model.safetensors" for n in NAMES}


def test_flat_folder_of_many_files_is_listed_by_many_tasks(spark, tmp_path):
    d = tmp_path / "flat"
    d.mkdir()
    for i in range(20_000):
        (d / f"{i:032x}_set.jsonl").touch()
    (d / "sub").mkdir()
    (d / "sub" / "inner.jsonl").write_text("x")
    listed = S.file_listing(spark, str(d), recursive=False)
    assert sorted(r.path.rsplit("/", 1)[-1] for r in listed.collect()) == sorted(e.name for e in os.scandir(d) if e.is_file())
    per_task = listed.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) == 4 and min(r["count"] for r in per_task) > 4000
    assert S.file_listing(spark, str(d), recursive=True).count() == 20_001


def test_header_is_parsed_as_it_is_read():
    """The members of headers cut into small reads, sound and broken, against json.loads."""
    import io
    import random
    rng = random.Random(3)

    def some(depth=0):
        kind = rng.random()
        if kind < 0.3:
            return rng.choice([1, 1.5, -2, 1e30, 12345678901234567890, True, None, "a\"b\\\u00e9\U0001f600"])
        if depth < 2 and kind < 0.6:
            return [some(depth + 1) for _ in range(rng.randrange(4))]
        return {f"k{i}": some(depth + 1) for i in range(rng.randrange(3))} if depth < 2 else 7

    for _ in range(400):
        data = json.dumps({f"n{rng.randrange(30)}": some() for _ in range(rng.randrange(6))}, ensure_ascii=rng.random() < 0.5).encode()
        if rng.random() < 0.5:
            at = rng.randrange(len(data))
            data = data[:at] + rng.choice([b"", b",", b"}", b"\xff", b"x", b"1", b".", b"e"]) + data[at + rng.randrange(2):]
        try:
            want = json.loads(data.decode())
            want = want if isinstance(want, dict) else None
        except ValueError:
            want = None
        for chunk in (1, 3, 1000):
            try:
                got = dict(W.header_entries(io.BytesIO(data), len(data), chunk))
            except ValueError:
                got = None
            assert repr(got) == repr(want), data


def test_large_header_in_a_small_worker(tmp_path):
    """60 MiB of header in an interpreter that may take 1 GB."""
    import subprocess
    import sys
    one = '"model.layers.{:07d}.weight": {{"dtype": "F32", "shape": [1, 1], "data_offsets": [0, 4]}}'
    n = (60 << 20) // (len(one.format(0)) + 2)
    head = ("{" + ", ".join(map(one.format, range(n))) + "}").encode()
    (tmp_path / "big.safetensors").write_bytes(len(head).to_bytes(8, "little") + head + b"\0" * 4)
    script = f"""
import resource, sys
resource.setrlimit(resource.RLIMIT_DATA, (1 << 30, 1 << 30))
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from tuneframe.sources.weights import _rows_of
p = {str(tmp_path / 'big.safetensors')!r}
rows = 0
for r in _rows_of("file:" + p, {len(head) + 12}, 100 << 20):
    rows += 1
print(rows, r[5], r[6])
"""
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300)
    assert out.stdout.split() == [str(n + 1), "True", str(n)], out.stderr[-2000:]
