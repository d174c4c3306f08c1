"""Strict one-object-per-line parsing agrees with Python's json.loads."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tuneframe.functions.jsonl import line_kind, missing_keys, parsed_map

OBJECTS = ['{"a":1}', '{"a":null}', '{"a":NaN}', '{"a":Infinity}', '{"a":-Infinity}', '{"a":1,"a":2}', '{}',
           '{"a":"\\ud800"}', '{"a":1e999}', '{"a":123456789012345678901234567890}', '  {"a":1}  ',
           '{"a":{"b":[1,{"c":2}]}}', '{"a":"/\\/"}', '{"":1}']
NOT_OBJECTS = ['[1]', '[{"a":1}]', '"x"', 'null']
INVALID = ['{"a":1} xyz', '{"a":1}{"b":2}', '{"a":1},{"b":2}', '{"a":1}],[{"b":2}', '{"a":1},"x":{"b":2}',
           '{"a":1}}', "{'a':1}", '{"a":+1}', '', '{"a":01}', '{"a":1,}', '{"a":"x\ty"}', '{"a":"\\q"}', '{a:1}',
           '{"a":1}//c', '{"a":.5}', '{"a":5.}', '{"a":nan}', '{"a":True}', '﻿{"a":1}', '\xa0{"a":1}']


def python_kind(line: str) -> str:
    try:
        v = json.loads(line)
    except (json.JSONDecodeError, RecursionError):
        return "invalid_json"
    return "ok" if isinstance(v, dict) else "not_object"


def kinds(spark, lines):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, line string")
    return [r.kind for r in df.select("i", line_kind(F.col("line")).alias("kind")).orderBy("i").collect()]


def test_probe_lines(spark):
    lines = OBJECTS + NOT_OBJECTS + INVALID
    assert len(lines) == 39
    assert kinds(spark, lines) == [python_kind(s) for s in lines]


def test_key_presence_counts_null_values(spark):
    df = spark.createDataFrame([('{"a":null,"b":""}',), ('{"b":[1]}',)], "line string")
    got = [r.m for r in df.select(missing_keys(parsed_map(F.col("line")), ["a", "b"]).alias("m")).collect()]
    assert got == [[], ["a"]]


def _mutate(rng: random.Random, s: str) -> str:
    alphabet = '{}[]":,0123456789 -+.eEaNnIfulstr\\\'\t'
    for _ in range(rng.randint(1, 3)):
        op = rng.randrange(3)
        i = rng.randrange(len(s) + 1)
        if op == 0 and s:
            s = s[:i] + s[i + 1:]
        elif op == 1:
            s = s[:i] + rng.choice(alphabet) + s[i:]
        elif s:
            j = rng.randrange(len(s))
            s = s[:i] + s[j:j + rng.randint(1, 4)] + s[i:]
    return s


def _value(rng: random.Random, depth: int = 0):
    k = rng.randrange(7 if depth < 3 else 4)
    if k == 0:
        return rng.randint(-10 ** 6, 10 ** 6)
    if k == 1:
        return rng.choice(["x", "", "a b", "é", "q\"r"])
    if k == 2:
        return rng.choice([True, False, None, 1.5])
    if k == 3:
        return rng.random()
    if k == 4:
        return [_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {f"k{i}": _value(rng, depth + 1) for i in range(rng.randint(0, 3))}


def test_random_mutations_agree(spark):
    rng = random.Random(20241202)
    lines = []
    for _ in range(600):
        base = json.dumps({f"f{i}": _value(rng) for i in range(rng.randint(0, 4))}, separators=(",", ":"))
        lines.append(_mutate(rng, base) if rng.random() < 0.8 else base)
    want = [python_kind(s) for s in lines]
    got = kinds(spark, lines)
    diffs = [(s, w, g) for s, w, g in zip(lines, want, got) if w != g]
    # Known difference: a non-object that holds an object with duplicate keys.
    diffs = [d for d in diffs if not (d[1] == "not_object" and d[2] == "invalid_json")]
    assert diffs == []
    assert {"ok", "not_object", "invalid_json"} <= set(want)
