"""Every registered query against its DuckDB oracle on the smallest tables."""

import hashlib
import json
import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tuneframe.plans import catalog

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
E.queries()
QUERIES = {k: v for k, v in catalog.QUERIES.items()}
ORACLE = {k: v for k, v in catalog.ORACLE.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                 "boolean": "BOOLEAN", "float": "FLOAT"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keys = sorted(json.dumps([_norm(r[i]) for i in order], default=str) for r in rows)
    return hashlib.md5("\n".join(keys).encode()).hexdigest()


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    rel = duck.sql(ORACLE[name])
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    duck_types = dict(zip(rel.columns, map(str, rel.types)))
    for f in df.schema:
        assert SPARK_TO_DUCK.get(f.dataType.simpleString()) == duck_types[f.name], (name, f.name)
    assert len(srows) == len(drows)
    assert _digest(df.columns, srows) == _digest(rel.columns, drows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["record_id", "text"]
    assert df.count() == 34


def test_rows_only_batch_infer(spark):
    df = QUERIES["batch_infer"](spark, SF_SMALL)
    rows = df.collect()
    assert len(rows) == 34
    assert all(r.response for r in rows)


BRANCHES = {
    "upload_gate": ("outcome", {"bad_suffix", "too_large", "stored", "invalid_json"}),
    "architecture_check": ("problem", {None, "no_model_type", "bad_architectures", "not_causal_lm"}),
    "tensor_checks": ("problem", {"ok", "bad_offsets", "negative_begin", "end_before_begin", "end_past_data", "bad_shape"}),
    "utf8_check": ("utf8_ok", {True, False}),
}


@pytest.mark.parametrize("name", BRANCHES)
def test_fixtures_reach_every_branch(spark, name):
    col, want = BRANCHES[name]
    got = {r[0] for r in QUERIES[name](spark, "/root/testdata/sf0.01").select(col).distinct().collect()}
    assert want <= got


def test_every_request_rule_is_broken_and_kept(spark):
    from tuneframe.constants import REQUEST_RULES
    rows = QUERIES["request_check"](spark, "/root/testdata/sf0.01").select("violations").distinct().collect()
    seen = {v for r in rows for v in r[0].split(",")}
    assert seen >= {"", "method", *(r[0] for r in REQUEST_RULES if r[0] != "learning_rate")}


def test_missing_fields_parses_each_line_once(spark):
    plan = QUERIES["missing_fields"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 4
