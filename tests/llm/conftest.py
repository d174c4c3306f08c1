import os

import pytest

SF = os.environ.get("LLM_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def rows(spark, sf):
    """Rows of a query as dictionaries, computed once."""
    from tuneframe.llm.queries import QUERIES

    kept = {}

    def get(name):
        if name not in kept:
            kept[name] = [r.asDict(recursive=True) for r in QUERIES[name](spark, sf).collect()]
        return kept[name]

    return get


@pytest.fixture(scope="session")
def given(spark, sf):
    """Rows of a given table as dictionaries."""
    kept = {}

    def get(name):
        if name not in kept:
            kept[name] = [r.asDict() for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]
        return kept[name]

    return get
