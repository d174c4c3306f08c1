"""Every pipeline stage on nulls, empty and long texts, repeated rows, empty
tables and extra columns whose names the stages use themselves."""

import os

import corpus_pipeline
import pytest

LONG = "the quick river runs over the old stones and goes on " * 5000
EXTRA = ["i", "text_hash", "leak", "pii", "langid", "weight", "copies", "place", "salt", "s", "id_kept", "white"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
WORDS = ("the house stands by the river and the people of the village walk there in the evening when the light is low and the "
         "air is warm so that all of them may talk of the day").split()
GIVEN = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n", None, None), (4, LONG, "en", None), (5, " ".join(WORDS), "en", "a"),
         (5, " ".join(WORDS), "en", "a"), (6, " ".join(WORDS).upper(), "en", "b"), (None, "mail me at jo@example.com please", "en", "b"),
         (None, None, None, None), (7, "Das Haus steht am Fluss und die Leute gehen dort am Abend", "de", "b"), (8, "12345 67890", "en", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, *EXTRA) for r in GIVEN], SCHEMA)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, sf, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out, none = stage(spark, docs, sf), stage(spark, docs.limit(0), sf)
    assert out.columns[: len(docs.columns)] == none.columns[: len(docs.columns)] == docs.columns
    assert none.count() == 0
    got = [r.asDict() for r in out.select(*docs.columns).collect()]
    assert all([r[c] for c in EXTRA] == EXTRA for r in got)
    ids = sorted((r["doc_id"] or 0, r["text"] or "") for r in got)
    if name == "language_id":
        assert [i for i, _ in ids] == [0, 4, 5, 5, 6, 7]
    elif name == "jaccard_join":
        assert [i for i, _ in ids] == [0, 0, 1, 2, 3, 4, 5, 7, 8]
    elif name == "decontamination":
        assert len(ids) == len(GIVEN)
    elif name == "pii":
        by = [(r["doc_id"], r["text"], r["n_chars"]) for r in got]
        assert (None, "mail me at <email> please", 25) in by and (1, None, None) in by and (4, LONG, len(LONG)) in by
    else:
        assert {i for i, _ in ids} <= {r[0] or 0 for r in GIVEN} and out.columns[len(docs.columns):] == ["weight_", "copies_", "place_"]


def test_run_returns_the_cleaned_texts_and_leaves_its_result_only(spark, sf, given):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*spark.read.parquet(f"{sf}/documents.parquet").columns, "weight", "copies", "place"]
    got = out.collect()
    text = {d["doc_id"]: d["text"] for d in given("documents")}
    assert got and all(r.copies > 0 and r.n_chars == len(r.text) for r in got)
    assert sum(r.text == text[r.doc_id] for r in got) > 0.5 * len(got)
    folder = out.inputFiles()[0].replace("file://", "").rsplit("/", 2)[0]
    assert os.listdir(folder) == ["4-mixing"]
