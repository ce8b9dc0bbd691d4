"""Registered queries against their SQL, and the pipeline's stages."""

from pathlib import Path

import pytest

import corpus_pipeline
from txloom.llm.oracle import SQL
from txloom.llm.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, views, name):
    found = QUERIES[name](spark, str(FOLDER))
    columns = sorted(found.columns)
    relation = views.sql(SQL[name])
    assert columns == sorted(relation.columns)
    ours = sorted(map(tuple, found.select(*columns).collect()), key=str)
    order = [relation.columns.index(c) for c in columns]
    theirs = sorted((tuple(row[i] for i in order) for row in relation.fetchall()), key=str)
    assert ours and ours == theirs


def test_pipeline_stages(spark, awkward):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "secrets", "tokens"]
    docs = awkward
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(FOLDER))
        assert docs.columns == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    ids = sorted(r.doc_id or 0 for r in docs.collect())
    # Without letters 2, 3, 4 and 6 go, and 8 is a copy of 7.
    assert ids == [0, 1, 5, 7, 9, 10]
    assert "[SECRET]" in docs.where("doc_id = 1").first().text
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, str(FOLDER))
    assert tokens.where("lossless").count() == 6
    assert [r.lang for r in docs.where("doc_id = 7").collect()] == ["en"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, awkward.limit(0), str(FOLDER)).count() == 0


def test_copies_without_an_id_or_with_a_shared_one_go(spark):
    """Three equal texts, two of them without an id; two other rows share an id with a copy."""
    copy = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"another{i}" for i in range(40))
    rows = [(1, copy), (None, copy), (None, copy), (2, other), (2, copy), (3, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs.coalesce(1), str(FOLDER)).collect()
    assert sorted([(r.doc_id, r.text) for r in kept], key=str) == sorted([(1, copy), (2, other), (3, None), (None, "")], key=str)


def test_the_pipeline_leaves_the_session_as_it_was(spark):
    before = [spark.conf.get(setting) for setting in corpus_pipeline.BATCHES]
    assert corpus_pipeline.run(spark, str(FOLDER)).where("lossless").count() > 0
    assert [spark.conf.get(setting) for setting in corpus_pipeline.BATCHES] == before
