"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from txloom.plans.oracle import SQL
from txloom.plans.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def test_contract(spark):
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, views, name):
    found = QUERIES[name](spark, str(FOLDER))
    columns = sorted(found.columns)
    relation = views.sql(SQL[name])
    assert columns == sorted(relation.columns)
    ours = sorted(map(tuple, found.select(*[f"`{c}`" for c in columns]).collect()))
    order = [relation.columns.index(c) for c in columns]
    theirs = sorted(tuple(row[i] for i in order) for row in relation.fetchall())
    # The deep page begins beyond these small tables.
    assert ours or name == "page_deep"
    assert ours == theirs
