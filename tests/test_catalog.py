"""Every query with SQL must give the SQL's rows; the others must run."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = [n for n in entry.queries() if n.startswith("q_")]


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v != v else round(v, 9) if isinstance(v, float) else str(v)
    return sorted((tuple(map(clean, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, oracle, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = oracle.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(want) > 0 or name == "q_grep_to_chunk"


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["rank", "id", "filePath", "startLine", "endLine", "score", "source"]
