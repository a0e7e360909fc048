"""Every query of the catalogue against its SQL in DuckDB, and the entry module without optional parts."""

import importlib
import math
import os
import sys

import duckdb
import pytest

from tidelog.queries import CATALOGUE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for file in os.listdir(SF):
        connection.sql(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{SF}/{file}')")
    return connection


def cell(value):
    return round(value, 6) if isinstance(value, float) and math.isfinite(value) else value


@pytest.mark.parametrize("name", CATALOGUE)
def test_query_agrees_with_sql(spark, oracle, name):
    run, sql = CATALOGUE[name]
    rows = run(spark, SF)
    names = sorted(rows.columns)
    found = oracle.sql(sql)
    assert sorted(found.columns) == names
    ours = [tuple(str(cell(r[n])) for n in names) for r in rows.collect()]
    theirs = [tuple(str(cell(x)) for x in r) for r in found.select(*(f'"{n}"' for n in names)).fetchall()]
    assert sorted(ours) == sorted(theirs)


def test_entry(spark, monkeypatch):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.setitem(sys.modules, "tidelog.llm", None)
    monkeypatch.setitem(sys.modules, "tidelog.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.reload(entry)
    assert set(alone.queries()) == set(CATALOGUE)
    monkeypatch.undo()
    importlib.reload(entry)
