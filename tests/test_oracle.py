"""The library's results against SQL, over whole tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return c


def _rows(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, con, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert _rows(df.select(*columns).collect()) == _rows([tuple(r[i] for i in at) for r in found.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
