"""Every registered reference query against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from loomgrid.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    data = [tuple(r) for r in got.collect()]
    assert got.columns
    if name in catalogue.ORACLE_SQL:
        c = con.execute(catalogue.ORACLE_SQL[name])
        assert rows(got.columns, data) == rows([d[0] for d in c.description], c.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
