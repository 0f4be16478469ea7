"""Every query with SQL gives what DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from vecstead.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return connection


def plain(rows):
    value = lambda v: round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) and not math.isnan(v) else str(v)
    return sorted((tuple(map(value, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n != "compressed_sweep"])
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert got
    if name in catalog.ORACLES:
        found = duck.execute(entry.oracle_sql()[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        assert plain(got) == plain([tuple(r[names.index(c)] for c in columns) for r in found.fetchall()])


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row.fro_norm > 0 and row.pip > 0 and 0 <= row.knn <= 1
