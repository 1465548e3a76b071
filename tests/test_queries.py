"""Every registered query against its SQL, and the contract of the entry module."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5f}".replace("-0.00000", "0.00000")
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_its_sql(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    expected = duck.sql(entry.oracle_sql()[name])
    columns = sorted(expected.columns)
    assert sorted(df.columns) == columns
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    want = sorted(([plain(r[expected.columns.index(c)]) for c in columns] for r in expected.fetchall()), key=str)
    assert len(got) == len(want)
    assert got == want


def test_entry_runs(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0


def test_each_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
