"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest
from conftest import SF

from vellum.plans import extra, recovery, reference

SQL = {**reference.SQL, **extra.SQL, **recovery.SQL}
QUERIES = {**reference.QUERIES, **extra.QUERIES, **recovery.QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(columns, found):
    """Rows as values, whatever a frame would make of nulls and whole numbers."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda x: None if x is None or x != x else x.item() if hasattr(x, "item") else x
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    found = QUERIES[name](spark, SF)
    wanted = con.sql(SQL[name])
    assert rows(found.columns, map(tuple, found.collect())) == rows(wanted.columns, wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
