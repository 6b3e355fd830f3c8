"""Every query with SQL gives its rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from vistaframe.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(round(r[i], 6) + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def test_all_have_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, tables, name):
    want = tables.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)
