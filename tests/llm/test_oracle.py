"""Every query of the subpackage with SQL gives its rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from vistaframe.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    assert rows and plain(rows, got.columns) == plain(want.fetchall(), want.columns)
