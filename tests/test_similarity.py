"""Similarity of the names of any two parts of a brand."""

import math
from itertools import combinations

import duckdb
import pytest

from vistaframe.queries import ORACLE_SQL, QUERIES

NAMES = ["red bolt", "Bolt, red!", "red red rod", "", None, "--", "old red bolt", "gear"]


@pytest.fixture
def part(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
        return str(tmp_path)

    return write


def plain(rows):
    return sorted((str(a), str(b), "nan" if s is not None and math.isnan(s) else str(s)) for a, b, s in rows)


def by_sql(folder):
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{folder}/part.parquet/*.parquet'")
    return plain(con.sql(ORACLE_SQL["word_similarity"]).fetchall())


def test_keys_far_apart(spark, part):
    folder = part([(k, "x", f"red {k}") for k in (-7, 0, 49, 50, 1000, 10**12)] + [(5, "y", "red")])
    got = QUERIES["word_similarity"](spark, folder).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(combinations((-7, 0, 49, 50, 1000, 10**12), 2))
    assert {r.similarity for r in got} == {round(1 / 3, 9)}
    assert plain(got) == by_sql(folder)


def test_odd_rows(spark, part):
    """Names without words and none at all, keys that come twice, rows without brand or key."""
    rows = [(100 * k, "x", name) for k, name in enumerate(NAMES + NAMES[::-1])]
    folder = part([*rows, (100, "x", "red rod"), (300, "x", ""), (None, "x", "red"), (7, None, "red"), (8, None, "red")])
    assert plain(QUERIES["word_similarity"](spark, folder).collect()) == by_sql(folder)


def test_pairs_of_one_brand_in_several_tasks(spark, part, monkeypatch):
    monkeypatch.setattr("vistaframe.queries._BLOCK", 10, raising=False)
    folder = part([(3 * k, "x", NAMES[k % len(NAMES)]) for k in range(64)])
    got = QUERIES["word_similarity"](spark, folder)
    by_task = [n for n in got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert sum(by_task) == 64 * 63 // 2 and max(by_task) < sum(by_task) / 4
    assert plain(got.collect()) == by_sql(folder)


def test_lists_of_one_name_are_cut(spark, part, monkeypatch):
    monkeypatch.setattr("vistaframe.queries._LIST", 3, raising=False)
    monkeypatch.setattr("vistaframe.queries._BLOCK", 40, raising=False)
    folder = part([(k, "x", NAMES[k % 7 % 3]) for k in range(90)] + [(4, "x", NAMES[0]), (4, "x", NAMES[2])])
    assert plain(QUERIES["word_similarity"](spark, folder).collect()) == by_sql(folder)
