import numpy as np
import pytest

from pyspark.sql import functions as F

from vistaframe.llm import neighbours
from vistaframe.llm.neighbours import clean, masks, nearest, plan, sure_cosine, within_radius

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return [set(np.argsort(-r)[:k].tolist()) for r in s]


@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_recall(spark, spread):
    """Tight clusters, which the codes settle, and vectors without structure, which they don't."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(60, 64))[rng.integers(0, 60, 1500)] + spread * 0.5 * rng.normal(size=(1500, 64))).astype(np.float32)
    found: dict[int, dict[int, float]] = {}
    for r in nearest(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA), k=5, turns=3).collect():
        found.setdefault(r["vec_id"], {})[r["neighbour"]] = r["cosine"]
    want = brute_force(x.astype(float), 5)
    assert len(found) == 1500 and all(len(v) == 5 for v in found.values())
    assert np.mean([len(found[i].keys() & w) / 5 for i, w in enumerate(want)]) >= 0.95


@pytest.mark.parametrize("offset", [2.0, 3.0])
def test_recall_with_a_common_offset(spark, offset):
    """Loose clusters far from the origin: raw cosines are all high, those of the codes' space are not."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 64))[rng.integers(0, 60, 3000)] + 0.8 * rng.normal(size=(3000, 64)) + offset * rng.normal(size=64)
    x = x.astype(np.float32)
    found: dict[int, set[int]] = {}
    for r in nearest(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA), k=10, turns=3).collect():
        found.setdefault(r["vec_id"], set()).add(r["neighbour"])
    want = brute_force(x.astype(float), 10)
    assert len(found) == 3000 and all(len(v) == 10 for v in found.values())
    assert np.mean([len(found[i] & w) / 10 for i, w in enumerate(want)]) >= 0.95


def test_copies_and_ties(spark):
    """A vector equally near to 300 others gets the smallest ids, within a group of copies and between different vectors."""
    rng = np.random.default_rng(2)
    axis = np.zeros(64)
    axis[0] = 1
    other = np.eye(64)[1:]
    ring = [(axis + other[i % 63] * (1 if i < 63 else -1)) / np.sqrt(2) for i in range(126)]  # all at the same angle to the axis
    x = [axis, *ring, *[ring[5]] * 100, *[v for v in rng.normal(size=(300, 64)) - 3 * axis], axis, axis]
    df = spark.createDataFrame([(i, [float(f) for f in v], 0) for i, v in enumerate(x)], SCHEMA)
    found: dict[int, list[int]] = {}
    for r in nearest(df, k=10, turns=2, queries=F.col("vec_id") % 100 == 0).orderBy("vec_id", "rank").collect():
        found.setdefault(r["vec_id"], []).append(r["neighbour"])
    assert found.keys() == {0, 100, 200, 300, 400, 500}
    assert found[0] == [527, 528, *range(1, 9)]
    assert found[200] == [6, *range(127, 136)]  # a copy of ring[5] itself


def test_settled_by_codes_alone(spark):
    """Tight clusters: no query needs the exact search, and recall is measured against brute force."""
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(200, 64))[np.repeat(np.arange(200), 20)] + 0.15 * rng.normal(size=(4000, 64))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    before = neighbours._compare
    neighbours._compare = None  # it must not be called
    try:
        found: dict[int, set[int]] = {}
        for r in nearest(df, k=10, turns=3, queries=F.col("vec_id") % 10 == 0, fit_rows=1000).collect():
            found.setdefault(r["vec_id"], set()).add(r["neighbour"])
    finally:
        neighbours._compare = before
    want = brute_force(x.astype(float), 10)
    assert len(found) == 400 and np.mean([len(found[i] & want[i]) / 10 for i in found]) >= 0.95


def test_plan_has_no_cross_join(spark, capsys):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(300, 16)))], SCHEMA)
    nearest(df, k=3, turns=1, queries=F.col("vec_id") % 10 == 0).explain()
    out = capsys.readouterr().out
    assert "Physical Plan" in out and "Cartesian" not in out and "NestedLoop" not in out


def test_every_code_within_the_radius(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 6)
    codes = np.concatenate([base[rng.integers(0, 6, 300)] ^ (np.int64(1) << rng.integers(0, 62, 300)) ^ (np.int64(1) << rng.integers(0, 62, 300)), base])
    df = spark.createDataFrame([(i, int(c)) for i, c in enumerate(codes)], "vec_id long, code long")
    differ = np.bitwise_count((codes[:, None] ^ codes[None]).view(np.uint64))
    for radius, rows in ((3, 306), (7, 1 << 20)):
        got = [(r["vec_id"], r["neighbour"]) for r in within_radius(df, df, 64, radius, rows).collect()]
        want = {(i, j) for i, j in zip(*np.nonzero(differ <= radius)) if i != j}
        assert len(got) == len(set(got)) and set(got) == want


def test_plan():
    for bits, radius, rows in ((64, 15, 50_000), (64, 3, 1000), (32, 0, 10), (64, 20, 1 << 30)):
        tables = plan(bits, radius, rows)
        assert sum(n for _, n, _ in tables) == bits and sum(r + 1 for *_, r in tables) == radius + 1
    assert len(masks(10, 3)) == 1 + 10 + 45 + 120
    assert 0.8 < sure_cosine(64, 15) < 0.95


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.1], 0), (3, None, 0), (4, [], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [0.0, 0.0], 0), (8, [1.0, None], 0), (9, [1.0], 0), (None, [1.0, 1.0], 0), (10, [0.0, 1.0], 0), (10, [0.0, 1.0], 0), (11, [0.0, 1.0], None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as code", "2 as neighbour")
    assert sorted(r["vec_id"] for r in clean(df).collect()) == [1, 2, 10, 11]
    found = {(r["vec_id"], r["rank"]): r["neighbour"] for r in nearest(df, k=2).collect()}
    assert found[1, 1] == 2 and found[10, 1] == 11 and found[11, 1] == 10 and len(found) == 8
    assert nearest(spark.createDataFrame([], SCHEMA)).collect() == [] and nearest(df.where("vec_id = 1")).collect() == []
