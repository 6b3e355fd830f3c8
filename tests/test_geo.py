"""Regions, names, polygons, and what samples of series are worth."""

import math
import random
from statistics import NormalDist

from pyspark.sql import functions as F

from vistaframe.operators import geo, sampling


def boxes(spark, rows, key="r", extra=""):
    return spark.createDataFrame(rows, f"{key} long, xmin double, ymin double, xmax double, ymax double{extra}")


def test_tag_points(spark):
    regions = boxes(spark, [(1, 0.0, 0.0, 4.0, 4.0), (2, 1.0, 1.0, 2.0, 2.0), (3, 1.0, 1.0, 2.0, 2.0)])
    points = spark.createDataFrame([(1, 1.5, 1.5), (2, 3.0, 3.0), (3, 9.0, 9.0), (4, None, 1.0)], "p long, x double, y double")
    assert {r["p"]: r["r"] for r in geo.tag_points(points, "p", regions, "r").collect()} == {1: 2, 2: 1, 3: None, 4: None}


def test_parents_and_names(spark):
    kids = spark.createDataFrame([(10, 0.0, 0.0, 2.0, 2.0, "s"), (11, 5.0, 5.0, 6.0, 6.0, "s"), (12, 0.0, 0.0, 2.0, 2.0, "t")], "k long, xmin double, ymin double, xmax double, ymax double, state string")
    parents = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 2.0, "s"), (2, 1.0, 0.0, 9.0, 2.0, "s"), (3, 0.0, 0.0, 2.0, 2.0, "u"), (4, -1.0, -1.0, 0.5, 0.5, "t")], "r long, xmin double, ymin double, xmax double, ymax double, state string")
    assert {r["k"]: r["r"] for r in geo.largest_parent(kids, parents, "k", "r").collect()} == {10: 3, 12: 3}
    assert {r["k"]: r["r"] for r in geo.largest_parent(kids, parents, "k", "r", same="state").collect()} == {10: 1, 12: 4}
    names = spark.createDataFrame([(1, "Irvine", "CA"), (2, "irvine", "ca"), (3, "Irvine", "KY")], "r long, name string, state string")
    rows = spark.createDataFrame([("IRVINE", "Ca"), ("Irvine", "TX"), (None, "CA")], "name string, state string")
    assert {(r["name"], r["state"]): r["r"] for r in geo.by_name(rows, names, "name", "state", "r").collect()} == {("IRVINE", "Ca"): 1, ("Irvine", "TX"): None, (None, "CA"): None}


def test_cascade(spark):
    regions = spark.createDataFrame([(1, "Alpha", "S", 0.0, 0.0, 10.0, 10.0), (2, "Beta", "S", 20.0, 0.0, 30.0, 10.0), (3, "alpha", "S", 0.0, 0.0, 1.0, 1.0)], "r long, name string, state string, xmin double, ymin double, xmax double, ymax double")
    rows = [
        (1, "city", "beta", "s", None, None, None, None, None, None), (2, "neighborhood", "ALPHA", None, 2.0, 2.0, 3.0, 3.0, None, None), (3, "neighborhood", "Alpha", None, 0.1, 0.1, 0.2, 0.2, None, None),
        (4, "poi", None, None, 24.0, 4.0, 26.0, 6.0, None, None), (5, "exact", None, None, None, None, None, None, 5.0, 5.0), (6, "city", "nowhere", "s", None, None, None, None, 25.0, 1.0), (7, None, None, None, None, None, None, None, None, None), (8, "city", "nowhere", "s", None, None, None, None, 90.0, 1.0),
    ]
    df = spark.createDataFrame(rows, "id long, place_type string, name string, state string, xmin double, ymin double, xmax double, ymax double, x double, y double")
    assert {r["id"]: r["r"] for r in geo.tag_cascade(df, "id", regions, regions, "r").collect()} == {1: 2, 2: 1, 3: 1, 4: 2, 5: 1, 6: 2}


def test_polygons(spark):
    """A star and an empty ring, against counting by winding angles."""
    r = random.Random(4)
    ring = [(math.cos(t * math.pi / 5) * (2 if t % 2 else 1), math.sin(t * math.pi / 5) * (2 if t % 2 else 1)) for t in range(10)]

    def inside(x, y):
        turn = 0.0
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
            turn += math.remainder(math.atan2(by - y, bx - x) - math.atan2(ay - y, ax - x), 2 * math.pi)
        return abs(turn) > 3

    points = [(i, r.uniform(-2, 2), r.uniform(-2, 2)) for i in range(300)]
    rows = [(i, x, y, ring) for i, x, y in points] + [(1000, 0.0, 0.0, []), (1001, None, 0.0, ring), (1002, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "i long, x double, y double, ring array<struct<x: double, y: double>>")
    assert sorted(x["i"] for x in geo.within_polygons(df).collect()) == [i for i, x, y in points if inside(x, y)]


def test_rectangles_and_text(spark):
    df = spark.createDataFrame([([(1.0, 5.0), (3.0, -1.0)],), ([(2.0, 2.0)],)], "c array<struct<x: double, y: double>>").withColumn("b", geo.rectangle(F.col("c")))
    got = [tuple(r["b"]) for r in df.collect()]
    assert got[0] == (1.0, -1.0, 3.0, 5.0) and got[1][:2] == (2.0, 2.0) and 0 < got[1][2] - 2 < 1e-6
    assert tuple(df.select(geo.centroid(F.col("b")).alias("m")).first()["m"]) == (2.0, 2.0)
    assert df.select(geo.point_text(F.get("c", F.lit(1))).alias("t")).collect() == [("POINT (3.0 -1.0)",), (None,)]


def test_decimate_whatever_the_columns(spark):
    rows = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k"), F.lit("x").alias("more"), F.col("id").alias("other")).repartition(7)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(r["k"] for r in sampling.decimate(rows, ["k"], 100).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert got == list(range(0, 5000, 50))
    assert sampling.decimate(rows, ["k"], 5000).count() == 5000


def symbol_distance(series, other, segments=16, letters=8):
    breaks = [NormalDist().inv_cdf(i / letters) for i in range(1, letters)]

    def symbols(x):
        mean = sum(x) / len(x)
        spread = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x)) or 1.0
        cuts = [i * len(x) // segments for i in range(segments + 1)]
        return [sum((sum(x[a:b]) / (b - a) - mean) / spread > k for k in breaks) for a, b in zip(cuts, cuts[1:])]

    gaps = [0.0 if abs(i - j) <= 1 else breaks[max(i, j) - 1] - breaks[min(i, j)] for i, j in zip(symbols(series), symbols(other))]
    return math.sqrt(len(series) / segments * sum(g * g for g in gaps))


def plain_ratio(v, ratios=sampling.RATIOS, most=1.0):
    n = len(v)
    if n >= 16:
        for r in ratios:
            m = max(2, math.floor(n * r + 0.5))
            kept = sorted({j * (n - 1) // (m - 1) for j in range(m)})
            drawn = [v[0]]
            for a, b in zip(kept, kept[1:]):
                drawn += [v[a] + (p - a) * (v[b] - v[a]) / (b - a) for p in range(a + 1, b + 1)]
            if symbol_distance(v, drawn) <= most:
                return r
    return ratios[-1]


def test_sample_ratios(spark):
    series = {k: [math.sin(i / 3**k) + random.Random(k * 1000 + i).uniform(-1, 1) * (k % 3) for i in range(300 + 7 * k)] for k in range(7)}
    series |= {20: [1.0] * 50, 21: [float(i) for i in range(40)], 22: [3.0, 1.0], 23: [random.Random(i).uniform(-1, 1) for i in range(400)]}
    rows = [(k, i, v) for k, x in series.items() for i, v in enumerate(x)] + [(0, None, 5.0), (0, 3, None)]
    df = spark.createDataFrame(rows, "k long, at long, x double").repartition(5)
    got = {r["k"]: r["ratio"] for r in sampling.sample_ratios(df, "k", "at", "x").collect()}
    assert got == {k: plain_ratio(v) for k, v in series.items()} and len(set(got.values())) > 2
    assert sampling.sample_ratios(df.limit(0), "k", "at", "x").collect() == []
