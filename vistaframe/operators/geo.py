"""Points and rectangles against regions: bounding-box joins, tagging, viewports, population repair.

Regions are rows with xmin, ymin, xmax, ymax. A join goes through grid cells, so it is an equi-join however many regions there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))


def _gridded(regions: DataFrame, size: float) -> DataFrame:
    wide = regions.withColumn("__cx", F.explode(_cells(F.col("xmin"), F.col("xmax"), size)))
    return wide.withColumn("__cy", F.explode(_cells(F.col("ymin"), F.col("ymax"), size)))


def points_in_boxes(points: DataFrame, regions: DataFrame, size: float = 1.0) -> DataFrame:
    """Every pair of a point (x, y) and a region whose closed box holds it; points with a null coordinate have none."""
    at = points.where("x is not null and y is not null").withColumn("__cx", F.floor(F.col("x") / size).cast("long")).withColumn("__cy", F.floor(F.col("y") / size).cast("long"))
    inside = F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))
    return at.join(_gridded(regions, size), ["__cx", "__cy"]).where(inside).drop("__cx", "__cy")


def boxes_overlapping(boxes: DataFrame, regions: DataFrame, key: str, region_key: str, size: float = 1.0, same: str | None = None) -> DataFrame:
    """(key, region_key, area): pairs of boxes and regions whose closed rectangles meet, with the area in common; with ``same`` only those equal in that column."""
    both = [F.col(same).alias("__same")] if same else []
    a = _gridded(boxes.select(key, *both, "xmin", "ymin", "xmax", "ymax"), size)
    b = _gridded(regions.select(region_key, *both, *[F.col(c).alias(f"r{c}") for c in ("xmin", "ymin", "xmax", "ymax")]).withColumnsRenamed({f"r{c}": c for c in ("xmin", "ymin", "xmax", "ymax")}), size)
    b = b.select(region_key, *(["__same"] if same else []), *[F.col(c).alias(f"r{c}") for c in ("xmin", "ymin", "xmax", "ymax")], "__cx", "__cy")
    w = F.least("xmax", "rxmax") - F.greatest("xmin", "rxmin")
    h = F.least("ymax", "rymax") - F.greatest("ymin", "rymin")
    # a pair may share many cells; it counts in the first
    first = (F.floor(F.greatest("xmin", "rxmin") / size) == F.col("__cx")) & (F.floor(F.greatest("ymin", "rymin") / size) == F.col("__cy"))
    return a.join(b, ["__cx", "__cy", *(["__same"] if same else [])]).where((w >= 0) & (h >= 0) & first).select(key, region_key, (w * h).alias("area"))


def tag_points(points: DataFrame, key: str, regions: DataFrame, region_key: str, size: float = 1.0) -> DataFrame:
    """Every point with ``region_key`` of the smallest region (ties to 9 digits of the area: by key) whose box holds it, null if none does."""
    area = F.round((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")), 9)
    hits = points_in_boxes(points.select(key, "x", "y"), regions, size).groupBy(key).agg(F.min(F.struct(area.alias("a"), F.col(region_key).alias("r"))).alias("__hit"))
    hits = hits.select(F.col(key).alias("__key"), F.col("__hit.r").alias(region_key))
    return points.join(hits, points[key] == F.col("__key"), "left").drop("__key")


def largest_parent(boxes: DataFrame, parents: DataFrame, key: str, parent_key: str, size: float = 1.0, same: str | None = None) -> DataFrame:
    """(key, parent_key): for each box the parent it shares the largest area with, of those equal in the column ``same`` if it is given; ties by key."""
    return best_parent(boxes_overlapping(boxes, parents, key, parent_key, size, same), key, parent_key)


def best_parent(pairs: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Of pairs with an ``area`` for each key the parent with the largest, to 9 digits; ties by key."""
    return pairs.groupBy(key).agg(F.min(F.struct((-F.round("area", 9)).alias("a"), F.col(parent_key).alias("p"))).alias("__best")).select(key, F.col("__best.p").alias(parent_key))


def by_name(rows: DataFrame, regions: DataFrame, name: str, state: str, region_key: str) -> DataFrame:
    """Every row with ``region_key`` of the region with its name and state (case ignored); of several the smallest key."""
    known = regions.groupBy(F.lower(name).alias("__n"), F.lower(state).alias("__s")).agg(F.min(region_key).alias(region_key))
    return rows.join(known, (F.lower(rows[name]) == F.col("__n")) & (F.lower(rows[state]) == F.col("__s")), "left").drop("__n", "__s")


def by_name_covering(rows: DataFrame, regions: DataFrame, key: str, name: str, region_key: str) -> DataFrame:
    """Every row with ``region_key`` of the region of its name (case ignored) whose box covers the row's (xmin, ymin, xmax, ymax); of several the smallest key."""
    known = regions.select(F.lower(name).alias("__n"), F.col(region_key).alias("__r"), *[F.col(c).alias(f"__{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    covers = (F.col("__xmin") <= F.col("xmin")) & (F.col("__ymin") <= F.col("ymin")) & (F.col("__xmax") >= F.col("xmax")) & (F.col("__ymax") >= F.col("ymax"))
    hits = rows.select(F.col(key).alias("__key"), F.lower(name).alias("__n"), "xmin", "ymin", "xmax", "ymax").join(known, "__n").where(covers).groupBy("__key").agg(F.min("__r").alias(region_key))
    return rows.join(hits, rows[key] == F.col("__key"), "left").drop("__key")


def tag_cascade(rows: DataFrame, key: str, city_names: DataFrame, regions: DataFrame, region_key: str, size: float = 1.0) -> DataFrame:
    """Rows tagged by what their ``place_type`` says; rows that remain untagged are dropped.

    A ``city`` is found by name and state, a ``neighborhood`` by name among the regions whose box covers its own, a
    ``poi`` by the middle of its box; anything else, and what these don't find, by its point. ``key`` names each row.
    """
    named = by_name(rows, city_names, "name", "state", region_key).withColumnRenamed(region_key, "__city")
    covered = by_name_covering(named, regions, key, "name", region_key).withColumnRenamed(region_key, "__hood")
    middle = lambda lo, hi: (F.col(lo) + F.col(hi)) / 2
    poi = F.col("place_type") == "poi"
    spots = covered.select(F.col(key).alias("__at"), F.when(poi, F.coalesce(middle("xmin", "xmax"), "x")).otherwise(F.col("x")).alias("x"), F.when(poi, F.coalesce(middle("ymin", "ymax"), "y")).otherwise(F.col("y")).alias("y"))
    by_point = tag_points(spots, "__at", regions, region_key, size).select("__at", F.col(region_key).alias("__point"))
    both = covered.join(by_point, covered[key] == F.col("__at"), "left")
    tag = F.coalesce(F.when(F.col("place_type") == "city", F.col("__city")), F.when(F.col("place_type") == "neighborhood", F.col("__hood")), "__point")
    return both.withColumn(region_key, tag).drop("__city", "__hood", "__point", "__at").where(F.col(region_key).isNotNull())


def in_ids(rows: DataFrame, key: str, ids: DataFrame, few: int = 200_000) -> DataFrame:
    """Rows whose key is among ``ids`` (a column of the same name), however many those are; few of them, counted, are broadcast."""
    ids = ids.select(key).distinct()
    return rows.join(F.broadcast(ids) if ids.count() <= few else ids, key, "left_semi")


def rectangle(corners: Column) -> Column:
    """The bounds of an array of points (structs x, y); a side without length is widened by 1e-7."""
    xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    low_x, low_y, high_x, high_y = F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)
    widen = lambda lo, hi: F.when(lo == hi, hi + 1e-7).otherwise(hi)
    return F.struct(low_x.alias("xmin"), low_y.alias("ymin"), widen(low_x, high_x).alias("xmax"), widen(low_y, high_y).alias("ymax"))


def centroid(box: Column) -> Column:
    return F.struct(((box["xmin"] + box["xmax"]) / 2).alias("x"), ((box["ymin"] + box["ymax"]) / 2).alias("y"))


def viewport(rows: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows whose point (x, y) lies in the view: x in [west, east), y in [south, north]."""
    return rows.where((F.col("x") >= west) & (F.col("x") < east) & F.col("y").between(south, north))


def point_text(p: Column) -> Column:
    """A point as ``POINT (x y)``."""
    return F.when(p.isNotNull(), F.concat(F.lit("POINT ("), p["x"].cast("string"), F.lit(" "), p["y"].cast("string"), F.lit(")")))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies inside a polygon (array of structs x, y), by counting the sides that a ray crosses; null for a null point or polygon."""
    before = F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))

    def crossed(p: Column, q: Column) -> Column:
        at = (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]
        return F.when((p["y"] > y) != (q["y"] > y), F.when(x < at, 1).otherwise(0)).otherwise(0)

    odd = F.aggregate(F.zip_with(ring, before, crossed), F.lit(0), lambda a, c: a + c) % 2 == 1
    return F.when(x.isNotNull() & y.isNotNull() & (F.size(ring) > 0), odd).otherwise(F.when(F.size(ring) == 0, False))


def within_polygons(pairs: DataFrame) -> DataFrame:
    """Of pairs with a point (x, y) and a polygon ``ring`` those where it lies inside."""
    return pairs.where(in_ring(F.col("x"), F.col("y"), F.col("ring")))


def repaired_population(regions: DataFrame, population: DataFrame, parent: str) -> DataFrame:
    """regions (name, parent) with ``population`` by name: names that occur more than once count as unknown.

    Unknown numbers become the mean of the parent's known ones, rounded down, or 100 if there are none.
    """
    known = population.groupBy("name").agg(F.count(F.lit(1)).alias("__n"), F.max("population").alias("population"))
    joined = regions.join(known, "name", "left")
    value = F.when(F.col("__n") == 1, F.col("population"))
    mean = F.avg(value).over(Window.partitionBy(parent))
    return joined.select(*regions.columns, F.coalesce(value, F.floor(mean), F.lit(100)).cast("long").alias("population"))
