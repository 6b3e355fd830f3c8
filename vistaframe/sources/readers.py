"""Sources and sinks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistaframe.types import Schema

FORMATS = ("parquet", "json", "csv", "orc", "jdbc")


def read(spark: SparkSession, form: str, path: str | None = None, schema: Schema | T.StructType | None = None, **options: str) -> DataFrame:
    """A table of one of FORMATS, with a declared schema where there is one; jdbc takes url and dbtable as options."""
    if form not in FORMATS:
        raise ValueError(f"unknown format: {form}")
    reader = spark.read.format(form).options(**options)
    if schema is not None and form != "jdbc":
        reader = reader.schema(schema.struct() if isinstance(schema, Schema) else schema)
    return reader.load() if form == "jdbc" else reader.load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, schema: Schema | None = None, column: str | None = None, bounds: tuple[object, object] | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A table of a database. With a column of numbers or times and its ``bounds``, ``parts`` tasks read a stretch each.

    A declared schema chooses the columns, whatever the letter case of the database, and their types: numbers that
    stand for truth values become booleans, ``LINESTRING`` texts of a point their middle, ``point(x y)`` texts points.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column:
        if bounds is None:
            raise ValueError("a partitioned read needs bounds")
        reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    df = reader.load()
    if schema is None:
        return df
    there = {c.lower(): c for c in df.columns}
    out = []
    for name, f in schema.fields.items():
        if f.kind in ("Hierarchy", "Record"):
            continue
        flat = name.lower() if name.lower() in there else name.replace(".", "_").lower()
        if flat not in there:
            if not f.optional:
                raise ValueError(f"{table} has no column {name}")
            out.append(F.lit(None).cast(f.spark_type()).alias(name))
            continue
        c = F.col(f"`{there[flat]}`")
        if f.kind == "Point":
            box = parse_line_box(c)
            c = F.coalesce(parse_point(c), F.when(box.isNotNull(), F.struct(((box["xmin"] + box["xmax"]) / 2).alias("x"), ((box["ymin"] + box["ymax"]) / 2).alias("y"))))
        elif f.kind == "Bag":
            c = F.from_json(c, f.spark_type())
        else:
            c = c.cast(f.spark_type())
        out.append(c.alias(name))
    return df.select(*out)


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    """Trip records by position, the header skipped, with pick-up and drop-off points."""
    columns = "vendor_id int, pickup timestamp, dropoff timestamp, passenger_count int, trip_distance double, px double, py double, dx double, dy double, fare double, tip double, total double"
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return spark.read.schema(columns).csv(path, header=True, enforceSchema=True).withColumn("pickup_point", point("px", "py")).withColumn("dropoff_point", point("dx", "dy")).drop("px", "py", "dx", "dy")


_RING = "array<array<array<double>>>"


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of a FeatureCollection: the properties, each polygon's outer ring, and its bounds; a row for each polygon of several."""
    shape = f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>>"
    features = spark.read.schema(shape).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    text = F.col("f.geometry.coordinates")
    polygons = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json(text, f"array<{_RING}>")).otherwise(F.array(F.from_json(text, _RING)))
    ring = F.transform(F.get("polygon", F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    rings = features.withColumn("polygon", F.explode(polygons)).select("f.properties.*", ring.alias("ring"))
    return rings.withColumns({"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)})


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(region, day, confirmed, deaths, recovered) of CSV lines in that order, the header skipped; lines without a region are left out."""
    rows = spark.read.schema("region long, last_update timestamp, confirmed long, deaths long, recovered long").csv(path, header=True, enforceSchema=True)
    return rows.where("region is not null").select("region", F.to_date("last_update").alias("day"), "confirmed", "deaths", "recovered")


def cases_between(cases: DataFrame, region: int, start: object, end: object) -> DataFrame:
    """A region's cases from day ``start`` to ``end``, both included."""
    return cases.where((F.col("region") == region) & F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def total_cases(cases: DataFrame, day: object) -> DataFrame:
    """(confirmed, deaths, recovered) of all regions on a day: where a region's last report is earlier, that report counts."""
    day = F.lit(day).cast("date")
    last = cases.groupBy("region").agg(F.max("day").alias("__last"))
    own = cases.join(last, "region").where(F.col("day") == F.least("__last", day))
    return own.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("confirmed", "deaths", "recovered")])


def parse_point(c: Column) -> Column:
    """``point(x y)``, in any case, as a struct; null for anything else."""
    number = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
    pattern = rf"(?i)^\s*point\s*\(\s*{number}[\s,]+{number}\s*\)\s*$"
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).cast("double").alias("x"), F.regexp_extract(c, pattern, 2).cast("double").alias("y")))


def parse_line_box(c: Column) -> Column:
    """The bounds of ``LINESTRING(x y, x y, ...)``; null for anything else."""
    inner = F.regexp_extract(c, r"(?i)^\s*linestring\s*\(([^()]*)\)\s*$", 1)
    points = F.transform(F.split(F.trim(inner), r"\s*,\s*"), lambda p: F.split(p, r"\s+"))
    xs, ys = F.transform(points, lambda p: p[0].try_cast("double")), F.transform(points, lambda p: F.get(p, F.lit(1)).try_cast("double"))
    box = F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))
    return F.when(inner != "", box)


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, href): the targets of the links in raw pages, in order and with repeats."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']+)["']"""), 1)).alias("href"))


#: Times to the microsecond, which Spark's own default would cut off.
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def as_json(df: DataFrame) -> DataFrame:
    """(value): each row as JSON, null fields left out."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), JSON_TIMES).alias("value"))


def json_rows(df: DataFrame) -> Iterator[str]:
    """The rows as JSON, one partition at a time in the driver."""
    return (r["value"] for r in as_json(df).toLocalIterator())


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**JSON_TIMES).json(path)


def pack_pins(df: DataFrame) -> bytes:
    """Rows (id, x, y) as a count and packed big-endian records of 8 bytes id, 8 bytes x, 8 bytes y; for results that a client draws."""
    out = bytearray()
    n = 0
    for r in df.select(F.col("id").cast("long"), F.col("x").cast("double"), F.col("y").cast("double")).na.drop().toLocalIterator():
        out += struct.pack(">qdd", *r)
        n += 1
    return struct.pack(">q", n) + bytes(out)


def unpack_pins(raw: bytes) -> list[tuple[int, float, float]]:
    (n,) = struct.unpack_from(">q", raw)
    return [struct.unpack_from(">qdd", raw, 8 + 24 * i) for i in range(n)]
