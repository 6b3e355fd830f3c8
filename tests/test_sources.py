"""Sources and sinks on small files, and a database in memory."""

import json
import struct
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from vistaframe.errors import FieldNotFound
from vistaframe.sources import readers
from vistaframe.types import Schema

SCHEMA = {
    "typeName": "t", "dimension": [{"name": "id", "datatype": "Number"}, {"name": "seen", "datatype": "Time"}, {"name": "ok", "datatype": "Boolean"}, {"name": "at", "datatype": "Point", "isOptional": True}, {"name": "tags", "datatype": "Bag", "innerType": "String", "isOptional": True}, {"name": "user.name", "datatype": "String", "isOptional": True}],
    "measurement": [{"name": "text", "datatype": "Text", "isOptional": True}], "primaryKey": ["id"], "timeField": "seen",
}


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "id long, s string, v double")
    for form in ("parquet", "json", "csv", "orc"):
        path = str(tmp_path / form)
        df.coalesce(1).write.format(form).save(path)
        assert sorted(map(tuple, readers.read(spark, form, path, df.schema).collect())) == [(1, "a", 1.5), (2, None, None)]
    with pytest.raises(ValueError):
        readers.read(spark, "xls", "x")


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(i, datetime(2024, 1, 1, i % 24), i % 2, f"point({i}.5 -{i})" if i % 3 else f"LINESTRING(0 0, {i} 4)", '["x","y"]', f"n{i}", "Some text") for i in range(40)]
    table = spark.createDataFrame(rows, "ID long, SEEN timestamp, OK int, AT_ string, TAGS string, USER_NAME string, TEXT string").withColumnRenamed("AT_", "AT")
    table.write.format("jdbc").option("url", url).option("dbtable", "ROWS_").options(**driver).save()
    plain = readers.read_jdbc(spark, url, "ROWS_", **driver)
    assert plain.count() == 40 and len(plain.columns) == 7
    found = readers.read_jdbc(spark, url, "ROWS_", Schema.from_json(SCHEMA), "ID", (0, 40), 4, **driver)
    assert found.rdd.getNumPartitions() == 4
    assert found.columns == ["id", "seen", "ok", "at", "tags", "user.name", "text"]
    got = {r["id"]: r for r in found.collect()}
    assert len(got) == 40 and got[1]["ok"] is True and got[2]["ok"] is False
    assert tuple(got[4]["at"]) == (4.5, -4.0) and tuple(got[6]["at"]) == (3.0, 2.0) and got[4]["tags"] == ["x", "y"] and got[4]["user.name"] == "n4"
    with pytest.raises(ValueError):
        readers.read_jdbc(spark, url, "ROWS_", Schema.from_json(SCHEMA | {"measurement": [{"name": "more", "datatype": "Number"}]}), **driver)
    with pytest.raises(ValueError):
        readers.read_jdbc(spark, url, "ROWS_", column="ID", **driver)


def test_text_forms(spark):
    texts = ["point(1 2)", "POINT ( -1.5, 2e1 )", "point(1)", "LINESTRING(0 1, 4 -3)", "linestring (2 2,2 2)", "LINESTRING(a b, 1 2)", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", readers.parse_point(F.col("t")).alias("p"), readers.parse_line_box(F.col("t")).alias("b"))
    got = {r["i"]: (tuple(r["p"]) if r["p"] else None, tuple(r["b"]) if r["b"] else None) for r in df.collect()}
    assert got[0] == ((1.0, 2.0), None) and got[1] == ((-1.5, 20.0), None) and got[2] == (None, None)
    assert got[3] == (None, (0.0, -3.0, 4.0, 1.0)) and got[4] == (None, (2.0, 2.0, 2.0, 2.0)) and got[6] == got[7] == (None, None)


def test_trips(spark, tmp_path):
    head = "VendorID,pickup,dropoff,passenger_count,trip_distance,px,py,dx,dy,fare,tip,total\n"
    (tmp_path / "trips.csv").write_text(head + "2,2015-01-15 19:05:39,2015-01-15 19:23:42,1,1.59,-73.99,40.75,-73.97,40.76,12,3.25,17.05\n")
    (r,) = readers.read_trips(spark, str(tmp_path / "trips.csv")).collect()
    assert (r["vendor_id"], r["pickup"], tuple(r["pickup_point"]), tuple(r["dropoff_point"]), r["total"]) == (2, datetime(2015, 1, 15, 19, 5, 39), (-73.99, 40.75), (-73.97, 40.76), 17.05)


def test_geojson(spark, tmp_path):
    square = lambda x, y, d: [[[x, y], [x + d, y], [x + d, y + d], [x, y + d], [x, y]]]
    features = [
        {"type": "Feature", "properties": {"id": 1, "name": "one"}, "geometry": {"type": "Polygon", "coordinates": square(0, 0, 2)}},
        {"type": "Feature", "properties": {"id": 2, "name": "two"}, "geometry": {"type": "MultiPolygon", "coordinates": [square(5, 5, 1), square(-3, 0, 1.5)]}},
    ]
    (tmp_path / "r.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    got = readers.read_geojson(spark, str(tmp_path / "r.json"), "id: long, name: string").orderBy("id", "xmin").collect()
    assert [(r["id"], r["xmin"], r["ymin"], r["xmax"], r["ymax"], len(r["ring"])) for r in got] == [(1, 0, 0, 2, 2, 5), (2, -3, 0, -1.5, 1.5, 5), (2, 5, 5, 6, 6, 5)]


def test_cases(spark, tmp_path):
    (tmp_path / "c.csv").write_text("state_id,last_update,confirmed,deaths,recovered\n1,2020-03-01,5,0,0\n1,2020-03-02,8,1,0\n2,2020-03-01,2,0,1\n2,2020-03-04,9,2,1\n,2020-03-01,100,1,1\n")
    cases = readers.read_cases(spark, str(tmp_path / "c.csv"))
    assert cases.count() == 4
    assert [r["confirmed"] for r in readers.cases_between(cases, 1, "2020-03-02", date(2020, 3, 9)).collect()] == [8]
    assert tuple(readers.total_cases(cases, "2020-03-01").first()) == (7, 0, 1)
    assert tuple(readers.total_cases(cases, "2020-03-03").first()) == (8, 1, 0)  # region 2 has no report of that day, and a later one
    assert tuple(readers.total_cases(cases, "2020-03-09").first()) == (17, 3, 1)
    assert tuple(readers.total_cases(cases.limit(0), "2020-03-09").first()) == (0, 0, 0)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, -1.0), (2, None, 1.0), (3, 7.25, 2.0)], "id long, x double, y double")
    readers.write_json(df, str(tmp_path / "j"))
    assert sorted(map(tuple, readers.read(spark, "json", str(tmp_path / "j"), df.schema).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert [json.loads(x)["id"] for x in readers.json_rows(df)] == [1, 2, 3]
    raw = readers.pack_pins(df)
    assert len(raw) == 8 + 2 * 24 and struct.unpack_from(">q", raw) == (2,) and readers.unpack_pins(raw) == [(1, 0.5, -1.0), (3, 7.25, 2.0)]


def test_ddl(spark):
    schema = Schema.from_json(SCHEMA)
    spark.sql("drop table if exists made_rows")
    spark.sql(schema.ddl("made_rows"))
    try:
        fields = spark.table("made_rows").schema
        assert fields["id"].dataType.simpleString() in ("double", "bigint") and [f.name for f in fields] == ["id", "seen", "ok", "at", "tags", "user", "text"]
        assert {r["key"]: r["value"] for r in spark.sql("show tblproperties made_rows").collect()}["primaryKey"] == "id"
    finally:
        spark.sql("drop table made_rows")
    assert "`id`" in schema.ddl("x").split(" NOT NULL")[0] and "`text` string," not in schema.ddl("x").replace("`text` string)", "")
    with pytest.raises(FieldNotFound):
        Schema.from_json(SCHEMA | {"primaryKey": ["nope"]})
