"""The engine on small tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vistaframe.engine import Cache, Engine
from vistaframe.errors import EngineError, QueryParsingError, RegistryError
from vistaframe.ir import Filter, Query
from vistaframe.plans.planner import view_name
from vistaframe.storage import write_by_time

SCHEMA = {
    "typeName": "t", "dimension": [{"name": "id", "datatype": "Number"}, {"name": "at", "datatype": "Time"}, {"name": "user.city", "datatype": "String", "isOptional": True}, {"name": "tags", "datatype": "Bag", "innerType": "String", "isOptional": True}],
    "measurement": [{"name": "text", "datatype": "Text"}, {"name": "v", "datatype": "Number"}], "primaryKey": ["id"], "timeField": "at",
}
T0 = datetime(2024, 1, 1)
COUNT = {"field": "*", "apply": {"name": "count"}, "as": "n"}
BY_CITY = {"by": [{"field": "user.city", "as": "city"}], "aggregate": [COUNT, {"field": "v", "apply": {"name": "avg"}, "as": "mean"}, {"field": "v", "apply": {"name": "distinctCount"}, "as": "d"}, {"field": "tags", "apply": {"name": "topK", "args": {"k": 2}}, "as": "top"}]}


def rows(n=60):
    out = []
    for i in range(n):
        at = None if i == 7 else T0 + timedelta(hours=7 * i)
        out.append((i, at, ("ab"[i % 2],) if i % 5 else None, None if i % 4 == 0 else ["x", "yz"[i % 2]], "River amber" if i % 3 == 0 else "river", float(i % 6) if i % 10 else None))
    return out


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, "id long, at timestamp_ntz, user struct<city: string>, tags array<string>, text string, v double")


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path), clock=lambda: datetime(2024, 2, 1))
    path = str(tmp_path / "data")
    table(spark).write.parquet(path)
    e.register({"dataset": "d", "schema": SCHEMA}, path)
    return e


def plain(df):
    return sorted((r.asDict(True) for r in df.collect()), key=str)


def test_registry(engine, spark, tmp_path):
    i = engine.registry.info("d")
    assert (i.start, i.end, i.stats.cardinality) == (T0, T0 + timedelta(hours=7 * 59), 60)
    with pytest.raises(RegistryError):
        engine.register({"dataset": "d", "schema": SCHEMA}, table(spark))
    with pytest.raises(RegistryError):
        engine.deregister({"dataset": "e"})
    again = Engine(spark, str(tmp_path))
    assert again.registry.info("d") == i and again.query({"dataset": "d"}).count() == 60
    assert engine.run({"dataset": "nope"}) == {"error": "dataset nope does not exist"}
    assert engine.deregister({"dataset": "d"}) == ["d"] and Engine(spark, str(tmp_path)).datasets() == []


def test_empty(spark):
    e = Engine(spark)
    e.register({"dataset": "d", "schema": SCHEMA}, table(spark, []))
    assert e.query({"dataset": "d", "group": BY_CITY}).collect() == []
    assert e.query({"dataset": "d", "global": {"globalAggregate": COUNT}}).first()["n"] == 0
    assert list(e.progressive({"dataset": "d", "group": BY_CITY, "option": {"sliceMillis": 10}, "filter": [{"field": "at", "relation": "inRange", "values": ["2024-01-01", "2024-01-03"]}]}))[-1]["value"] == []


def test_nested_nulls_and_wrap(engine):
    got = engine.run({"dataset": "d", "filter": [{"field": "user.city", "relation": "isNull", "values": []}], "global": {"globalAggregate": COUNT}, "transform": {"wrap": {"id": "q", "category": "c"}}})
    assert got == {"id": "q", "category": "c", "value": [{"n": 12}]}
    flat = engine.query({"dataset": "d", "select": {"order": ["-user.city", "id"], "limit": 2, "offset": 1, "field": ["id", "user.city"]}})
    assert flat.columns == ["id", "user.city"] and [tuple(r) for r in flat.collect()] == [(3, "b"), (7, "b")]
    tags = engine.query({"dataset": "d", "unnest": [{"tags": "tag"}], "group": {"by": [{"field": "tag"}], "aggregate": [COUNT]}})
    assert {r["tag"]: r["n"] for r in tags.collect()} == {"x": 45, "y": 15, "z": 30}


@pytest.mark.parametrize("extra", [{}, {"filter": [{"field": "at", "relation": "inRange", "values": ["2024-01-03", "2024-01-15"]}]}])
def test_slices_give_the_whole_answer(engine, extra):
    q = {"dataset": "d", "group": BY_CITY, **extra}
    q["filter"] = [*q.get("filter", []), {"field": "at", "relation": "isNotNull", "values": []}]
    whole = engine.query(q)
    parts = list(engine.progressive(q | {"option": {"sliceMillis": 1}}, least_hours=120))
    assert len(parts) > 2 and parts[-1]["progress"] == 1
    assert sorted(map(str, engine.run(q))) == sorted(map(str, parts[-1]["value"]))
    deltas = list(engine.progressive(q | {"option": {"sliceMillis": 1, "returnDelta": True}}, least_hours=240))
    assert sum(r["n"] for d in deltas for r in d["value"]) == whole.agg(F.sum("n")).first()[0]


def test_sliced_limit_stops_early(engine):
    q = {"dataset": "d", "select": {"order": ["-at"], "limit": 3, "offset": 0, "field": ["id"]}, "option": {"sliceMillis": 1}, "filter": [{"field": "at", "relation": "<", "values": ["2024-01-18T05:00:01"]}]}
    parts = list(engine.progressive(q))
    assert len(parts) == 1 and [r["id"] for r in parts[0]["value"]] == [59, 58, 57]
    done = list(engine.stream(q | {"transform": {"wrap": {"id": "1", "category": "x"}}}, sleep=lambda s: None))
    assert done[-1] == {"key": "done"} and done[0]["id"] == "1"
    with pytest.raises(QueryParsingError):
        next(engine.progressive({"dataset": "d"}))


def test_views(engine, spark):
    q = {"dataset": "d", "filter": [{"field": "text", "relation": "contains", "values": ["river", "amber"]}], "group": BY_CITY}
    before = plain(engine.query(q))
    assert engine.is_solvable_by_view(q) == [False]
    wanted = engine.suggest_views(q)
    assert [v.filter[0].values for v in wanted] == [("amber",), ("river",)]
    v = engine.create_view(wanted[0], until=T0 + timedelta(days=6))
    assert v.stats.cardinality < 20 and engine.is_solvable_by_view(q) == [True] and engine.suggest_views(q) == []
    assert plain(engine.query(q)) == before
    refreshed = engine.refresh_view(v.name)
    assert refreshed.stats.cardinality == 20 - 0 and refreshed.stats.modified == datetime(2024, 2, 1)
    assert plain(engine.query(q)) == before
    again = Engine(spark, engine.root, clock=engine.clock)
    assert again.best_view(again._checked(q).queries[0]).name == v.name and plain(again.query(q)) == before
    engine.drop_view(v.name)
    assert engine.is_solvable_by_view(q) == [False]
    with pytest.raises(EngineError):
        Engine(spark).create_view(wanted[0])
    assert v.name == view_name(Query("d", filter=(Filter("text", "contains", ("amber",)),)))


def test_changes(engine, spark):
    new = table(spark, [(1, T0, ("q",), [], "new", 1.0), (99, None, None, None, None, None), (99, None, None, None, "a", None)])
    assert engine.upsert("d", new).count() == 61 and engine.query({"dataset": "d", "filter": [{"field": "text", "relation": "contains", "values": ["new"]}]}).count() == 1
    # rows for which the condition is null stay
    assert engine.delete("d", [{"field": "v", "relation": "<", "values": [3]}]).where("v < 3").count() == 0
    assert engine.query({"dataset": "d", "filter": [{"field": "v", "relation": "isNull", "values": []}]}).count() == 7
    with pytest.raises(QueryParsingError):
        engine.delete("d", [])


def test_estimate(engine):
    q = {"dataset": "d", "estimable": True, "global": {"globalAggregate": COUNT}}
    engine.registry.tables["d"] = None  # it isn't read
    assert engine.run(q) == [{"n": 60}]


def test_cache(engine):
    now = [0.0]
    c = Cache(engine, 600, clock=lambda: now[0])
    q = {"dataset": "d", "global": {"globalAggregate": COUNT}}
    assert c.run(q) == [{"n": 60}]
    engine.registry.tables["d"] = engine.registry.table("d").limit(5)
    assert c.run(q) == [{"n": 60}]
    now[0] = 601
    assert c.run(q) == [{"n": 5}]


def test_udf_by_name_and_json_paths(engine, spark):
    """Functions registered with Spark, and any expression, in the definition of a derived column."""
    spark.udf.register("shout", lambda t: t.upper() if t else None, "string")
    q = {"dataset": "d", "append": [{"field": "text", "definition": "shout(text)", "type": "String", "as": "loud"}, {"field": "id", "definition": "cast(get_json_object(to_json(struct(id, v)), '$.id') as long)", "type": "Number", "as": "again"}], "filter": [{"field": "loud", "relation": "=", "values": ["RIVER AMBER"]}], "select": {"order": ["id"], "limit": 2, "offset": 0, "field": ["id", "again", "loud"]}}
    assert [tuple(r) for r in engine.query(q).collect()] == [(0, 0, "RIVER AMBER"), (3, 3, "RIVER AMBER")]


def test_several_unnests(engine):
    got = engine.query({"dataset": "d", "filter": [{"field": "id", "relation": "=", "values": [1]}], "unnest": [{"tags": "a"}, {"tags": "b"}]})
    assert sorted(map(tuple, got.collect())) == [("x", "x"), ("x", "z"), ("z", "x"), ("z", "z")]


def test_sliced_rows_keep_order_limit_offset_and_projection(engine):
    q = {"dataset": "d", "filter": [{"field": "at", "relation": "isNotNull", "values": []}], "select": {"order": ["-v", "id"], "limit": 5, "offset": 3, "field": ["id", "v"]}}
    sizes, kept = [], engine._kept
    engine._kept = lambda state: sizes.append(state.count()) or kept(state)
    parts = list(engine.progressive(q | {"option": {"sliceMillis": 1}}, least_hours=72))
    assert len(parts) > 3 and max(sizes) <= 8
    assert parts[-1]["value"] == engine.run(q) and len(engine.run(q)) == 5


def test_states_of_values(engine):
    """Several valued aggregates at once, of a text's words too, in slices and at once; null groups and values."""
    q = {"dataset": "d", "filter": [{"field": "at", "relation": "isNotNull", "values": []}], "group": {"by": [{"field": "user.city", "as": "city"}], "aggregate": [{"field": "text", "apply": {"name": "topK", "args": {"k": 2}}, "as": "words"}, {"field": "v", "apply": {"name": "topK", "args": {"k": 3}}, "as": "top"}, {"field": "v", "apply": {"name": "distinctCount"}, "as": "d"}, COUNT, {"field": "v", "apply": {"name": "sum"}, "as": "s"}, {"field": "v", "apply": {"name": "max"}, "as": "m"}]}}
    data = [r for r in rows() if r[1] is not None]
    want = {}
    for city in {r[2] for r in data}:
        mine = [r for r in data if r[2] == city]
        words, values = {}, {}
        for r in mine:
            for w in r[4].lower().split():
                words[w] = words.get(w, 0) + 1
            if r[5] is not None:
                values[r[5]] = values.get(r[5], 0) + 1
        top = lambda c, k: sorted(c, key=lambda x: (-c[x], x))[:k]
        want[city and city[0]] = (top(words, 2), top(values, 3), len(values), len(mine), sum(k * n for k, n in values.items()), max(values))
    assert {r["city"]: tuple(r)[1:] for r in engine.query(q).collect()} == want
    last = list(engine.progressive(q | {"option": {"sliceMillis": 1}}, least_hours=100))[-1]["value"]
    assert {r.get("city"): (r["words"], r["top"], r["d"], r["n"], r["s"], r["m"]) for r in last} == want


def test_tables_in_order_of_time(engine, spark, tmp_path):
    """A slice of time opens the folders of its days alone, rows without a time are kept, the folder column doesn't show."""
    path = str(tmp_path / "by_time")
    write_by_time(table(spark), path, F.col("at"))
    engine.register({"dataset": "t", "schema": SCHEMA}, path)
    assert engine.query({"dataset": "t"}).columns == ["id", "at", "user", "tags", "text", "v"] and engine.query({"dataset": "t"}).count() == 60
    q = {"dataset": "t", "filter": [{"field": "at", "relation": "inRange", "values": ["2024-01-03", "2024-01-04T12:00:00"]}], "select": {"order": ["id"], "limit": 0, "offset": 0, "field": ["id"]}}
    assert [r["id"] for r in engine.query(q).collect()] == [i for i in range(60) if i != 7 and timedelta(days=2) <= timedelta(hours=7 * i) < timedelta(days=3, hours=12)]
    plan = engine.query(q)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__day" in plan and "2024-01-03" in plan


def test_pushdown(engine):
    plan = engine.query({"dataset": "d", "filter": [{"field": "at", "relation": "<", "values": ["2024-01-05"]}, {"field": "v", "relation": ">", "values": [1]}], "group": {"by": [{"field": "v"}], "aggregate": [COUNT]}})._jdf.queryExecution().toString()
    assert "LessThan(at" in plan and "GreaterThan(v" in plan and "ReadSchema: struct<at:timestamp_ntz,v:double>" in plan
