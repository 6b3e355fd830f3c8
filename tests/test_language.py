"""Parsing and validation."""

import pytest

from vistaframe.errors import FieldNotFound, JsonRequestError, QueryParsingError, UnknownDataset
from vistaframe.plans.parser import parse, to_json
from vistaframe.plans.validate import validate
from vistaframe.queries import SCHEMAS
from vistaframe.types import Schema

KNOWN = {n: Schema.from_json(s) for n, s in SCHEMAS.items()}


def schema_of(name):
    if name not in KNOWN:
        raise UnknownDataset(name)
    return KNOWN[name]


def check(request, **more):
    return [validate(q, schema_of, **more) for q in parse(request).queries]


COUNT = {"field": "*", "apply": {"name": "count"}, "as": "n"}


@pytest.mark.parametrize(
    "request_",
    [
        "{", "[]", {}, {"batch": []}, {"dataset": 3},
        {"dataset": "events", "filter": [{"field": "ts", "relation": "near", "values": []}]},
        {"dataset": "events", "filter": [{"field": "value", "relation": "=", "values": [[1, 2]]}]},
        {"dataset": "events", "filter": [{"field": "value", "relation": "=", "values": [1], "apply": {"name": "upper"}}]},
        {"dataset": "events", "group": {"by": [{"field": "ts", "apply": {"name": "interval", "args": {"unit": "eon"}}}], "aggregate": [COUNT]}},
        {"dataset": "events", "group": {"by": [{"field": "value", "apply": {"name": "log"}}], "aggregate": [COUNT]}},
        {"dataset": "events", "group": {"by": [{"field": "value", "apply": {"name": "bin", "args": {"scale": 0}}}], "aggregate": [COUNT]}},
        {"dataset": "events", "group": {"by": [{"field": "value"}], "aggregate": [{"field": "*", "apply": {"name": "median"}, "as": "m"}]}},
        {"dataset": "events", "group": {"by": [{"field": "value"}], "aggregate": [{"field": "value", "apply": {"name": "topK", "args": {"k": 0}}, "as": "m"}]}},
        {"dataset": "events", "select": {"order": [], "limit": 1}}, {"dataset": "events", "select": {"order": [], "limit": -1, "offset": 0}},
        {"dataset": "events", "append": [{"field": "value", "definition": "1", "type": "Money", "as": "x"}]}, {"dataset": "events", "unnest": [{"a": "b", "c": "d"}]},
        {"batch": [{"dataset": "events", "select": {"order": [], "limit": 5, "offset": 0}}], "option": {"sliceMillis": 100}},
    ],
)
def test_malformed(request_):
    with pytest.raises(JsonRequestError):
        parse(request_)


F = lambda field, relation, *values, **more: {"dataset": more.pop("dataset", "events"), "filter": [{"field": field, "relation": relation, "values": list(values), **more}]}


@pytest.mark.parametrize(
    "request_",
    [
        F("value", "contains", "x"), F("value", "=", 1, 2), F("value", "inRange", 1), F("value", "=", "x"), F("value", "in"), F("ts", "in", "2020-01-01"), F("ts", "<", "yesterday"), F("event_type", "<", "a"), F("event_type", "=", 4),
        F("props", "=", "x"), F("event_type", "startsWith", "x", apply={"name": "toString"}), F("ts", "isNull", 1), F("geo", "=", "x", dataset="orders_geo"), F("at", "inRange", 1, 2, dataset="points"),
        {"dataset": "events", "unnest": [{"value": "v"}]}, {"dataset": "events", "group": {"by": [], "aggregate": [COUNT]}}, {"dataset": "events", "group": {"by": [{"field": "value"}], "aggregate": []}},
        {"dataset": "events", "group": {"by": [{"field": "event_type", "apply": {"name": "bin", "args": {"scale": 2}}}], "aggregate": [COUNT]}},
        {"dataset": "events", "group": {"by": [{"field": "value"}], "aggregate": [{"field": "event_type", "apply": {"name": "sum"}, "as": "x"}]}},
        {"dataset": "orders_geo", "group": {"by": [{"field": "geo", "apply": {"name": "level", "args": {"level": "planet"}}}], "aggregate": [COUNT]}},
        {"dataset": "orders", "lookup": [{"joinKey": ["o_custkey"], "dataset": "customer", "lookupKey": [], "select": [], "as": []}]},
        {"dataset": "orders", "lookup": [{"joinKey": ["o_custkey"], "dataset": "customer", "lookupKey": ["c_custkey"], "select": ["c_name"], "as": []}]},
    ],
)
def test_unfit(request_):
    with pytest.raises(QueryParsingError):
        check(request_, allow_lookup_scan=True)


def test_unknown_names():
    for r in (F("nope", "isNull"), {"dataset": "events", "select": {"order": ["nope"], "limit": 1, "offset": 0}}, {"dataset": "events", "group": {"by": [{"field": "event_type"}], "aggregate": [COUNT]}, "select": {"order": ["-ts"], "limit": 1, "offset": 0}}):
        with pytest.raises(FieldNotFound):
            check(r)
    with pytest.raises(UnknownDataset):
        check({"dataset": "nope"})
    with pytest.raises(QueryParsingError):
        check({"dataset": "customer"})
    assert set(check({"dataset": "customer"}, allow_lookup_scan=True)[0]) >= {"c_name"}


def test_round_trip():
    r = {
        "dataset": "orders", "append": [{"field": "o_totalprice", "definition": "o_totalprice * 2", "type": "Number", "as": "twice"}],
        "lookup": [{"joinKey": ["o_custkey"], "dataset": "customer", "lookupKey": ["c_custkey"], "select": ["c_name"], "as": ["name"]}],
        "filter": [{"field": "twice", "relation": "inRange", "values": [1, 2.5]}, {"field": "o_custkey", "relation": "matches", "values": ["7"], "apply": {"name": "toString"}}],
        "group": {"by": [{"field": "o_orderdate", "apply": {"name": "interval", "args": {"unit": "hour", "x": 6}}, "as": "t"}], "aggregate": [COUNT, {"field": "name", "apply": {"name": "topK", "args": {"k": 3}}, "as": "top"}]},
        "select": {"order": ["-n"], "limit": 3, "offset": 1, "field": ["t", "n"]}, "global": {"globalAggregate": COUNT}, "estimable": True,
    }
    q = parse(r).queries[0]
    assert parse(to_json(q)).queries[0] == q
    assert list(check(r)[0]) == ["n"]


def test_schema():
    s = KNOWN["orders_geo"]
    assert Schema.from_json(s.to_json()) == s
    nested = Schema.from_json({"typeName": "t", "dimension": [{"name": "a.b", "datatype": "Number"}, {"name": "t", "datatype": "Time"}], "measurement": [{"name": "bag", "datatype": "Bag", "innerType": "String", "isOptional": True}], "primaryKey": ["a.b"], "timeField": "t"})
    assert nested.struct().simpleString() == "struct<a:struct<b:double>,t:timestamp,bag:array<string>>"
    with pytest.raises(FieldNotFound):
        Schema.from_json({"typeName": "t", "dimension": [], "measurement": [], "primaryKey": ["x"]})
    with pytest.raises(QueryParsingError):
        Schema.from_json({"typeName": "t", "dimension": [{"name": "x", "datatype": "String"}], "measurement": [], "primaryKey": [], "timeField": "x"})
    with pytest.raises(JsonRequestError):
        Schema.from_json({"typeName": "t"})
