"""Checks a query against the schemas, clause by clause in the order of evaluation."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from vistaframe.errors import FieldNotFound, QueryParsingError
from vistaframe.ir import Aggregate, Filter, Lookup, Query
from vistaframe.types import RELATIONS, Field, Schema

ARITY = {"=": 1, "!=": 1, "<=": 1, ">=": 1, "<": 1, ">": 1, "inRange": 2, "startsWith": 1, "endsWith": 1, "matches": 1, "~=": 1, "isNull": 0, "isNotNull": 0, "true": 0, "false": 0}
NEEDS = {"bin": ("Number",), "level": ("Hierarchy",), "interval": ("Time",), "geoCellTenth": ("Point",), "geoCellHundredth": ("Point",), "geoCellThousandth": ("Point",)}
NEEDS |= {"sum": ("Number",), "avg": ("Number",), "min": ("Number", "Time"), "max": ("Number", "Time")}


def parse_time(text) -> datetime:
    """An ISO instant as naive UTC."""
    try:
        t = datetime.fromisoformat(text)
    except (TypeError, ValueError) as e:
        raise QueryParsingError(f"invalid time: {text!r}") from e
    return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t


def _literals(f: Filter, kind: str) -> None:
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    if f.relation in ARITY and len(f.values) != ARITY[f.relation]:
        raise QueryParsingError(f"relation {f.relation} requires {ARITY[f.relation]} values, not {len(f.values)}")
    if f.relation in ("in", "contains") and not f.values:
        raise QueryParsingError(f"relation {f.relation} requires values")
    if kind == "Time":
        for v in f.values:
            parse_time(v)
    elif kind == "Point":
        if not all(isinstance(v, tuple) and len(v) == 2 and all(map(number, v)) for v in f.values):
            raise QueryParsingError("a range of points is two pairs of numbers")
    elif kind == "Number":
        if not all(map(number, f.values)):
            raise QueryParsingError(f"field {f.field} requires numbers, not {f.values}")
    elif kind in ("String", "Text") and not all(isinstance(v, str) for v in f.values):
        raise QueryParsingError(f"field {f.field} requires strings, not {f.values}")


def check_filter(f: Filter, field: Field) -> None:
    kind = field.kind
    if kind == "Hierarchy":
        raise QueryParsingError("a hierarchy can't be filtered")
    if f.apply == "toString":
        if kind != "Number":
            raise QueryParsingError("toString requires type Number")
        kind = "String"
    if f.relation not in RELATIONS[kind]:
        raise QueryParsingError(f"field {f.field} of type {kind} can't be related by {f.relation}")
    _literals(f, field.inner or "String" if kind == "Bag" else kind)


def validate(q: Query, schema_of: Callable[[str], Schema], allow_lookup_scan: bool = False) -> dict[str, Field]:
    """The fields that the query's result has, or all that are in scope if it neither groups nor selects."""
    schema = schema_of(q.dataset)
    if schema.time_field is None and not allow_lookup_scan:
        raise QueryParsingError(f"dataset {q.dataset} is a lookup dataset and can't be queried by itself")
    scope = dict(schema.fields)

    def find(name: str) -> Field:
        if name == "*":
            return Field("*", "Record")
        if name not in scope:
            raise FieldNotFound(name)
        return scope[name]

    def look_up(x: Lookup) -> None:
        if len(x.join_key) != len(x.lookup_key) or not x.join_key:
            raise QueryParsingError("lookup keys and join keys must be as many, and one at least")
        if len(x.select) != len(x.names):
            raise QueryParsingError("a lookup needs a name for each selected field")
        other = schema_of(x.dataset).fields
        for name in (*x.lookup_key, *x.select):
            if name not in other:
                raise FieldNotFound(name)
        for name in x.join_key:
            find(name)
        for name, new in zip(x.select, x.names):
            scope[new] = Field(new, other[name].kind, True, other[name].inner)

    def check_aggregate(a: Aggregate) -> Field:
        field = find(a.field)
        if a.func in NEEDS and field.kind not in NEEDS[a.func]:
            raise QueryParsingError(f"{a.func} requires type {' or '.join(NEEDS[a.func])}, not {field.kind}")
        if a.func in ("topK", "distinctCount") and field.kind in ("Record", "Hierarchy"):
            raise QueryParsingError(f"{a.func} requires a field")
        if a.func == "topK":
            return Field(a.name, "Bag", inner=field.inner or field.kind)
        return Field(a.name, field.kind if a.func in ("min", "max") else "Number")

    for a in q.append:
        find(a.field)
        scope[a.name] = Field(a.name, a.kind, True)
    for x in q.lookup:
        look_up(x)
    for bag, name in q.unnest:
        if find(bag).kind != "Bag":
            raise QueryParsingError(f"field {bag} can't be unnested; it is no bag")
        scope[name] = Field(name, scope[bag].inner or "String")
    for f in q.filter:
        check_filter(f, find(f.field))
    if q.group:
        if not q.group.by or not q.group.aggregates:
            raise QueryParsingError("a group needs keys and aggregates")
        made: dict[str, Field] = {}
        for b in q.group.by:
            field = find(b.field)
            if b.func and field.kind not in NEEDS[b.func]:
                raise QueryParsingError(f"{b.func} requires type {NEEDS[b.func][0]}, not {field.kind}")
            kind = field.kind
            if b.func == "level":
                levels = dict(field.levels)
                if dict(b.args)["level"] not in levels:
                    raise QueryParsingError(f"level {dict(b.args)['level']} is not found in {b.field}")
                kind = find(levels[dict(b.args)["level"]]).kind
            elif b.func == "interval" and dict(b.args).get("mode") == "component":
                kind = "Number"
            elif not b.func and kind in ("Hierarchy", "Record", "Bag"):
                raise QueryParsingError(f"field {b.field} of type {kind} can't be a key by itself")
            made[b.name] = Field(b.name, kind, True)
        for a in q.group.aggregates:
            made[a.name] = check_aggregate(a)
        scope.clear()
        scope |= made
        for x in q.group.lookups:
            look_up(x)
    if q.select:
        for o in q.select.order:
            field = find(o.removeprefix("-"))
            if field.kind in ("Bag", "Hierarchy", "Record"):
                raise QueryParsingError(f"can't order by {o}")
        if q.select.fields and "*" not in q.select.fields:
            chosen = {n: find(n) for n in q.select.fields}
            scope.clear()
            scope |= chosen
    if q.glob:
        return {q.glob.name: check_aggregate(q.glob)}
    return scope
