"""JSON requests to IR."""

from __future__ import annotations

import json

from vistaframe.errors import JsonRequestError
from vistaframe.ir import Aggregate, Append, By, Filter, Group, Lookup, Option, Query, Request, Select
from vistaframe.types import ALL_RELATIONS, RELATIONS

UNITS = ("second", "minute", "hour", "day", "week", "month", "year")
GROUP_FUNCS = ("bin", "level", "interval", "geoCellTenth", "geoCellHundredth", "geoCellThousandth")
AGGREGATES = ("count", "sum", "max", "min", "avg", "topK", "distinctCount")


def _get(j, key: str, kind: type | tuple[type, ...], default=...):
    if not isinstance(j, dict):
        raise JsonRequestError(f"an object is expected instead of {j!r}")
    if key not in j:
        if default is ...:
            raise JsonRequestError(f"key {key} is missing in {json.dumps(j, default=str)}")
        return default
    if not isinstance(j[key], kind) or isinstance(j[key], bool) and kind is int:
        raise JsonRequestError(f"key {key} has the wrong kind of value: {j[key]!r}")
    return j[key]


def _strings(j, key: str, default=...) -> tuple[str, ...]:
    found = _get(j, key, list, default)
    if any(not isinstance(x, str) for x in found):
        raise JsonRequestError(f"{key} must list strings")
    return tuple(found)


def _filter(j) -> Filter:
    relation = _get(j, "relation", str)
    if relation not in ALL_RELATIONS:
        raise JsonRequestError(f"unknown relation: {relation}")
    values = _get(j, "values", list, [])
    point = relation == "inRange" and all(isinstance(v, list) and len(v) == 2 for v in values)
    if any(isinstance(v, (list, dict)) for v in values) and not point:
        raise JsonRequestError(f"unknown data type in values: {values}")
    apply = j.get("apply")
    if apply is not None:
        apply = _get(apply, "name", str)
        if apply != "toString":
            raise JsonRequestError(f"unknown transform function: {apply}")
    return Filter(_get(j, "field", str), relation, tuple(tuple(v) if isinstance(v, list) else v for v in values), apply)


def _lookup(j) -> Lookup:
    return Lookup(_strings(j, "joinKey"), _get(j, "dataset", str), _strings(j, "lookupKey"), _strings(j, "select"), _strings(j, "as"), bool(j.get("firstMatch", False)))


def _append(j) -> Append:
    kind = _get(j, "type", str)
    if kind not in RELATIONS:
        raise JsonRequestError(f"unknown data type: {kind}")
    return Append(_get(j, "field", str), _get(j, "definition", str), kind, _get(j, "as", str))


def _by(j) -> By:
    name, apply = _get(j, "field", str), j.get("apply")
    if apply is None:
        return By(name, name=_get(j, "as", str, name))
    func, args = _get(apply, "name", str), _get(apply, "args", dict, {})
    if func not in GROUP_FUNCS:
        raise JsonRequestError(f"unknown group function: {func}")
    if func == "interval":
        if _get(args, "unit", str) not in UNITS:
            raise JsonRequestError(f"unknown time unit: {args['unit']}")
        if _get(args, "x", int, 1) < 1:
            raise JsonRequestError("x must be 1 at least")
        if args.get("mode", "truncate") not in ("truncate", "component", "text"):
            raise JsonRequestError(f"unknown mode: {args['mode']}")
    elif func == "bin":
        if _get(args, "scale", (int, float)) <= 0:
            raise JsonRequestError("scale must be positive")
    elif func == "level":
        _get(args, "level", str)
    return By(name, func, tuple(sorted(args.items())), _get(j, "as", str, f"{func}({name})"))


def _aggregate(j) -> Aggregate:
    apply = _get(j, "apply", dict)
    func = _get(apply, "name", str)
    if func not in AGGREGATES:
        raise JsonRequestError(f"unknown aggregate function: {func}")
    k = _get(_get(apply, "args", dict), "k", int) if func == "topK" else 0
    if func == "topK" and k < 1:
        raise JsonRequestError("k must be 1 at least")
    return Aggregate(_get(j, "field", str), func, _get(j, "as", str), k)


def _query(j) -> Query:
    unnest = []
    for x in _get(j, "unnest", list, []):
        if not isinstance(x, dict) or len(x) != 1 or not all(isinstance(v, str) for v in x.values()):
            raise JsonRequestError("each unnest names one field and what its elements are called")
        unnest += x.items()
    group = select = glob = None
    if (g := _get(j, "group", dict, None)) is not None:
        group = Group(tuple(map(_by, _get(g, "by", list))), tuple(map(_aggregate, _get(g, "aggregate", list))), tuple(map(_lookup, _get(g, "lookup", list, []))))
    if (s := _get(j, "select", dict, None)) is not None:
        select = Select(_strings(s, "order"), _get(s, "limit", int), _get(s, "offset", int), _strings(s, "field", []))
        if select.limit < 0 or select.offset < 0:
            raise JsonRequestError("limit and offset must not be negative")
    if (x := _get(j, "global", dict, None)) is not None:
        glob = _aggregate(_get(x, "globalAggregate", dict))
    return Query(
        _get(j, "dataset", str), tuple(map(_append, _get(j, "append", list, []))), tuple(map(_lookup, _get(j, "lookup", list, []))),
        tuple(map(_filter, _get(j, "filter", list, []))), tuple(unnest), group, select, glob, _get(j, "estimable", bool, False),
    )


def parse(request: str | dict) -> Request:
    """A request of one query or a batch. In a sliced batch a limit needs aggregates."""
    try:
        j = json.loads(request) if isinstance(request, str) else request
    except ValueError as e:
        raise JsonRequestError(f"not JSON: {e}") from e
    o = _get(j, "option", dict, {})
    option = Option(_get(o, "sliceMillis", int, -1), _get(o, "continueSeconds", int, -1), _get(o, "returnDelta", bool, False))
    transform = _get(j, "transform", dict, None)
    if transform is not None:
        wrap = _get(transform, "wrap", dict)
        _get(wrap, "id", str), _get(wrap, "category", str)
    batch = "batch" in j
    queries = tuple(map(_query, _get(j, "batch", list) if batch else [j]))
    if not queries:
        raise JsonRequestError("the batch is empty")
    if batch and option.slice_millis > 0 and any(q.select and q.select.limit and not q.group for q in queries):
        raise JsonRequestError("a sliced batch can't have a limit without aggregates")
    return Request(queries, option, batch, transform)


def to_json(q: Query) -> dict:
    """The JSON form of a query; ``parse`` reads it back."""

    def lookup(x: Lookup) -> dict:
        return {"joinKey": list(x.join_key), "dataset": x.dataset, "lookupKey": list(x.lookup_key), "select": list(x.select), "as": list(x.names), "firstMatch": x.first_match}

    def aggregate(a: Aggregate) -> dict:
        return {"field": a.field, "apply": {"name": a.func, **({"args": {"k": a.k}} if a.k else {})}, "as": a.name}

    out: dict = {"dataset": q.dataset, "estimable": q.estimable}
    out["append"] = [{"field": a.field, "definition": a.definition, "type": a.kind, "as": a.name} for a in q.append]
    out["lookup"] = [lookup(x) for x in q.lookup]
    out["filter"] = [{"field": f.field, "relation": f.relation, "values": [list(v) if isinstance(v, tuple) else v for v in f.values], **({"apply": {"name": f.apply}} if f.apply else {})} for f in q.filter]
    out["unnest"] = [{a: b} for a, b in q.unnest]
    if q.group:
        by = [{"field": b.field, **({"apply": {"name": b.func, "args": dict(b.args)}} if b.func else {}), "as": b.name} for b in q.group.by]
        out["group"] = {"by": by, "aggregate": [aggregate(a) for a in q.group.aggregates], "lookup": [lookup(x) for x in q.group.lookups]}
    if q.select:
        out["select"] = {"order": list(q.select.order), "limit": q.select.limit, "offset": q.select.offset, "field": list(q.select.fields)}
    if q.glob:
        out["global"] = {"globalAggregate": aggregate(q.glob)}
    return out
