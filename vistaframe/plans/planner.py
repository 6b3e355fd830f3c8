"""Which part of a query a view answers, and which views would help."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from vistaframe.ir import Filter, Query
from vistaframe.plans.validate import parse_time


INSTANT = timedelta(microseconds=1)


@dataclass(frozen=True)
class Part:
    """A query on one table over [start, end) of the time field, open where None; ``nulls`` takes rows without a time too."""

    query: Query
    start: datetime | None = None
    end: datetime | None = None
    nulls: bool = False


def words(f: Filter) -> set[str]:
    return {p for v in f.values for p in v.lower().split()}


def covers(view: Filter, asked: Filter, is_text: bool) -> bool:
    """Whether every row that satisfies ``asked`` satisfies ``view``."""
    if view.field != asked.field or view.apply != asked.apply:
        return False
    if is_text and view.relation == asked.relation == "contains":
        return words(view) <= words(asked)
    return view == asked


def solves(view: Query, q: Query, text_fields: set[str]) -> bool:
    """A view that only filters the same dataset solves a query if each of its filters covers one of the query's."""
    if view.dataset != q.dataset or view.group or view.unnest or view.select or view.lookup or view.append or view.glob:
        return False
    return all(any(covers(v, f, v.field in text_fields) for f in q.filter) for v in view.filter)


def time_range(q: Query, time_field: str) -> tuple[datetime | None, datetime | None]:
    """The bounds [start, end) that the time filters set; those of one microsecond for an equality."""
    start = end = None
    for f in q.filter:
        if f.field != time_field:
            continue
        if f.relation == "inRange":
            lo, hi = map(parse_time, f.values)
        elif f.relation in ("=", "matches"):
            lo = parse_time(f.values[0])
            hi = lo + INSTANT
        elif f.relation in (">", ">="):
            lo, hi = parse_time(f.values[0]) + (INSTANT if f.relation == ">" else timedelta(0)), None
        elif f.relation in ("<", "<="):
            lo, hi = None, parse_time(f.values[0]) + (INSTANT if f.relation == "<=" else timedelta(0))
        else:
            continue
        start = lo if start is None or lo and lo > start else start
        end = hi if end is None or hi and hi < end else end
    return start, end


def split(q: Query, view: Query, view_name: str, seen_until: datetime, time_field: str, text_fields: set[str]) -> list[Part]:
    """The view for what it has seen, and the dataset for later rows and, unless the query bounds time, for rows without one."""
    start, end = time_range(q, time_field)
    rest = tuple(f for f in q.filter if not any(covers(f, v, f.field in text_fields) for v in view.filter))
    parts = []
    if start is None or start < seen_until:
        parts.append(Part(replace(q, dataset=view_name, filter=rest), None, seen_until))
    bounded = any(f.field == time_field for f in q.filter)
    if end is None or end > seen_until or not bounded:
        parts.append(Part(q, seen_until, None, not bounded))
    return parts


def suggest(q: Query, text_fields: set[str], known: list[Query]) -> list[Query]:
    """A view for each word of the query's text filters, if none solves the query yet."""
    if any(solves(v, q, text_fields) for v in known):
        return []
    out = []
    for f in q.filter:
        if f.field in text_fields and f.relation == "contains":
            out += [Query(q.dataset, filter=(Filter(f.field, "contains", (w,)),)) for w in sorted(words(f))]
    return [v for v in dict.fromkeys(out) if v not in known]


def view_name(view: Query) -> str:
    key = json.dumps([[f.field, f.apply, f.relation, sorted(map(str, f.values))] for f in view.filter])
    return f"{view.dataset}_{hashlib.md5(key.encode()).hexdigest()}"
