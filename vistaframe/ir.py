"""Requests as data."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Append:
    field: str
    definition: str
    kind: str
    name: str


@dataclass(frozen=True)
class Lookup:
    join_key: tuple[str, ...]
    dataset: str
    lookup_key: tuple[str, ...]
    select: tuple[str, ...]
    names: tuple[str, ...]
    first_match: bool = False


@dataclass(frozen=True)
class Filter:
    field: str
    relation: str
    values: tuple = ()
    apply: str | None = None


@dataclass(frozen=True)
class By:
    field: str
    func: str | None = None
    args: tuple[tuple[str, object], ...] = ()
    name: str = ""


@dataclass(frozen=True)
class Aggregate:
    field: str
    func: str
    name: str
    k: int = 0


@dataclass(frozen=True)
class Group:
    by: tuple[By, ...]
    aggregates: tuple[Aggregate, ...]
    lookups: tuple[Lookup, ...] = ()


@dataclass(frozen=True)
class Select:
    order: tuple[str, ...]
    limit: int
    offset: int
    fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class Query:
    dataset: str
    append: tuple[Append, ...] = ()
    lookup: tuple[Lookup, ...] = ()
    filter: tuple[Filter, ...] = ()
    unnest: tuple[tuple[str, str], ...] = ()
    group: Group | None = None
    select: Select | None = None
    glob: Aggregate | None = None
    estimable: bool = False


@dataclass(frozen=True)
class Option:
    slice_millis: int = -1
    continue_seconds: int = -1
    return_delta: bool = False


@dataclass(frozen=True)
class Request:
    queries: tuple[Query, ...]
    option: Option = Option()
    batch: bool = False
    transform: dict | None = field(default=None, hash=False)
