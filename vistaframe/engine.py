"""The engine: JSON requests in, DataFrames, rows or progressive answers out."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaframe.errors import EngineError, JsonRequestError, QueryParsingError, UnknownDataset
from vistaframe.functions.columns import time_literal
from vistaframe.ir import Filter, Lookup, Option, Query, Request
from vistaframe.operators.dml import delete, upsert
from vistaframe.plans import planner, slicing
from vistaframe.plans.lower import Scope, combine, conclude, condition, lower, lower_partial, trim
from vistaframe.plans.parser import parse
from vistaframe.plans.validate import check_filter, validate
from vistaframe.registry import Info, Registry, Stats, measure, utc_now
from vistaframe.sources.readers import as_json
from vistaframe.storage import DAY, read_files, shared_folder, write_by_time
from vistaframe.types import Schema


class Engine:
    def __init__(self, spark: SparkSession, root: str | None = None, allow_lookup_scan: bool = False, text_mode: str = "substring", use_views: bool = True, clock: Callable[[], datetime] = utc_now) -> None:
        self.spark, self.root, self.allow_lookup_scan, self.text_mode, self.use_views, self.clock = spark, root, allow_lookup_scan, text_mode, use_views, clock
        self.registry = Registry(spark, f"{root}/registry" if root else None, clock)
        #: how often rows or datasets have changed; answers kept from before are out of date
        self.changes = 0

    # datasets

    def register(self, request: str | dict, source: DataFrame | str) -> Info:
        """Registers ``{"dataset": name, "schema": {...}}`` with its rows, a DataFrame or a Parquet path."""
        j = json.loads(request) if isinstance(request, str) else request
        if "dataset" not in j or "schema" not in j:
            raise JsonRequestError("a registration needs dataset and schema")
        self.changes += 1
        return self.registry.register(j["dataset"], Schema.from_json(j["schema"]), source)

    def deregister(self, request: str | dict) -> list[str]:
        j = json.loads(request) if isinstance(request, str) else request
        self.changes += 1
        return self.registry.deregister(j["dataset"])

    def datasets(self) -> list[Info]:
        return self.registry.datasets()

    # queries

    def _text_fields(self, dataset: str) -> set[str]:
        return {n for n, f in self.registry.schema(dataset).fields.items() if f.kind == "Text"}

    def _checked(self, request: str | dict | Request) -> Request:
        r = request if isinstance(request, Request) else parse(request)
        for q in r.queries:
            validate(q, self.registry.schema, self.allow_lookup_scan)
        return r

    def best_view(self, q: Query) -> Info | None:
        """Of the views that solve a query the one with the fewest rows."""
        if not self.use_views or not q.filter:
            return None
        text = self._text_fields(q.dataset)
        fit = [v for v in self.registry.views(q.dataset) if planner.solves(v.query, q, text)]
        return min(fit, key=lambda v: (v.stats.cardinality, v.name), default=None)

    def is_solvable_by_view(self, request: str | dict) -> list[bool]:
        return [self.best_view(q) is not None for q in self._checked(request).queries]

    def _plan(self, q: Query) -> list[planner.Part]:
        view = self.best_view(q)
        field = self.registry.schema(q.dataset).time_field
        if view is None or field is None:
            # the bounds that the query's own filters set let the scan leave out folders of days
            bounds = planner.time_range(q, field) if field and DAY in self.registry.table(q.dataset).columns else (None, None)
            return [planner.Part(q, *bounds)]
        self.registry.put(replace(view, stats=replace(view.stats, read=self.clock())))
        return planner.split(q, view.query, view.name, view.stats.modified, field, self._text_fields(q.dataset))

    def _between(self, dataset: str, start: datetime | None, end: datetime | None, nulls: bool = False) -> Callable[[Scope], Column] | None:
        field = self.registry.schema(dataset).time_field
        if field is None or start is None and end is None:
            return None

        def bound(scope: Scope) -> Column:
            c, ntz = scope.columns[field], scope.is_ntz(field)
            out = F.lit(True)
            if start is not None:
                out = out & (c >= time_literal(start, ntz))
            if end is not None:
                out = out & (c < time_literal(end, ntz))
            if nulls:
                out = out | c.isNull()
            if DAY in scope.df.columns:  # folders that can hold such rows
                day = F.lit(True)
                if start is not None:
                    day = day & (F.col(DAY) >= F.lit(start.date()))
                if end is not None:
                    day = day & (F.col(DAY) <= F.lit(end.date()))
                out = out & (day | F.col(DAY).isNull() if nulls else day)
            return out

        return bound

    def _partials(self, q: Query, start: datetime | None = None, end: datetime | None = None) -> tuple[list[DataFrame], Scope]:
        parts, scope = [], None
        for p in self._plan(q):
            lo = max((x for x in (p.start, start) if x is not None), default=None)
            hi = min((x for x in (p.end, end) if x is not None), default=None)
            if lo is not None and hi is not None and lo >= hi:
                continue
            state, scope = lower_partial(p.query, self.registry.table, self.registry.schema, self.text_mode, self._between(p.query.dataset, lo, hi, p.nulls and start is None))
            parts.append(state)
        if not parts:
            state, scope = lower_partial(q, self.registry.table, self.registry.schema, self.text_mode, lambda s: F.lit(False))
            parts.append(state)
        return parts, scope

    def estimate(self, q: Query) -> DataFrame | None:
        """A count from statistics: the rows last counted and those expected since. Only for an unfiltered estimable count."""
        if not (q.estimable and q.glob and q.glob.func == "count") or q.filter or q.group or q.unnest or q.lookup or (q.select and (q.select.limit or q.select.offset)):
            return None
        s = self.registry.info(q.dataset).stats
        n = s.cardinality + int(s.rate * max(0.0, (self.clock() - s.modified).total_seconds()))
        return self.spark.createDataFrame([(n,)], f"`{q.glob.name}` long")

    def _answer(self, q: Query) -> DataFrame:
        guess = self.estimate(q)
        if guess is not None:
            return guess
        plan = self._plan(q)
        if len(plan) == 1:
            p = plan[0]
            return lower(p.query, self.registry.table, self.registry.schema, self.text_mode, self._between(p.query.dataset, p.start, p.end, p.nulls))
        parts, scope = self._partials(q)
        return conclude(q, combine(q, parts), scope, self.registry.table, self.registry.schema)

    def query(self, request: str | dict | Request) -> DataFrame | list[DataFrame]:
        """The lazy answer: a DataFrame, or one for each query of a batch."""
        r = self._checked(request)
        answers = [self._answer(q) for q in r.queries]
        return answers if r.batch else answers[0]

    def run(self, request: str | dict) -> object:
        """The rows as JSON values; ``transform.wrap`` adds id and category. Unknown datasets give an error value."""
        try:
            r = self._checked(request)
        except UnknownDataset as e:
            return {"error": str(e)}
        found = [_rows(self._answer(q)) for q in r.queries]
        return _wrapped(found if r.batch else found[0], r.transform)

    # progressive answers

    def _bounds(self, queries: tuple[Query, ...]) -> tuple[datetime, datetime]:
        lows, highs = [], []
        for q in queries:
            info = self.registry.info(q.dataset)
            start, end = planner.time_range(q, info.schema.time_field)
            lows.append(start or info.start or datetime(1970, 1, 1))
            highs.append(end or self.clock())
        return min(lows), max(highs)

    def progressive(self, request: str | dict | Request, first: timedelta = timedelta(days=2), least_hours: int = 24, clock: Callable[[], float] = time.monotonic, cancelled: Callable[[], bool] = lambda: False) -> Iterator[dict]:
        """Answers that grow as slices of time, the newest first, are added.

        Each has ``value`` (the rows so far, or with returnDelta those of the slice), ``timeInterval`` and
        ``progress``. States, not answers, are merged, so that the last one is the answer in full; rows without a
        time belong to none. A single ungrouped query with a limit that is ordered by time from the newest on stops
        when it has enough rows. Merged states are kept in the shared folder.
        """
        r = self._checked(request)
        pace = r.option.slice_millis
        if pace <= 0:
            raise QueryParsingError("option.sliceMillis must be positive")
        for q in r.queries:
            if self.registry.schema(q.dataset).time_field is None:
                raise QueryParsingError(f"dataset {q.dataset} has no time field to slice by")
        start, end = self._bounds(r.queries)
        if start >= end:
            yield {"value": [[] for _ in r.queries] if r.batch else [], "timeInterval": _interval(start, end), "progress": 1.0}
            return
        states: list[DataFrame | None] = [None] * len(r.queries)
        latest: list[list] = [[] for _ in r.queries]

        def work(lo: datetime, hi: datetime) -> bool:
            for i, q in enumerate(r.queries):
                parts, scope = self._partials(q, lo, hi)
                state = combine(q, parts)
                if not r.option.return_delta and states[i] is not None:
                    state = combine(q, [states[i], state])
                states[i] = self._kept(trim(q, state, scope))
                latest[i] = _rows(conclude(q, states[i], scope, self.registry.table, self.registry.schema))
            return cancelled() or self._enough(r.queries, latest) and not r.option.return_delta

        for lo, hi, share in slicing.slices(start, end, pace, work, first, least_hours, clock=clock):
            value = latest if r.batch else latest[0]
            yield {"value": value, "timeInterval": _interval(lo if r.option.return_delta else lo, hi if r.option.return_delta else end), "progress": share}
            if cancelled():
                return

    def _kept(self, state: DataFrame) -> DataFrame:
        """The state with its lineage cut, so that slices don't pile up in one plan."""
        shared_folder(self.spark)
        return state.checkpoint()

    def _enough(self, queries: tuple[Query, ...], latest: list[list]) -> bool:
        if len(queries) > 1:
            return False
        q, field = queries[0], self.registry.schema(queries[0].dataset).time_field
        newest = q.select and not q.group and not q.glob and q.select.limit and q.select.order[:1] == (f"-{field}",)
        return bool(newest) and len(latest[0]) >= q.select.limit

    def stream(self, request: str | dict, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Iterator[object]:
        """Progressive answers at the requested pace, wrapped, and {"key": "done"} at the end."""
        r = self._checked(request)
        for a in slicing.paced(self.progressive(r, clock=clock), r.option.slice_millis, clock, sleep):
            yield a if a.get("key") == "done" else _wrapped(a, r.transform)

    # views

    def suggest_views(self, request: str | dict) -> list[Query]:
        out: list[Query] = []
        for q in self._checked(request).queries:
            known = [v.query for v in self.registry.views(q.dataset)]
            out += [v for v in planner.suggest(q, self._text_fields(q.dataset), known + out) if v not in out]
        return out

    def _path(self, name: str) -> str:
        if not self.root:
            raise EngineError("views need a root folder")
        return f"{self.root}/views/{name}"

    def create_view(self, view: Query, until: datetime | None = None) -> Info:
        """Writes the rows of a filter query that lie before ``until`` (now) as a view, in order of time."""
        schema = self.registry.schema(view.dataset)
        if schema.time_field is None or not view.filter or view.group or view.select or view.unnest or view.lookup or view.append:
            raise QueryParsingError("a view filters a temporal dataset")
        return self._write_view(planner.view_name(view), view, schema, until or self.clock())

    def _write_view(self, name: str, view: Query, schema: Schema, until: datetime, rows: DataFrame | None = None) -> Info:
        """A new version of the view's files; without ``rows`` it is made from the dataset. The last version but one is removed."""
        if rows is None:
            rows = lower(view, self.registry.table, self.registry.schema, self.text_mode, self._between(view.dataset, None, until))
        old = self.registry.infos.get(name)
        version = int(old.path.rsplit("/", 1)[1]) + 1 if old and old.path else 0
        path = f"{self._path(name)}/{version}"
        write_by_time(rows, path, Scope.of(rows, schema).columns[schema.time_field])
        self.registry.remove(f"{self._path(name)}/{version - 2}")
        df = read_files(self.spark, path, rows.schema)
        start, end, n = measure(df, schema)
        self.registry.tables[name] = df
        self.registry.put(Info(name, schema, start, end, Stats(old.stats.created if old else self.clock(), until, self.clock(), n), view, path))
        return self.registry.infos[name]

    def refresh_view(self, name: str, until: datetime | None = None, overlap: timedelta = timedelta(0)) -> Info:
        """Upserts what the dataset has since the view's last time, less ``overlap`` for late rows, by primary key."""
        info, until = self.registry.info(name), until or self.clock()
        delta = lower(info.query, self.registry.table, self.registry.schema, self.text_mode, self._between(info.query.dataset, info.stats.modified - overlap, until))
        merged = upsert(self.registry.table(name).drop(DAY), delta, list(info.schema.primary_key))
        return self._write_view(name, info.query, info.schema, until, merged)

    def drop_view(self, name: str) -> None:
        if name in self.registry.infos:
            self.registry.drop(name)

    # changes

    def _changed(self, name: str, df: DataFrame) -> DataFrame:
        """Puts rows in the place of a dataset's: with a root as a new version that later sessions see. Its statistics are taken again, its views written again."""
        info, now = self.registry.info(name), self.clock()
        field = info.schema.time_field
        if self.root:
            path = f"{self.root}/data/{name}/{uuid.uuid4().hex}"
            if field:
                write_by_time(df, path, Scope.of(df, info.schema).columns[field])
            else:
                df.write.parquet(path)
            df, info = read_files(self.spark, path, df.schema), replace(info, path=path)
        self.registry.tables[name] = df
        if field:
            start, end, n = measure(df, info.schema)
            info = replace(info, start=start, end=end, stats=replace(info.stats, modified=now, cardinality=n))
        self.registry.put(info)
        for v in self.registry.views(name):
            if self.root:
                self._write_view(v.name, v.query, v.schema, v.stats.modified)
            else:
                self.registry.drop(v.name)
        self.changes += 1
        return df.drop(DAY)

    def upsert(self, name: str, rows: DataFrame) -> DataFrame:
        """The dataset with the rows in place of those of the same primary key; it stands for the dataset from now on."""
        keys = list(self.registry.schema(name).primary_key)
        return self._changed(name, upsert(self.registry.table(name).drop(DAY), rows, keys))

    def delete(self, name: str, filters: list[dict] | tuple[Filter, ...]) -> DataFrame:
        """The dataset without the rows that satisfy all filters; it stands for the dataset from now on."""
        parsed = tuple(f for f in (parse({"dataset": name, "filter": list(filters)}).queries[0].filter if filters and isinstance(filters[0], dict) else filters))
        schema = self.registry.schema(name)
        for f in parsed:
            if f.field not in schema.fields:
                raise QueryParsingError(f"field {f.field} is not found")
            check_filter(f, schema.fields[f.field])
        scope = Scope.of(self.registry.table(name).drop(DAY), schema)
        which = None
        for f in parsed:
            c = condition(scope, f, self.text_mode)
            which = c if which is None else which & c
        return self._changed(name, delete(scope.df, which))


class Cache:
    """Answers by request for ``max_age`` seconds, or until a dataset changes; an open end of a time range within that age is left out of the key."""

    def __init__(self, engine: Engine, max_age: float = 600, most: int = 1000, clock: Callable[[], float] = time.time) -> None:
        self.engine, self.max_age, self.most, self.clock = engine, max_age, most, clock
        self.held: dict[str, tuple[float, object]] = {}

    def _key(self, j: dict) -> str:
        now = datetime.fromtimestamp(self.clock(), timezone.utc).replace(tzinfo=None)

        def plain(x):
            if isinstance(x, dict):
                if x.get("relation") == "inRange" and len(x.get("values", [])) == 2:
                    try:
                        end = datetime.fromisoformat(x["values"][1]).replace(tzinfo=None)
                    except (TypeError, ValueError):
                        return {k: plain(v) for k, v in x.items()}
                    if timedelta(0) <= now - end < timedelta(seconds=self.max_age):
                        return {**x, "values": x["values"][:1]}
                return {k: plain(v) for k, v in x.items() if k != "transform"}
            return [plain(v) for v in x] if isinstance(x, list) else x

        return json.dumps(plain(j), sort_keys=True)

    def run(self, request: str | dict) -> object:
        j = json.loads(request) if isinstance(request, str) else request
        key, now = f"{self.engine.changes} {self._key(j)}", self.clock()
        if key not in self.held or now - self.held[key][0] > self.max_age:
            while len(self.held) >= self.most:
                self.held.pop(next(iter(self.held)))
            self.held[key] = now, self.engine.run({k: v for k, v in j.items() if k != "transform"})
        return _wrapped(self.held[key][1], j.get("transform"))


def _interval(start: datetime, end: datetime) -> dict:
    return {"start": start.isoformat(), "end": end.isoformat()}


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(r["value"]) for r in as_json(df).collect()]


def _wrapped(value: object, transform: dict | None) -> object:
    if not transform:
        return value
    return {"id": transform["wrap"]["id"], "category": transform["wrap"]["category"], "value": value}


__all__ = ["Cache", "Engine", "Filter", "Lookup", "Option", "Query"]
