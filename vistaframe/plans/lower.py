"""Queries to DataFrames: append, lookup, unnest, filter, group, lookup after grouping, select, global aggregate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistaframe.functions.columns import CELLS, all_words, bin_number, component, geo_cell, interval, interval_text, time_literal
from vistaframe.ir import Aggregate, By, Filter, Lookup, Query, Select
from vistaframe.plans.validate import parse_time
from vistaframe.storage import DAY
from vistaframe.types import Schema


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Scope:
    """A DataFrame, how each field is reached in it, and what kind it is."""

    df: DataFrame
    columns: dict[str, Column]
    kinds: dict[str, str]
    inner: dict[str, str | None] = field(default_factory=dict)
    levels: dict[str, dict[str, str]] = field(default_factory=dict)

    @staticmethod
    def of(df: DataFrame, schema: Schema) -> Scope:
        real = {n: f for n, f in schema.fields.items() if f.kind != "Hierarchy"}
        columns = {n: quoted(n) if n in df.columns else F.col(n) for n in real}
        kinds = {n: f.kind for n, f in schema.fields.items()}
        return Scope(df, columns, kinds, {n: f.inner for n, f in real.items()}, {n: dict(f.levels) for n, f in schema.fields.items() if f.levels})

    def is_ntz(self, name: str) -> bool:
        return isinstance(self.df.select(self.columns[name].alias("x")).schema["x"].dataType, T.TimestampNTZType)

    def put(self, df: DataFrame, name: str, kind: str, inner: str | None = None) -> None:
        self.df, self.columns[name], self.kinds[name], self.inner[name] = df, quoted(name), kind, inner


def condition(scope: Scope, f: Filter, text_mode: str = "substring") -> Column:
    c, kind, r, v = scope.columns[f.field], scope.kinds[f.field], f.relation, f.values
    if f.apply == "toString":
        c, kind = c.cast("string"), "String"
    if r == "isNull":
        return c.isNull()
    if r == "isNotNull":
        return c.isNotNull()
    if kind == "Text":
        return all_words(c, v, text_mode)
    if kind == "Boolean":
        return c.cast("boolean") if r == "true" else ~c.cast("boolean")
    if kind == "Point":
        (x0, y0), (x1, y1) = v
        return c["x"].between(min(x0, x1), max(x0, x1)) & c["y"].between(min(y0, y1), max(y0, y1))
    if kind == "Bag":
        return reduce(lambda a, b: a & b, [F.array_contains(c, x) for x in v])
    if kind == "Time":
        ntz = scope.is_ntz(f.field)
        v = tuple(time_literal(parse_time(x), ntz) for x in v)
    if r == "in":
        return c.isin(*v)
    if r == "inRange":
        return (c >= v[0]) & (c < v[1])
    if r in ("=", "matches"):
        return c == v[0]
    if r == "contains":
        return reduce(lambda a, b: a & b, [F.lower(c).contains(x.lower()) for x in v])
    simple = {"!=": lambda: c != v[0], "<": lambda: c < v[0], "<=": lambda: c <= v[0], ">": lambda: c > v[0], ">=": lambda: c >= v[0], "startsWith": lambda: c.startswith(v[0]), "endsWith": lambda: c.endswith(v[0]), "~=": lambda: c.rlike(v[0])}
    return simple[r]()


def look_up(scope: Scope, x: Lookup, table: DataFrame, schema: Schema, nth: int) -> None:
    """Left outer join; with ``first_match`` each row gets one partner at most, the smallest by the selected columns."""
    other = Scope.of(table, schema)
    keys = [f"_key{nth}_{i}" for i in range(len(x.join_key))]
    right = other.df.select(*[other.columns[k].alias(a) for k, a in zip(x.lookup_key, keys)], *[other.columns[s].alias(f"_new{nth}_{i}") for i, s in enumerate(x.select)])
    if x.first_match:
        rest = [c for c in right.columns if c not in keys]
        right = right.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_first")).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])
    joined = scope.df.join(right, reduce(lambda a, b: a & b, [scope.columns[j] == right[a] for j, a in zip(x.join_key, keys)]), "left").drop(*keys)
    for i, (s, name) in enumerate(zip(x.select, x.names)):
        joined = (joined.drop(quoted(name)) if name in joined.columns else joined).withColumnRenamed(f"_new{nth}_{i}", name)
        scope.put(joined, name, other.kinds[s], other.inner[s])


def group_key(scope: Scope, b: By) -> Column:
    args = dict(b.args)
    if b.func == "level":
        return scope.columns[scope.levels[b.field][args["level"]]]
    c = scope.columns[b.field]
    if b.func == "interval":
        if args.get("mode") == "text":
            return interval_text(c, args["unit"])
        return component(c, args["unit"]) if args.get("mode") == "component" else interval(c, args["unit"], int(args.get("x", 1)), scope.is_ntz(b.field))
    if b.func == "bin":
        return bin_number(c, args["scale"])
    if b.func in CELLS:
        return geo_cell(c, b.func, args.get("mode") == "truncate")
    return c


def prepare(q: Query, table: Callable[[str], DataFrame], schema_of: Callable[[str], Schema], text_mode: str = "substring", extra: Callable[[Scope], Column] | None = None) -> Scope:
    """The rows before grouping. ``extra`` is a condition of the planner's own on the dataset, which the scan can use."""
    scope = Scope.of(table(q.dataset), schema_of(q.dataset))
    if extra is not None:
        scope.df = scope.df.where(extra(scope))
    # the folder column of a table written in order of time
    scope.df = scope.df.drop(DAY)
    for a in q.append:
        scope.put(scope.df.withColumn(a.name, F.expr(a.definition)), a.name, a.kind)
    for i, x in enumerate(q.lookup):
        look_up(scope, x, table(x.dataset), schema_of(x.dataset), i)
    for bag, name in q.unnest:
        scope.put(scope.df.withColumn(name, F.explode(scope.columns[bag])), name, scope.inner.get(bag) or "String")
    if q.filter:
        scope.df = scope.df.where(reduce(lambda a, b: a & b, [condition(scope, f, text_mode) for f in q.filter]))
    return scope


def _plain_states(a: Aggregate) -> list[tuple[str, str]]:
    """(column, how it merges) of an aggregate whose state is a few numbers."""
    if a.func in VALUED:
        return []
    if a.func == "avg":
        return [(f"__sum__{a.name}", "sum"), (f"__count__{a.name}", "sum")]
    return [(a.name, "sum" if a.func in ("count", "sum") else a.func)]


#: Aggregates whose state is the different values of a group: one row for each, with how often it occurs.
VALUED = ("distinctCount", "topK")
MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def _valued(aggregates: tuple[Aggregate, ...]) -> list[Aggregate]:
    return [a for a in aggregates if a.func in VALUED]


def _simple(a: Aggregate, c: Column | None) -> Column:
    if a.func == "count":
        return F.count(F.lit(1)) if c is None else F.count(c)
    return {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "distinctCount": F.count_distinct}[a.func](c)


def _elements(scope: Scope, a: Aggregate) -> Column:
    """The values of a row as an array, nulls left out: for topK of a bag its elements count, and for a text its words."""
    c, kind = scope.columns[a.field], scope.kinds[a.field]
    if a.func == "topK" and kind == "Bag":
        c = F.coalesce(c, F.array())
    elif a.func == "topK" and kind == "Text":
        c = F.coalesce(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""), F.array())
    else:
        c = F.array(c)
    return F.filter(c, lambda v: v.isNotNull())


def _one_plain(scope: Scope, valued: list[Aggregate]) -> bool:
    return len(valued) == 1 and not (valued[0].func == "topK" and scope.kinds[valued[0].field] in ("Bag", "Text"))


def _by_value(keyed: Scope, valued: list[Aggregate]) -> DataFrame:
    """The rows with ``__kind`` and a column of values for each valued aggregate.

    A single aggregate of plain fields keeps its rows as they are, with kind 1. Else a row of kind 0 carries the other
    aggregates' fields, and rows of kind i the values of the i-th valued one, all in one pass.
    """
    a = valued[0]
    if _one_plain(keyed, valued):
        return keyed.df.withColumns({"__kind": F.lit(1), f"__value__{a.name}": keyed.columns[a.field]})
    found = [_elements(keyed, a) for a in valued]
    types = [f.dataType.elementType for f in keyed.df.select(*[c.alias(f"v{i}") for i, c in enumerate(found)]).schema]

    def struct(kind: int, value: Column | None = None) -> Column:
        cells = [(value if i == kind else F.lit(None).cast(t)).alias(f"v{i}") for i, t in enumerate(types, 1)]
        return F.struct(F.lit(kind).alias("kind"), *cells)

    def each(kind: int, values: Column) -> Column:
        return F.transform(values, lambda v: struct(kind, v))

    out = keyed.df.withColumn("__e", F.explode(F.concat(F.array(struct(0)), *[each(i, c) for i, c in enumerate(found, 1)])))
    return out.withColumns({"__kind": F.col("__e.kind"), **{f"__value__{a.name}": F.col(f"__e.v{i}") for i, a in enumerate(valued, 1)}}).drop("__e")


def aggregate(scope: Scope, keys: list[tuple[str, Column]], aggregates: tuple[Aggregate, ...], partial: bool = False) -> DataFrame:
    """Groups in one pass. A partial state has, for each group, a row for each different value of the valued aggregates, with ``__n``."""
    names = [n for n, _ in keys]
    clash = {n: f"__group{i}" for i, n in enumerate(names)}
    hidden = [clash[n] for n in names]
    keyed = Scope(scope.df.select("*", *[c.alias(clash[n]) for n, c in keys]), scope.columns, scope.kinds, scope.inner, scope.levels)
    valued = _valued(aggregates)
    if not partial and any(a.func == "topK" for a in valued):
        return settle(aggregate(scope, keys, aggregates, True), names, aggregates)
    if not (partial and valued):
        aggs = []
        for a in aggregates:
            c = None if a.field == "*" else keyed.columns[a.field]
            if partial and a.func == "avg":
                aggs += [F.sum(c).alias(f"__sum__{a.name}"), F.count(c).alias(f"__count__{a.name}")]
            else:
                aggs.append(_simple(a, c).alias(a.name))
        order = [n for a in aggregates for n, _ in _plain_states(a)] if partial else [a.name for a in aggregates]
        return keyed.df.groupBy(*hidden).agg(*aggs).select(*[F.col(clash[n]).alias(n) for n in names], *map(quoted, order))
    rows = _by_value(keyed, valued)
    aggs = [F.count(F.lit(1)).alias("__n")]
    # rows of other kinds hold values alone
    carrier = 1 if _one_plain(keyed, valued) else 0
    own = lambda c: F.when(F.col("__kind") == carrier, c)
    for a in aggregates:
        if a.func in VALUED:
            continue
        c = own(F.lit(1) if a.field == "*" else keyed.columns[a.field])
        if a.func == "avg":
            aggs += [F.sum(c).alias(f"__sum__{a.name}"), F.count(c).alias(f"__count__{a.name}")]
        else:
            aggs.append(_simple(a, c).alias(a.name))
    values = [f"__value__{a.name}" for a in valued]
    out = rows.groupBy(*hidden, "__kind", *map(quoted, values)).agg(*aggs)
    return out.select(*[F.col(clash[n]).alias(n) for n in names], "__kind", *map(quoted, values), "__n", *[quoted(n) for a in aggregates for n, _ in _plain_states(a)])


def merge(parts: list[DataFrame], keys: list[str], aggregates: tuple[Aggregate, ...]) -> DataFrame:
    """Partial states of the same groups, made one state, in one pass."""
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    valued = _valued(aggregates)
    own = [*keys, "__kind", *[f"__value__{a.name}" for a in valued]] if valued else keys
    aggs = [MERGE[m](quoted(n)).alias(n) for a in aggregates for n, m in _plain_states(a)]
    if valued:
        aggs.append(F.sum("__n").alias("__n"))
    out = rows.groupBy(*map(quoted, own)).agg(*aggs) if aggs else rows.groupBy(*map(quoted, own)).agg(F.count(F.lit(1)).alias("__rows"))
    return out.select(*map(quoted, rows.columns))


def settle(state: DataFrame, keys: list[str], aggregates: tuple[Aggregate, ...]) -> DataFrame:
    """The aggregates that a merged state stands for; an average of nothing is null, ties of topK go to the smaller value.

    Of a group's values at most k are ever brought together.
    """
    valued = _valued(aggregates)
    out, k = state, [F.col(f"`{x}`") for x in keys]
    if valued:
        aggs = [MERGE[m](quoted(n)).alias(n) for a in aggregates for n, m in _plain_states(a)]
        aggs += [F.count(F.when(F.col("__kind") == i, quoted(f"__value__{a.name}"))).alias(f"__distinct__{a.name}") for i, a in enumerate(valued, 1) if a.func == "distinctCount"]
        out = state.groupBy(*k).agg(*(aggs or [F.count(F.lit(1)).alias("__rows")]))
    for i, a in enumerate(valued, 1):
        if a.func == "topK":
            value = quoted(f"__value__{a.name}")
            order = Window.partitionBy(*k).orderBy(F.desc("__n"), value)
            best = state.where((F.col("__kind") == i) & value.isNotNull()).select(*k, value.alias("__v"), "__n").withColumnRenamed("__v", f"__value__{a.name}")
            best = best.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= a.k)
            listed = F.array_sort(F.collect_list(F.struct("__rank", value.alias("value"))))
            best = best.groupBy(*k).agg(F.transform(listed, lambda e: e["value"]).alias(f"__top__{a.name}"))
            if keys:
                same = reduce(lambda x, y: x & y, [out[f"`{n}`"].eqNullSafe(best[f"`{n}`"]) for n in keys])
                out = out.join(best, same, "left").select(*[out[f"`{c}`"] for c in out.columns], best[f"`__top__{a.name}`"])
            else:  # one row each
                out = out.withColumn("__one", F.lit(1)).join(best.withColumn("__one", F.lit(1)), "__one").drop("__one")

    def value_of(a: Aggregate) -> Column:
        if a.func == "avg":
            return F.when(quoted(f"__count__{a.name}") > 0, quoted(f"__sum__{a.name}") / quoted(f"__count__{a.name}"))
        if a.func == "distinctCount":
            return quoted(f"__distinct__{a.name}")
        if a.func == "topK":
            return F.coalesce(quoted(f"__top__{a.name}"), F.array())
        return quoted(a.name)

    return out.select(*map(quoted, keys), *[value_of(a).alias(a.name) for a in aggregates])


def select(scope: Scope, s: Select) -> None:
    """Order, offset, limit (0 means none) and projection."""
    if s.order:
        scope.df = scope.df.orderBy(*[scope.columns[o[1:]].desc() if o.startswith("-") else scope.columns[o].asc() for o in s.order])
    if s.offset:
        scope.df = scope.df.offset(s.offset)
    if s.limit:
        scope.df = scope.df.limit(s.limit)
    if s.fields and "*" not in s.fields:
        scope.df = scope.df.select(*[scope.columns[n].alias(n) for n in s.fields])
        for n in s.fields:
            scope.columns[n] = quoted(n)


def grouped_scope(df: DataFrame, q: Query, before: Scope) -> Scope:
    columns = {n: quoted(n) for n in df.columns}
    kinds = {}
    for b in q.group.by:
        kinds[b.name] = before.kinds[before.levels[b.field][dict(b.args)["level"]]] if b.func == "level" else before.kinds[b.field]
    for a in q.group.aggregates:
        kinds[a.name] = before.kinds[a.field] if a.func in ("min", "max") else "Bag" if a.func == "topK" else "Number"
    return Scope(df, columns, kinds)


def finish(scope: Scope, q: Query, table, schema_of) -> DataFrame:
    """What follows grouping."""
    for i, x in enumerate(q.group.lookups if q.group else ()):
        look_up(scope, x, table(x.dataset), schema_of(x.dataset), 100 + i)
    if q.select:
        select(scope, q.select)
    if q.glob:
        # a count counts rows, whatever its field
        a = q.glob if q.glob.func != "count" else Aggregate("*", "count", q.glob.name)
        return aggregate(scope, [], (a,))
    if not q.group and not q.select and q.unnest:
        # an unnesting query without a projection gives what it made
        made = [*(a.name for a in q.append), *(n for x in q.lookup for n in x.names), *(n for _, n in q.unnest)]
        return scope.df.select(*[scope.columns[n].alias(n) for n in dict.fromkeys(made)])
    return scope.df


def lower(q: Query, table: Callable[[str], DataFrame], schema_of: Callable[[str], Schema], text_mode: str = "substring", extra=None) -> DataFrame:
    scope = prepare(q, table, schema_of, text_mode, extra)
    if q.group:
        scope = grouped_scope(aggregate(scope, [(b.name, group_key(scope, b)) for b in q.group.by], q.group.aggregates), q, scope)
    return finish(scope, q, table, schema_of)


def lower_partial(q: Query, table, schema_of, text_mode: str = "substring", extra=None) -> tuple[DataFrame, Scope]:
    """The part of the answer that can be merged: states of groups, or rows; and the scope that ``conclude`` needs."""
    scope = prepare(q, table, schema_of, text_mode, extra)
    if not q.group:
        return scope.df, scope
    return aggregate(scope, [(b.name, group_key(scope, b)) for b in q.group.by], q.group.aggregates, partial=True), scope


def combine(q: Query, parts: list[DataFrame]) -> DataFrame:
    if q.group:
        return merge(parts, [b.name for b in q.group.by], q.group.aggregates)
    return reduce(lambda a, b: a.unionByName(b), parts)


def trim(q: Query, state: DataFrame, scope: Scope) -> DataFrame:
    """Of the rows of a query without groups only those that its order, limit and offset can still reach."""
    s = q.select
    if q.group or not s or not s.limit:
        return state
    if s.order:
        state = state.orderBy(*[scope.columns[o[1:]].desc() if o.startswith("-") else scope.columns[o].asc() for o in s.order])
    return state.limit(s.limit + s.offset)


def conclude(q: Query, state: DataFrame, before: Scope, table, schema_of) -> DataFrame:
    if q.group:
        return finish(grouped_scope(settle(state, [b.name for b in q.group.by], q.group.aggregates), q, before), q, table, schema_of)
    return finish(Scope(state, before.columns, before.kinds, before.inner, before.levels), q, table, schema_of)
