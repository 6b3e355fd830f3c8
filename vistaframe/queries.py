"""A query for each operator on the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaframe.caches import SeriesCache
from vistaframe.engine import Engine
from vistaframe.functions.columns import similarity_jaccard, word_tokens
from vistaframe.ir import Filter, Query
from vistaframe.operators import geo, sampling
from vistaframe.plans.lower import combine, conclude
from vistaframe.plans.parser import parse
from vistaframe.sources.readers import page_links, read, write_json
from vistaframe.storage import shared_folder, write_by_time
from vistaframe.streaming import ingest

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}


def _f(name: str, kind: str, **more) -> dict:
    return {"name": name, "datatype": kind, **more}


def _schema(type_name: str, dims: list, meas: list, key: list[str], time: str | None = None) -> dict:
    return {"typeName": type_name, "dimension": dims, "measurement": meas, "primaryKey": key, **({"timeField": time} if time else {})}


def _n(*names: str) -> list[dict]:
    return [_f(n, "Number") for n in names]


def _s(*names: str) -> list[dict]:
    return [_f(n, "String") for n in names]


_GEO = _f("geo", "Hierarchy", innerType="String", levels=[{"level": "region", "field": "r_name"}, {"level": "nation", "field": "n_name"}, {"level": "customer", "field": "c_name"}])
SCHEMAS = {
    "events": _schema("event", [_f("ts", "Time"), *_n("event_id", "user_id"), *_s("event_type")], [*_n("value"), _f("props", "Text")], ["event_id"], "ts"),
    "orders": _schema("order", [_f("o_orderdate", "Time"), *_n("o_orderkey", "o_custkey"), *_s("o_orderstatus", "o_orderpriority")], _n("o_totalprice"), ["o_orderkey"], "o_orderdate"),
    "lineitem": _schema("line", [_f("l_shipdate", "Time"), *_n("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), *_s("l_returnflag", "l_linestatus")], _n("l_quantity", "l_extendedprice", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber"], "l_shipdate"),
    "customer": _schema("customer", [*_n("c_custkey", "c_nationkey"), *_s("c_name", "c_mktsegment")], _n("c_acctbal"), ["c_custkey"]),
    "nation": _schema("nation", [*_n("n_nationkey", "n_regionkey"), *_s("n_name")], [], ["n_nationkey"]),
    "region": _schema("region", [*_n("r_regionkey"), *_s("r_name")], [], ["r_regionkey"]),
    "part": _schema("part", [*_n("p_partkey", "p_size"), *_s("p_name", "p_brand", "p_type")], _n("p_retailprice"), ["p_partkey"]),
    "labels": _schema("label", _n("doc_id"), _n("quality", "toxic"), ["doc_id"]),
    "documents": _schema("document", [*_n("doc_id"), *_s("lang", "source"), _f("words", "Bag", innerType="String")], [_f("text", "Text"), *_n("n_chars")], ["doc_id"]),
    "points": _schema("point", [*_n("vec_id", "label"), _f("at", "Point")], [], ["vec_id"]),
    "orders_geo": _schema("order", [_f("o_orderdate", "Time"), *_n("o_orderkey"), *_s("r_name", "n_name", "c_name"), _GEO], _n("o_totalprice"), ["o_orderkey"], "o_orderdate"),
}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    if name == "documents":
        words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
        return read("documents").withColumn("words", words)
    if name == "points":
        at = F.struct(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
        return read("embeddings").select("vec_id", "label", at.alias("at"))
    if name == "orders_geo":
        o, c, n, r = read("orders"), read("customer"), read("nation"), read("region")
        return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("o_orderkey", "o_orderdate", "o_totalprice", "c_name", "n_name", "r_name")
    return read(name)


def engine(spark: SparkSession, sf: str, names: list[str] | None = None, **options) -> Engine:
    """An engine with the driver's tables; statistics are taken for those that are named alone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = Engine(spark, allow_lookup_scan=True, **options)
    for n in names or SCHEMAS:
        e.register({"dataset": n, "schema": SCHEMAS[n]}, _table(spark, sf, n))
    return e


def _used(j: dict) -> list[str]:
    found = [j["dataset"], *(x["dataset"] for x in j.get("lookup", [])), *(x["dataset"] for x in j.get("group", {}).get("lookup", []))]
    return list(dict.fromkeys(found))


def ask(name: str, request: dict, sql: str, digits: dict[str, int] | None = None, post: Callable[[DataFrame], DataFrame] | None = None, **options) -> None:
    """Registers a JSON query; ``digits`` rounds sums of floats, whose last digits depend on the order of addition."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = engine(spark, sf, _used(request), **options).query(request)
        for c, d in (digits or {}).items():
            df = df.withColumn(c, F.round(c, d))
        return post(df) if post else df

    QUERIES[name], ORACLE_SQL[name] = run, sql


def _flt(field: str, relation: str, *values, **more) -> dict:
    return {"field": field, "relation": relation, "values": list(values), **more}


def _agg(field: str, func: str, name: str, **args) -> dict:
    return {"field": field, "apply": {"name": func, **({"args": args} if args else {})}, "as": name}


def _by(field: str, func: str | None = None, name: str | None = None, **args) -> dict:
    out: dict = {"field": field}
    if func:
        out["apply"] = {"name": func, "args": args}
    return out | ({"as": name} if name else {})


COUNT = _agg("*", "count", "n")


def _select(fields: list[str], order: list[str] | None = None, limit: int = 0, offset: int = 0) -> dict:
    return {"order": order or [], "limit": limit, "offset": offset, "field": fields}


# predicates

_L = ["l_orderkey", "l_linenumber"]
for op, word in (("=", "eq"), ("!=", "ne"), ("<", "lt"), ("<=", "le"), (">", "gt"), (">=", "ge")):
    ask(f"filter_number_{word}", {"dataset": "lineitem", "filter": [_flt("l_linenumber", op, 5)], "select": _select(_L)}, f"select l_orderkey, l_linenumber from lineitem where l_linenumber {op} 5")
    ask(f"filter_time_{word}", {"dataset": "orders", "filter": [_flt("o_orderdate", op, "1995-03-15T00:00:00.000Z")], "select": _select(["o_orderkey"])}, f"select o_orderkey from orders where o_orderdate {op} timestamp '1995-03-15'")
ask("filter_number_in", {"dataset": "lineitem", "filter": [_flt("l_linenumber", "in", 1, 4, 7)], "select": _select(_L)}, "select l_orderkey, l_linenumber from lineitem where l_linenumber in (1, 4, 7)")
ask("filter_number_range", {"dataset": "lineitem", "filter": [_flt("l_quantity", "inRange", 10, 20.5)], "select": _select([*_L, "l_quantity"])}, "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity >= 10 and l_quantity < 20.5")
ask("filter_number_to_string", {"dataset": "orders", "filter": [_flt("o_custkey", "startsWith", "1", apply={"name": "toString"})], "select": _select(["o_orderkey", "o_custkey"])}, "select o_orderkey, o_custkey from orders where o_custkey::varchar like '1%'")
ask("filter_time_range", {"dataset": "events", "filter": [_flt("ts", "inRange", "2024-01-05T00:00:00.000Z", "2024-01-12T12:00:00.000Z")], "select": _select(["event_id", "ts"])}, "select event_id, ts from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-12 12:00:00'")
ask("filter_text_all_words", {"dataset": "documents", "filter": [_flt("text", "contains", "the", "license")], "select": _select(["doc_id"])}, "select doc_id from documents where lower(text) like '%the%' and lower(text) like '%license%'")
ask("filter_text_token", {"dataset": "documents", "filter": [_flt("text", "contains", "license")], "select": _select(["doc_id"])}, "select doc_id from documents where list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'license')", text_mode="token")
for relation, word, cond in (
    ("=", "eq", "= '1-URGENT'"), ("matches", "matches", "= '1-URGENT'"), ("!=", "ne", "!= '1-URGENT'"), ("contains", "contains", "ilike '%urgent%'"), ("startsWith", "starts", "like '1%'"), ("endsWith", "ends", "like '%T'"), ("~=", "regex", None), ("in", "in", "in ('1-URGENT', '2-HIGH')"),
):
    values = {"contains": ["urgent"], "startsWith": ["1"], "endsWith": ["T"], "~=": ["^[12]-"], "in": ["1-URGENT", "2-HIGH"]}.get(relation, ["1-URGENT"])
    where = f"o_orderpriority {cond}" if cond else "regexp_matches(o_orderpriority, '^[12]-')"
    ask(f"filter_string_{word}", {"dataset": "orders", "filter": [_flt("o_orderpriority", relation, *values)], "select": _select(["o_orderkey", "o_orderpriority"])}, f"select o_orderkey, o_orderpriority from orders where {where}")
_LABEL = {"joinKey": ["doc_id"], "dataset": "labels", "lookupKey": ["doc_id"], "select": ["quality"], "as": ["quality"]}
ask("filter_null", {"dataset": "documents", "lookup": [_LABEL], "filter": [_flt("quality", "isNull")], "select": _select(["doc_id"])}, "select d.doc_id from documents d left join labels l on d.doc_id = l.doc_id where l.quality is null")
ask("filter_not_null", {"dataset": "documents", "lookup": [_LABEL], "filter": [_flt("quality", "isNotNull")], "select": _select(["doc_id", "quality"])}, "select d.doc_id, l.quality from documents d left join labels l on d.doc_id = l.doc_id where l.quality is not null")
_URGENT = {"field": "o_orderpriority", "definition": "o_orderpriority = '1-URGENT'", "type": "Boolean", "as": "urgent"}
ask("filter_true", {"dataset": "orders", "append": [_URGENT], "filter": [_flt("urgent", "true")], "select": _select(["o_orderkey"])}, "select o_orderkey from orders where o_orderpriority = '1-URGENT'")
ask("filter_false", {"dataset": "orders", "append": [_URGENT], "filter": [_flt("urgent", "false")], "select": _select(["o_orderkey"])}, "select o_orderkey from orders where not (o_orderpriority = '1-URGENT')")
ask("filter_point_rect", {"dataset": "points", "filter": [_flt("at", "inRange", [0, -0.1], [0.1, 0.1])], "select": _select(["vec_id"])}, "select vec_id from embeddings where embedding[1]::double between 0 and 0.1 and embedding[2]::double between -0.1 and 0.1")
_BAG = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w != '')"
ask("filter_bag_contains", {"dataset": "documents", "filter": [_flt("words", "contains", "the", "of")], "select": _select(["doc_id"])}, f"select doc_id from documents where list_contains({_BAG}, 'the') and list_contains({_BAG}, 'of')")

# group keys

for unit in ("second", "minute", "hour", "day", "week", "month", "year"):
    ask(f"group_interval_{unit}", {"dataset": "events", "group": {"by": [_by("ts", "interval", "t", unit=unit)], "aggregate": [COUNT]}}, f"select date_trunc('{unit}', ts)::timestamp as t, count(*) as n from events group by 1")
    if unit == "day":
        ask("group_component_day", {"dataset": "events", "group": {"by": [_by("ts", "interval", "t", unit="day", mode="component")], "aggregate": [COUNT]}}, "select ts::date as t, count(*) as n from events group by 1")
    else:
        ask(f"group_component_{unit}", {"dataset": "events", "group": {"by": [_by("ts", "interval", "t", unit=unit, mode="component")], "aggregate": [COUNT]}}, f"select {unit}(ts)::integer as t, count(*) as n from events group by 1")
for unit, form in (("second", "%Y-%m-%d %H:%M:%S"), ("hour", "%Y-%m-%d %H"), ("day", "%Y-%m-%d"), ("month", "%Y-%m"), ("year", "%Y")):
    ask(f"group_text_{unit}", {"dataset": "events", "group": {"by": [_by("ts", "interval", "t", unit=unit, mode="text")], "aggregate": [COUNT]}}, f"select strftime(ts, '{form}') as t, count(*) as n from events group by 1")
for x, unit, width in ((6, "hour", "6 hours"), (2, "week", "14 days"), (3, "month", "3 months"), (2, "year", "24 months")):
    ask(f"group_interval_{x}{unit}", {"dataset": "orders", "group": {"by": [_by("o_orderdate", "interval", "t", unit=unit, x=x)], "aggregate": [COUNT]}}, f"select time_bucket(interval '{width}', o_orderdate, timestamp '1990-01-01') as t, count(*) as n from orders group by 1")
ask("group_bin", {"dataset": "lineitem", "group": {"by": [_by("l_quantity", "bin", "bin", scale=10)], "aggregate": [COUNT]}}, "select round(l_quantity / 10) * 10 as bin, count(*) as n from lineitem group by 1")
ask("group_identity", {"dataset": "lineitem", "group": {"by": [_by("l_returnflag"), _by("l_linestatus")], "aggregate": [COUNT]}}, "select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2")
for level, column in (("region", "r_name"), ("nation", "n_name"), ("customer", "c_name")):
    ask(f"group_level_{level}", {"dataset": "orders_geo", "group": {"by": [_by("geo", "level", level, level=level)], "aggregate": [COUNT]}}, f"select {column} as {level}, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1")
_FLAT = lambda df: df.select(F.col("cell.x").alias("cell_x"), F.col("cell.y").alias("cell_y"), "n")
for func, n in (("geoCellTenth", 10), ("geoCellHundredth", 100), ("geoCellThousandth", 1000)):
    ask(f"group_geocell_{n}", {"dataset": "points", "group": {"by": [_by("at", func, "cell")], "aggregate": [COUNT]}}, f"select floor(embedding[1]::double * {n}) / {n} as cell_x, floor(embedding[2]::double * {n}) / {n} as cell_y, count(*) as n from embeddings group by 1, 2", post=_FLAT)
ask("group_geocell_truncate", {"dataset": "points", "group": {"by": [_by("at", "geoCellTenth", "cell", mode="truncate")], "aggregate": [COUNT]}}, "select trunc(embedding[1]::double * 10) / 10 + 0.0 as cell_x, trunc(embedding[2]::double * 10) / 10 + 0.0 as cell_y, count(*) as n from embeddings group by 1, 2", post=lambda df: _FLAT(df).groupBy((F.col("cell_x") + 0.0).alias("cell_x"), (F.col("cell_y") + 0.0).alias("cell_y")).agg(F.sum("n").alias("n")))
ask("group_time_space", {"dataset": "orders_geo", "group": {"by": [_by("o_orderdate", "interval", "month", unit="month"), _by("geo", "level", "nation", level="nation")], "aggregate": [COUNT]}}, "select date_trunc('month', o_orderdate)::timestamp as month, n_name as nation, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2")

# aggregates

_FLAG = [_by("l_returnflag")]
for func in ("count", "min", "max", "sum", "avg"):
    ask(f"agg_{func}", {"dataset": "lineitem", "group": {"by": _FLAG, "aggregate": [_agg("l_extendedprice", func, "x")]}}, f"select l_returnflag, {'round(' if func in ('sum', 'avg') else ''}{func}(l_extendedprice){', 2)' if func in ('sum', 'avg') else ''} as x from lineitem group by 1", digits={"x": 2} if func in ("sum", "avg") else None)
    ask(f"global_{func}", {"dataset": "lineitem", "global": {"globalAggregate": _agg("l_extendedprice", func, "x")}}, f"select {'round(' if func in ('sum', 'avg') else ''}{func}(l_extendedprice){', 2)' if func in ('sum', 'avg') else ''} as x from lineitem", digits={"x": 2} if func in ("sum", "avg") else None)
ask("agg_time_min_max", {"dataset": "lineitem", "group": {"by": _FLAG, "aggregate": [_agg("l_shipdate", "min", "first"), _agg("l_shipdate", "max", "last")]}}, "select l_returnflag, min(l_shipdate) as first, max(l_shipdate) as last from lineitem group by 1")
ask("agg_distinct", {"dataset": "lineitem", "group": {"by": _FLAG, "aggregate": [_agg("l_partkey", "distinctCount", "x")]}}, "select l_returnflag, count(distinct l_partkey) as x from lineitem group by 1")
_TOP = "select {k} as k, {v} as value, count(*) as n from {t} group by 1, 2"
ask("agg_topk", {"dataset": "lineitem", "group": {"by": _FLAG, "aggregate": [_agg("l_suppkey", "topK", "top", k=5)]}}, "select k as l_returnflag, list(value order by n desc, value)[1:5]::varchar as top from (" + _TOP.format(k="l_returnflag", v="l_suppkey", t="lineitem") + ") group by 1", post=lambda df: df.withColumn("top", F.col("top").cast("string")))
ask("agg_topk_words", {"dataset": "documents", "group": {"by": [_by("lang")], "aggregate": [_agg("words", "topK", "top", k=5)]}}, f"select lang, list(w order by n desc, w)[1:5]::varchar as top from (select lang, w, count(*) as n from (select lang, unnest({_BAG}) as w from documents) group by 1, 2) group by 1", post=lambda df: df.withColumn("top", F.col("top").cast("string")))
ask("global_over_group", {"dataset": "orders", "group": {"by": [_by("o_custkey")], "aggregate": [COUNT]}, "global": {"globalAggregate": _agg("n", "max", "most")}}, "select max(n) as most from (select o_custkey, count(*) as n from orders group by 1)")
ask("global_count_groups", {"dataset": "orders", "group": {"by": [_by("o_custkey")], "aggregate": [COUNT]}, "global": {"globalAggregate": _agg("*", "count", "groups")}}, "select count(*) as groups from (select o_custkey, count(*) as n from orders group by 1)")
ask("global_after_limit", {"dataset": "orders", "select": _select(["o_orderkey", "o_totalprice"], ["-o_totalprice", "o_orderkey"], 100), "global": {"globalAggregate": _agg("o_totalprice", "min", "x")}}, "select min(o_totalprice) as x from (select o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100)")

# lookups, derived columns, unnesting, projection and order

_CUST = {"joinKey": ["o_custkey"], "dataset": "customer", "lookupKey": ["c_custkey"], "select": ["c_name", "c_nationkey"], "as": ["name", "nation"]}
_NATION = {"joinKey": ["nation"], "dataset": "nation", "lookupKey": ["n_nationkey"], "select": ["n_name", "n_regionkey"], "as": ["nation_name", "region"]}
_REGION = {"joinKey": ["region"], "dataset": "region", "lookupKey": ["r_regionkey"], "select": ["r_name"], "as": ["region_name"]}
ask("lookup_single", {"dataset": "orders", "lookup": [_CUST], "select": _select(["o_orderkey", "name"])}, "select o_orderkey, c_name as name from orders left join customer on o_custkey = c_custkey")
ask("lookup_first_match", {"dataset": "customer", "lookup": [{"joinKey": ["c_nationkey"], "dataset": "customer", "lookupKey": ["c_nationkey"], "select": ["c_custkey"], "as": ["first"], "firstMatch": True}], "select": _select(["c_custkey", "first"])}, "select c.c_custkey, d.first from customer c left join (select c_nationkey, min(c_custkey) as first from customer group by 1) d on c.c_nationkey = d.c_nationkey")
ask("lookup_chain", {"dataset": "orders", "lookup": [_CUST, _NATION, _REGION], "select": _select(["o_orderkey", "nation_name", "region_name"])}, "select o_orderkey, n_name as nation_name, r_name as region_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
ask("lookup_multi_key", {"dataset": "lineitem", "lookup": [{"joinKey": ["l_orderkey", "l_linenumber"], "dataset": "orders", "lookupKey": ["o_orderkey", "o_custkey"], "select": ["o_totalprice"], "as": ["price"]}], "select": _select([*_L, "price"])}, "select l_orderkey, l_linenumber, o_totalprice as price from lineitem left join orders on l_orderkey = o_orderkey and l_linenumber = o_custkey")
ask("group_lookup", {"dataset": "orders", "group": {"by": [_by("o_custkey", name="customer")], "aggregate": [_agg("o_totalprice", "sum", "total")], "lookup": [{"joinKey": ["customer"], "dataset": "customer", "lookupKey": ["c_custkey"], "select": ["c_name"], "as": ["name"]}]}}, "select customer, round(total, 2) as total, c_name as name from (select o_custkey as customer, sum(o_totalprice) as total from orders group by 1) left join customer on customer = c_custkey", digits={"total": 2})
ask("lookup_in_and_out", {"dataset": "orders", "lookup": [_CUST], "group": {"by": [_by("nation")], "aggregate": [COUNT], "lookup": [_NATION]}}, "select nation, n, n_name as nation_name, n_regionkey as region from (select c_nationkey as nation, count(*) as n from orders left join customer on o_custkey = c_custkey group by 1) left join nation on nation = n_nationkey")
ask("append_expr", {"dataset": "orders", "append": [{"field": "o_orderpriority", "definition": "length(o_orderpriority)", "type": "Number", "as": "len"}], "select": _select(["o_orderkey", "len"])}, "select o_orderkey, length(o_orderpriority)::integer as len from orders")
ask("append_then_group", {"dataset": "orders", "append": [{"field": "o_orderpriority", "definition": "length(o_orderpriority)", "type": "Number", "as": "len"}], "filter": [_flt("len", ">", 5)], "group": {"by": [_by("len")], "aggregate": [COUNT]}}, "select length(o_orderpriority)::integer as len, count(*) as n from orders where length(o_orderpriority) > 5 group by 1")
ask("unnest_rows", {"dataset": "documents", "append": [{"field": "doc_id", "definition": "doc_id", "type": "Number", "as": "id"}], "unnest": [{"words": "word"}]}, f"select doc_id as id, unnest({_BAG}) as word from documents")
ask("unnest_topk", {"dataset": "documents", "unnest": [{"words": "word"}], "group": {"by": [_by("word")], "aggregate": [COUNT]}, "select": _select(["word", "n"], ["-n", "word"], 20)}, f"select word, count(*) as n from (select unnest({_BAG}) as word from documents) group by 1 order by n desc, word limit 20")
ask("topk_groups", {"dataset": "orders", "group": {"by": [_by("o_custkey")], "aggregate": [COUNT]}, "select": _select(["o_custkey", "n"], ["-n", "o_custkey"], 10)}, "select o_custkey, count(*) as n from orders group by 1 order by n desc, o_custkey limit 10")
ask("select_order_limit_offset", {"dataset": "orders", "select": _select(["o_orderkey", "o_totalprice"], ["-o_totalprice", "o_orderkey"], 25, 50)}, "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25 offset 50")
ask("sample_latest", {"dataset": "events", "filter": [_flt("event_type", "!=", "error")], "select": _select(["event_id", "ts"], ["-ts", "event_id"], 100)}, "select event_id, ts from events where event_type != 'error' order by ts desc, event_id limit 100")
ask("select_all_fields", {"dataset": "nation"}, "select * from nation")

# merging: batches, slices, views

_HOURS = {"dataset": "events", "group": {"by": [_by("event_type"), _by("ts", "interval", "hour", unit="hour")], "aggregate": [COUNT, _agg("value", "avg", "mean"), _agg("value", "min", "low"), _agg("user_id", "distinctCount", "users")]}}
_HOURS_SQL = "select event_type, date_trunc('hour', ts)::timestamp as hour, count(*) as n, round(avg(value), 9) as mean, min(value) as low, count(distinct user_id) as users from events group by 1, 2"


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return add


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("flagship_hourly", _HOURS_SQL)
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(engine(spark, sf, ["events"]).query(_HOURS), mean=9)


@query("slice_equals_full", _HOURS_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """States of eight equal slices of time, merged."""
    e = engine(spark, sf, ["events"])
    q, info = parse(_HOURS).queries[0], e.registry.info("events")
    width = (info.end - info.start) / 8
    parts, scope = [], None
    for i in range(8):
        more, scope = e._partials(q, info.start + width * i, info.end + timedelta(1) if i == 7 else info.start + width * (i + 1))
        parts += more
    return _rounded(conclude(q, combine(q, parts), scope, e.registry.table, e.registry.schema), mean=9)


@query("batch_union", "select 'orders' as name, count(*) as n from orders where o_orderdate >= timestamp '1995-01-01' union all select 'lineitem', count(*) from lineitem where l_shipdate >= timestamp '1995-01-01'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda d, t: {"dataset": d, "filter": [_flt(t, ">=", "1995-01-01T00:00:00.000Z")], "global": {"globalAggregate": COUNT}}
    a, b = engine(spark, sf, ["orders", "lineitem"]).query({"batch": [one("orders", "o_orderdate"), one("lineitem", "l_shipdate")]})
    return a.select(F.lit("orders").alias("name"), "n").unionByName(b.select(F.lit("lineitem").alias("name"), "n"))


def _root(spark: SparkSession) -> str:
    """A folder of its own below the shared one."""
    return f"{shared_folder(spark)}/engine-{uuid.uuid4().hex}"


def _frame(spark: SparkSession, rows: list[dict], like: DataFrame) -> DataFrame:
    """JSON rows as a table of the same columns as ``like``."""
    text = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    return text.select(F.from_json("value", like.schema).alias("r")).select("r.*")


@query("progressive_last", _HOURS_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The last of the answers that grow slice by slice."""
    e = engine(spark, sf, ["events"])
    end = (e.registry.info("events").end + timedelta(1)).isoformat()
    q = _HOURS | {"filter": [_flt("ts", "<", end)]}
    *_, last = e.progressive(q | {"option": {"sliceMillis": 2000}}, first=timedelta(days=10), least_hours=240)
    return _rounded(_frame(spark, last["value"], e.query(q)), mean=9)


@query("progressive_limit", "select event_id, ts from events where event_type != 'error' order by value desc, event_id limit 50 offset 10")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in an order other than time's, a limit and an offset, slice by slice; only those that can still count are kept."""
    e = engine(spark, sf, ["events"])
    end = (e.registry.info("events").end + timedelta(1)).isoformat()
    q = {"dataset": "events", "filter": [_flt("event_type", "!=", "error"), _flt("ts", "<", end)], "select": _select(["event_id", "ts"], ["-value", "event_id"], 50, 10)}
    *_, last = e.progressive(q | {"option": {"sliceMillis": 2000}}, first=timedelta(days=15), least_hours=360)
    return _frame(spark, last["value"], e.query(q))


def _viewed(spark: SparkSession, sf: str) -> Engine:
    """Events with a view of those whose properties contain 1, up to ten days before the last."""
    e = engine(spark, sf, ["events"], root=_root(spark))
    e.create_view(Query("events", filter=(Filter("props", "contains", ("1",)),)), e.registry.info("events").end - timedelta(days=10))
    return e


@query("view_split", "select event_type, count(*) as n, round(sum(value), 4) as total from events where lower(props) like '%1%' and lower(props) like '%2%' group by 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    q = {"dataset": "events", "filter": [_flt("props", "contains", "1", "2")], "group": {"by": [_by("event_type")], "aggregate": [COUNT, _agg("value", "sum", "total")]}}
    return _rounded(_viewed(spark, sf).query(q), total=4)


@query("view_append", "select event_id, ts from events where lower(props) like '%1%'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A view, and what came since appended to it."""
    e = _viewed(spark, sf)
    view = e.refresh_view(e.registry.views("events")[0].name)
    return e.registry.table(view.name).select("event_id", "ts")


_ONES = {"dataset": "events", "filter": [_flt("props", "contains", "1")], "group": {"by": [_by("event_type")], "aggregate": [COUNT, _agg("user_id", "distinctCount", "users")]}}


@query("delete_then_view", "select event_type, count(*) as n, count(distinct user_id) as users from events where lower(props) like '%1%' and not (value < 50) group by 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A view answers rightly after rows of its dataset have been deleted."""
    e = _viewed(spark, sf)
    e.delete("events", [_flt("value", "<", 50)])
    return e.query(_ONES)


@query("upsert_then_view", "select case when event_id % 3 = 0 then 'new' else event_type end as event_type, count(*) as n, count(distinct user_id) as users from events where lower(props) like '%1%' group by 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = _viewed(spark, sf)
    e.upsert("events", _table(spark, sf, "events").where("event_id % 3 = 0").withColumn("event_type", F.lit("new")))
    return e.query(_ONES)


@query("estimate_count", "select count(*) as n from events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return engine(spark, sf, ["events"]).query({"dataset": "events", "estimable": True, "global": {"globalAggregate": COUNT}})


@query("stats_minmaxcount", "select min(ts) as first, max(ts) as last, count(*) as n from events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    i = engine(spark, sf, ["events"]).registry.info("events")
    return spark.createDataFrame([(i.start, i.end, i.stats.cardinality)], "first timestamp_ntz, last timestamp_ntz, n long")


# changes


@query("upsert_rows", "select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey % 7 != 0 union all select o_orderkey, 'U', o_totalprice from orders where o_orderkey % 7 = 0 union all select -o_orderkey, 'N', o_totalprice from orders where o_orderkey % 11 = 0 and o_orderkey != 0")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = engine(spark, sf, ["orders"])
    orders = _table(spark, sf, "orders")
    changed = orders.where("o_orderkey % 7 = 0").withColumn("o_orderstatus", F.lit("U"))
    new = orders.where("o_orderkey % 11 = 0 and o_orderkey != 0").withColumn("o_orderstatus", F.lit("N")).withColumn("o_orderkey", -F.col("o_orderkey"))
    return e.upsert("orders", changed.unionByName(new)).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("delete_filter", "select o_orderkey from orders where not (o_orderstatus = 'F' and o_totalprice >= 100000)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return engine(spark, sf, ["orders"]).delete("orders", [_flt("o_orderstatus", "=", "F"), _flt("o_totalprice", ">=", 100000)]).select("o_orderkey")


# geography

_BOXES = "(select n_nationkey as box, (n_nationkey % 5) * 0.1 - 0.25 as xmin, (n_nationkey // 5) * 0.1 - 0.25 as ymin, (n_nationkey % 5) * 0.1 - 0.1 as xmax, (n_nationkey // 5) * 0.1 - 0.1 as ymax from nation)"
_POINTS = "(select vec_id, embedding[1]::double as x, embedding[2]::double as y from embeddings)"


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    at = "cast({} as decimal(10, 1)) * 0.1 {}"
    spots = {"xmin": at.format("n_nationkey % 5", "- 0.25"), "ymin": at.format("n_nationkey div 5", "- 0.25"), "xmax": at.format("n_nationkey % 5", "- 0.1"), "ymax": at.format("n_nationkey div 5", "- 0.1")}
    return _table(spark, sf, "nation").selectExpr("n_nationkey as box", *[f"cast({e} as double) as {c}" for c, e in spots.items()])


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "points").select("vec_id", F.col("at.x").alias("x"), F.col("at.y").alias("y"))


@query("bbox_join", f"select vec_id, box from {_POINTS} p join {_BOXES} b on x between xmin and xmax and y between ymin and ymax")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return geo.points_in_boxes(_points(spark, sf), _boxes(spark, sf), 0.1).select("vec_id", "box")


@query("tag_points", f"select p.vec_id, min(box) as box from {_POINTS} p left join {_BOXES} b on x between xmin and xmax and y between ymin and ymax group by 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return geo.tag_points(_points(spark, sf), "vec_id", _boxes(spark, sf), "box", 0.1).select("vec_id", "box")


@query("points_in_polygons", f"select vec_id, box from {_POINTS} p join {_BOXES} b on x > xmin and x < xmax and y > ymin and y < ymax and (x - xmin) / (xmax - xmin) + (y - ymin) / (ymax - ymin) < 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Points in the lower left half of each box, a triangle: boxes first, then the exact test."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    triangles = _boxes(spark, sf).withColumn("ring", F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmin", "ymax")))
    return geo.within_polygons(geo.points_in_boxes(_points(spark, sf), triangles, 0.1)).select("vec_id", "box")


@query("largest_parent", f"select a, b from (select a.box as a, b.box as b, row_number() over (partition by a.box order by round((least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)), 9) desc, b.box) as nth from {_BOXES} a join {_BOXES} b on a.box % 2 = b.box % 2 and a.box != b.box and a.xmin <= b.xmax and b.xmin <= a.xmax and a.ymin <= b.ymax and b.ymin <= a.ymax) where nth = 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Of the other boxes of the same parity the one with the largest area in common."""
    boxes = _boxes(spark, sf).withColumn("parity", F.col("box") % 2)
    pairs = geo.boxes_overlapping(boxes.withColumnRenamed("box", "a"), boxes.withColumnRenamed("box", "b"), "a", "b", 0.1, "parity").where("a != b")
    return geo.best_parent(pairs, "a", "b")


@query("box_overlap", f"select a.box as a, b.box as b, round((least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)), 6)::double as area from {_BOXES} a join {_BOXES} b on a.xmin <= b.xmax and b.xmin <= a.xmax and a.ymin <= b.ymax and b.ymin <= a.ymax")
def _(spark: SparkSession, sf: str) -> DataFrame:
    boxes = _boxes(spark, sf)
    return _rounded(geo.boxes_overlapping(boxes.withColumnRenamed("box", "a"), boxes.withColumnRenamed("box", "b"), "a", "b", 0.1), area=6)


@query("viewport_filter", f"select vec_id from {_POINTS} where x >= -0.05 and x < 0.1 and y between -0.1 and 0.05")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return geo.viewport(_points(spark, sf), -0.05, -0.1, 0.1, 0.05).select("vec_id")


@query("population_repair", "with p as (select c_name as name, c_nationkey as parent, case when c_custkey % 3 != 0 then c_custkey end as population from customer) select name, parent, coalesce(population, floor(avg(population) over (partition by parent)), 100)::bigint as population from p")
def _(spark: SparkSession, sf: str) -> DataFrame:
    regions = _table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("parent"), F.col("c_custkey").alias("population"))
    return geo.repaired_population(regions.select("name", "parent"), regions.where("population % 3 != 0").select("name", "population"), "parent")


# sampling, sources


@query("decimate_every_k", "select event_id, ts from (select event_id, ts, row_number() over (order by ts, event_id) - 1 as pos, count(*) over () as n from events) where n <= 200 or n // 200 < 2 or pos % (n // 200) = 0")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.decimate(_table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], 200)


@query("time_means", "select to_timestamp(floor(epoch_ms(ts) / 3600000) * 3600)::timestamp as bucket, round(avg(value), 9) as mean from events group by 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return _rounded(sampling.time_means(_table(spark, sf, "events"), "ts", "value", 3_600_000), mean=9).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("decimate_extra_column", "select event_id, ts, user_id, event_type, value, props from (select *, row_number() over (order by ts, event_id) - 1 as pos, count(*) over () as n from events) where n <= 150 or n // 150 < 2 or pos % (n // 150) = 0")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.decimate(_table(spark, sf, "events"), ["ts", "event_id"], 150)


@query("random_sample", "select event_id, ts from events order by md5('0:' || event_id), event_id limit 200")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.random_sample(_table(spark, sf, "events").select("event_id", "ts"), "event_id", 200)


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w != ''))"


#: Rows of a block, on average, and keys that are listed at once: a task keeps the pairs of two such lists in memory
_BLOCK, _LIST = 1 << 15, 1 << 8


def _word_pairs(part: DataFrame) -> DataFrame:
    """Keys are dealt to blocks, and tasks list the pairs between two blocks of a brand. Lists of keys with the same words are compared as one, so their pairs cost no more than a row each."""
    n = part.count() // _BLOCK + 1
    cells, tasks = ["p_brand", "i", "j"], max(part.sparkSession.sparkContext.defaultParallelism, n * n)
    words = F.array_sort(F.array_distinct(word_tokens(F.col("p_name"))))
    # sorted, as both sides of the join must cut the same lists
    lists = part.where("p_brand is not null").groupBy("p_brand", words.alias("w"), F.pmod(F.xxhash64("p_partkey"), F.lit(n)).alias("block")).agg(F.sort_array(F.collect_list("p_partkey")).alias("keys"))
    lists = lists.where("size(keys) > 0").selectExpr("p_brand", "w", "block", "keys", f"explode(sequence(0, (size(keys) - 1) div {_LIST})) as at").selectExpr("p_brand", "block", "struct(w, at) as s", f"slice(keys, int(at * {_LIST} + 1), {_LIST}) as keys")
    left = lists.selectExpr("p_brand", "block as i", f"explode(sequence(block, {n - 1}L)) as j", "s as x", "keys as us")
    right = lists.selectExpr("p_brand", "explode(sequence(0L, block)) as i", "block as j", "s as y", "keys as vs")
    both = left.repartition(tasks, *cells).join(right.repartition(tasks, *cells), cells).where("i < j or x <= y")
    # as the SQL has it: NaN where neither has words, null where the first has no name, no words where the second has none
    p, q = F.coalesce("x.w", F.array().cast("array<string>")), F.coalesce("y.w", F.array().cast("array<string>"))
    alike = F.when(F.size(p) + F.size(q) == 0, F.lit(float("nan"))).otherwise(F.round(similarity_jaccard(p, q), 9))
    both = both.select("us", "vs", "x", "y", F.expr("i = j and x = y").alias("same"), alike.alias("s")).selectExpr("us", "vs", "same", "if(x.w is null, null, s) as one", "if(y.w is null, null, s) as two")
    rows = both.select(F.explode("us").alias("u"), "vs", "same", "one", "two").select("u", F.explode("vs").alias("v"), "same", "one", "two")
    return rows.where("u < v or u > v and not same").selectExpr("least(u, v) as a", "greatest(u, v) as b", "if(u < v, one, two) as similarity")


@query("word_similarity", f"select a.p_partkey as a, b.p_partkey as b, round(len(list_intersect({_TOKENS.format('a.p_name')}, {_TOKENS.format('b.p_name')})) / len(list_distinct(list_concat({_TOKENS.format('a.p_name')}, {_TOKENS.format('b.p_name')}))), 9) as similarity from part a join part b on a.p_brand = b.p_brand and a.p_partkey < b.p_partkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """How alike the names of any two parts of a brand are."""
    return _word_pairs(_table(spark, sf, "part"))


@query("series_count_map", "select region, sum(case when day between date '1994-01-01' and date '1995-12-31' then n else 0 end)::bigint as count, any_value(population) as population from (select c_nationkey as region, o_orderdate::date as day, count(*) as n from orders join customer on o_custkey = c_custkey where c_nationkey in (1, 2, 3, 7, 11) and o_orderdate < timestamp '1997-01-01' group by 1, 2) left join (select n_nationkey as region, n_regionkey * 1000 as population from nation) using (region) group by 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Daily counts of some regions are kept; those of two years come from what is held."""
    cache, ids, population = SeriesCache(), [1, 2, 3, 7, 11], _table(spark, sf, "nation").selectExpr("n_nationkey as region", "n_regionkey * 1000 as population")
    q = {"dataset": "orders", "lookup": [_CUST], "filter": [_flt("o_orderdate", "<", "1997-01-01T00:00:00.000Z"), _flt("nation", "in", *ids)], "group": {"by": [_by("nation", name="region"), _by("o_orderdate", "interval", "day", unit="day")], "aggregate": [_agg("*", "count", "count")]}}
    start, end = date(1970, 1, 1), date(1996, 12, 31)
    assert cache.missing(["all"], "nation", start, end, ids) == ids
    cache.put(ids, engine(spark, sf, ["orders", "customer"]).query(q), start, end)
    assert cache.missing(["all"], "nation", date(1994, 1, 1), end, [1, 11]) == []
    return cache.count_map(ids, date(1994, 1, 1), date(1995, 12, 31), population)


@query("json_round_trip", "select event_id, ts, value, props from events where user_id % 2 = 0")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written as JSON and read again under the declared types."""
    rows = _table(spark, sf, "events").where("user_id % 2 = 0").select("event_id", "ts", "value", "props")
    path = f"{_root(spark)}/rows"
    write_json(rows, path)
    return read(spark, "json", path, rows.schema)


@query("time_layout", "select event_id, ts from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-08 12:00:00'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A slice of a table that is written in order of time, in folders of days of which it opens four."""
    path = f"{_root(spark)}/events"
    rows = _table(spark, sf, "events")
    write_by_time(rows, path, F.col("ts"))
    e = Engine(spark)
    e.register({"dataset": "events", "schema": SCHEMAS["events"]}, path)
    return e.query({"dataset": "events", "filter": [_flt("ts", "inRange", "2024-01-05T00:00:00.000Z", "2024-01-08T12:00:00.000Z")], "select": _select(["event_id", "ts"])})


@query("ids_probe", "select l_orderkey, l_linenumber from lineitem where l_partkey in (select p_partkey from part where p_size < 10)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ids = _table(spark, sf, "part").where("p_size < 10").selectExpr("p_partkey as l_partkey")
    return geo.in_ids(_table(spark, sf, "lineitem"), "l_partkey", ids).select("l_orderkey", "l_linenumber")


@query("page_links", """select page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']+)["'']', 1)) as href from pages""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return page_links(spark.read.parquet(f"{sf}/pages.parquet"))


@query("stream_tumbling", "select to_timestamp(floor(epoch(ts) / 21600) * 21600)::timestamp as bin, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Events replayed as a stream; the aggregates of all bins land in a table of the shared folder."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.read.parquet(f"{sf}/events.parquet")
    folder, pattern = (f"{sf}/events.parquet", None) if _is_dir(spark, f"{sf}/events.parquet") else (sf, "events*.parquet")
    feed = ingest.file_feed(spark, folder, source.schema, pattern=pattern)
    bins = ingest.tumbling(feed, "ts", "6 hours", ["event_type"], {"n": F.count(F.lit(1)), "total": F.sum("value")}, "3650 days")
    ingest.drain(bins, lambda batch, nth: batch.write.mode("overwrite").parquet(f"{base}/bins"), f"{base}/checkpoint", "complete")
    return _rounded(spark.read.parquet(f"{base}/bins"), total=4).withColumn("bin", F.col("bin").cast("timestamp_ntz"))


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
