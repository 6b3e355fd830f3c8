"""Sharding along a Hilbert curve through the metadata, for pruning in several dimensions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistaframe.llm.shared import cut, free_name, keyed, running_start

BITS, SLICES = 5, 16


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points with the given coordinates below 2**bits (Skilling's transform)."""
    x = [np.asarray(a, np.int64).copy() for a in axes]
    n = len(x)
    q = 1 << bits - 1
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << bits - 1
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x = [a ^ t for a in x]
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for a in x:
            out = out << 1 | a >> b & 1
    return out


@F.pandas_udf(T.LongType())
def _hilbert(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index([a.to_numpy(), b.to_numpy(), c.to_numpy()], BITS))


def _code(docs: DataFrame, column: str) -> DataFrame:
    """Each value of a column with its rank scaled to 0 .. 2**BITS - 1; nulls count as the empty string."""
    value = docs.groupBy(F.coalesce(column, F.lit("")).alias(f"v_{column}")).agg(F.lit(1).alias("_one")).drop("_one")
    order = Window.orderBy(f"v_{column}")
    rank = F.row_number().over(order) - 1
    count = F.count(F.lit(1)).over(Window.partitionBy())
    return value.select(f"v_{column}", F.floor(rank * (1 << BITS) / count).cast("long").alias(f"x_{column}"))


def shard(docs: DataFrame, target_chars: int = 1_000_000) -> DataFrame:
    """(doc_id, curve, shard) for every row: its cell on the Hilbert curve through language, source and length, and its run.

    Language and source are quantised by rank, length (n_chars; where null, that of the text; 0 where both are)
    by its number of binary digits, to 32 steps each. Rows in the order (curve, doc_id mod 16, doc_id, length),
    null doc_ids first, are cut every ``target_chars`` characters; a row belongs to the run where it starts.
    Null languages and sources count as the empty string; equal rows stay side by side; a long text stays whole;
    an empty table gives none; other columns are not read, and texts only if some n_chars is null.
    """
    of_text = [F.length("text")] if docs.where("n_chars is null").select(F.lit(1)).take(1) else []
    length = F.greatest(F.coalesce(F.col("n_chars"), *of_text, F.lit(0)).cast("long"), F.lit(0).cast("long"))
    meta = cut(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("v_lang"), F.coalesce("source", F.lit("")).alias("v_source"), length.alias("size")))
    named = meta.select(F.col("v_lang").alias("lang"), F.col("v_source").alias("source"))
    both = meta.join(_code(named, "lang"), "v_lang").join(_code(named, "source"), "v_source")
    digits = F.least(F.length(F.bin("size")), F.lit((1 << BITS) - 1)).cast("long")
    cells = both.select("doc_id", "size", _hilbert("x_lang", "x_source", digits).alias("curve"), F.coalesce(F.pmod("doc_id", F.lit(SLICES)), F.lit(-1)).cast("int").alias("slice"))
    cells = cut(cells)
    # at most 2**15 cells, whatever the input: one task adds them up, and they may be broadcast
    totals = cells.groupBy("curve").agg(F.sum("size").alias("t"))
    start = totals.select("curve", (F.sum("t").over(Window.orderBy("curve")) - F.col("t")).alias("base"))
    inside = running_start(cells, ["curve"], "slice", ["doc_id", "size"], "size", "begin")
    return inside.join(F.broadcast(start), "curve").select("doc_id", "curve", F.floor((F.col("base") + F.col("begin")) / target_chars).cast("long").alias("shard"))


def write_shards(docs: DataFrame, path: str, target_chars: int = 1_000_000) -> str:
    """Writes documents in curve order, one file for each shard, so that min/max statistics prune on every dimension.

    Every row is placed by itself, also those with a null or repeated doc_id. Returns the name of the folder column:
    ``_shard``, with more underscores in front if docs has such a column.
    """
    base, key = keyed(docs)
    number, of = free_name(base, "_shard"), free_name(base, "_of")
    curve = free_name(base, "_curve")
    where = shard(base.select(F.col(key).alias("doc_id"), "lang", "source", "text", "n_chars"), target_chars).select(F.col("doc_id").alias(of), F.col("shard").alias(number), F.col("curve").alias(curve))
    placed = base.join(where, F.col(key) == F.col(of)).drop(key, of)
    placed.repartition(number).sortWithinPartitions(number, curve, "doc_id").drop(curve).write.partitionBy(number).parquet(path)
    return number


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(target_chars: int = 1_000_000) -> str:
    step, n = [], 0
    top = (1 << BITS) - 1
    step.append(
        f"c0 as (select doc_id, size, (least(length(bin(size)), {top}))::bigint as x2, (l.r * {1 << BITS} // l.n)::bigint as x0, (s.r * {1 << BITS} // s.n)::bigint as x1 from m "
        "join (select lang, row_number() over (order by lang) - 1 as r, count(*) over () as n from (select distinct lang from m)) l on l.lang = m.lang "
        "join (select source, row_number() over (order by source) - 1 as r, count(*) over () as n from (select distinct source from m)) s on s.source = m.source)"
    )
    q = 1 << BITS - 1
    while q > 1:
        p = q - 1
        for i in range(3):
            t = f"(xor(x0, x{i}) & {p})"
            cols = [f"case when (x{i} & {q}) > 0 then xor(x0, {p}) else xor(x0, {t}) end as x0"]
            cols += [f"case when (x{j} & {q}) > 0 then x{j} else xor(x{j}, {t}) end as x{j}" if j == i else f"x{j}" for j in (1, 2)]
            step.append(f"c{n + 1} as (select doc_id, size, {', '.join(cols)} from c{n})")
            n += 1
        q >>= 1
    step.append(f"g as (select doc_id, size, x0, xor(x1, x0) as x1, xor(x2, xor(x1, x0)) as x2 from c{n})")
    t, q = "0", 1 << BITS - 1
    while q > 1:
        t = f"xor({t}, case when (x2 & {q}) > 0 then {q - 1} else 0 end)"
        q >>= 1
    step.append(f"u as (select doc_id, size, xor(x0, t) as x0, xor(x1, t) as x1, xor(x2, t) as x2 from (select *, {t} as t from g))")
    terms = [f"((x{i} >> {b}) & 1) * {1 << 3 * b + 2 - i}" for b in range(BITS) for i in range(3)]
    step.append(f"h as (select doc_id, size, ({reduce(lambda a, b: a + ' + ' + b, terms)})::bigint as curve from u)")
    first = "m as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, greatest(coalesce(n_chars, length(text), 0), 0)::bigint as size from documents)"
    order = f"curve, coalesce(((doc_id % {SLICES}) + {SLICES}) % {SLICES}, -1), doc_id nulls first, size"
    return "with " + ",\n".join([first, *step]) + f"\nselect doc_id, curve, ((sum(size) over (order by {order} rows unbounded preceding) - size)::bigint // {target_chars})::bigint as shard from h"
