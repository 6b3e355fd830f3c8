"""Packing: optimal length buckets, and token-budget batches inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaframe.llm.shared import cut, running_start

SLICES = 64


def tokens(column: str = "text"):
    """Words between white space, and one token that ends the document."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"\S+")), F.lit(0)).cast("long") + 1


def optimal_buckets(lengths: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
    """The upper bounds of at most k buckets of the ascending lengths for which padding to the bound costs least.

    dp[b][j] = min over i of dp[b-1][i] + lengths[j-1] * (documents in i..j), solved as the lower envelope of
    lines in one pass for each bucket. Of equally good cuts the one with the smallest i is taken.
    """
    n = len(lengths)
    if not n:
        return []
    length = [int(x) for x in lengths]
    seen = [0, *np.cumsum(counts).tolist()]
    k = min(k, n)
    table = [[0] + [None] * n]
    for _ in range(k):
        last, now, hull = table[-1], [None] * (n + 1), []

        def worse(a, b, c):  # line b never is the lowest between a and c
            return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])

        head = 0
        for j in range(1, n + 1):
            i = j - 1
            if last[i] is not None:
                line = (-seen[i], last[i])
                while len(hull) - head >= 2 and worse(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
            x = length[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            if len(hull) > head:
                now[j] = hull[head][0] * x + hull[head][1] + x * seen[j]
        table.append(now)
    bounds, j = [], n
    for b in range(k, 0, -1):
        last, x = table[b - 1], length[j - 1]
        bounds.append(x)
        j = next(i for i in range(j) if last[i] is not None and last[i] + x * (seen[j] - seen[i]) == table[b][j])
    return bounds[::-1]


def pack(docs: DataFrame, buckets: int = 12, budget: int = 65_536, shard: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_tokens, batch, slot) for every row of docs.

    The histogram of all lengths decides the bounds (its size is the number of different lengths). A batch
    of a bucket holds as many documents as fit ``budget`` tokens when each is padded to the bound, one at
    least. Documents fill batches in the order (doc_id mod 64, doc_id, n_tokens), null doc_ids first; equal
    rows take adjoining slots. Null and empty texts have the one ending token; a text longer than the budget
    has a batch of its own. An empty table gives none, and other columns are not read.

    With ``shard``, the name of a column of whole numbers, the batches of a bucket are filled shard by shard (nulls first),
    within one in the order above, so that batches in the order of their numbers hold the shards in theirs; the documents of a
    batch take its slots in the order above.
    """
    spark = docs.sparkSession
    sizes = cut(docs.select("doc_id", tokens().alias("n_tokens"), (F.col(shard).cast("long") if shard else F.lit(0).cast("long")).alias("shard")))
    found = sorted((r["n_tokens"], r["count"]) for r in sizes.groupBy("n_tokens").count().collect())
    bounds = optimal_buckets(np.array([x for x, _ in found]), np.array([c for _, c in found]), buckets)
    if not bounds:
        return spark.createDataFrame([], "doc_id long, n_tokens long, bucket int, bucket_tokens long, batch long, slot long")
    limits = F.array(*[F.lit(b).cast("long") for b in bounds])
    bucket = F.size(F.filter(limits, lambda b: b < F.col("n_tokens")))
    placed = sizes.select("doc_id", "n_tokens", "shard", bucket.alias("bucket"), F.coalesce(F.pmod("doc_id", F.lit(SLICES)), F.lit(-1)).cast("int").alias("slice"), F.lit(1).cast("long").alias("one"))
    placed = placed.withColumn("part", F.struct("shard", "slice")) if shard else placed.withColumnRenamed("slice", "part")
    numbered = running_start(placed, ["bucket"], "part", ["doc_id", "n_tokens"], "one", "nth")
    bound = F.element_at(limits, F.col("bucket") + 1)
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / bound)).cast("long")
    filled = numbered.select("*", bound.alias("bucket_tokens"), F.floor(F.col("nth") / room).cast("long").alias("batch"), (F.col("nth") % room).alias("slot"))
    if shard:
        within = Window.partitionBy("bucket", "batch").orderBy("slice", "doc_id", "n_tokens")
        filled = filled.withColumn("slot", F.row_number().over(within).cast("long") - 1)
    return filled.select("doc_id", "n_tokens", "bucket", "bucket_tokens", "batch", "slot")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(buckets: int = 12, budget: int = 65_536, source: str = "documents") -> str:
    """The same rows in SQL: one step of the table for each bucket, then the way back."""
    out = [
        f"s as (select doc_id, coalesce(len(regexp_extract_all(text, '\\S+')), 0)::bigint + 1 as n_tokens from {source})",
        "h as (select row_number() over (order by n_tokens) as j, n_tokens as x, sum(c) over (order by n_tokens)::bigint as p from (select n_tokens, count(*)::bigint as c from s group by 1))",
        "h0 as (select 0::bigint as j, 0::bigint as p union all select j, p from h)",
        f"k as (select least({buckets}, count(*)) as k from h)",
        "d0 as (select 0::bigint as j, 0::bigint as cost)",
    ]
    for b in range(1, buckets + 1):
        out.append(f"d{b} as materialized (select h.j, min(d.cost + h.x * (h.p - h0.p))::bigint as cost from d{b - 1} d join h0 on h0.j = d.j join h on h.j > d.j group by 1)")
    every = " union all ".join(f"select {b} as b, j, cost from d{b}" for b in range(buckets + 1))
    out.append(f"d as materialized ({every})")
    back = "(select min(p.j) from d p join h0 on h0.j = p.j where p.b = t{0}.b - 1 and p.j < t{0}.j and p.cost + h.x * (h.p - h0.p) = c.cost)"
    out.append("t0 as (select k.k as b, (select max(j) from h) as j from k where k.k > 0)")
    for i in range(buckets):
        out.append(f"t{i + 1} as materialized (select t{i}.b - 1 as b, {back.format(i)} as j from t{i} join h on h.j = t{i}.j join d c on c.b = t{i}.b and c.j = t{i}.j where t{i}.b > 0)")
    ends = " union all ".join(f"select b, j from t{i} where b > 0" for i in range(buckets))
    out.append(f"e as (select (t.b - 1)::integer as bucket, h.x as bucket_tokens, coalesce(lag(h.x) over (order by t.b), -1) as low from ({ends}) t join h on h.j = t.j)")
    out.append(f"n as (select s.doc_id, s.n_tokens, e.bucket, e.bucket_tokens, greatest(1, {budget} // e.bucket_tokens) as room, row_number() over (partition by e.bucket order by coalesce(((doc_id % {SLICES}) + {SLICES}) % {SLICES}, -1), doc_id nulls first, n_tokens) - 1 as nth from s join e on s.n_tokens > e.low and s.n_tokens <= e.bucket_tokens)")
    return "with " + ",\n".join(out) + "\nselect doc_id, n_tokens, bucket, bucket_tokens, (nth // room)::bigint as batch, (nth % room)::bigint as slot from n"
