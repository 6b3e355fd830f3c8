"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaframe.llm.packing import tokens
from vistaframe.llm.shared import cut, hex_range, maybe_broadcast, running_start

CHUNK = 1 << 16


def _seats(weight: float, quotient: float, more: bool) -> int:
    """How many k have weight / (2k + 1) above the quotient, or with ``more`` at least it."""
    held = lambda k: weight / (2 * k + 1) > quotient or more and weight / (2 * k + 1) == quotient
    n = max(0, int((weight / quotient - 1) / 2))  # as good as exact; rounding is put right below
    while n and not held(n - 1):
        n -= 1
    while held(n):
        n += 1
    return n


class _Dealing:
    """How many blocks each source has among the first ones that Sainte-Laguë deals, without dealing them one by one."""

    def __init__(self, weights: dict[str, float], most: dict[str, int | None]) -> None:
        self.weights = {s: float(w) for s, w in sorted(weights.items()) if w > 0}
        self.most = most

    def until(self, quotient: float, more: bool) -> dict[str, int]:
        found = {s: _seats(w, quotient, more) for s, w in self.weights.items()}
        return {s: n if self.most.get(s) is None else min(n, self.most[s]) for s, n in found.items()}

    def first(self, n: int) -> dict[str, int]:
        """The first n blocks; equal quotients go by name. The least quotient among them is found by bisection of all doubles."""
        as_float = lambda x: struct.unpack("<d", struct.pack("<q", x))[0]
        bits = lambda x: struct.unpack("<q", struct.pack("<d", x))[0]
        # among n blocks no source has more than n
        low, high = bits(min(self.weights.values()) / (2 * n + 3)), bits(max(self.weights.values())) + 1
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if sum(self.until(as_float(mid), True).values()) >= n else (low, mid)
        out, every = self.until(as_float(low), False), self.until(as_float(low), True)
        left = n - sum(out.values())
        for s in self.weights:
            add = min(left, every[s] - out[s])
            out[s], left = out[s] + add, left - add
        return out


def apportion(weights: dict[str, float], blocks: dict[str, int], shards: int, go_on: bool = False) -> list[tuple[str, int, int]]:
    """(source, shard, quota): blocks dealt one by one to the source with the highest quotient.

    A source with k blocks so far has the quotient weight / (2k + 1); ties go to the first name. Dealing ends
    when the next block falls to a source that has none left, so no source is used twice and the weights hold; with
    ``go_on`` that source drops out and the others are dealt on, until all blocks of sources with a weight are used.
    The sequence is cut into ``shards`` runs of equal length to within one block. Quotas come from the quotients at the
    ends of the runs, found by bisection, so that time doesn't grow with the number of blocks but for its logarithm.
    """
    weights = {s: w for s, w in weights.items() if w > 0}
    if not weights:
        return []
    if go_on:
        dealing, total = _Dealing(weights, {s: blocks.get(s, 0) for s in weights}), sum(blocks.get(s, 0) for s in weights)
    else:
        dealing = _Dealing(weights, {})
        # the first turn of a source without blocks left
        end, source = min((-(w / (2 * blocks.get(s, 0) + 1)), s) for s, w in weights.items())
        before, upto = dealing.until(-end, False), dealing.until(-end, True)
        total = sum(min(upto[s], blocks.get(s, 0)) if s < source else before[s] for s in weights)
    out, last = [], dict.fromkeys(weights, 0)
    for shard in range(shards):
        now = dealing.first(-(-(shard + 1) * total // shards)) if total else last
        out += [(s, shard, now[s] - last[s]) for s in weights if now[s] > last[s]]
        last = now
    return sorted(out)


def _listed(spark, blocks: dict[str, int]) -> DataFrame:
    """(source, block) of all blocks, unfolded in chunks so that no row holds those of a large source."""
    chunks = F.ceil(F.col("whole") / CHUNK).cast("long")
    whole = spark.createDataFrame(list(blocks.items()), "source string, whole long").where("whole > 0")
    begun = whole.select("source", "whole", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"))
    parts = max(1, min(10_000, sum(blocks.values()) // (16 * CHUNK)))
    begun = begun.repartition(parts, "source", "chunk") if parts > 1 else begun
    first = F.col("chunk") * CHUNK
    return begun.select("source", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("whole")) - 1)).alias("block"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_tokens: int = 4096, shards: int = 16, seed: int = 17, go_on: bool = False) -> DataFrame:
    """(doc_id, source, block, shard): the documents of the chosen blocks.

    Within a source, documents in the order of md5(seed, doc_id) are cut every ``block_tokens`` tokens; a
    document belongs to the block where it starts, and the rest after the last whole block is not used. Blocks
    in the order of md5(seed, source, block) fill the source's quota of each shard in turn. ``weights`` are the
    target shares; by default the square root of each source's tokens (whole ones, so that it is exact).
    Null sources are one source of the empty name, null texts one token; equal rows stay in one order and each
    counts; null doc_ids sort as the empty string. A source with less than one block ends the dealing at its
    first turn only if it has positive weight and nothing at all, so such sources are left out beforehand. So the source
    that runs out first bounds what is used of all. With ``go_on`` it doesn't: dealing continues among the others, a
    source's last, partial block counts as a block, and every document of a source with a weight gets a shard; the
    weights hold until the first source runs out, and among those left from then on. Texts of any length
    count whole. An empty table gives none; other columns are not read. The driver holds a few numbers for each source
    and shard, however many blocks there are.
    """
    spark = docs.sparkSession
    empty = "doc_id long, source string, block long, shard int"
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key")
    sized = cut(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), tokens().alias("n_tokens"), key).withColumn("slice", hex_range("key")))
    total = {r["source"]: r["t"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    blocks = {s: -(-t // block_tokens) if go_on else t // block_tokens for s, t in total.items() if go_on or t >= block_tokens}
    target = {s: (weights.get(s, 0.0) if weights is not None else float(int(total[s] ** 0.5))) for s in blocks}
    quotas = apportion(target, blocks, shards, go_on)
    if not quotas:
        return spark.createDataFrame([], empty)
    placed = running_start(sized, ["source"], "slice", ["key", "doc_id", "n_tokens"], "n_tokens", "begin").withColumn("block", F.floor(F.col("begin") / block_tokens).cast("long"))
    edges: list[tuple[str, int, int, int]] = []
    used: dict[str, int] = {}
    for s, shard, n in quotas:
        edges.append((s, shard, used.get(s, 0), used.get(s, 0) + n))
        used[s] = used.get(s, 0) + n
    name = F.md5(F.concat(F.lit(f"{seed}:"), "source", F.lit(":"), F.col("block").cast("string")))
    listed = _listed(spark, blocks).withColumn("key", name).withColumn("slice", hex_range("key")).withColumn("one", F.lit(1).cast("long"))
    ranked = running_start(listed, ["source"], "slice", ["key"], "one", "nth")
    runs = spark.createDataFrame(edges, "source string, shard int, low long, high long")
    r, e = ranked.alias("r"), maybe_broadcast(runs, len(edges)).alias("e")
    chosen = r.join(e, (F.col("r.source") == F.col("e.source")) & (F.col("nth") >= F.col("low")) & (F.col("nth") < F.col("high"))).select("r.source", "block", "shard")
    return placed.join(chosen, ["source", "block"]).select("doc_id", "source", "block", "shard")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(block_tokens: int = 4096, shards: int = 16, seed: int = 17, source: str = "documents") -> str:
    return f"""with s as (select doc_id, coalesce(source, '') as source, coalesce(len(regexp_extract_all(text, '\\S+')), 0)::bigint + 1 as n_tokens, md5('{seed}:' || coalesce(doc_id::varchar, '')) as key from {source}),
p as (select doc_id, source, (sum(n_tokens) over (partition by source order by key, doc_id, n_tokens rows unbounded preceding) - n_tokens)::bigint // {block_tokens} as block from s),
w as (select source, sum(n_tokens)::bigint // {block_tokens} as blocks, floor(sqrt(sum(n_tokens)::double)) as weight from s group by 1 having sum(n_tokens) >= {block_tokens}),
q as (select source, k, blocks, row_number() over (order by weight / (2 * k + 1) desc, source) - 1 as turn from w, lateral (select unnest(range(blocks + 1)) as k)),
stop as (select min(turn) as turn from q where k >= blocks),
seats as (select source, k, ((turn * {shards}) // (select turn from stop))::integer as shard from q where turn < (select turn from stop)),
b as (select source, block, row_number() over (partition by source order by md5('{seed}:' || source || ':' || block)) - 1 as nth from (select source, unnest(range(blocks)) as block from w))
select p.doc_id, p.source, p.block, seats.shard from p join b on b.source = p.source and b.block = p.block join seats on seats.source = b.source and seats.k = b.nth"""
