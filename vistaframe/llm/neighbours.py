"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

A rotation learned on all vectors turns each into a code of up to 64 signs. Codes are split into substrings, and a
table for each substring finds every code within the Hamming radius (if two codes differ in ``radius`` digits at
most, some substring differs in its share at most), whose floats then decide. A query whose k-th neighbour found so
is near enough that the radius can hardly have missed a nearer one is settled (see ``settled_rows``); the others
go on to the next larger radius, and those that the largest one doesn't settle are compared with all vectors, block
by block. Equal vectors are indexed and searched as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, comb, cos, pi

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistaframe.llm.shared import cut, fresh_path, maybe_broadcast

SHARES = (15 / 64, 19 / 64)
FIT_ROWS = 200_000
BLOCK_ROWS, QUERY_ROWS = 16_384, 4_096
GROUP_ROWS = 1 << 21


def _floats(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles of length 1): one row for each vec_id, the smallest of its vectors.

    Left out are null ids, null or empty vectors, those with a null, a NaN or an infinity, zero vectors, and those
    of another length than most (of equally frequent lengths the smaller counts).
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0").where(finite)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    unit = whole.withColumn("norm", norm).where("norm > 0").select("vec_id", F.transform("embedding", lambda x: x / F.col("norm")).alias("embedding"))
    sizes = unit.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return cut(unit.where(F.size("embedding") == (sizes["d"] if sizes else 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))


def _summed(vectors: DataFrame, of) -> np.ndarray:
    """The sum over all vectors of a matrix that ``of`` makes of a batch; each task sends one matrix, Spark adds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_floats(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(np.round(total.ravel(), 6))], ["at", "v"])

    rows = vectors.select("embedding").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.empty(len(rows))
    for r in rows:
        out[r["at"]] = r["v"]
    return out


def rotation(vectors: DataFrame, dims: int, turns: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix): principal directions, turned until the signs lose least (iterative quantisation). Every turn reads the vectors again."""

    def moments(x: np.ndarray) -> np.ndarray:
        return np.vstack([x.T @ x, x.sum(0), np.full(dims, float(len(x)))])

    total = _summed(vectors, moments).reshape(dims + 2, dims)
    n = total[-1, 0]
    mean = total[-2] / n
    _, vec = np.linalg.eigh(total[:dims] / n - np.outer(mean, mean))
    base = vec[:, ::-1][:, :64]
    turn = np.linalg.qr(np.random.default_rng(5).normal(size=(base.shape[1],) * 2))[0]
    for _ in range(turns):
        now = base @ turn

        def products(x: np.ndarray, now=now) -> np.ndarray:
            p = x - mean
            return np.sign(p @ now).T @ (p @ base)

        u, _, vt = np.linalg.svd(_summed(vectors, products).reshape(turn.shape))
        turn = vt.T @ u.T
    return mean, base @ turn


def plan(bits: int, radius: int, rows: int) -> list[tuple[int, int, int]]:
    """(offset, length, radius) of each substring; lengths of about log2(rows), the radii by the pigeonhole principle."""
    m = max(2, min(bits, round(bits / max(8.0, np.log2(max(2, rows))))))
    at = [bits * i // m for i in range(m + 1)]
    each, rest = divmod(radius - m + 1, m) if radius >= m - 1 else (-1, radius + 1)
    return [(at[i], at[i + 1] - at[i], each + (i < rest)) for i in range(m)]


def masks(length: int, radius: int) -> np.ndarray:
    """All numbers of ``length`` binary digits of which at most ``radius`` are set."""
    out = [0]
    for r in range(1, min(radius, length) + 1):
        out += [sum(1 << b for b in c) for c in combinations(range(length), r)]
    return np.array(out, np.uint64)


def _probe(tables: list[tuple[int, int, int]], prefix_bits: int, radius: int):
    """The pairs of a query and a code that a part of one table brings together and no earlier table would."""

    def run(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        nth, prefix = key >> prefix_bits, np.uint64(key & (1 << prefix_bits) - 1)
        offset, length, reach = tables[nth]
        low_bits = length - prefix_bits
        asks = table.column("asks").to_numpy()
        if not asks.any():
            return pa.table({"vec_id": np.empty(0, np.int64), "neighbour": np.empty(0, np.int64)})
        ids, codes = table.column("vec_id").to_numpy(), table.column("code").to_numpy().view(np.uint64)
        sub = codes >> np.uint64(offset) & np.uint64((1 << length) - 1)
        low, high = sub & np.uint64((1 << low_bits) - 1), sub >> np.uint64(low_bits)
        mine = np.flatnonzero(~asks)
        mine = mine[np.argsort(low[mine], kind="stable")]
        names, values, sorted_low = ids[mine], codes[mine], low[mine]
        found_q, found_d = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for p in np.unique(high[asks]):
            left = reach - int(np.bitwise_count(p ^ prefix))
            if left < 0:
                continue
            q = np.flatnonzero(asks & (high == p))
            for mask in masks(low_bits, left):
                target = low[q] ^ mask
                a, b = np.searchsorted(sorted_low, target), np.searchsorted(sorted_low, target, side="right")
                n = b - a
                some = n > 0
                if not some.any():
                    continue
                x, n, a = q[some], n[some], a[some]
                at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
                x = np.repeat(x, n)
                differ = codes[x] ^ values[at]
                ok = (np.bitwise_count(differ) <= radius) & (ids[x] != names[at])
                for o, size, within in tables[:nth]:
                    ok &= np.bitwise_count(differ >> np.uint64(o) & np.uint64((1 << size) - 1)) > within
                found_q.append(ids[x[ok]])
                found_d.append(names[at[ok]])
        return pa.table({"vec_id": np.concatenate(found_q), "neighbour": np.concatenate(found_d)})

    return run


def within_radius(codes: DataFrame, queries: DataFrame, bits: int, radius: int, rows: int) -> DataFrame:
    """(vec_id, neighbour): all pairs of a query and another id whose codes differ in ``radius`` digits at most. Both tables are (vec_id, code).

    Codes that fall to one key of a table are spread over salts, to which the queries go in copies, so that no group
    grows with the number of codes that are alike.
    """
    tables = plan(bits, radius, rows)
    prefix_bits = max(0, min(min(s for _, s, _ in tables) - 1, int(np.log2(max(2, rows))) - 13, 12))
    salts = -(-rows // GROUP_ROWS)
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("long")
    sent = None
    for nth, (offset, length, reach) in enumerate(tables):
        if reach < 0:
            continue
        prefix = F.shiftrightunsigned("code", offset + length - prefix_bits).bitwiseAND((1 << prefix_bits) - 1) if prefix_bits else F.lit(0).cast("long")
        key = F.lit(nth << prefix_bits).cast("long")
        kept = codes.select((key + prefix).alias("key"), salt.alias("salt"), "vec_id", "code", F.lit(False).alias("asks"))
        reached = F.explode(F.array(*[prefix.bitwiseXOR(F.lit(int(x)).cast("long")) for x in masks(prefix_bits, reach)]))
        asking = queries.select(reached.alias("p"), "vec_id", "code").select((key + F.col("p")).alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), "vec_id", "code", F.lit(True).alias("asks"))
        part = kept.unionByName(asking)
        sent = part if sent is None else sent.unionByName(part)
    return sent.groupBy("key", "salt").applyInArrow(_probe(tables, prefix_bits, radius), "vec_id long, neighbour long")


def sure_cosine(bits: int, radius: int, sure: float = 0.95) -> float:
    """The cosine from which on a pair's codes are within the radius with this probability, each sign differing with angle / pi.

    The angle is that of the centred and projected vectors of which the codes are the signs, not of the vectors themselves.
    """
    def held(p: float) -> float:
        return sum(comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(radius + 1))

    low, high = 0.0, 0.5
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if held(mid) >= sure else (low, mid)
    return cos(pi * low)


def settled_rows(near: DataFrame, codes: DataFrame, k: int, bits: int, radius: int) -> DataFrame:
    """The vec_ids for which the radius can hardly have missed a neighbour nearer than the k-th one found.

    Such a neighbour's vector lies within sqrt(2 - 2 cosine) of the row's, and so does its projection, whatever lies
    outside the projection. From the centred projection of the row, of squared length ``size``, it is then seen under
    an angle whose sine is at most the ratio of the two, which must keep within that of ``sure_cosine``. A common
    offset of all vectors makes ``size`` small, so that fewer rows are settled.
    """
    sine2 = 1 - sure_cosine(bits, radius) ** 2
    kth = near.where(F.col("rank") == k).select("vec_id", "cosine")
    return kth.join(codes.select("vec_id", "size"), "vec_id").where(2 - 2 * F.col("cosine") + 1e-6 <= sine2 * F.col("size")).select("vec_id")


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = np.einsum("ij,ij->i", _floats(batch.column("x")), _floats(batch.column("y"))) if batch.num_rows else np.empty(0)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("neighbour"), pa.array(score)], ["vec_id", "neighbour", "cosine"])


def _blocks(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def blob() -> pa.RecordBatch:
            all_rows = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays([pa.array([all_rows.column("vec_id").to_numpy().tobytes()]), pa.array([_floats(all_rows.column("embedding")).tobytes()])], ["ids", "floats"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(rows - n, batch.num_rows - at)
                held.append(batch.slice(at, take))
                n, at = n + take, at + take
                if n == rows:
                    yield blob()
                    held, n = [], 0
        if n:
            yield blob()

    return run


def _compare(path: str, k: int):
    """The k nearest of a block of vectors to each query, ties by id; the queries are read block by block from ``path``."""

    def best(qi: np.ndarray, q: np.ndarray, di: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        out = []
        d32, some = d.astype(np.float32).T, min(k + 1, len(di))
        for at in range(0, len(qi), 256):
            near = q[at : at + 256].astype(np.float32) @ d32
            # all that rounding could put among the k nearest besides the query itself
            least = np.partition(near, len(di) - some, axis=1)[:, len(di) - some] - 1e-5
            i, j = np.nonzero(near >= least[:, None])
            other = qi[at + i] != di[j]
            i, j = i[other], j[other]
            score = np.round(np.einsum("ij,ij->i", q[at + i], d[j]), 6)
            order = np.lexsort((di[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            first = np.searchsorted(i, i)
            kept = np.arange(len(i)) - first < k
            out.append((qi[at + i[kept]], di[j[kept]], score[kept]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["vec_id", "neighbour", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        files = sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(root)) if f.path.endswith(".parquet"))
        for block in _blocks(BLOCK_ROWS)(batches):
            di = np.frombuffer(block.column(0)[0].as_py(), np.int64)
            d = np.frombuffer(block.column(1)[0].as_py()).reshape(len(di), -1)
            for file in files:
                with fs.open_input_file(file) as f:
                    queries = pyarrow.parquet.ParquetFile(f)
                    for asked in queries.iter_batches(batch_size=1):
                        qi = np.frombuffer(asked.column(0)[0].as_py(), np.int64)
                        yield best(qi, np.frombuffer(asked.column(1)[0].as_py()).reshape(len(qi), -1), di, d)

    return run


def nearest(vectors: DataFrame, k: int = 10, shares: tuple[float, ...] = SHARES, turns: int = 8, queries: Column | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(vec_id, neighbour, cosine, rank): the ``k`` nearest other rows by cosine of every row, or of those for which ``queries`` holds, rank 1 first; ties by id.

    ``shares`` are the Hamming radii as shares of the code's digits, in ascending order. Queries that no radius settles
    are searched exactly, all of them in one pass over the vectors; which are settled is decided in the space of the codes (see ``settled_rows``), so an offset
    that all vectors share doesn't matter. The rotation is fitted on about ``fit_rows`` vectors, chosen by a hash of the id; all are indexed. Cosines are rounded to 6 digits. For rows that are left out, and for repeated ids, see ``clean``. A table of one row or none gives none;
    other columns are not read. Copies of a vector are one in the index, so a group of them costs no more than its k + 1 smallest ids.
    """
    spark = vectors.sparkSession
    nothing = "vec_id long, neighbour long, cosine double, rank int"
    same = [F.xxhash64("embedding").alias("s1"), F.xxhash64(F.lit(1), "embedding").alias("s2")]
    unit = cut(clean(vectors).select("vec_id", "embedding", *same))
    if unit.count() < 2:
        return spark.createDataFrame([], nothing)
    copies = Window.partitionBy("s1", "s2").orderBy("vec_id")
    few = cut(unit.withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= k + 1))
    index = few.where("nth = 1").select("vec_id", "embedding")
    rep = few.where("nth = 1").select("s1", "s2", F.col("vec_id").alias("rep"))
    members = few.select("s1", "s2", F.col("vec_id").alias("member")).join(rep, ["s1", "s2"]).select("rep", "member")
    asking = cut((unit if queries is None else unit.where(queries)).select("vec_id", "s1", "s2").join(rep, ["s1", "s2"]).select("vec_id", "rep"))
    rows = index.count()
    dims = len(index.first()["embedding"])
    sample = index if rows <= fit_rows else cut(index.where(F.pmod(F.xxhash64("vec_id"), F.lit(rows)) < fit_rows))
    mean, matrix = rotation(sample, dims, turns)
    bits = matrix.shape[1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        for batch in batches:
            x = (_floats(batch.column("embedding")) - mean) @ matrix if batch.num_rows else np.empty((0, bits))
            code = ((x > 0) * weight).sum(1, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(code), pa.array((x * x).sum(1))], ["vec_id", "code", "size"])

    codes = cut(index.mapInArrow(encode, "vec_id long, code long, size double"))
    first = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "neighbour")
    x, y = index.select("vec_id", F.col("embedding").alias("x")), index.select(F.col("vec_id").alias("neighbour"), F.col("embedding").alias("y"))
    open_ids = asking.select(F.col("rep").alias("vec_id")).distinct()
    found = spark.createDataFrame([], "vec_id long, neighbour long, cosine double")
    for share in shares:
        radius = max(1, int(bits * share))
        open_ids = cut(open_ids)
        left = open_ids.count()
        if not left:
            break
        asked = codes.select("vec_id", "code", "size").join(maybe_broadcast(open_ids, left), "vec_id", "left_semi")
        pairs = within_radius(codes.select("vec_id", "code"), asked.select("vec_id", "code"), bits, radius, rows)
        near = pairs.join(x, "vec_id").join(y, "neighbour").select("vec_id", "neighbour", "x", "y").mapInArrow(_cosines, "vec_id long, neighbour long, cosine double")
        near = cut(near.select("vec_id", "neighbour", F.round("cosine", 6).alias("cosine")).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k))
        settled = cut(settled_rows(near, asked, k, bits, radius))
        settled = maybe_broadcast(settled, settled.count())
        found = found.unionByName(near.join(settled, "vec_id", "left_semi").select("vec_id", "neighbour", "cosine"))
        open_ids = open_ids.join(settled, "vec_id", "left_anti")
    open_ids = cut(open_ids)
    if left := open_ids.count():
        path = fresh_path(spark, "queries")
        index.join(maybe_broadcast(open_ids, left), "vec_id", "left_semi").mapInArrow(_blocks(QUERY_ROWS), "ids binary, floats binary").write.parquet(path)
        exact = index.mapInArrow(_compare(path, k), "vec_id long, neighbour long, cosine double")
        found = found.unionByName(exact.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("vec_id", "neighbour", "cosine"))
    # the k nearest rows are among the members of the k nearest vectors and the query's own copies
    found = found.select(F.col("vec_id").alias("rep"), F.col("neighbour").alias("other"), "cosine")
    own = asking.select("rep").distinct().select("rep", F.col("rep").alias("other"), F.lit(1.0).alias("cosine"))
    rows_of = found.unionByName(own).join(members.withColumnRenamed("rep", "other"), "other").select("rep", F.col("member").alias("neighbour"), "cosine")
    final = asking.join(rows_of, "rep").where("vec_id != neighbour").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return final.select("vec_id", "neighbour", "cosine", "rank")


def op4_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), queries=F.col("vec_id") % 100 == 0)


def sql(k: int = 10) -> str:
    """Brute force for the stated queries. It gives the same rows where no query is settled by its code alone, as on tables without near copies."""
    return f"""with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings where vec_id is not null),
p as (select a.vec_id, b.vec_id as neighbour, round(list_cosine_similarity(a.e, b.e), 6) as cosine from v a join v b on a.vec_id != b.vec_id where a.vec_id % 100 = 0)
select vec_id, neighbour, cosine, (row_number() over (partition by vec_id order by cosine desc, neighbour))::integer as rank from p qualify rank <= {k}"""
