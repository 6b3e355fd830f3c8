"""Suffix-array dedup: passages of many words that occur more than once in the corpus.

Every passage of ``min_words`` words holds an anchor, the word k-gram with the smallest hash in it, and reaches at
least half of the rest to one side of it. So equal passages meet under the hash of an anchor with that much
text to the right, or to the left. A first reading counts these hashes; a second sends the surroundings of those
that occur twice or more to their bucket. There a suffix array and its Burrows-Wheeler transform are built, and breadth-first
backward extension of intervals finds the longest common prefixes by increasing value. It stops at ``min_words``:
neighbours without a value by then start with the same passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaframe.llm.shared import bucket_bits, cut, free_name, fresh_path, keyed, slot_count, steady, steady_splits
from vistaframe.llm.text import Words, chunks, mix, ngram_hash, pack, release, unpack

WIDTH = 48
PIECE_BYTES = 6 << 20
SYMBOL = np.uint64((1 << 32) - 1)


def anchors(h: np.ndarray, row: np.ndarray, k: int, min_words: int) -> np.ndarray:
    """Positions of the leftmost smallest k-gram of every stretch of min_words words within a row."""
    g = ngram_hash(h, k)
    if len(h) < min_words:
        return np.empty(0, np.int64)
    bits = np.uint64(max(1, int(len(g)).bit_length()))
    low = (g >> bits) << bits | np.arange(len(g), dtype=np.uint64)
    span, have = min_words - k + 1, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    inside = row[: len(low)] == row[min_words - 1 : min_words - 1 + len(low)]
    return np.unique(low[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _stretch_hash(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[at + i]
    return mix(out)


class Piece:
    """A stretch of documents: word hashes, and the keys of the anchors, those that look right first, in the order of their hashes."""

    def __init__(self, parts: list[tuple[list, np.ndarray, np.ndarray]], k: int, min_words: int) -> None:
        self.ids = [i for p in parts for i in p[0]]
        base = np.cumsum([0] + [len(p[0]) for p in parts])
        self.h = np.concatenate([p[1] for p in parts])
        self.row = row = np.concatenate([p[2] + f for p, f in zip(parts, base)])
        at = anchors(self.h, row, k, min_words)
        half = (min_words - k + 1) // 2
        n, last = k + half, len(row) - 1
        right = at[row[np.minimum(at + n - 1, last)] == row[at]]
        right = right[right + n - 1 <= last]
        begin = at - half
        left = at[(begin >= 0) & (row[np.maximum(begin, 0)] == row[at])]
        key = np.concatenate([_stretch_hash(self.h, right, n), ~_stretch_hash(self.h, left - half, n)]) >> np.uint64(64 - WIDTH)
        side = np.repeat([0, 1], [len(right), len(left)])
        order = np.argsort(key, kind="stable")
        self.key, self.at, self.side = key[order], np.concatenate([right, left])[order], side[order]
        #: a window begins in [at - early, at - late]
        self.reach = {0: (half, 0), 1: (min_words - k, half)}

    def buckets(self, bits: int) -> np.ndarray:
        return np.searchsorted(self.key >> np.uint64(WIDTH - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def pieces(batches: Iterator[pa.RecordBatch], k: int, min_words: int, limit: int) -> Iterator[tuple[int, Piece]]:
    task, nth, parts, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        for part in chunks(batch):
            words = Words(part.column("text"))
            size += len(words.data)
            parts.append((part.column("doc_id").to_pylist(), words.hash, words.row))
            if size >= limit:
                yield task << 20 | nth, Piece(parts, k, min_words)
                nth, parts, size = nth + 1, [], 0
                release()
    if parts:
        yield task << 20 | nth, Piece(parts, k, min_words)
    del parts
    release()


def _ask(bits: int, k: int, min_words: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, piece in pieces(batches, k, min_words, limit):
            at = piece.buckets(bits)
            some = np.flatnonzero(at[1:] > at[:-1])
            keys = [pack(np.diff(piece.key[at[b] : at[b + 1]], prepend=np.uint64(0)), 6) for b in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([number] * len(some), pa.int64()), pa.array(keys, pa.binary())], ["bucket", "piece", "keys"])

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """For each piece, which of its keys in this bucket occur twice or more in the corpus."""
    rows = table.to_pylist()
    keys = [np.cumsum(unpack(r["keys"], 6), dtype=np.uint64) for r in rows]
    _, code, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    more = count[code] > 1
    at = np.cumsum([0] + [len(x) for x in keys])
    flags = [pa.compress(np.packbits(more[a:b]).tobytes(), codec="zstd", asbytes=True) for a, b in zip(at[:-1], at[1:])]
    return pa.table({"bucket": table.column("bucket"), "piece": pa.array([r["piece"] for r in rows], pa.int64()), "n": pa.array([len(x) for x in keys], pa.int64()), "flags": pa.array(flags, pa.binary())})


SUB_BITS = 4
_AROUND = "bucket int, piece long, ids array<long>, rows binary, words binary, starts binary, subs binary, lengths binary, symbols binary"


def _send(path: str, slots: int, bits: int, k: int, min_words: int, limit: int):
    """The second reading: for each repeated key the words around its anchor, as far as its windows go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        for number, piece in pieces(batches, k, min_words, limit):
            cuts = piece.buckets(bits)
            if not len(piece.key):
                continue
            said = pyarrow.parquet.read_table(f"{root}/slot={(number >> 20) % slots}", filesystem=fs, filters=[("piece", "=", number)], partitioning=None).to_pylist()
            more = np.zeros(len(piece.key), bool)
            for r in said:
                a, b = cuts[r["bucket"]], cuts[r["bucket"] + 1]
                if b - a != r["n"]:
                    raise RuntimeError("the documents changed between the two readings")
                raw = pa.decompress(r["flags"], (r["n"] + 7) // 8, codec="zstd", asbytes=True)
                more[a:b] = np.unpackbits(np.frombuffer(raw, np.uint8), count=r["n"]).astype(bool)
            first_word = np.searchsorted(piece.row, np.arange(len(piece.ids) + 1))
            symbol = piece.h & SYMBOL
            out = []
            for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
                hit = np.flatnonzero(more[cuts[b] : cuts[b + 1]]) + cuts[b]
                if not len(hit):
                    continue
                at, side = piece.at[hit], piece.side[hit]
                row = piece.row[at]
                early = np.where(side == 0, piece.reach[0][0], piece.reach[1][0])
                late = np.where(side == 0, piece.reach[0][1], piece.reach[1][1])
                begin = np.maximum(at - early, first_word[row])
                end = np.minimum(at - late + min_words, first_word[row + 1])
                length = end - begin
                ok = length >= min_words
                row, begin, length = row[ok], begin[ok], length[ok]
                sub = piece.key[hit[ok]] >> np.uint64(WIDTH - bits - SUB_BITS) & np.uint64((1 << SUB_BITS) - 1)
                if not len(row):
                    continue
                kept, place = np.unique(row, return_inverse=True)
                words = np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())
                blob = lambda x, w: pack(x.astype(np.uint64), w)
                out.append((int(b), number, [piece.ids[i] for i in kept], blob(kept, 3), blob(place, 3), blob(begin - first_word[row], 4), blob(sub, 1), blob(length, 2), blob(symbol[words], 4)))
            if out:
                types = (pa.int32(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 6)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["bucket", "piece", "ids", "rows", "words", "starts", "subs", "lengths", "symbols"])

    return run


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes in the order of their first ``depth`` symbols or more, by doubling; only those still equal to another are sorted again."""
    n = len(text)
    _, code, count = np.unique(text, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - count)[code].astype(np.int64)
    active = np.flatnonzero(count[code] > 1)
    h = 1
    while h < depth and len(active):
        follow = active + h
        key = rank[active] * (n + 1) + np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        new = np.append(True, key[1:] != key[:-1])
        old = rank[active]
        group = np.append(True, old[1:] != old[:-1])
        place = np.arange(len(active))
        begin = np.maximum.accumulate(np.where(group, place, 0))
        run = np.maximum.accumulate(np.where(new, place, 0))
        rank[active] = old + run - begin
        size = np.diff(np.append(np.flatnonzero(new), len(active)))
        active = active[np.repeat(size > 1, size)]
        h *= 2
    return np.argsort(rank, kind="stable")


def equal_starts(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, class): suffixes of one class start with the same ``length`` symbols.

    Interval [lb, rb) of the suffixes that begin with w goes to those of cw for each symbol c before one of them;
    where that interval ends, the common prefix with the next suffix is as long as w, unless a shorter one is known.
    """
    n = len(text)
    order = suffix_order(text, length + 1)
    _, before = np.unique(text[order - 1], return_inverse=True)  # the transform, in dense symbols
    step = np.empty(n, np.int64)
    step[np.argsort(before, kind="stable")] = np.arange(n)
    sigma = int(before.max()) + 1
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    lb, rb = np.array([0]), np.array([n])
    for _ in range(length):
        size = rb - lb
        at = np.repeat(lb - np.cumsum(size) + size, size) + np.arange(size.sum())
        key = np.repeat(np.arange(len(lb)), size) * sigma + before[at]
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        lb = step[at[first]]
        rb = lb + count
        fresh = ~known[rb]
        lb, rb = lb[fresh], rb[fresh]
        if not len(lb):
            break
        known[rb] = True
    return order, np.cumsum(known[:n]) - 1


def _words_of(first: np.ndarray, length: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return symbol[np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())]


def _windows(doc: np.ndarray, start: np.ndarray, length: np.ndarray, first: np.ndarray, symbol: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context, bits of the windows in it that are repeated, and of those with an earlier occurrence."""
    every = (np.int64(1) << (length - min_words + 1)) - 1
    words = _words_of(first, length, symbol).astype(np.uint64)
    ends = np.cumsum(length)
    place = np.arange(len(words)) - np.repeat(ends - length, length)
    tag = np.add.reduceat(mix(words + (place.astype(np.uint64) << np.uint64(34))), ends - length)
    # equal contexts are judged once, by the earliest; all windows of the others are repeated and later
    order = np.lexsort((start, doc, tag))
    fresh = np.append(True, tag[order][1:] != tag[order][:-1])
    once = fresh | np.append(True, (doc[order][1:] != doc[order][:-1]) | (start[order][1:] != start[order][:-1]))
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(fresh) - 1
    is_first = np.empty(len(order), bool)
    nth = np.cumsum(once) - 1
    is_first[order] = nth == nth[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    several = np.bincount(which[order], once) > 1
    head = order[fresh]
    d0, s0, n = doc[head], start[head], length[head]
    m = len(n)
    # a mark of its own ends each context
    text = np.empty(int(n.sum()) + m, np.int64)
    ends = np.cumsum(n + 1) - 1
    body = np.ones(len(text), bool)
    body[ends] = False
    text[ends] = -1 - np.arange(m)
    text[body] = _words_of(first[head], n, symbol)
    suffix, group = equal_starts(text, min_words)
    context = np.repeat(np.arange(m), n + 1)[suffix]
    offset = suffix - (ends - n)[context]
    window = offset + min_words <= n[context]
    group, offset, context = group[window], offset[window], context[window]
    d, p = d0[context], s0[context] + offset
    order = np.lexsort((p, d, group))
    g, d, p, c, o = group[order], d[order], p[order], context[order], offset[order]
    new_group = np.append(True, g[1:] != g[:-1])
    new_one = new_group | np.append(True, (d[1:] != d[:-1]) | (p[1:] != p[:-1]))
    of = np.cumsum(new_group) - 1
    hit = (np.bincount(of, new_one) > 1)[of]
    nth = np.cumsum(new_one) - 1
    later = hit & (nth > nth[np.flatnonzero(new_group)][of])
    bit = np.int64(1) << o
    repeated_bits, later_bits = np.zeros(m, np.int64), np.zeros(m, np.int64)
    np.bitwise_or.at(repeated_bits, c[hit], bit[hit])
    np.bitwise_or.at(later_bits, c[later], bit[later])
    repeated = np.where(several[which], every, repeated_bits[which])
    return repeated, np.where(is_first, later_bits[which], every)


def _judge(min_words: int):
    """In a bucket: of every window around the anchors, whether it is repeated, and whether an occurrence comes earlier."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        get = lambda r, name, w: unpack(r[name], w).astype(np.int64)
        base = np.cumsum([0] + [len(r["ids"]) for r in rows])
        ids = [i for r in rows for i in r["ids"]]
        doc_row = np.concatenate([get(r, "rows", 3) for r in rows])
        piece = np.repeat([r["piece"] for r in rows], np.diff(base))
        null = np.array([i is None for i in ids])
        value = np.array([0 if i is None else i for i in ids], np.int64)
        # the same document may come several times: equal (piece, row) get equal places in the order of documents
        order = np.lexsort((doc_row, piece, value, ~null))
        same = (piece[order][1:] == piece[order][:-1]) & (doc_row[order][1:] == doc_row[order][:-1])
        place = np.empty(len(ids), np.int64)
        place[order] = np.cumsum(np.append(0, ~same))
        doc = np.concatenate([place[get(r, "words", 3) + f] for r, f in zip(rows, base)])
        of = np.concatenate([get(r, "words", 3) + f for r, f in zip(rows, base)])
        start = np.concatenate([get(r, "starts", 4) for r in rows])
        length = np.concatenate([get(r, "lengths", 2) for r in rows])
        sub = np.concatenate([get(r, "subs", 1) for r in rows])
        symbol = np.concatenate([unpack(r["symbols"], 4).astype(np.uint32) for r in rows])
        rows.clear()
        first_symbol = np.cumsum(length) - length
        repeated_bits, later_bits = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        # contexts of one key have one sub-bucket, so each can be judged by itself
        for k in np.unique(sub):
            mine = np.flatnonzero(sub == k)
            repeated_bits[mine], later_bits[mine] = _windows(doc[mine], start[mine], length[mine], first_symbol[mine], symbol, min_words)
        del symbol
        release()
        out = []
        row_of, piece_of = doc_row[of], piece[of]
        keep = np.flatnonzero(repeated_bits)
        order = keep[np.argsort(piece_of[keep], kind="stable")]
        for part in np.split(order, np.flatnonzero(np.diff(piece_of[order])) + 1) if len(order) else []:
            kept, back = np.unique(row_of[part], return_index=True)
            blob = lambda x, w: pack(x.astype(np.uint64), w)
            out.append((int(piece_of[part[0]]), [ids[of[part[i]]] for i in back], blob(kept, 3), blob(row_of[part], 3), blob(start[part], 4), blob(repeated_bits[part], 8), blob(later_bits[part], 8)))
        types = (pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], ["piece", "ids", "kept", "rows", "starts", "repeated", "later"])

    return run


def _spans(min_words: int):
    """In a piece: the words that repeated windows cover, and those that windows with an earlier occurrence cover."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        names = {int(k): i for r in rows for k, i in zip(unpack(r["kept"], 3), r["ids"])}
        row = np.concatenate([unpack(r["rows"], 3) for r in rows]).astype(np.int64)
        start = np.concatenate([unpack(r["starts"], 4) for r in rows]).astype(np.int64)
        out = []
        for drop, name in ((False, "repeated"), (True, "later")):
            bits = np.concatenate([unpack(r[name], 8) for r in rows]).astype(np.int64)
            which, offset = np.nonzero(bits[:, None] >> np.arange(63) & 1)
            at = np.unique(row[which] << 36 | start[which] + offset)
            if not len(at):
                continue
            r, s = at >> 36, at & (1 << 36) - 1
            new = np.append(True, (r[1:] != r[:-1]) | (s[1:] - s[:-1] > min_words))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            out += [(names[int(x)], int(a), int(b) + min_words, drop) for x, a, b in zip(r[first], s[first], s[last])]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["doc_id", "begin", "end", "drop"])

    return run


def repeated_passages(docs: DataFrame, min_words: int = 50, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(doc_id, begin, end, drop): words begin to end (exclusive, counted from 0) of a text, in repeated passages.

    Rows without ``drop`` are the longest runs of words that lie in passages of ``min_words`` words that occur
    anywhere else too, in the same text or another. Rows with ``drop`` are the parts that have an earlier
    occurrence, in the order of doc_id (null first) and position; to drop them leaves one occurrence of everything.
    Words are runs of letters, digits and non-ASCII characters, letter case folded. Null, empty and shorter texts have
    none, texts of any length are searched whole, repeated rows repeat each other, an empty table gives none, other
    columns are not read. ``min_words`` lies between 20 and 100.
    """
    if not 20 <= min_words <= 100:
        raise ValueError("min_words must lie between 20 and 100")
    spark, k = docs.sparkSession, min_words // 5
    with steady_splits(spark):
        base = steady(docs.select("doc_id", F.col("text").cast("string").alias("text")))
        bits, slots = bucket_bits(base), slot_count(base)
        asked = base.mapInArrow(_ask(bits, k, min_words, piece_bytes), "bucket int, piece long, keys binary")
        said = asked.groupBy("bucket").applyInArrow(_repeated, "bucket int, piece long, n long, flags binary").withColumn("slot", F.pmod(F.shiftright("piece", 20), F.lit(slots)).cast("int"))
        path = fresh_path(spark, "anchors")
        said.repartition("slot").sortWithinPartitions("slot", "piece").write.partitionBy("slot").parquet(path)
        around = base.mapInArrow(_send(path, slots, bits, k, min_words, piece_bytes), _AROUND)
        judged = around.groupBy("bucket").applyInArrow(_judge(min_words), "piece long, ids array<long>, kept binary, rows binary, starts binary, repeated binary, later binary")
        return cut(judged.groupBy("piece").applyInArrow(_spans(min_words), "doc_id long, begin long, end long, drop boolean"))


def _without(name: str):
    """Texts without the stretches of words that the column ``name`` lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column(name).to_pylist()):
                if spans:
                    raw = texts[i].encode()
                    words = Words(pa.array([texts[i]]), fold=False)
                    kept, at = [], 0
                    for s in sorted(spans, key=lambda s: s["begin"]):
                        kept.append(raw[at : words.start[s["begin"]]])
                        at = int(words.start[s["end"]]) if s["end"] < len(words.start) else len(raw)
                    texts[i] = b"".join([*kept, raw[at:]]).decode()
            names = [n for n in batch.schema.names if n != name]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names)

    return run


def drop_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs without the passages that have an earlier occurrence, in the order of doc_id (nulls first, then by a hash of the text); n_chars, if there, follows the text.

    A text that consists of such passages throughout is dropped with its row, others are kept, null and empty texts
    too. Every row counts by itself, also one without a doc_id or with one that others have; columns of any other name are kept.
    """
    base, key = keyed(docs)
    spans, of = free_name(base, "spans"), free_name(base, "_of")
    found = repeated_passages(base.select(F.col(key).alias("doc_id"), "text"), min_words).where("drop")
    found = found.groupBy(F.col("doc_id").alias(of)).agg(F.collect_list(F.struct("begin", "end")).alias(spans))
    marked = base.join(found, F.col(key) == F.col(of), "left").select(*docs.columns, spans)
    touched = F.col(spans).isNotNull()
    done = marked.where(touched).mapInArrow(_without(spans), docs.schema).where(F.trim("text") != "")
    both = done.unionByName(marked.where(~touched).drop(spans))
    return both.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else both


def op5_repeats(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(min_words: int = 50, source: str = "documents") -> str:
    return f"""with t as (select row_number() over (order by doc_id) as r, doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') as w from {source}),
i as (select r, doc_id, unnest(range(len(w) - {min_words} + 1)) as i, w from t where len(w) >= {min_words}),
h as (select r, doc_id, i, md5(array_to_string(w[i + 1 : i + {min_words}], ' ')) as h from i),
c as (select r, doc_id, i, count(*) over (partition by h) > 1 as repeated, row_number() over (partition by h order by r, i) > 1 as later from h),
k as (select r, doc_id, i, false as "drop" from c where repeated union all select r, doc_id, i, true from c where later),
n as (select *, case when i - lag(i) over (partition by r, "drop" order by i) <= {min_words} then 0 else 1 end as fresh from k),
s as (select *, sum(fresh) over (partition by r, "drop" order by i) as run from n)
select doc_id, min(i)::bigint as "begin", (max(i) + {min_words})::bigint as "end", "drop" from s group by r, doc_id, "drop", run"""
