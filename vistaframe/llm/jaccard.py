"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams, that of their hashes, is cut into fragments. A first round over the fragments counts
in how many documents each n-gram occurs; only documents of whose n-grams the share ``threshold`` or more occurs
elsewhere can have a partner, so the others drop out with all they hold. A second round counts, fragment by
fragment, the overlaps of the pairs that share an n-gram there, and the sum for each pair decides.

N-grams of more than ``hot`` documents don't make pairs by themselves: a document whose hot n-grams are a smaller
share than ``threshold`` must have a cold one in common with any partner, so for its pairs the hot n-grams are one
more fragment, counted for those pairs alone. That leaves out no pair.

Documents that consist of hot n-grams for the most part ("heavy" ones) may form groups of any size, whose pairs grow with its
square. Those among themselves are therefore never sent as pairs: heavy documents that share an n-gram of their
prefixes, as every similar pair does, are brought together, large groups in blocks; products of matrices give all the
overlaps of two blocks, and what leaves a block is a row for each document, with its number of links and its class there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaframe.llm.shared import bucket_bits, cut, maybe_broadcast, steady, steady_splits
from vistaframe.llm.text import Words, chunks, mix, ngram_hash, pack, release, row_ngrams, unpack

WIDTH = 48
PIECE_BYTES = 12 << 20
HOT = 64
PAIRS_AT_ONCE = 1 << 21
BLOCK_ROWS, BLOCK_GRAMS = 2048, 1 << 20


def distinct_grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's different n-grams, by row; a row with fewer than n words has one of all its words."""
    h, row, _ = row_ngrams(words.hash, words.row, n)
    at = words.bounds()
    size = np.diff(at)
    short, extra = np.flatnonzero((size > 0) & (size < n)), []
    for k in range(1, n):
        rows = short[size[short] == k]
        if len(rows):
            first = words.hash[at[rows]].copy()
            for j in range(1, k):
                first = mix(first * np.uint64(3) + words.hash[at[rows] + j])
            extra.append((rows, mix(first + np.uint64(k))))
    if extra:
        row = np.concatenate([row, *(r for r, _ in extra)])
        h = np.concatenate([h, *(x for _, x in extra)])
    h = h >> np.uint64(64 - WIDTH)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


_SENT = "bucket int, piece long, kind string, ids array<long>, a binary, b binary, c binary"
_NAMES = ["bucket", "piece", "kind", "ids", "a", "b", "c"]
_TYPES = (pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())


def _rows(rows: list[tuple], names: list[str] = _NAMES, types: tuple = _TYPES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names)


def _cut_up(bits: int, n: int, limit: int):
    """Each piece of the corpus: the identities of its documents, and for each fragment their n-grams there."""

    def flush(number: int, parts: list) -> pa.RecordBatch:
        ids = [i for p in parts for i in p[0]]
        base = np.cumsum([0] + [len(p[0]) for p in parts])
        row = np.concatenate([p[1] + f for p, f in zip(parts, base)]).astype(np.uint64)
        h = np.concatenate([p[2] for p in parts])
        size = np.bincount(row.astype(np.int64), minlength=len(ids))
        sig = np.zeros(len(ids), np.uint64)
        if len(h):
            some = size > 0
            sig[some] = np.add.reduceat(mix(h.copy()), np.cumsum(size)[some] - size[some])
        sig = mix(sig + size.astype(np.uint64))
        order = np.argsort(h, kind="stable")
        h, row = h[order], row[order]
        at = np.searchsorted(h >> np.uint64(WIDTH - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        out = [(number % (1 << bits), number, "docs", ids, pack(size.astype(np.uint64), 4), pack(sig, 8), None)]
        for b in np.flatnonzero(at[1:] > at[:-1]):
            s = slice(at[b], at[b + 1])
            out.append((int(b), number, "grams", None, pack(row[s], 3), pack(np.diff(h[s], prepend=np.uint64(0)), 6), None))
        return _rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, parts, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"))
                size += len(words.data)
                parts.append((part.column("doc_id").to_pylist(), *distinct_grams(words, n)))
                if size >= limit:
                    yield flush(task << 20 | nth, parts)
                    nth, parts, size = nth + 1, [], 0
                    release()
        if parts:
            yield flush(task << 20 | nth, parts)
        del parts
        release()

    return run


def _fragment_counts(hot: int):
    """In a fragment: which n-grams occur in two documents or more, returned to the pieces that hold them, with a rank that is 0 for cold ones and grows with the number of documents for hot ones."""

    def run(table: pa.Table) -> pa.Table:
        release()
        rows = table.to_pylist()
        out = [tuple(r[k] for k in _NAMES) for r in rows if r["kind"] == "docs"]
        rows = [r for r in rows if r["kind"] == "grams"]
        if rows:
            hashes = [np.cumsum(unpack(r["b"], 6), dtype=np.uint64) for r in rows]
            size = np.cumsum([0] + [len(h) for h in hashes])
            order = np.argsort(h := np.concatenate(hashes), kind="stable")
            same = h[order]
            first = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
            count = np.diff(np.append(first, len(same)))
            df = np.empty(len(h), np.int64)
            df[order] = np.repeat(count, count)
            for i, r in enumerate(rows):
                d = df[size[i] : size[i + 1]]
                keep = d > 1
                if keep.any():
                    out.append((r["bucket"], r["piece"], "grams", None, pack(unpack(r["a"], 3)[keep], 3), pack(np.diff(hashes[i][keep], prepend=np.uint64(0)), 6), pack(np.where(d[keep] > hot, 1 + np.minimum(254, 4 * np.log2(np.maximum(d[keep] / hot, 1))), 0).astype(np.uint64), 1)))
        return pa.Table.from_batches([_rows(out)])

    return run


_LEFT = "bucket int, ids array<long>, uids binary, sigs binary, sizes binary, n_hot binary, docs binary, grams binary, ranks binary"
_LEFT_NAMES = ["bucket", "ids", "uids", "sigs", "sizes", "n_hot", "docs", "grams", "ranks"]
_LEFT_TYPES = (pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 7)


def _heavy(n_hot: np.ndarray, size: np.ndarray, threshold: float) -> np.ndarray:
    """Which documents consist of hot n-grams for the most part: pairs of two such needn't have a cold one in common."""
    return n_hot >= threshold * size - 1e-6


def _survivors(threshold: float, coarser: int):
    """In a piece: the documents that may have a partner, with their shared cold n-grams by fragment; bucket -1 lists them with their hot n-grams, bucket -2 the heavy ones with all shared n-grams."""

    def run(table: pa.Table) -> pa.Table:
        release()
        rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        head = next(r for r in rows if r["kind"] == "docs")
        rows = [r for r in rows if r["kind"] == "grams"]
        size = unpack(head["a"], 4).astype(np.int64)
        docs = [unpack(r["a"], 3).astype(np.int64) for r in rows]
        grams = [np.cumsum(unpack(r["b"], 6), dtype=np.uint64) for r in rows]
        ranks = [unpack(r["c"], 1) for r in rows]
        hot = [x > 0 for x in ranks]
        shared, n_hot = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for d, x in zip(docs, hot):
            shared += np.bincount(d, minlength=len(size))
            n_hot += np.bincount(d[x], minlength=len(size))
        live = (size > 0) & (shared >= threshold * size - 1e-6)
        kept = np.flatnonzero(live)
        place = np.cumsum(live) - 1
        out = []
        if len(kept):
            whole = [(head["piece"] << 24 | kept).astype(np.uint64), unpack(head["b"], 8)[kept], size[kept].astype(np.uint64), n_hot[kept].astype(np.uint64)]
            of = lambda some: [pack(x[some], w) for x, w in zip(whole, (8, 8, 4, 4))]
            parts: dict[int, list] = {}
            hot_docs, hot_grams = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for r, d, g, x in zip(rows, docs, grams, hot):
                ok = live[d]
                mine = ok & ~x
                if mine.any():
                    parts.setdefault(r["bucket"] >> coarser, []).append((place[d[mine]], g[mine]))
                hot_docs.append(place[d[ok & x]])
                hot_grams.append(g[ok & x])
            for b, found in parts.items():
                d, g = (np.concatenate(c) for c in zip(*found))
                # only documents with an n-gram there: all of them in each fragment would grow with the square of the input
                here = np.zeros(len(kept), bool)
                here[d] = True
                nth = np.cumsum(here) - 1
                out.append((b, None, *of(here), pack(nth[d], 3), pack(np.diff(g, prepend=np.uint64(0)), 6), None))
            out.append((-1, [head["ids"][i] for i in kept], *of(slice(None)), pack(np.concatenate(hot_docs).astype(np.uint64), 3), pack(np.concatenate(hot_grams), 6), None))
            heavy = live & _heavy(n_hot, size, threshold)
            if heavy.any():
                nth = np.cumsum(heavy) - 1
                d, g, x = (np.concatenate(c) for c in (docs, grams, ranks))
                mine = heavy[d]
                out.append((-2, None, None, pack(unpack(head["b"], 8)[heavy], 8), pack(size[heavy].astype(np.uint64), 4), None, pack(nth[d[mine]].astype(np.uint64), 3), pack(g[mine], 6), pack(x[mine], 1)))
        return pa.Table.from_batches([_rows(out, _LEFT_NAMES, _LEFT_TYPES)])

    return run


def _pairs_of(lists: np.ndarray, times: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs within each row of ``lists``, with how many n-grams the row stands for."""
    width = lists.shape[1]
    if width <= 512:
        left, right = np.triu_indices(width, 1)
        step = max(1, PAIRS_AT_ONCE // len(left))
        for at in range(0, len(lists), step):
            part = lists[at : at + step]
            yield part[:, left].ravel(), part[:, right].ravel(), np.repeat(times[at : at + step], len(left))
        return
    step = max(1, PAIRS_AT_ONCE // width)
    for members, n in zip(lists, times):
        for at in range(0, width, step):
            rest = members[at:]
            i, j = np.triu_indices(min(step, width - at), 1, len(rest))
            yield rest[i], rest[j], np.full(len(i), n)


def _components(lists: np.ndarray, docs: np.ndarray, n_docs: int) -> np.ndarray:
    """For each (list, document) entry, ordered by list, the smallest document that lists connect it to."""
    label = np.arange(n_docs)
    first = np.flatnonzero(np.append(True, lists[1:] != lists[:-1]))
    length = np.diff(np.append(first, len(lists)))
    while True:
        least = np.repeat(np.minimum.reduceat(label[docs], first), length)
        new = label.copy()
        np.minimum.at(new, docs, least)
        new = new[new]
        if (new == label).all():
            return label[docs]
        label = new


def _dense(lists: np.ndarray, docs: np.ndarray, n_docs: int) -> tuple[Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """Pairs within groups of documents that share most of their lists, by products of incidence matrices; and which lists are left."""
    label = _components(lists, docs, n_docs)
    order = np.argsort(label, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(label[order])) + 1)
    todo, left = [], np.zeros(int(lists[-1]) + 1, bool)
    for at in parts:
        members, d = np.unique(docs[at], return_inverse=True)
        kept, g = np.unique(lists[at], return_inverse=True)
        # a product of dense matrices takes about a thousandth of the time for each step
        if len(members) ** 2 * len(kept) <= 1000 * (np.bincount(g).astype(float) ** 2).sum() and len(members) * len(kept) <= 1 << 25:
            todo.append((members, d, g, len(kept)))
        else:
            left[kept] = True

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for members, d, g, width in todo:
            m = np.zeros((len(members), width), np.float32)
            m[d, g] = 1
            step = max(1, PAIRS_AT_ONCE // len(members))
            for a in range(0, len(members), step):
                n = np.triu(m[a : a + step] @ m[a:].T, 1)
                x, y = np.nonzero(n)
                yield members[x + a], members[y + a], n[x, y].astype(np.int64)

    return pairs(), left


WIDE = 8
_PAIRS = "a long, b long, n long, size_a long, size_b long, more long"
_PLANES = ((8, "a"), (8, "b"), (4, "n"), (4, "size_a"), (4, "size_b"), (4, "hot_a"), (4, "hot_b"))


def _overlaps(threshold: float, shards: int):
    """In a fragment: the overlap there of every pair whose sizes allow a match, but for pairs of heavy documents, sent to the pair's shard. Documents of equal n-grams count as one."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        sig = [unpack(r["sigs"], 8) for r in rows]
        base = np.cumsum([0] + [len(x) for x in sig])
        _, first, code = np.unique(np.concatenate(sig), return_index=True, return_inverse=True)
        # copies meet in the same fragments, so the least of their numbers stands for them everywhere
        uid = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(uid, code, np.concatenate([unpack(r["uids"], 8) for r in rows]).astype(np.int64))
        size = np.concatenate([unpack(r["sizes"], 4) for r in rows]).astype(np.int64)[first]
        n_hot = np.concatenate([unpack(r["n_hot"], 4) for r in rows]).astype(np.int64)[first]
        # in the order of the numbers, so that x < y means the same in every fragment
        order = np.argsort(uid)
        place = np.empty(len(uid), np.int64)
        place[order] = np.arange(len(uid))
        uid, size, n_hot, code = uid[order], size[order], n_hot[order], place[code]
        shard = (mix(uid.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
        doc = np.concatenate([code[unpack(r["docs"], 3).astype(np.int64) + f] for r, f in zip(rows, base)])
        gram = np.concatenate([np.cumsum(unpack(r["grams"], 6), dtype=np.uint64) for r in rows])
        rows.clear()
        order = np.argsort(doc, kind="stable")
        order = order[np.argsort(gram[order], kind="stable")]
        doc, gram = doc[order], gram[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
        doc, gram = doc[new], gram[new]
        start = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.empty(0, np.int64)
        width = np.diff(np.append(start, len(gram)))
        least = threshold - 1e-9
        heavy = _heavy(n_hot, size, threshold)
        held, held_n = [], 0

        def sent() -> pa.RecordBatch:
            key, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(back, np.concatenate([c for _, c in held])).astype(np.int64)
            x, y = np.divmod(key, len(uid))
            # sorted once, as there are the more shards the larger the input is
            order = np.argsort(shard[x], kind="stable")
            x, y, n = x[order], y[order], n[order]
            to = shard[x]
            first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            near = np.append(True, x[1:] != x[:-1])
            one = np.diff(uid[x], prepend=0)
            one[first] = uid[x[first]]
            other = np.where(near, uid[y], np.diff(uid[y], prepend=0))
            planes = [v.astype(np.uint64) for v in (one, other, n, size[x], size[y], n_hot[x], n_hot[y])]
            out = [(int(to[a]), *(pack(v[a:b], w) for v, (w, _) in zip(planes, _PLANES))) for a, b in zip(first, np.append(first[1:], len(to)))]
            types = (pa.int32(), *[pa.binary()] * len(_PLANES))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["shard", *(name for _, name in _PLANES)])

        wide = width >= WIDE
        sources = []
        if wide.any():
            entry = np.repeat(wide, width)
            found, left = _dense(np.repeat(np.cumsum(wide) - 1, width)[entry], doc[entry], len(uid))
            sources.append(found)
            sparse = ~wide
            sparse[np.flatnonzero(wide)[: len(left)]] = left
        else:
            sparse = ~wide

        def by_lists() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for d in np.unique(width[sparse]):
                if d < 2:
                    continue
                first_at = start[sparse & (width == d)]
                lists = np.stack([doc[first_at + i] for i in range(d)], axis=1)
                # n-grams with the same documents count together
                tag = np.zeros(len(lists), np.uint64)
                for i in range(d):
                    tag = mix(tag + lists[:, i].astype(np.uint64))
                _, one, times = np.unique(tag, return_index=True, return_counts=True)
                yield from _pairs_of(lists[one], times)

        sources.append(by_lists())
        for x, y, n in (p for source in sources for p in source):
            ok = (np.minimum(size[x], size[y]) >= least * np.maximum(size[x], size[y])) & ~(heavy[x] & heavy[y])
            if ok.any():
                held.append((x[ok] * len(uid) + y[ok], n[ok]))
                held_n += len(held[-1][0])
            if held_n > PAIRS_AT_ONCE:
                yield sent()
                held, held_n = [], 0
        if held:
            yield sent()

    names = ["shard", *(name for _, name in _PLANES)]

    def run(table: pa.Table) -> pa.Table:
        out = list(partial(iter(table.to_batches())))
        release()
        return pa.Table.from_batches(out) if out else pa.Table.from_arrays([pa.array([], pa.int32()), *[pa.array([], pa.binary())] * len(_PLANES)], names)

    return run


def _summed(threshold: float):
    """In a shard: the overlaps of each pair added up, of pairs that may match; ``more`` bounds what hot n-grams may still add."""

    def run(table: pa.Table) -> pa.Table:
        cols: list[list[np.ndarray]] = [[] for _ in _PLANES]
        for r in table.to_pylist():
            got = [unpack(r[name], w).astype(np.int64) for w, name in _PLANES]
            a = np.cumsum(got[0])
            near = np.append(True, a[1:] != a[:-1])
            total = np.cumsum(got[1])
            # the second number starts anew where the first changes
            begin = np.maximum.accumulate(np.where(near, np.arange(len(a)), 0))
            got[0], got[1] = a, total - (total[begin] - got[1][begin])
            for c, v in zip(cols, got):
                c.append(v)
        a, b, n, size_a, size_b, hot_a, hot_b = (np.concatenate(c) for c in cols)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        n = np.add.reduceat(n[order], first)
        a, b, size_a, size_b, hot_a, hot_b = a[first], b[first], *(v[order[first]] for v in (size_a, size_b, hot_a, hot_b))
        more = np.minimum(hot_a, hot_b)
        most = np.minimum(n + more, np.minimum(size_a, size_b))
        ok = most / (size_a + size_b - most) >= threshold
        return pa.table({c: v[ok] for c, v in zip(("a", "b", "n", "size_a", "size_b", "more"), (a, b, n, size_a, size_b, more))})

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, uid, sig, hot) of the documents that may have a partner."""
    for batch in batches:
        for r in batch.to_pylist():
            docs, grams = unpack(r["docs"], 3).astype(np.int64), unpack(r["grams"], 6).astype(np.int64)
            order = np.argsort(docs, kind="stable")
            lists = np.split(grams[order], np.searchsorted(docs[order], np.arange(1, len(r["ids"]))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["ids"], pa.int64()), pa.array(unpack(r["uids"], 8).view(np.int64)), pa.array(unpack(r["sigs"], 8).view(np.int64)), pa.array(lists, pa.list_(pa.int64()))],
                ["doc_id", "uid", "sig", "hot"],
            )


def _prefixes(threshold: float):
    """(sig, size, prefix, grams) of heavy documents. Of all their n-grams in one order, rare ones first, two similar documents share one among the first size - ceil(threshold * size) + 1 of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sig, size = unpack(r["sigs"], 8).view(np.int64), unpack(r["sizes"], 4).astype(np.int64)
                docs, grams, ranks = unpack(r["docs"], 3).astype(np.int64), unpack(r["grams"], 6).astype(np.int64), unpack(r["ranks"], 1)
                order = np.lexsort((grams, ranks, docs))
                docs, grams = docs[order], grams[order]
                at = np.searchsorted(docs, np.arange(len(sig) + 1))
                # those of no other document come first, and aren't here
                first = np.diff(at) - np.ceil(threshold * size - 1e-6).astype(np.int64) + 1
                prefix = [grams[a : a + k] for a, k in zip(at, first)]
                held = [pack(grams[a:b].astype(np.uint64), 6) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(size), pa.array(prefix, pa.list_(pa.int64())), pa.array(held, pa.binary())], ["sig", "size", "prefix", "grams"])

    return run


def _common(row_a: np.ndarray, gram_a: np.ndarray, n_a: int, row_b: np.ndarray, gram_b: np.ndarray, n_b: int) -> np.ndarray:
    """How many n-grams each of n_a documents has in common with each of n_b."""
    _, col = np.unique(np.concatenate([gram_a, gram_b]), return_inverse=True)
    col_a, col_b = col[: len(gram_a)], col[len(gram_a) :]
    count_a, count_b = np.bincount(col_a, minlength=col.max() + 1), np.bincount(col_b, minlength=col.max() + 1)
    # a step of a product takes a small part of the time of a pair
    dense = count_a * count_b * 256 >= n_a * n_b
    out = np.zeros((n_a, n_b), np.float32)
    nth, step = np.cumsum(dense) - 1, max(1, (1 << 22) // max(n_a, n_b))
    for at in range(0, int(dense.sum()), step):
        part = dense & (nth >= at) & (nth < at + step)
        m = []
        for row, c, n in ((row_a, col_a, n_a), (row_b, col_b, n_b)):
            mine = part[c]
            m.append(np.zeros((n, min(step, int(dense.sum()) - at)), np.float32))
            m[-1][row[mine], nth[c[mine]] - at] = 1
        out += m[0] @ m[1].T
    mine = ~dense[col_a] & (count_b[col_a] > 0)
    row_a, col_a = row_a[mine], col_a[mine]
    row_b = row_b[np.argsort(col_b, kind="stable")]
    begin, width, flat = (np.cumsum(count_b) - count_b)[col_a], count_b[col_a], out.reshape(-1)
    upto = np.cumsum(width)
    low = 0
    while low < len(width):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PAIRS_AT_ONCE, side="right")))
        w = width[low:high]
        inner = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        np.add.at(flat, np.repeat(row_a[low:high] * n_b, w) + row_b[np.repeat(begin[low:high], w) + inner], np.float32(1))
        low = high
    return out


_CELL = "sig long, rep long, sig_b long, rep_b long, n long, n_b long, jaccard double"


def _cells(threshold: float, listed: bool):
    """In two blocks of a group, or in several small groups: for each document with links there their number and the least representative that they lead to (rep_b); or with ``listed`` the similar pairs."""

    def cell(t: dict, a: np.ndarray, b: np.ndarray, same: bool) -> pa.RecordBatch:
        spread = lambda i: (np.repeat(np.arange(len(i)), [len(t["grams"][k]) for k in i]), np.concatenate([t["grams"][k] for k in i]))
        both = _common(*spread(a), len(a), *spread(b), len(b))
        if same:
            np.fill_diagonal(both, 0)
        size_a, size_b = t["size"][a], t["size"][b]
        found = [np.empty((3, 0))]
        step = max(1, PAIRS_AT_ONCE // len(b))
        for at in range(0, len(a), step):
            o = both[at : at + step].astype(np.float64)
            j = o / (size_a[at : at + step, None] + size_b[None, :] - o)
            x, y = np.nonzero((j >= threshold) & (o > 0))
            found.append(np.stack([x + at, y, j[x, y]]))
        x, y, j = np.concatenate(found, axis=1)
        x, y = x.astype(np.int64), y.astype(np.int64)
        if listed:
            once = x < y if same else slice(None)
            i, k = a[x[once]], b[y[once]]
            return rows(t["sig"][i], t["rep"][i], t["sig"][k], t["rep"][k], t["n_ids"][i], t["n_ids"][k], j[once])
        nodes = a if same else np.concatenate([a, b])
        nodes = nodes[np.argsort(t["rep"][nodes], kind="stable")]
        place = np.zeros(len(t["sig"]), np.int64)
        place[nodes] = np.arange(len(nodes))
        links = np.bincount(place[a[x]], t["n_ids"][b[y]], minlength=len(nodes))
        if not same:
            links += np.bincount(place[b[y]], t["n_ids"][a[x]], minlength=len(nodes))
        some = nodes[links > 0]
        label = np.arange(len(nodes))
        if len(x):
            first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            length = np.diff(np.append(first, len(x)))
            u, v = place[a[x[first]]], place[b[y]]
            while True:
                new = label.copy()
                least = np.minimum(np.minimum.reduceat(label[v], first), label[u])
                np.minimum.at(new, u, least)
                np.minimum.at(new, v, np.repeat(least, length))
                new = new[new]
                if (new == label).all():
                    break
                label = new
        return rows(t["sig"][some], t["rep"][some], None, t["rep"][nodes[label[place[some]]]], links[links > 0].astype(np.int64), None, None)

    def rows(*cols) -> pa.RecordBatch:
        n = len(cols[0])
        types = [pa.int64()] * 6 + [pa.float64()]
        return pa.RecordBatch.from_arrays([pa.nulls(n, x) if c is None else pa.array(c, x) for c, x in zip(cols, types)], [x.split()[0] for x in _CELL.split(", ")])

    def run(table: pa.Table) -> pa.Table:
        release()
        t = {c: table.column(c).to_numpy() for c in ("sig", "rep", "n_ids", "size", "comp", "block")}
        t["grams"] = [unpack(x, 6).astype(np.int64) for x in table.column("grams").to_pylist()]
        i, k = table.column("i")[0].as_py(), table.column("k")[0].as_py()
        out = []
        if i != k:
            a, b = np.flatnonzero(t["block"] == i), np.flatnonzero(t["block"] == k)
            # blocks of few long documents may be empty
            out.append(cell(t, a, b, False) if len(a) and len(b) else rows(*[[]] * 7))
        else:
            order = np.argsort(t["comp"], kind="stable")
            for a in np.split(order, np.flatnonzero(np.diff(t["comp"][order])) + 1):
                out.append(cell(t, a, a, True))
        return pa.Table.from_batches(out)

    return run


def _among_heavy(left: DataFrame, sets: DataFrame, threshold: float, listed: bool, block_rows: int, block_grams: int) -> DataFrame:
    """The rows of ``_cells`` for all heavy documents, sets of equal n-grams as one."""
    heavy = left.where("bucket = -2").select("sigs", "sizes", "docs", "grams", "ranks").mapInArrow(_prefixes(threshold), "sig long, size long, prefix array<long>, grams binary")
    heavy = cut(heavy.dropDuplicates(["sig"]).join(sets.select("sig", "rep", "n_ids"), "sig"))
    shared = heavy.select("sig", F.explode("prefix").alias("gram"))
    least = shared.groupBy("gram").agg(F.min("sig").alias("doc_a"), F.count("sig").alias("n")).where("n > 1")
    comps = groups(shared.join(least, "gram").where("sig != doc_a").select("doc_a", F.col("sig").alias("doc_b")).distinct())
    near = cut(heavy.drop("prefix").join(comps.select(F.col("doc_id").alias("sig"), F.col("first").alias("comp")), "sig"))
    grams = F.sum(F.length("grams") / 6)
    sizes = cut(near.groupBy("comp").agg(F.greatest(F.ceil(grams / block_grams), F.ceil(F.count("sig") / block_rows)).alias("blocks"), grams.alias("grams")))
    total = sizes.agg(F.sum(F.expr("if(blocks = 1, grams, 0)")).alias("small"), F.sum(F.expr("if(blocks > 1, blocks * (blocks + 1) / 2, 0)")).alias("cells")).first()
    shares = int((total["small"] or 0) // block_grams) + 1
    placed = near.join(sizes.select("comp", "blocks"), "comp").withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    home = F.when(F.col("blocks") > 1, F.col("comp")).otherwise(F.pmod(F.xxhash64("comp"), F.lit(shares)))
    placed = placed.select((F.col("blocks") > 1).alias("large"), home.alias("home"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("k"), "block", "comp", "sig", "rep", "n_ids", "size", "grams")
    keys = ["large", "home", "i", "k"]
    return placed.repartition(min(10_000, shares + int(total["cells"] or 0)), *keys).groupBy(*keys).applyInArrow(_cells(threshold, listed), _CELL)


def _similar(docs: DataFrame, n: int, threshold: float, hot: int, piece_bytes: int, listed_pairs: bool, block_rows: int, block_grams: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, pairs, heavy): each doc_id with each set of n-grams that it has, as (doc_id, sig, rep, n_ids), rep the smallest doc_id of the set and n_ids their number; and the pairs of similar sets, as (sig_a, sig_b, rep_a, rep_b, n_a, n_b, jaccard), but for those of two heavy sets, which are in the rows of ``_cells``."""
    spark = docs.sparkSession
    with steady_splits(spark):
        base = steady(docs.select("doc_id", F.col("text").cast("string").alias("text")))
        bits = bucket_bits(base)
        pieces = base.mapInArrow(_cut_up(bits, n, piece_bytes), _SENT)
        counted = pieces.groupBy("bucket").applyInArrow(_fragment_counts(hot), _SENT)
        # what is left is so much less that fewer fragments do, and a pair's overlap comes in fewer parts
        left = cut(counted.groupBy("piece").applyInArrow(_survivors(threshold, 2), _LEFT))
    parts = left.where("bucket >= 0").groupBy("bucket").applyInArrow(_overlaps(threshold, 1 << bits >> 2), "shard int, " + ", ".join(f"{name} binary" for _, name in _PLANES))
    pairs = cut(parts.groupBy("shard").applyInArrow(_summed(threshold), _PAIRS))
    enough = lambda o: o / (F.col("size_a") + F.col("size_b") - o) >= threshold
    listed = left.where("bucket = -1").select("ids", "uids", "sigs", "docs", "grams").mapInArrow(_listed, "doc_id long, uid long, sig long, hot array<long>")
    open_pairs = pairs.where("more > 0").drop("more")
    # copies are in all fragments together, so the pairs name a set by the least number of its documents
    grams = listed.groupBy("uid").agg(F.first("hot").alias("hot"))
    hot_a, hot_b = grams.select(F.col("uid").alias("a"), F.col("hot").alias("x")), grams.select(F.col("uid").alias("b"), F.col("hot").alias("y"))
    summed = open_pairs.join(hot_a, "a").join(hot_b, "b").withColumn("n", F.col("n") + F.size(F.array_intersect("x", "y")))
    final = pairs.where("more = 0").drop("more").unionByName(summed.select(open_pairs.columns)).where(enough(F.col("n")))
    final = final.select("a", "b", (F.col("n") / (F.col("size_a") + F.col("size_b") - F.col("n"))).alias("jaccard"))
    once = cut(listed.groupBy("sig", "doc_id").agg(F.min("uid").alias("uid")))
    sets = cut(once.groupBy("sig").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("rep"), F.count("doc_id").alias("n_ids")).where("rep is not null"))
    of = maybe_broadcast(sets, sets.count())
    side = lambda x: of.select(F.col("uid").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("rep").alias(f"rep_{x}"), F.col("n_ids").alias(f"n_{x}"))
    pair = cut(final.join(side("a"), "a").join(side("b"), "b").select("sig_a", "sig_b", "rep_a", "rep_b", "n_a", "n_b", "jaccard"))
    heavy = cut(_among_heavy(left, of, threshold, listed_pairs, block_rows, block_grams))
    return once.where("doc_id is not null").select("doc_id", "sig").join(of.select("sig", "rep", "n_ids"), "sig").select("doc_id", "sig", "rep", "n_ids"), pair, heavy


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.5, hot: int = HOT, piece_bytes: int = PIECE_BYTES, block_rows: int = BLOCK_ROWS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b: the pairs of documents whose sets of word n-grams overlap by ``threshold`` or more, copies as a class.

    Documents with equal sets are a class, whose representative is the smallest doc_id. Listed are all similar pairs
    of representatives, and each other member with its own representative (jaccard 1), which names every link without
    listing those within and between groups of copies one by one; there is no limit on partners.
    Letter case of all scripts is folded. A text of fewer than n words has one n-gram, of all its words; null and empty texts, and texts without a word,
    have none and no partner. Rows with a null doc_id can't be named and are left out of the result; rows that share
    a doc_id aren't paired with each other, and a row repeated as a whole changes nothing. Texts of any length count
    whole; an empty table gives none; other columns are not read.
    """
    entries, pairs, heavy = _similar(docs, n, threshold, hot, piece_bytes, True, block_rows, block_grams)
    pairs = pairs.select("rep_a", "rep_b", "jaccard").unionByName(heavy.select(F.col("rep").alias("rep_a"), "rep_b", "jaccard"))
    own = entries.select("doc_id", "rep", F.lit(1.0).alias("jaccard"))
    found = pairs.select(F.col("rep_a").alias("doc_id"), F.col("rep_b").alias("rep"), "jaccard").unionByName(own).where("doc_id != rep")
    found = found.select(F.least("doc_id", "rep").alias("doc_a"), F.greatest("doc_id", "rep").alias("doc_b"), "jaccard")
    # a doc_id with several texts can give a pair twice
    return found.groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def similar_documents(docs: DataFrame, n: int = 5, threshold: float = 0.5, hot: int = HOT, piece_bytes: int = PIECE_BYTES, block_rows: int = BLOCK_ROWS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(doc_id, class_id, n_links): one row for each doc_id that isn't null.

    A link is a pair of documents whose sets of word n-grams overlap by ``threshold`` or more. class_id is the smallest
    doc_id that links lead to, the document's own if it has none. n_links counts the document's links, copies one by
    one although no pairs of copies are listed anywhere: each similar set counts with the number of its documents. Nor are
    pairs of heavy documents listed, so a large group of different near copies sends rows in proportion to its size times its blocks. A
    doc_id with several texts has the links of all of them, those between them too. See ``jaccard_join`` for the rest.
    """
    entries, pairs, heavy = _similar(docs, n, threshold, hot, piece_bytes, False, block_rows, block_grams)
    gained = pairs.select(F.col("sig_a").alias("sig"), F.col("n_b").alias("n")).unionByName(pairs.select(F.col("sig_b").alias("sig"), F.col("n_a").alias("n"))).unionByName(heavy.select("sig", "n"))
    gained = gained.groupBy("sig").agg(F.sum("n").alias("n"))
    links = entries.join(gained, "sig", "left").select("doc_id", (F.col("n_ids") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.lit(None).cast("long").alias("first"))
    edges = pairs.select(F.col("rep_a").alias("doc_a"), F.col("rep_b").alias("doc_b")).unionByName(heavy.select(F.col("rep_b").alias("doc_a"), F.col("rep").alias("doc_b")))
    edges = edges.unionByName(entries.where("doc_id != rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b")))
    classes = groups(edges).select("doc_id", F.lit(0).cast("long").alias("n"), "first")
    every = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"))
    rows = every.unionByName(links).unionByName(classes).groupBy("doc_id").agg(F.sum("n").alias("n_links"), F.min("first").alias("first"))
    return rows.select("doc_id", F.coalesce("first", "doc_id").alias("class_id"), "n_links")


def groups(pairs: DataFrame) -> DataFrame:
    """(doc_id, first): for every document that a pair names, the smallest doc_id that pairs lead to from it.

    Each turn links the neighbours of every document to the smallest among them, alternately all and the larger
    ones, until nothing changes; the number of turns grows with the logarithm of a group's diameter.
    """
    edges = cut(pairs.select(F.col("doc_b").alias("u"), F.col("doc_a").alias("v")).where("u != v"))
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    ends = edges.groupBy("u").agg(F.min("v").alias("first"))
    return ends.select(F.col("u").alias("doc_id"), "first").unionByName(ends.select(F.col("first").alias("doc_id"), "first").distinct())


def op2_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(n: int = 5, threshold: float = 0.5, source: str = "documents") -> str:
    return f"""with recursive w as (select row_number() over () as r, doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') as w from {source}),
g as (select distinct r, doc_id, unnest(list_transform(range(greatest(len(w) - {n} + 1, 1)), lambda i: array_to_string(w[i + 1 : i + {n}], ' '))) as g from w where len(w) > 0),
s as (select r, any_value(doc_id) as doc_id, count(*) as size, md5(string_agg(g, '|' order by g)) as sig from g group by r),
sets as (select sig, min(r) as r, min(doc_id) as rep, any_value(size) as size, count(distinct doc_id) as n_ids from s group by sig having min(doc_id) is not null),
o as (select x.r as a, y.r as b, count(*) as n from g x join g y on x.g = y.g and x.r < y.r where x.r in (select r from sets) and y.r in (select r from sets) group by 1, 2),
j as (select a.sig as a, b.sig as b, a.rep as rep_a, b.rep as rep_b, b.n_ids as n from o join sets a on a.r = o.a join sets b on b.r = o.b where n / (a.size + b.size - n) >= {threshold}
  union all select b.sig, a.sig, b.rep, a.rep, a.n_ids from o join sets a on a.r = o.a join sets b on b.r = o.b where n / (a.size + b.size - n) >= {threshold}),
entry as (select distinct s.doc_id, sig, rep, n_ids from s join sets using (sig) where s.doc_id is not null),
links as (select doc_id, sum(n_ids - 1 + coalesce(more.n, 0)) as n from entry left join (select a as sig, sum(n) as n from j group by 1) more using (sig) group by 1),
edge as (select distinct x, y from (select rep_a as x, rep_b as y from j union all select doc_id, rep from entry union all select rep, doc_id from entry) where x != y),
reach as (select distinct x as doc_id, x as y from edge union select reach.doc_id, edge.y from reach join edge on edge.x = reach.y)
select d.doc_id, coalesce(c.first, d.doc_id) as class_id, coalesce(links.n, 0)::bigint as n_links from (select distinct doc_id from {source} where doc_id is not null) d
left join (select doc_id, min(y) as first from reach group by 1) c using (doc_id) left join links using (doc_id)"""
