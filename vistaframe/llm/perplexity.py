"""Quality rules by n-gram perplexity: a modified Kneser-Ney bigram model of each language, counted over the whole corpus.

The corpus is read three times in pieces, stretches of one scan task's rows. First each piece sends the sorted
hashes of its different bigrams, with counts, to buckets; a bucket adds them up and tells every piece the totals,
in the order in which it asked, and the first that asked for a bigram that it owns it. Then each piece sends what
the bigrams it owns add to the statistics of their words, and is told those words' sums. The third reading scores:
the model that a piece needs has come back as arrays in the order of its own sorted hashes, through files in the
shared folder, and neither text nor any occurrence of an n-gram is ever shuffled.
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

from vistaframe.llm.shared import bucket_bits, cut, fresh_path, maybe_broadcast, slot_count, steady, steady_splits
from vistaframe.llm.text import Words, chunks, hash_str, mix, pack, release, unpack

WIDTH = 48
_MASK = np.uint64((1 << WIDTH) - 1)
BEGIN = np.uint64(hash_str("<begin>") & (1 << WIDTH) - 1)
PIECE_BYTES = 6 << 20
SPARE = 34


class Piece:
    """The words of a stretch of documents, and for each language its different words and bigrams in order."""

    def __init__(self, parts: list[tuple[pa.RecordBatch, Words]]) -> None:
        self.ids = pa.concat_arrays([p.column("doc_id") for p, _ in parts])
        named = pa.concat_arrays([p.column("lang") for p, _ in parts]).fill_null("").dictionary_encode()
        self.langs = named.dictionary.to_pylist()
        self.lang = named.indices.to_numpy()
        first = np.cumsum([0] + [w.rows for _, w in parts])
        row = np.concatenate([w.row + f for (_, w), f in zip(parts, first)])
        word = np.concatenate([w.hash for _, w in parts]) & _MASK
        parts.clear()
        of = self.lang[row] if len(row) else np.empty(0, np.int32)
        self.tables = {}
        for k, lang in enumerate(self.langs):
            at = np.flatnonzero(of == k) if len(self.langs) > 1 else slice(None)
            w, r = word[at], row[at]
            known, code = np.unique(np.append(w, BEGIN), return_inverse=True)
            begin, code = code[-1], code[:-1].astype(np.int64)
            before = np.empty(len(code), np.int64)
            before[1:] = np.where(r[1:] == r[:-1], code[:-1], begin)
            before[:1] = begin
            self.tables[lang] = known, before * len(known) + code, r
        self.n = np.bincount(row, minlength=len(self.ids))


def pieces(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, Piece]]:
    task, nth, parts, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        for part in chunks(batch):
            words = Words(part.column("text"), raw=True)
            size += len(words.data)
            words.data = words.start = words.end = words.off = None
            parts.append((part.select(["doc_id", "lang"]), words))
            if size >= limit:
                yield task << 20 | nth, Piece(parts)
                nth, parts, size = nth + 1, [], 0
                release()
    if parts:
        yield task << 20 | nth, Piece(parts)
    del parts
    release()


_ASK = "lang string, bucket int, piece long, keys binary, a binary"
_SAID = "lang string, bucket int, piece long, a binary, b binary, stats array<long>"
_SAID_TYPES = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))


def _batch(rows: list[tuple], schema: str, types: tuple) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names)


class Sorted:
    """Keys of which the top ``bits`` name a bucket, in order. So many digits are kept that keys stay rare among the possible ones, however many buckets there are."""

    def __init__(self, key: np.ndarray, bits: int) -> None:
        key = key >> np.uint64(64 - min(64, SPARE + bits))
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]
        self.at = np.searchsorted(self.key >> np.uint64(min(64, SPARE + bits) - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        self.buckets = np.flatnonzero(self.at[1:] > self.at[:-1])

    def part(self, b: int) -> slice:
        return slice(self.at[b], self.at[b + 1])

    def packed(self, b: int) -> bytes:
        return pack(np.diff(self.key[self.part(b)], prepend=np.uint64(0)), 8)

    def answered(self, found: list[np.ndarray]) -> np.ndarray:
        """Answers by bucket, in the order of the keys as they were before sorting."""
        flat = np.concatenate([np.empty(found[0].shape[:-1] + (0,)) if found else np.empty(0), *found], axis=-1)
        if flat.shape[-1] != len(self.key):
            raise RuntimeError("the documents changed between two readings")
        out = np.empty(flat.shape)
        out[..., self.order] = flat
        return out


def _pairs(known: np.ndarray, pair: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Sorted]:
    """(code of each token's bigram, its words before and after, count) and the bigrams' sorted keys."""
    unique, code, count = np.unique(pair, return_inverse=True, return_counts=True)
    before, after = np.divmod(unique, len(known))
    return code, before, after, count, Sorted(mix(known[before] * np.uint64(0x9E3779B97F4A7C15) + known[after]), bits)


def _words(known: np.ndarray, bits: int) -> Sorted:
    return Sorted(mix(known + np.uint64(1)), bits)


def _ask_pairs(bits: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, piece in pieces(batches, limit):
            rows = []
            for lang, (known, pair, _) in piece.tables.items():
                if len(pair):
                    *_, count, keys = _pairs(known, pair, bits)
                    count = count[keys.order]
                    rows += [(lang, int(b), number, keys.packed(b), pack(count[keys.part(b)].astype(np.uint64), 4)) for b in keys.buckets]
            yield _batch(rows, _ASK, (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))

    return run


def _count_pairs(table: pa.Table) -> pa.Table:
    """Totals of a bucket's bigrams for every piece, which of them it owns, and how many occur once, twice, three and four times."""
    rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
    keys = [np.cumsum(unpack(r["keys"], 8), dtype=np.uint64) for r in rows]
    _, first, code = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    total = np.bincount(code, np.concatenate([unpack(r["a"], 4) for r in rows]).astype(float)).astype(np.uint64)
    own = np.zeros(len(code), np.uint64)
    own[first] = 1
    at = np.cumsum([0] + [len(x) for x in keys])
    lang, bucket = rows[0]["lang"], rows[0]["bucket"]
    out = [(lang, bucket, r["piece"], pack(total[code[a:b]], 5), pack(own[a:b], 1), None) for r, a, b in zip(rows, at[:-1], at[1:])]
    out.append((lang, bucket, -1, None, None, [len(total), *(int((total == i).sum()) for i in (1, 2, 3, 4))]))
    return pa.Table.from_batches([_batch(out, _SAID, _SAID_TYPES)])


class Answers:
    """What the buckets have told the pieces, in files by slot."""

    def __init__(self, path: str, slots: int) -> None:
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(path)
        self.slots = slots

    def of(self, number: int) -> dict[str, list[dict]]:
        rows = pyarrow.parquet.read_table(f"{self.root}/slot={(number >> 20) % self.slots}", filesystem=self.fs, filters=[("piece", "=", number)], partitioning=None).to_pylist()
        out: dict[str, list[dict]] = {}
        for r in sorted(rows, key=lambda r: r["bucket"]):
            out.setdefault(r["lang"], []).append(r)
        return out


def _told(df: DataFrame, name: str, slots: int) -> str:
    """Writes answers for the pieces and returns where; those for piece -1 are in slot -1."""
    path = fresh_path(df.sparkSession, name)
    slot = F.when(F.col("piece") < 0, -1).otherwise(F.pmod(F.shiftright("piece", 20), F.lit(slots))).cast("int")
    df.withColumn("slot", slot).repartition("slot").sortWithinPartitions("slot", "piece").write.partitionBy("slot").option("parquet.block.size", 4 << 20).parquet(path)
    return path


def _ask_words(path: str, slots: int, bits: int, limit: int):
    """What a piece's words gain from its tokens (their count as contexts) and from the bigrams that it owns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = Answers(path, slots)
        for number, piece in pieces(batches, limit):
            said, rows = answers.of(number), []
            for lang, (known, pair, _) in piece.tables.items():
                if not len(pair):
                    continue
                _, before, after, count, keys = _pairs(known, pair, bits)
                total = keys.answered([unpack(r["a"], 5).astype(float) for r in said[lang]])
                own = keys.answered([unpack(r["b"], 1).astype(float) for r in said[lang]]) > 0
                n = len(known)
                gains = [np.bincount(before, count, n), *(np.bincount(before[own & hit], minlength=n) for hit in (total == 1, total == 2, total >= 3)), np.bincount(after[own], minlength=n)]
                words = _words(known, bits)
                gains = np.stack(gains).astype(np.uint64)[:, words.order]
                rows += [(lang, int(b), number, words.packed(b), pack(gains[:, words.part(b)].ravel(), 5)) for b in words.buckets]
            yield _batch(rows, _ASK, (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))

    return run


def _count_words(table: pa.Table) -> pa.Table:
    """Sums of a bucket's words for every piece: occurrences as a context, different next words seen once, twice and more, different words before."""
    rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
    keys = [np.cumsum(unpack(r["keys"], 8), dtype=np.uint64) for r in rows]
    known, code = np.unique(np.concatenate(keys), return_inverse=True)
    gains = np.concatenate([unpack(r["a"], 5).reshape(5, -1) for r in rows], axis=1).astype(float)
    total = np.stack([np.bincount(code, g, len(known)) for g in gains]).astype(np.uint64)
    at = np.cumsum([0] + [len(x) for x in keys])
    out = [(r["lang"], r["bucket"], r["piece"], pack(total[:, code[a:b]].ravel(), 5), None, None) for r, a, b in zip(rows, at[:-1], at[1:])]
    return pa.Table.from_batches([_batch(out, _SAID, _SAID_TYPES)])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts for counts of 1, 2 and more; 0.5, 1 and 1.5 where a count of counts is missing."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(float(min(max(x, 0.05), i)) for i, x in enumerate(d, 1))


#: Weight of a document's own bigrams in the adapted score.
OWN = 0.75


def _costs(row, code, pairs, total, ctx, follow, stat, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The summed -log p of each row's bigrams, the row's own counts left out of the model that judges it; and the same where the row's other bigrams take the place of the corpus's."""
    types, d1, d2, d3 = stat
    before, after = pairs
    n_pairs, n_words = len(total), len(ctx)
    key, own = np.unique(row * n_pairs + code, return_counts=True)
    r, k = np.divmod(key, n_pairs)
    v, w = before[k], after[k]
    left = total[k] - own
    _, at = np.unique(r * n_words + v, return_inverse=True)
    mine = np.bincount(at, own)[at]
    context = ctx[v, 0] - mine
    _, at = np.unique(r * n_words + w, return_inverse=True)
    kinds = follow[w] - np.bincount(at, left == 0)[at]
    lower = np.where(kinds > 0, kinds, 0.5) / types
    off = np.where(left == 1, d1, np.where(left == 2, d2, d3))
    back = (ctx[v, 1:] @ np.array([d1, d2, d3])) / ctx[v, 0]
    p = np.where(context > 0, np.maximum(left - off, 0) / np.maximum(context, 1) + back * lower, lower)
    adapted = OWN * (own - 1) / np.maximum(mine - 1, 1) + (1 - OWN) * lower
    return np.bincount(r, -np.log(p) * own, rows), np.bincount(r, -np.log(adapted) * own, rows)


def _score(pair_path: str, word_path: str, slots: int, model, bits: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, of_pairs, of_words = model.value, Answers(pair_path, slots), Answers(word_path, slots)
        for number, piece in pieces(batches, limit):
            about_pairs, about_words = of_pairs.of(number), of_words.of(number)
            cost = np.zeros((2, len(piece.ids)))
            for lang, (known, pair, row) in piece.tables.items():
                if not len(pair):
                    continue
                code, before, after, _, keys = _pairs(known, pair, bits)
                total = keys.answered([unpack(r["a"], 5).astype(float) for r in about_pairs[lang]])
                sums = _words(known, bits).answered([unpack(r["a"], 5).reshape(5, -1).astype(float) for r in about_words[lang]])
                cost += _costs(row, code, (before, after), total, sums[:4].T, sums[4], stats[lang], len(piece.ids))
            n = piece.n
            yield pa.RecordBatch.from_arrays(
                [piece.ids, pa.array([piece.langs[k] for k in piece.lang], pa.string()), pa.array(n, pa.int64()), *(pa.array(c / np.maximum(n, 1), mask=n == 0) for c in cost)],
                ["doc_id", "lang", "n_words", "log_perplexity", "log_adapted"],
            )

    return run


def log_perplexities(docs: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(doc_id, lang, n_words, log_perplexity, log_adapted) for every row under the model of its language.

    A document is a begin mark and its words, here what white space parts, as written; each word counts, whole
    texts are read. A document is judged by the others: its own counts are taken off those of its bigrams,
    contexts and continuations (a context's discounts stay as they are), and a word that no other document has
    counts as half a continuation. In the adapted score a bigram's probability is that among the document's own
    other bigrams with the same first word, with weight 0.75, and that of its word as a continuation in the corpus,
    with the rest; copies in other documents don't change it. Texts that are null or have no word get a null. Null languages are a language of the empty name. Repeated rows count each time and
    score alike; doc_id may be null; other columns are not read; an empty table gives none. Documents that
    don't come straight from files are first written to the shared folder, so that all readings see the same.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    with steady_splits(spark):
        base, schema = steady(base), "doc_id long, lang string, n_words long, log_perplexity double, log_adapted double"
        if not base.where("text rlike '\\\\S'").take(1):
            none = F.lit(None).cast("double")
            return base.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.lit(0).cast("long").alias("n_words"), none.alias("log_perplexity"), none.alias("log_adapted"))
        bits, slots = bucket_bits(base), slot_count(base)
        asked = base.mapInArrow(_ask_pairs(bits, piece_bytes), _ASK)
        pair_path = _told(asked.groupBy("lang", "bucket").applyInArrow(_count_pairs, _SAID), "pairs", slots)
        sums = spark.read.parquet(f"{pair_path}/slot=-1").groupBy("lang").agg(*[F.sum(F.col("stats")[i]).alias(f"n{i}") for i in range(5)]).collect()
        stats = {r["lang"]: (float(r["n0"]), *discounts(*(r[f"n{i}"] for i in range(1, 5)))) for r in sums}
        words = base.mapInArrow(_ask_words(pair_path, slots, bits, piece_bytes), _ASK)
        word_path = _told(words.groupBy("lang", "bucket").applyInArrow(_count_words, _SAID), "words", slots)
        return cut(base.mapInArrow(_score(pair_path, word_path, slots, spark.sparkContext.broadcast(stats), bits, piece_bytes), schema))


def _median(found: list[tuple[int, int]]) -> float:
    found = sorted(found)
    total = np.cumsum([c for _, c in found])
    return float(found[int(np.searchsorted(total, total[-1] / 2))][0])


def bands(scores: DataFrame, below: float, above: float, step: float = 0.002, least: float = 0.05) -> DataFrame:
    """(lang, middle, high, middle_adapted, low): the median of log perplexity plus ``above`` median deviations (``least`` at least), and the median of the adapted one times ``below``.

    A share of the median holds where a large group of copies would move deviations. Scores are taken in steps of 0.002, so that counts of steps are all that reaches the driver.
    """
    kinds = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.round(F.col(c) / step).cast("long").alias("at")) for c in ("log_perplexity", "log_adapted"))))
    found: dict[str, dict[str, list[tuple[int, int]]]] = {}
    for r in scores.where("log_perplexity is not null").select("lang", kinds.alias("x")).groupBy("lang", "x.kind", "x.at").count().collect():
        found.setdefault(r["lang"], {}).setdefault(r["kind"], []).append((r["at"], r["count"]))
    rows = []
    for lang, of in found.items():
        middle, own = _median(of["log_perplexity"]), _median(of["log_adapted"])
        off = max(least / step, _median([(abs(x - middle), c) for x, c in of["log_perplexity"]]))
        rows.append((lang, middle * step, (middle + above * off) * step, own * step, own * below * step))
    return scores.sparkSession.createDataFrame(rows, "lang string, middle double, high double, middle_adapted double, low double")


def perplexity_rules(docs: DataFrame, below: float = 0.5, above: float = 6.0, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(doc_id, lang, n_words, log_perplexity, log_adapted, low, high, keep) for every row.

    keep says whether the log perplexity is at most ``high`` and the adapted one at least ``low``, the bounds of its
    language (see ``bands``); a document without words is not kept. A short document strays more than a long one, so
    its band is wider by the square root of 1 + 50 / words. The lower bound looks at the adapted score, as text that
    others copy is foreseeable without being bad, and is the duplicate stages' business; text that repeats itself is
    foreseeable from itself. Short documents have room for a first line that comes again as the last. See ``log_perplexities`` for nulls, repeats and empty tables.
    """
    scores = log_perplexities(docs, piece_bytes)
    limits = bands(scores, below, above)
    both = scores.join(maybe_broadcast(limits, limits.count()), "lang", "left")
    wider = F.when(F.col("n_words") > 0, F.sqrt(1 + F.lit(50.0) / F.col("n_words")))
    low = F.col("middle_adapted") - (F.col("middle_adapted") - F.col("low")) * wider
    high = F.col("middle") + (F.col("high") - F.col("middle")) * wider
    both = both.withColumn("low", low).withColumn("high", high)
    keep = F.coalesce((F.col("log_perplexity") <= F.col("high")) & (F.col("log_adapted") >= F.col("low")), F.lit(False))
    return both.select("doc_id", "lang", "n_words", "log_perplexity", "log_adapted", "low", "high", keep.alias("keep"))


def op7_perplexity(spark, sf_dir: str) -> DataFrame:
    return perplexity_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
