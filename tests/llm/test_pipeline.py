import hashlib
import math
import random
import re

import pytest

import corpus_pipeline
from tests.llm.test_jaccard import brute_classes, near_copies
from tests.llm.test_layout import dealt_one_by_one
from tests.llm.test_perplexity import brute_force as perplexities
from vistaframe.llm import jaccard
from vistaframe.llm.text import Words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st", "l")]


def prose(r, n):
    return " ".join(r.choice(VOCABULARY[: 10 if r.random() < 0.5 else None]) for _ in range(n))


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    r = random.Random(11)
    rows = [(i, prose(r, r.randrange(60, 200)), "en", f"s{i % 3}", None) for i in range(150)]
    near = rows[3][1].split()
    near[5] = "changed"
    passage = prose(r, 70)
    rows += [(200, rows[3][1], "en", "s0", 1), (201, " ".join(near), "en", "s1", 1), (202, f"{prose(r, 200)} {passage} {prose(r, 200)}", "en", "s2", 1), (203, f"{prose(r, 200)} {passage} {prose(r, 200)}", "en", "s2", 1)]
    rows += [(300, " ".join(f"#{i}$%{i * 7}" for i in range(400)), "en", "s1", 1), (301, None, "en", "s1", None), (302, "", None, None, 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, documents):
    docs, seen = spark.read.parquet(f"{documents}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        found = stage(spark, docs, documents)
        assert found.dtypes == docs.dtypes
        docs = spark.createDataFrame(found.collect(), SCHEMA)
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    quality, near, repeated = seen.values()
    # noise, null and empty texts go; clean documents stay
    assert not quality.keys() & {300, 301, 302} and len(quality) >= 150
    assert quality.keys() - near.keys() == {200, 201}
    assert repeated.keys() == near.keys()
    assert [i for i in near if near[i] != repeated[i]] == [203]
    assert len(near[203].split()) - len(repeated[203].split()) >= 70


def test_run(spark, documents):
    out = corpus_pipeline.run(spark, documents)
    rows = out.collect()
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert out.columns == ["doc_id", "n_tokens", "bucket", "bucket_tokens", "batch", "slot"] and len({r["doc_id"] for r in rows}) == len(rows)


WORD = re.compile("[A-Za-z0-9\x80-\U0010ffff]+")


def plain_quality(rows):
    """rows: {doc_id: [text, lang, source]}"""
    scores = perplexities([(i, lang, text) for i, (text, lang, _) in rows.items()])
    middle = lambda x: sorted(x)[-(-len(x) // 2) - 1]
    kept = {}
    for lang in {r[1] or "" for r in rows.values()}:
        mine = {i: s for i, s in scores.items() if (rows[i][1] or "") == lang and s[0] is not None}
        if not mine:
            continue
        high, low = ([math.floor(s[k] / 0.002 + 0.5) for s in mine.values()] for k in (0, 1))
        m, own = middle(high), middle(low)
        off = max(25.0, middle([abs(x - m) for x in high]))
        for i, (score, adapted) in mine.items():
            wide = math.sqrt(1 + 50 / len(rows[i][0].split()))
            if score <= (m + 6 * off * wide) * 0.002 and adapted >= (own - own * 0.5 * wide) * 0.002:
                kept[i] = rows[i]
    return kept


def plain_near(rows):
    classes = brute_classes([(i, r[0]) for i, r in rows.items()], 5, 0.5)
    return {i: r for i, r in rows.items() if classes[i][0] == i}


def plain_repeats(rows, n=50):
    seen, out = set(), {}
    for i in sorted(rows):
        text = rows[i][0]
        spots = list(WORD.finditer(text))
        words, gone = [w.group().lower() for w in spots], set()
        for j in range(len(words) - n + 1):
            window = tuple(words[j : j + n])
            if window in seen:
                gone.update(range(j, j + n))
            seen.add(window)
        kept, at = [], 0
        for j in sorted(gone):
            if j - 1 not in gone:
                kept.append(text[at : spots[j].start()])
            at = spots[j + 1].start() if j + 1 < len(spots) else len(text)
        text = "".join([*kept, text[at:]])
        if not gone or text.strip(" "):
            out[i] = [text, *rows[i][1:]]
    return out


def plain_mixture(rows):
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    by, block_of = {}, {}
    for i, (text, _, source) in rows.items():
        by.setdefault(source or "", []).append((md5(f"17:{i}"), i, len(text.split()) + 1))
    total = {s: sum(n for *_, n in x) for s, x in by.items()}
    for s, x in by.items():
        begin = 0
        for _, i, n in sorted(x):
            block_of[i] = s, begin // 4096
            begin += n
    blocks = {s: -(-t // 4096) for s, t in total.items()}
    shard_of = {}
    for s in by:
        order = sorted(range(blocks[s]), key=lambda b: md5(f"17:{s}:{b}"))
        for source, shard, n in dealt_one_by_one({s: float(int(t**0.5)) for s, t in total.items()}, blocks, 16, True):
            if source == s:
                shard_of.update({(s, b): shard for b in order[:n]})
                order = order[n:]
    return {i: shard_of[at] for i, at in block_of.items()}


def plain_packing(rows, buckets=12, budget=65_536):
    size = {i: len(r[0].split()) + 1 for i, r in rows.items()}
    lengths = sorted(set(size.values()))
    count = [sum(n == x for n in size.values()) for x in lengths]
    k = min(buckets, len(lengths))
    best = [[math.inf] * (len(lengths) + 1) for _ in range(k + 1)]
    cut = [[0] * (len(lengths) + 1) for _ in range(k + 1)]
    best[0][0] = 0
    for b in range(1, k + 1):
        for j in range(1, len(lengths) + 1):
            for i in range(j):
                cost = best[b - 1][i] + lengths[j - 1] * sum(count[i:j])
                if cost < best[b][j]:
                    best[b][j], cut[b][j] = cost, i
    bounds, j = [], len(lengths)
    for b in range(k, 0, -1):
        bounds.append(lengths[j - 1])
        j = cut[b][j]
    bounds.sort()
    out, nth = set(), {}
    for i in sorted(rows, key=lambda i: (i % 64, i)):
        b = sum(x < size[i] for x in bounds)
        room, at = max(1, budget // bounds[b]), nth.get(b, 0)
        nth[b] = at + 1
        out.add((i, size[i], b, bounds[b], at // room, at % room))
    return out


def test_every_stage_by_brute_force(spark, documents):
    """Each stage on the small corpus against plain Python that reads the method's definition, document by document."""
    docs = spark.read.parquet(f"{documents}/documents.parquet")
    rows = {r["doc_id"]: [r["text"], r["lang"], r["source"]] for r in docs.collect()}
    plain = {"quality_rules": plain_quality, "near_duplicates": plain_near, "repeated_text": plain_repeats}
    for name, stage in corpus_pipeline.STAGES[:3]:
        rows = plain[name](rows)
        docs = spark.createDataFrame(stage(spark, docs, documents).collect(), SCHEMA)
        assert {r["doc_id"]: [r["text"], r["lang"], r["source"]] for r in docs.collect()} == rows, name
    mixed = corpus_pipeline.mixture(spark, docs, documents)
    assert {r["doc_id"]: r["shard"] for r in mixed.collect()} == plain_mixture(rows)
    packed = {tuple(r) for r in corpus_pipeline.packing(spark, mixed, documents).collect()}
    assert packed == plain_packing(rows) and packed == {tuple(r) for r in corpus_pipeline.run(spark, documents).collect()}


def test_rows_without_an_id_of_their_own(spark, tmp_path):
    """Null and repeated doc_ids, rows equal throughout, a very long text, columns of clashing names."""
    r = random.Random(21)
    rows = [(i, prose(r, 150), "en", f"s{i % 3}", 1) for i in range(120)]
    loop = "one two three four " * 60
    rows += [(None, prose(r, 120), "en", None, 1), (5, prose(r, 130), "en", "s1", 1), (5, rows[5][1], "en", "s2", 1), (5, rows[5][1], "en", "s2", 1), (None, rows[9][1], "en", "s0", 1), (7, loop, "en", "s0", 1), (500, prose(r, 20_000), "en", "s0", 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as _key", "2 as spans", "3 as _gone", "4 as _of")
    docs = df
    for _, stage in corpus_pipeline.STAGES[:3]:
        found = stage(spark, docs, "")
        assert found.columns == df.columns
        docs = spark.createDataFrame(found.collect(), df.schema)
    kept = [(x["doc_id"], x["text"]) for x in docs.collect()]
    # the loop goes although its doc_id stays; of equal texts one is left, whatever its id
    assert (7, loop) not in kept and any(i == 7 for i, _ in kept) and sum(t == rows[5][1] for _, t in kept) == 1 == sum(t == rows[9][1] for _, t in kept)
    assert sum(i == 5 for i, _ in kept) == 2 and sum(i is None for i, _ in kept) == 2 and len(kept) == 123
    mixed = corpus_pipeline.mixture(spark, docs, "")
    assert mixed.columns == [*df.columns, "shard"] and mixed.count() == 123 == corpus_pipeline.packing(spark, mixed, "").count()


def test_mixture_keeps_every_source(spark):
    r = random.Random(5)
    rows = [(i, prose(r, 400), "en", "hot" if i % 2 else f"s{i % 3}", None) for i in range(200)]
    rows += [(1000, prose(r, 300), "en", "small", None), (None, "a b", None, None, None), (7, rows[7][1], "en", "hot", None)]
    found = corpus_pipeline.mixture(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(map(str, (tuple(x)[:5] for x in found.collect()))) == sorted(map(str, rows))
    assert found.columns[5:] == ["shard"] and found.where("shard is null").count() == 0


def test_large_group_of_near_duplicates(spark, monkeypatch):
    """Two groups larger than the limit for pairs leave their first documents, and no intermediate table has a row for each pair."""
    rows, seen, plain = [(i, text, "en", source, None) for i, text, source in near_copies(3, (300, 120))], [], jaccard.cut

    def watched(df):
        out = plain(df)
        seen.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "cut", watched)
    found = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(x["doc_id"] for x in found) == [0, 300]
    assert max(seen) <= 10 * len(rows)


def test_batches_follow_the_mixture(spark):
    """With batches of few documents, those of a bucket hold the shards one after the other, as plain Python fills them."""
    r = random.Random(9)
    rows = [(i, prose(r, r.choice((9_000, 12_000))), "en", "hot" if i % 3 else f"s{i % 2}", None) for i in range(60)]
    mixed = corpus_pipeline.mixture(spark, spark.createDataFrame([*rows, (None, rows[4][1], "en", "s0", None)], SCHEMA), "").cache()
    shards = {x["doc_id"]: x["shard"] for x in mixed.collect()}
    found = corpus_pipeline.packing(spark, mixed, "").collect()
    assert len(found) == 61 and len(set(shards.values())) > 10
    place, by = lambda i: (-1, -1) if i is None else (i % 64, i), {}
    for x in found:
        by.setdefault((x["bucket"], 65_536 // x["bucket_tokens"]), []).append(x)
    for (_, room), mine in by.items():
        assert len({x["batch"] for x in mine}) == -(-len(mine) // room) > 1
        order = sorted((x["doc_id"] for x in mine), key=lambda i: (shards[i], place(i)))
        want = {(i, at // room, s) for at in range(0, len(order), room) for s, i in enumerate(sorted(order[at : at + room], key=place))}
        assert {(x["doc_id"], x["batch"], x["slot"]) for x in mine} == want
    # and other shards make other batches
    assert {tuple(x) for x in found} != {tuple(x) for x in corpus_pipeline.packing(spark, mixed.withColumn("shard", 15 - mixed["shard"]), "").collect()}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_words():
    import pyarrow as pa

    texts = ["Hé HELLO, hello_3x", None, "", "  ", "日本 ÀB"]
    folded, plain, raw = Words(pa.array(texts)), Words(pa.array(texts), fold=False), Words(pa.array(texts), raw=True)
    cut = lambda w: [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)]
    assert cut(plain) == ["Hé", "HELLO", "hello", "3x", "日本", "ÀB"] and folded.row.tolist() == plain.row.tolist() == [0, 0, 0, 0, 4, 4]
    assert folded.hash[5] == Words(pa.array(["àb"])).hash[0] and plain.hash[1] != plain.hash[2]
    assert folded.hash[1] == folded.hash[2]
    assert cut(raw) == ["Hé", "HELLO,", "hello_3x", "日本", "ÀB"]
