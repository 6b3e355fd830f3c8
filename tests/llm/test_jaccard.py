import random
import re
from itertools import combinations

import pytest

from vistaframe.llm import jaccard
from vistaframe.llm.jaccard import groups, jaccard_join, similar_documents

SCHEMA = "doc_id long, text string, source string"


def brute_force(rows, n, threshold):
    sets = {}
    for i, text, *_ in rows:
        w = re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
        g = frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset()
        if i is not None and g:
            sets.setdefault(g, set()).add(i)
    out = {}

    def add(a, b, j):
        if a != b:
            out[min(a, b), max(a, b)] = max(j, out.get((min(a, b), max(a, b)), 0))

    for ids in sets.values():
        for i in ids:
            add(i, min(ids), 1.0)
    for (x, xs), (y, ys) in combinations(sets.items(), 2):
        j = len(x & y) / len(x | y)
        if j >= threshold:
            add(min(xs), min(ys), j)
    return out


def brute_classes(rows, n, threshold):
    """(class, links) of each document, every pair of texts compared."""
    sets = {}
    for i, text, *_ in rows:
        w = re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
        if i is not None:
            sets.setdefault(i, set()).add(frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset())
    entries = [(i, g) for i, gs in sets.items() for g in gs if g]
    label, links = {i: i for i in sets}, dict.fromkeys(sets, 0)
    near = [(i, k) for (i, x), (k, y) in combinations(entries, 2) if len(x & y) / len(x | y) >= threshold]
    for i, k in near:
        links[i] += 1
        links[k] += 1
    for _ in sets:
        for i, k in near:
            label[i] = label[k] = min(label[i], label[k])
    return {i: (label[i], links[i]) for i in sets}


def corpus(seed):
    """Groups of near copies of several sizes, some larger than any hot limit, and a passage that many texts share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(12)]
    rows = []
    for size in (1, 1, 1, 1, 2, 3, 12, 40):
        base = [word() for _ in range(r.choice((8, 40, 90)))]
        for _ in range(size):
            w = [x if r.random() > 0.03 else word() for x in base]
            if r.random() < 0.4:
                w += shared
            rows.append((len(rows), " ".join(w), "s"))
            if r.random() < 0.2:
                rows.append((len(rows), " ".join(w).upper() + "!", "t"))
    return rows + [(len(rows) + i, " ".join(shared), "u") for i in range(3)]


@pytest.mark.parametrize(("seed", "hot", "threshold"), [(1, 64, 0.5), (2, 5, 0.5), (3, 2, 0.7), (4, 10, 0.3)])
def test_brute_force(spark, seed, hot, threshold):
    rows = corpus(seed)
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in jaccard_join(spark.createDataFrame(rows, SCHEMA), threshold=threshold, hot=hot, piece_bytes=3000).collect()}
    want = brute_force(rows, 5, threshold)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


@pytest.mark.parametrize(("seed", "hot", "threshold"), [(1, 64, 0.5), (2, 3, 0.4)])
def test_classes(spark, seed, hot, threshold):
    rows = corpus(seed)
    rows += [(None, rows[5][1], "s"), (5, rows[9][1], "s"), (5, rows[5][1], "s"), (900, None, None), (901, " ", "s")]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in similar_documents(spark.createDataFrame(rows, SCHEMA), threshold=threshold, hot=hot, piece_bytes=3000).collect()}
    assert got == brute_classes(rows, 5, threshold)


def near_copies(seed, sizes, shared=0):
    """Groups of different near copies, of texts that may end in the same passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    end, rows = [word() for _ in range(shared)], []
    for size in sizes:
        base = [word() for _ in range(80)]
        for _ in range(size):
            w = list(base)
            for i in r.sample(range(80), 3):
                w[i] = word()
            rows.append((len(rows), " ".join(w + end), "s"))
    return rows


def test_large_group_is_not_listed_by_pairs(spark, monkeypatch):
    """400 different near copies: right links, and no intermediate table has a row for each pair."""
    rows, seen, plain = near_copies(7, (400,)), [], jaccard.cut

    def watched(df):
        out = plain(df)
        seen.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "cut", watched)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in similar_documents(spark.createDataFrame(rows, SCHEMA), hot=20).collect()}
    assert got == brute_classes(rows, 5, 0.5)
    assert max(seen) <= 10 * len(rows) < sum(n for _, n in got.values()) // 4


def test_fragments_list_only_their_documents(spark, monkeypatch):
    """With more fragments than a document has n-grams, as for large inputs: right classes, and no document is sent to a fragment where it has none."""
    rows, seen, plain = near_copies(9, (3,) * 30), [], jaccard.cut

    def watched(df):
        out = plain(df)
        if "uids" in out.columns:
            seen.extend(out.where("bucket >= 0").select("uids", "docs").collect())
        return out

    monkeypatch.setattr(jaccard, "cut", watched)
    monkeypatch.setattr(jaccard, "bucket_bits", lambda df: 8)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in similar_documents(spark.createDataFrame(rows, SCHEMA), piece_bytes=3000).collect()}
    assert got == brute_classes(rows, 5, 0.5) and any(n for _, n in got.values())
    for r in seen:
        listed, used = jaccard.unpack(r["uids"], 8), jaccard.unpack(r["docs"], 3)
        assert len(set(listed)) == len(listed) and set(used) == set(range(len(listed)))


@pytest.mark.parametrize(("rows_at_once", "grams_at_once"), [(16, 1 << 20), (1000, 150)])
def test_blocks(spark, rows_at_once, grams_at_once):
    """Groups cut into many blocks, some of them empty, against brute force, as counts and as pairs."""
    rows = near_copies(8, (40, 25, 30), shared=20)
    rows += [(len(rows) + i, rows[i][1], "t") for i in range(3)] + [(3, rows[50][1], "s"), (None, rows[60][1], "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    options = {"threshold": 0.55, "hot": 6, "block_rows": rows_at_once, "block_grams": grams_at_once}
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in similar_documents(df, **options).collect()}
    assert got == brute_classes(rows, 5, 0.55)
    pairs = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in jaccard_join(df, **options).collect()}
    want = brute_force(rows, 5, 0.55)
    assert pairs.keys() == want.keys() and all(abs(pairs[k] - want[k]) < 1e-12 for k in pairs)


@pytest.mark.parametrize("text", ["Съешь же ещё этих мягких французских булок", "ΞΕΣΚΕΠΑΖΩ τὴν ψυχοφθόρα βδελυγμία ναί", "Příliš žluťoučký kůň úpěl ďábelské ódy", "Ça où Éléphant naïve cœur Ÿ"])
def test_letter_case_of_other_scripts(spark, text):
    rows = [(1, text, "s"), (2, text.upper(), "s"), (3, text.lower(), "s"), (4, "something else of five words", "s")]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 0)}


def test_edges(spark):
    long_text = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None, None), (2, "", "s"), (3, "!!", "s"), (4, "one two", "s"), (5, "One, two.", "s"), (6, long_text, "s"), (7, long_text + " end", "s"), (None, "one two", "s"), (4, "one two", "s"), (8, "one", "s"), (9, "two one", "s")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as sig", "2 as uid", "3 as bucket")
    assert sorted((r["doc_a"], r["doc_b"]) for r in jaccard_join(df).collect()) == [(4, 5), (6, 7)]
    assert jaccard_join(spark.createDataFrame([], SCHEMA)).collect() == [] and similar_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in similar_documents(df.selectExpr("*", "4 as rep", "5 as n")).collect()}
    assert found == {1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (4, 1), 5: (4, 1), 6: (6, 1), 7: (6, 1), 8: (8, 0), 9: (9, 0)}
    # one id with several texts: each is compared, none with itself
    several = [(1, "a b c d e f", None), (1, "u v w x y z", None), (2, "a b c d e f", None), (3, "u v w x y z", None)]
    assert sorted((r["doc_a"], r["doc_b"]) for r in jaccard_join(spark.createDataFrame(several, SCHEMA)).collect()) == [(1, 2), (1, 3)]


def test_groups(spark):
    pairs = [(i, i + 1) for i in range(1, 9)] + [(20, 30), (30, 40), (20, 40), (50, 51)]
    found = {r["doc_id"]: r["first"] for r in groups(spark.createDataFrame(pairs, "doc_a long, doc_b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 10)}, 20: 20, 30: 20, 40: 20, 50: 50, 51: 50}
    assert groups(spark.createDataFrame([], "doc_a long, doc_b long")).collect() == []
