import random
import re
from collections import defaultdict

import numpy as np
import pytest

from vistaframe.llm.repeats import drop_repeats, equal_starts, repeated_passages, suffix_order

SCHEMA = "doc_id long, text string, lang string, n_chars long"


def brute_force(rows, n):
    seen = defaultdict(list)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    for i in order:
        w = re.findall("[a-z0-9\x80-\U0010ffff]+", (rows[i][1] or "").lower())
        for j in range(len(w) - n + 1):
            seen[tuple(w[j : j + n])].append((i, j))
    out = []
    for drop in (False, True):
        at = defaultdict(set)
        for places in seen.values():
            if len(places) > 1:
                for i, j in places[drop:]:
                    at[i].add(j)
        for i, starts in at.items():
            run = None
            for j in sorted(starts):
                if run and j <= run[1]:
                    run[1] = j + n
                else:
                    if run:
                        out.append((rows[i][0], *run, drop))
                    run = [j, j + n]
            out.append((rows[i][0], *run, drop))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(("the", "of", "and")) if r.random() < 0.3 else "".join(r.choice("abcdefghij") for _ in range(3))
    passages = [[word() for _ in range(n)] for n in (19, 20, 21, 45, 120)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(r.choice((0, 5, 30, 100)))]
        for _ in range(r.choice((0, 1, 2))):
            p = r.choice(passages)
            at = r.randrange(len(w) + 1)
            w = w[:at] + p + w[at:]
        rows.append((i, " ".join(w), "en", 1))
    return [*rows, (100, rows[7][1].title(), "en", 1), (101, "la " * 70, "en", 1)]


@pytest.mark.parametrize(("seed", "piece_bytes"), [(1, 1 << 20), (2, 2000), (3, 5000)])
def test_brute_force(spark, seed, piece_bytes):
    rows = corpus(seed)
    got = [tuple(r) for r in repeated_passages(spark.createDataFrame(rows, SCHEMA).coalesce(1), 20, piece_bytes).collect()]
    assert sorted(got, key=str) == brute_force(rows, 20)


@pytest.mark.parametrize("seed", range(5))
def test_equal_starts(seed):
    rng = np.random.default_rng(seed)
    text = np.concatenate([rng.integers(0, 3, 80), rng.integers(0, 3, 40).repeat(2), [7] * 30, [-1]])
    text = np.concatenate([text, text[:50], [-2]])
    length = 8
    order, group = equal_starts(text, length)
    starts = [tuple(text[i : i + length]) for i in order]
    assert starts == sorted(starts)
    assert [a == b for a, b in zip(starts, starts[1:])] == [x == y for x, y in zip(group, group[1:])]
    assert sorted(suffix_order(text, 64)) == list(range(len(text)))


def test_drop(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"Start. {passage} end.", "en", 1), (2, f"Other words,\n {passage}! And more.", "en", 1), (3, passage, "en", 1), (4, None, None, None), (5, "", "en", 0), (None, passage, "en", 1), (6, "clean text", "en", 1), (7, f"x {passage}", "a", 1), (7, f"y {passage}", "a", 1)]
    got = {(r["doc_id"], r["text"]) for r in drop_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    # the row without an id comes first and keeps the passage
    assert got == {(1, "Start. end."), (2, "Other words,\n And more."), (4, None), (5, ""), (None, passage), (6, "clean text"), (7, "x "), (7, "y ")}
    # rows of one id count by themselves, of rows equal throughout one stays; a column of any name is kept
    twice = [(7, f"x {passage}", "a", 1), (7, f"y {passage.upper()}", "a", 1), (8, f"z {passage}", "a", 1), (8, f"z {passage}", "a", 1)]
    found = drop_repeats(spark.createDataFrame(twice, SCHEMA).selectExpr("*", "5 as spans", "6 as _key", "7 as _of")).collect()
    assert sorted(r["text"] for r in found) in ([f"x {passage}", "y ", "z "], ["x ", f"y {passage.upper()}", "z "]) and {(r["spans"], r["_key"], r["_of"]) for r in found} == {(5, 6, 7)}


def test_letter_case_of_other_scripts(spark):
    passage = " ".join(f"слово{i}ж" for i in range(60))
    found = drop_repeats(spark.createDataFrame([(1, f"А {passage}", "ru", 1), (2, f"Б Ⱥ {passage.upper()} конец", "ru", 1)], SCHEMA)).collect()
    assert sorted(r["text"] for r in found) == [f"А {passage}", "Б Ⱥ конец"]


def test_edges(spark):
    rows = [(1, None, None, None), (2, "", None, 0), (3, " ".join(f"w{i}" for i in range(100_000)), "x", 1), (4, "a b c", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as begin", "2 as slot")
    assert repeated_passages(df).collect() == [] and drop_repeats(df).count() == 4
    assert repeated_passages(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        repeated_passages(df, 5)
