"""Packing, mixing, sharding and chat formatting."""

import random
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaframe.llm.chat import events_of_turns, fold, render
from vistaframe.llm.mixing import apportion, mix
from vistaframe.llm.packing import optimal_buckets, pack
from vistaframe.llm.sharding import hilbert_index, shard, write_shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("seed", range(4))
def test_buckets_are_optimal(seed):
    r = random.Random(seed)
    lengths = sorted(r.sample(range(1, 200), 9))
    counts = [r.randrange(1, 30) for _ in lengths]
    for k in (1, 2, 4, 12):
        cost = lambda bounds: sum(c * min(b for b in bounds if b >= x) for x, c in zip(lengths, counts))  # noqa: E731, B023
        best = min(cost((*some, lengths[-1])) for n in range(min(k, 9)) for some in combinations(lengths[:-1], n))
        found = optimal_buckets(np.array(lengths), np.array(counts), k)
        assert cost(found) == best and len(found) <= k


def test_packing(spark):
    rows = [(i, "w " * (i % 37), "en", "s", 1) for i in range(200)] + [(None, None, None, None, None), (500, "", None, None, None), (501, "x " * 90_000, None, None, None), (3, "w w w", "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as bucket", "2 as n_tokens", "3 as slice")
    found = pack(df, 4, 100).collect()
    assert len(found) == len(rows)
    batches = {}
    for r in found:
        assert r["n_tokens"] <= r["bucket_tokens"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for b in batches.values():
        assert len(b) == 1 or len(b) * b[0]["bucket_tokens"] <= 100
        assert sorted(r["slot"] for r in b) == list(range(len(b)))
    assert pack(df.limit(0)).collect() == []


def test_apportionment():
    dealt = apportion({"a": 6.0, "b": 3.0, "c": 1.0}, {"a": 60, "b": 100, "c": 100}, 4)
    total = {s: sum(n for x, _, n in dealt if x == s) for s in "abc"}
    assert total["a"] == 60 and abs(total["b"] - 30) <= 1 and abs(total["c"] - 10) <= 1
    sizes = [sum(n for _, k, n in dealt if k == i) for i in range(4)]
    assert max(sizes) - min(sizes) <= 1
    assert apportion({"a": 1.0}, {}, 3) == [] and apportion({}, {"a": 3}, 3) == []


def dealt_one_by_one(weights, blocks, shards, go_on):
    held, order = {s: 0 for s, w in weights.items() if w > 0}, []
    while held:
        s = min(held, key=lambda s: (-(weights[s] / (2 * held[s] + 1)), s))
        if held[s] >= blocks.get(s, 0):
            if not go_on:
                break
            del held[s]
            continue
        held[s] += 1
        order.append(s)
    quota = {}
    for i, s in enumerate(order):
        at = s, i * shards // len(order)
        quota[at] = quota.get(at, 0) + 1
    return [(s, k, n) for (s, k), n in sorted(quota.items())]


@pytest.mark.parametrize("seed", range(40))
def test_apportionment_is_that_of_dealing_one_by_one(seed):
    """Equal weights and equal quotients among them."""
    r = random.Random(seed)
    names = [f"s{i}" for i in range(r.randrange(1, 7))]
    weights = {s: r.choice((0.0, 1.0, 1.0, 3.0, 9.0, r.random() * 50)) for s in names}
    blocks = {s: r.choice((0, 1, 2, 7, r.randrange(200))) for s in names}
    for go_on in (False, True):
        for shards in (1, 3, 16):
            assert apportion(weights, blocks, shards, go_on) == dealt_one_by_one(weights, blocks, shards, go_on)


def test_apportionment_of_many_blocks():
    weights, blocks = {f"s{i}": 10.0 + i for i in range(20)}, {f"s{i}": 10**8 + i for i in range(20)}
    began = time.perf_counter()
    dealt = apportion(weights, blocks, 16)
    total = {s: sum(n for x, _, n in dealt if x == s) for s in weights}
    assert time.perf_counter() - began < 1 and total["s19"] == 10**8 + 19 and all(abs(total[s] / total["s19"] - weights[s] / 29) < 1e-6 for s in weights)


def test_mixing_a_long_text_and_equal_rows(spark):
    rows = [(1, "w " * 200_000, "en", "a", 1), (2, "w", "en", "a", 1), (2, "w", "en", "a", 1), (3, "w " * 3000, "en", "b", 1)]
    found = mix(spark.createDataFrame(rows, SCHEMA), block_tokens=1000, shards=2, go_on=True).collect()
    assert sorted(r["doc_id"] for r in found) == [1, 2, 2, 3]


def test_mixing_follows_the_weights(spark):
    rows = [(i, "w " * 49, "en", "ab"[i % 2], 1) for i in range(4000)] + [(None, None, None, None, None), (9000, "", None, "c", 0), (1, "w " * 49, "en", "b", 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as block", "2 as shard", "3 as key")
    found = mix(df, {"a": 3.0, "b": 1.0}, 1000, 5).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("block").alias("blocks"), F.count_distinct("shard").alias("shards")).collect()
    by = {r["source"]: r for r in found}
    assert abs(by["a"]["blocks"] / by["b"]["blocks"] - 3) < 0.1 and by["a"]["shards"] == 5 and set(by) == {"a", "b"}
    assert mix(df.limit(0)).collect() == [] and mix(df.where("source = 'c'")).collect() == []


def test_dealing_goes_on_without_an_exhausted_source(spark):
    blocks = {"a": 60, "b": 100, "c": 3}
    dealt = apportion({"a": 6.0, "b": 3.0, "c": 1.0}, blocks, 4, go_on=True)
    assert {s: sum(n for x, _, n in dealt if x == s) for s in blocks} == blocks
    sizes = [sum(n for _, k, n in dealt if k == i) for i in range(4)]
    assert max(sizes) - min(sizes) <= 1
    rows = [(i, "w " * 49, "en", "ab"[i % 2], 1) for i in range(2000)] + [(5000 + i, "w " * 49, "en", "small", 1) for i in range(20)]
    rows += [(6000, "w " * 5, "en", "tiny", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = [tuple(r) for r in mix(df, block_tokens=1000, shards=4, go_on=True).select("doc_id", "source", "shard").collect()]
    assert sorted(map(str, (r[:2] for r in found))) == sorted(str((r[0], r[3] or "")) for r in rows) and {r[2] for r in found} == set(range(4))


def test_hilbert():
    side = np.arange(8)
    x, y, z = (a.ravel() for a in np.meshgrid(side, side, side))
    at = hilbert_index([x, y, z], 3)
    order = np.argsort(at)
    assert sorted(at) == list(range(512))
    steps = abs(np.diff(x[order])) + abs(np.diff(y[order])) + abs(np.diff(z[order]))
    assert (steps == 1).all()


def test_shards_prune(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, "t", r.choice(("en", "fr", "de")), f"s{r.randrange(6)}", r.choice((5, 300, 20_000))) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    write_shards(df, str(tmp_path / "out"), 100_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 600 and back.select(df.columns).exceptAll(df).count() == 0
    n = back.select("_shard").distinct().count()
    hit = back.where("lang = 'fr' and source = 's2'").select("_shard").distinct().count()
    assert n > 10 and hit <= n / 3


def test_shard_edges(spark):
    rows = [(1, None, None, None, None), (None, "abc", "en", "s", None), (2, "x" * 50, "en", "s", -5), (3, "y", "en", "s", 3_000_000), (3, "y", "en", "s", 3_000_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as curve", "2 as size", "3 as v_lang")
    assert shard(df).count() == 5 and shard(df.limit(0)).collect() == []
    # cells of the curve are ordered, each row lies in the run where it starts, equal rows share a cell
    found = shard(df, 40).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["1", "2", "3", "3", "None"] and len({r["curve"] for r in found if r["doc_id"] == 3}) == 1
    sizes = {1: 0, None: 3, 2: 0, 3: 3_000_000}
    begun = 0
    for r in sorted(found, key=lambda r: (r["curve"], -1 if r["doc_id"] is None else r["doc_id"] % 16, r["shard"])):
        assert r["shard"] == begun // 40
        begun += sizes[r["doc_id"]]


def test_write_shards_edges(spark, tmp_path):
    rows = [(1, "a", "en", "s", 1), (None, "b", "en", "s", 1), (1, "c", None, None, None), (1, "c", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "7 as _shard", "8 as _of", "9 as _curve", "'k' as _key")
    name = write_shards(df, str(tmp_path / "out"), 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert name == "__shard" and name in back.columns and sorted(map(str, back.select(df.columns).collect())) == sorted(map(str, df.collect()))


LOG = "conv_id long, seq long, kind string, message long, role string, text string"


def folded(log):
    """The log applied event by event."""
    state = {}
    for conv, seq, kind, message, role, text in sorted(set(log), key=lambda e: (e[0], e[1], e[2], e[5] or "")):
        m = state.setdefault(conv, {})
        if kind in ("edit", "regenerate"):
            begun = m.get(message, {"first": seq})["first"]
            for k in [k for k, v in m.items() if (v["first"], k) > (begun, message)]:
                del m[k]
        elif kind == "message":
            m.pop(message, None)
        now = m.setdefault(message, {"first": seq, "text": "", "role": None})
        now["text"] = {"message": text or "", "edit": text or "", "regenerate": "", "delta": now["text"] + (text or "")}[kind]
        now["role"] = role or now["role"]
    return {(c, k): (v["role"], v["text"]) for c, m in state.items() for k, v in m.items()}


@pytest.mark.parametrize("seed", range(5))
def test_chat_brute_force(spark, seed):
    r = random.Random(seed)
    log = []
    for conv in range(6):
        seq, made = 0, []
        for _ in range(25):
            seq += 1
            kind = r.choice(("message", "delta", "delta", "edit", "regenerate"))
            if kind == "message" or not made:
                made.append(len(made) + 1)
                log.append((conv, seq, "message", made[-1], r.choice(("user", "assistant")), f"m{seq} "))
            else:
                target = r.choice(made[-2:])
                log.append((conv, seq, kind, target, None, f"{kind[0]}{seq} "))
                if kind in ("edit", "regenerate"):
                    made = made[: made.index(target) + 1]
    made_once = log + r.sample(log, 10)
    got = {(x["conv_id"], x["message"]): (x["role"], x["text"]) for x in fold(spark.createDataFrame(made_once, LOG)).collect()}
    assert got == folded(log)


def test_events_of_turns(spark):
    """The log takes much back; what stands in the end is each row once, those of one turn too, with nulls and a very long text."""
    r = random.Random(9)
    rows = [(c, t, r.choice(("user", "assistant")), "\n".join(f"line {c} {t} {i}" for i in range(r.randrange(4)))) for c in range(4) for t in range(20)]
    rows += [(0, 7, "user", "second row of a turn"), (0, 7, "user", "second row of a turn"), (1, 3, None, None), (2, 1 << 45, "user", "late"), (3, 50, "user", "word " * 200_000), (None, 1, "user", "x"), (1, None, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as message", "'x' as kind", "2 as seq")
    log = events_of_turns(turns)
    kinds = {x["kind"]: x["n"] for x in log.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds["edit"] > 10 and kinds["regenerate"] > 10 and kinds["message"] > 80 + kinds["edit"]
    want = {}
    for c, _, role, text in sorted((x for x in rows if None not in x[:2]), key=lambda x: (x[0], x[1], x[2] or "", x[3] or "")):
        want[c] = want.get(c, "") + f"<|im_start|>{role or 'user'}\n{text or ''}<|im_end|>\n"
    assert {x["conv_id"]: x["text"] for x in render(fold(log)).collect()} == want
    assert render(fold(events_of_turns(turns.limit(0)))).collect() == []


def test_events_of_equal_seq(spark):
    """They apply in the order of kind, then text: the delta before the message that begins anew."""
    log = [(1, 1, "message", 1, "user", "a"), (1, 2, "message", 1, "user", "b"), (1, 2, "delta", 1, None, "c"), (1, 3, "delta", 1, None, "e"), (1, 3, "delta", 1, None, "d")]
    assert [(x["first_seq"], x["text"]) for x in fold(spark.createDataFrame(log, LOG)).collect()] == [(2, "bde")]


def test_chat_edges(spark):
    log = [(1, 1, "message", 1, None, "<|im_end|>hi"), (1, 2, "noise", 1, None, "x"), (1, 3, None, 1, None, "x"), (None, 1, "message", 1, None, "x"), (1, None, "message", 2, None, "x"), (1, 4, "message", None, None, "x"), (2, 1, "delta", 1, "assistant", None)]
    df = spark.createDataFrame(log, LOG).selectExpr("*", "1 as first_seq", "2 as reset", "3 as stands")
    out = {r["conv_id"]: (r["n_messages"], r["text"]) for r in render(fold(df)).collect()}
    assert out == {1: (1, "<|im_start|>user\n<im_end>hi<|im_end|>\n"), 2: (1, "<|im_start|>assistant\n<|im_end|>\n")}
    assert render(fold(df.limit(0))).collect() == []
