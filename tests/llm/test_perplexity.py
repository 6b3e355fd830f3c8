import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vistaframe.llm.perplexity import bands, discounts, log_perplexities, perplexity_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_force(rows):
    out = {}
    for lang in {r[1] or "" for r in rows}:
        docs = [(r[0], (r[2] or "").split()) for r in rows if (r[1] or "") == lang]
        pairs = [list(zip(["<begin>", *w], w)) for _, w in docs]
        total = Counter(p for b in pairs for p in b)
        context, kinds, follow = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
        for (v, w), c in total.items():
            context[v] += c
            kinds[v][min(c, 3) - 1] += 1
            follow[w] += 1
        by_count = Counter(total.values())
        d = discounts(*(by_count[i] for i in (1, 2, 3, 4)))
        for (i, words), b in zip(docs, pairs):
            own, own_context = Counter(b), Counter(v for v, _ in b)
            lost = Counter(w for (v, w), c in own.items() if total[v, w] == c)
            cost = adapted = 0.0
            for (v, w), c in own.items():
                left, seen = total[v, w] - c, follow[w] - lost[w]
                lower = (seen if seen > 0 else 0.5) / len(total)
                rest = context[v] - own_context[v]
                p = lower
                if rest > 0:
                    p = (max(left - d[min(left, 3) - 1], 0) if left else 0) / rest + sum(x * y for x, y in zip(kinds[v], d)) / context[v] * lower
                cost -= math.log(p) * c
                adapted -= math.log(0.75 * (c - 1) / max(own_context[v] - 1, 1) + 0.25 * lower) * c
            out[i] = (cost / len(words), adapted / len(words)) if words else (None, None)
    return out


@pytest.mark.parametrize("piece_bytes", [1 << 25, 100_000])
def test_brute_force(spark, piece_bytes):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_force(docs.select("doc_id", "lang", "text").collect())
    got = {r["doc_id"]: (r["log_perplexity"], r["log_adapted"]) for r in log_perplexities(docs, piece_bytes).collect()}
    assert got.keys() == want.keys()
    assert all((x is None) == (y is None) and (y is None or abs(x - y) < 1e-9) for i in want for x, y in zip(got[i], want[i]))


def test_edges(spark):
    rows = [(1, None, "en", None, None), (2, "", None, None, 0), (3, "a b c", None, "s", 5), (3, "a b c", None, "s", 5), (None, "x " * 50_000, "en", "s", 5), (5, "...", "en", None, None)]
    found = perplexity_rules(spark.createDataFrame(rows, SCHEMA).withColumn("keep", F.lit(1)).withColumn("n_words", F.lit("x"))).collect()
    assert len(found) == 6
    assert {r["doc_id"]: r["keep"] for r in found if r["doc_id"] in (1, 2)} == {1: False, 2: False}
    twins = [r["log_perplexity"] for r in found if r["doc_id"] == 3]
    assert twins[0] == twins[1]
    assert perplexity_rules(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [r["keep"] for r in perplexity_rules(spark.createDataFrame(rows[:2], SCHEMA)).collect()] == [False, False]


def test_bands_reject_noise(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    noise = spark.range(5).select((F.col("id") + 10_000_000).alias("doc_id"), F.lit(" ".join(f"q{i}x{i * i}" for i in range(300))).alias("text"), F.lit("en").alias("lang"))
    noise = noise.withColumn("text", F.regexp_replace("text", "q", F.concat(F.lit("z"), F.col("doc_id").cast("string"))))
    found = perplexity_rules(docs.select("doc_id", "text", "lang").unionByName(noise))
    # documents that repeat the same few words or lines are the lower band's
    words = F.split("text", "\\s+")
    own = docs.select("doc_id", (F.size(F.array_distinct(words)) > 0.4 * F.size(words)).alias("varied"))
    got = found.join(own, "doc_id", "left").groupBy((F.col("doc_id") >= 10_000_000).alias("noise"), F.coalesce("varied", F.lit(True)).alias("varied")).agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {(r["noise"], r["varied"]): r["kept"] for r in got}
    assert kept[True, True] == 0 and kept[False, True] > 0.95


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_lower_band_rejects_loops(spark, sf):
    """Few words over and over, in every language, go at either size; copies of an ordinary text stay."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text", "lang")
    loops, copies = [], []
    for k, lang in enumerate(("en", "fr", "es", "de")):
        words = [w for r in docs.where(F.col("lang") == lang).orderBy("doc_id").limit(30).collect() for w in r["text"].split()]
        loops += [(10_000_000 + 100 * k + i, " ".join(words[7 * i : 7 * i + 6] * (20 + i)), lang) for i in range(10)]
        copies += [(20_000_000 + 100 * k + i, " ".join(f"{lang}w{j * j % 997}" for j in range(400)), lang) for i in range(40)]
    found = perplexity_rules(docs.unionByName(spark.createDataFrame(loops + copies, docs.schema))).where("doc_id >= 10000000").collect()
    assert not any(r["keep"] for r in found if r["doc_id"] < 20_000_000) and all(r["low"] > 1 for r in found)
    assert all(r["log_adapted"] >= r["low"] for r in found if r["doc_id"] >= 20_000_000)


def test_bands_median(spark):
    scores = spark.createDataFrame([("en", x, 10 - x) for x in (1.0, 2.0, 3.0, 4.0, 9.0)] + [("de", None, None)], "lang string, log_perplexity double, log_adapted double")
    (r,) = bands(scores, 0.5, 2).collect()
    # adapted: 1, 6, 7, 8, 9
    assert (r["lang"], *(round(r[c], 3) for c in ("middle", "high", "middle_adapted", "low"))) == ("en", 3.0, 5.0, 7.0, 3.5)
