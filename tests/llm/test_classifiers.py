import math
import random
import re
import textwrap
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vistaframe.llm.licenses import FAMILIES, TEMPLATES, judge, license_scan, sample_paragraphs, similarity, train
from vistaframe.llm.quality import BITS, quality_scores, score_with
from vistaframe.llm.text import Words, ngram_hash

DOCS = "doc_id long, text string, extra string"


def test_quality_held_out(spark):
    r = random.Random(3)
    good, bad = [f"good{i}" for i in range(40)], [f"bad{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(400):
        y = i % 2
        words = [r.choice(good if y else bad) if r.random() < 0.3 else f"common{r.randrange(200)}" for _ in range(40)]
        rows.append((i, " ".join(words), None))
        if i < 300:
            labels.append((i, y, 0))
    found = quality_scores(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("doc_id >= 300").collect()
    assert sum((x["score"] > 0.5) == (x["doc_id"] % 2 == 1) for x in found) >= 95
    assert all(x["keep"] for x in found if x["doc_id"] % 2)


def test_quality_on_the_labelled_table(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels, "doc_id")
    test = F.pmod(F.hash("doc_id"), F.lit(4)) == 0
    scored = quality_scores(docs.where(test).select("doc_id", "text").unionByName(docs.where(~test).select("doc_id", "text")), labels.join(docs.where(~test).select("doc_id"), "doc_id"))
    both = scored.join(docs.where(test).select("doc_id", "quality"), "doc_id")
    assert both.agg(F.avg(((F.col("score") > 0.5).cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.85


def test_quality_scores_by_brute_force(spark):
    """Every document of the smallest table, word by word under given weights; Counter and floats instead of arrays."""
    weights = np.random.default_rng(1).normal(size=(1 << BITS) + 1).astype(np.float32)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: (r["score"], r["keep"]) for r in score_with(docs, weights, 0.6).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert got.keys() == {r["doc_id"] for r in rows}
    for r in rows:
        words = re.findall("[a-z0-9\x80-\U0010ffff]+", (r["text"] or "").lower())
        h = Words(pa.array([" ".join(words)])).hash
        assert len(h) == len(words)
        counts = Counter(int(x) % (1 << BITS) for x in h) + Counter(int(x) % (1 << BITS) for x in ngram_hash(h, 2))
        total = sum(counts.values())
        dot = sum(c * float(weights[i]) for i, c in counts.items()) / math.sqrt(max(1, total)) + float(weights[-1])
        score = 1 / (1 + math.exp(-dot))
        assert abs(got[r["doc_id"]][0] - score) < 1e-6 and (got[r["doc_id"]][1] == (score >= 0.6) or abs(score - 0.6) < 1e-6)


def test_quality_edges(spark):
    rows = [(1, None, None), (2, "", "x"), (None, "good words", "x"), (3, "long " * 100_000, "x"), (3, "long " * 100_000, "x")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as score", "2 as y", "3 as q")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert [r["score"] for r in quality_scores(docs, none).collect()] == [0.5] * 5
    assert quality_scores(docs.limit(0), none).collect() == []
    tied = spark.createDataFrame([(3, 1), (3, 0), (2, 0), (1, 1)], "doc_id long, quality int")
    found = quality_scores(docs, tied).collect()
    assert len(found) == 5 and len({r["score"] for r in found if r["doc_id"] == 3}) == 1


LINES = {
    "mit": "Released under the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
}


def test_licenses(spark):
    plain = "The river ran under the bridge and the children watched it.\nNobody was licensed to fish there, or so they said."
    rows = [(i, f"{plain}\n{line}\n{plain}", None) for i, line in enumerate(LINES.values())] + [(50, plain, None), (51, "Copyright the authors. All rights reserved.", None)]
    found = license_scan(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r["doc_id"], r["family"]) for r in found if r["doc_id"] < 50} == set(enumerate(LINES))
    assert all(r["paragraph"] == 2 for r in found if r["doc_id"] < 50)
    assert [r["family"] for r in found if r["doc_id"] >= 50] == ["unknown"]


def test_licenses_across_and_within_lines(spark):
    """Notices wrapped at 72 columns, bare and as comments, and in the middle of one long line."""
    r = random.Random(8)
    prose = " ".join(r.choice("the river ran under a bridge and children of this town watched it with some joy".split()) for _ in range(600))
    notices = {f: max(TEMPLATES[f], key=len) for f in ("mit", "bsd-3-clause", "gpl-3.0", "lgpl-3.0", "apache-2.0")}
    rows, want = [], set()
    for f, t in notices.items():
        lines = textwrap.wrap(t, 72)
        assert len(lines) > 1
        for at, text in ((0, "\n".join(lines)), (2, "code\n/*\n" + "\n".join(f" * {x}" for x in lines) + "\n */\nmore code"), (1, "x = 1\n" + "\n".join(f"# {x}" for x in lines)), (0, f"{prose} {t} {prose}")):
            want.add((len(rows), at, f))
            rows.append((len(rows), text, None))
    rows.append((900, prose, None))
    found = license_scan(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((x["doc_id"], x["paragraph"], x["family"]) for x in found) == sorted(want)
    assert all(x["similarity"] >= 0.9 for x in found)


def test_license_lines_by_brute_force(spark):
    """What the scan says of single lines follows from the trained weights, the share of a template's word pairs, and the two thresholds."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = random.Random(2)
    lines = [t for ts in TEMPLATES.values() for t in ts] + [" ".join(w for w in t.split() if r.random() > 0.4) for ts in TEMPLATES.values() for t in ts]
    lines += ["Proprietary and confidential.", "plain words of no licence", "Licensed", "MIT"]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(lines)], "doc_id long, text string"))
    w, heat = train(sample_paragraphs(both, 300, 2000))
    assert 0.25 <= heat <= 2.0
    found = {x["doc_id"] - 10**6: x for x in license_scan(both).where("doc_id >= 1000000").collect()}
    for i, t in enumerate(lines):
        words = re.findall("[a-z0-9\x80-\U0010ffff]+", t.lower())
        h = Words(pa.array([" ".join(words)])).hash
        x = [int(v) % (1 << BITS) for v in (*h, *ngram_hash(h, 2))]
        if not x:
            assert i not in found
            continue
        p = 1 / (1 + np.exp(-(w[x].astype(float).sum(0) / math.sqrt(len(x)) + w[-1]) / heat))
        best = max((f for f in FAMILIES if f != "unknown"), key=lambda f: (p[FAMILIES.index(f)], -FAMILIES.index(f)))
        pairs = set(zip(words, words[1:]))
        shares = []
        for template in TEMPLATES[best]:
            tw = re.findall("[a-z0-9\x80-\U0010ffff]+", template.lower())
            want = set(zip(tw, tw[1:]))
            shares.append(len(want & pairs) / max(1, len(want)))
        assert abs(similarity(t, best) - max(shares)) < 1e-12
        said = judge(p, t, 0.5, 0.6)
        assert (said is None) == (i not in found) or i in found and said is None and found[i]["similarity"] >= 0.6
        if said and i in found:
            assert found[i]["family"] == FAMILIES[said[0]] and abs(found[i]["probability"] - said[1]) < 1e-4
    assert sum(i in found for i in range(len(lines))) > 20


def test_license_ties_and_sample(spark):
    p = np.full(len(FAMILIES), 0.9)
    k, chance, like = judge(p, max(TEMPLATES[FAMILIES[0]], key=len), 0.5, 0.6)
    assert (FAMILIES[k], chance, like) == (FAMILIES[0], 0.9, 1.0)  # of equally likely families the first by name
    rows = [(i // 2, f"line {i}\nsame line\n\n  ", None) for i in range(40)] + [(None, "no id", None), (99, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    some = sample_paragraphs(docs, 5, 1000)
    assert len(some) == 11 and "same line" in some and some == sample_paragraphs(docs.repartition(7), 5, 1000)
    assert len(sample_paragraphs(docs, 100, 7)) == 7 and sample_paragraphs(docs.limit(0), 5, 5) == []


def test_license_edges(spark):
    rows = [(1, None, None), (2, "", None), (None, LINES["mit"], None), (3, " ".join(f"word{i}" for i in range(50_000)) + "\n" + LINES["mit"], None), (4, LINES["mit"], "a"), (4, LINES["mit"], "a")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as family", "2 as paragraph")
    found = license_scan(docs).collect()
    assert sorted((str(r["doc_id"]), r["paragraph"], r["family"]) for r in found) == [("3", 1, "mit"), ("4", 0, "mit"), ("4", 0, "mit"), ("None", 0, "mit")]
    assert license_scan(docs.limit(0)).collect() == []
