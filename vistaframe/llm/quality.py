"""Quality classifier: hashed word n-gram logistic regression, trained follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaframe.llm.shared import cut
from vistaframe.llm.text import Words, chunks, ngram_hash

BITS = 18


def features(words: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word and every word pair within a row."""
    h, row = words.hash, words.row
    pair = ngram_hash(h, 2)
    same = row[:-1] == row[1:] if len(h) else np.empty(0, bool)
    mask = np.uint64((1 << bits) - 1)
    return np.concatenate([row, row[:-1][same]]), np.concatenate([h & mask, pair[same] & mask]).astype(np.int64)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 1.0) -> np.ndarray:
    """Weights (the last one is the bias) after FTRL-proximal passes over sparse (index, value) rows in the given order."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rows = [(np.append(i, size), np.append(v, 1.0)) for i, v in rows]

    def weights(zi, ni, bias_last):
        w = (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2)
        w[np.abs(zi) <= l1] = 0
        if bias_last:
            w[-1] = -zi[-1] / ((beta + np.sqrt(ni[-1])) / alpha)
        return w

    for _ in range(epochs):
        for (i, v), target in zip(rows, y):
            zi, ni = z[i], n[i]
            w = weights(zi, ni, True)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - target) * v
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[i] = ni + g * g
    return weights(z, n, True)


def _counted(row: np.ndarray, feature: np.ndarray, rows: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    key, count = np.unique(row << bits | feature, return_counts=True)
    at = np.searchsorted(key >> bits, np.arange(rows + 1))
    out = []
    for a, b in zip(at[:-1], at[1:]):
        c = count[a:b]
        out.append((key[a:b] & (1 << bits) - 1, c / np.sqrt(max(1, c.sum()))))
    return out


def train(docs: DataFrame, labels: DataFrame, max_train: int = 6000, bits: int = BITS, holdout: float = 0.2) -> tuple[np.ndarray, float]:
    """(weights, threshold) from a bounded sample of labelled documents.

    ``max_train`` bounds the sample: the labelled doc_ids with the smallest hashes. A fifth of them is held
    out; the threshold is the highest score, 0.5 at most, that keeps 99 % of its good documents. Rows whose
    label or doc_id is null are no examples; repeated labels of a document are averaged. Without both
    classes the weights are all zero, which scores every document 0.5.
    """
    sample = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("q"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
        .select("doc_id", (F.col("q") >= 0.5).cast("int").alias("y"))
    )
    # at most max_train rows, so the broadcast is of bounded size; of several texts of one id the one with the smallest hash counts
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    schema = "y int, index binary, value binary, h long"

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                w = Words(part.column("text"))
                sparse = _counted(*features(w, bits), w.rows, bits)
                yield pa.RecordBatch.from_arrays(
                    [part.column("y"), pa.array([i.astype(np.int32).tobytes() for i, _ in sparse], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in sparse], pa.binary()), part.column("h")],
                    ["y", "index", "value", "h"],
                )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in b.to_pylist()]
        x = [(np.frombuffer(r["index"], np.int32).astype(np.int64), np.frombuffer(r["value"], np.float32).astype(float)) for r in got]
        y = np.array([r["y"] for r in got], float)
        w, threshold = np.zeros((1 << bits) + 1), 0.5
        if 0 < y.sum() < len(y):
            test = int(len(y) * holdout)
            w = ftrl(x[test:], y[test:], 1 << bits).astype(np.float32).astype(float)
            good = [1 / (1 + np.exp(-(w[i] @ v + w[-1]))) for (i, v), t in zip(x[:test], y[:test]) if t]
            threshold = min(0.5, float(np.quantile(good, 0.01))) if good else 0.5
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([threshold])], ["w", "threshold"])

    hashed = rows.select("y", "text", F.xxhash64("doc_id", "text").alias("h"))
    found = hashed.mapInArrow(featurise, schema).coalesce(1).sortWithinPartitions("h", "y").mapInArrow(fit, "w binary, threshold double").collect()
    w = next((r["w"] for r in found), None)
    return (np.frombuffer(w, np.float32), found[0]["threshold"]) if w else (np.zeros((1 << bits) + 1, np.float32), 0.5)


def score_with(docs: DataFrame, weights: np.ndarray, threshold: float, bits: int = BITS) -> DataFrame:
    """(doc_id, score, keep) under given weights: the sparse dot product of a text's counts of words and word pairs, over the root of their number, as a probability."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, threshold))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, least = shared.value
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"))
                row, feature = features(words, bits)
                n = np.bincount(row, minlength=words.rows)
                dot = np.bincount(row, weight[feature], words.rows) / np.sqrt(np.maximum(n, 1)) + weight[-1]
                p = 1 / (1 + np.exp(-dot))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array(p >= least)], ["doc_id", "score", "keep"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, keep boolean")


def quality_scores(docs: DataFrame, labels: DataFrame, max_train: int = 6000, bits: int = BITS) -> DataFrame:
    """(doc_id, score, keep) for every row of docs; score is the probability of good quality.

    Null and empty texts have no n-grams and get the bias alone; texts of any length are scored whole;
    repeated rows are scored alike; doc_id may be null; other columns are not read; an empty table gives none.
    Row order and ties play no part in scoring.
    """
    return score_with(docs, *train(docs, labels, max_train, bits), bits)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
