"""License scans: a trained paragraph classifier, confirmed by comparison with templates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaframe.llm.quality import ftrl
from vistaframe.llm.shared import cut
from vistaframe.llm.text import Words, chunks, ngram_hash

BITS = 18
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file in the project root for full license information.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl-3.0": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "bsd-3-clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal",
        "This is free and unencumbered software released into the public domain.",
    ],
}
#: Notices of no family above; the model learns to call them unknown.
OTHER = [
    "Copyright the authors. All rights reserved.",
    "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    "Licensed to the customer under the terms of the commercial license agreement.",
    "This software is provided under the terms of the vendor end user license agreement.",
    "Distributed under a custom license, see the accompanying notice.",
]
FAMILIES = [*sorted(TEMPLATES), "unknown"]
_WORD = re.compile("[a-z0-9\x80-\U0010ffff]+")


def _tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _features(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return (h & mask).astype(np.int64), (ngram_hash(h, 2) & mask).astype(np.int64)


def train(paragraphs: list[str], bits: int = BITS, variants: int = 40, seed: int = 7) -> tuple[np.ndarray, float]:
    """One-against-rest weights, (2**bits + 1) x families, and the temperature that calibrates them.

    Examples are the templates and notices with words dropped or swapped for words of the corpus, and, as
    examples of none, all the given paragraphs that share no template's wording. The temperature is the one
    that gives held-out variants the least log loss.
    """
    rng = np.random.default_rng(seed)
    grams = {g for ts in TEMPLATES.values() for t in ts for g in zip(_tokens(t), _tokens(t)[1:])}
    plain = [p for p in paragraphs if not grams & set(zip(_tokens(p), _tokens(p)[1:]))]
    filler = [w for p in plain for w in p.split()] or ["of"]
    texts, y = [], []
    for k, family in enumerate(FAMILIES):
        for t in OTHER if family == "unknown" else TEMPLATES[family]:
            for v in range(variants):
                w = t.split()
                if v:
                    w = [x if rng.random() > 0.06 else filler[rng.integers(len(filler))] for x in w if rng.random() > 0.03]
                    w = [*(filler[rng.integers(len(filler))] for _ in range(rng.integers(0, 3) * (v % 3 == 0))), *w]
                texts.append(" ".join(w))
                y.append(k)
    texts += plain
    y += [-1] * len(plain)
    words = Words(pa.array(texts))
    at = words.bounds()
    rows = []
    for a, b in zip(at[:-1], at[1:]):
        one, two = _features(words.hash[a:b], bits)
        i, c = np.unique(np.concatenate([one, two]), return_counts=True)
        rows.append((i, c / np.sqrt(max(1, c.sum()))))
    y = np.array(y)
    order = rng.permutation(len(y))
    test, fit = order[: len(y) // 5], order[len(y) // 5 :]
    w = np.stack([ftrl([rows[i] for i in fit], (y[fit] == k).astype(float), 1 << bits, epochs=4, alpha=1.0, l1=0.05) for k in range(len(FAMILIES))], axis=1)
    logits = np.stack([rows[i][1] @ w[rows[i][0]] + w[-1] for i in test])
    truth = y[test][:, None] == np.arange(len(FAMILIES))

    def loss(t):
        p = np.clip(1 / (1 + np.exp(-logits / t)), 1e-9, 1 - 1e-9)
        return -(truth * np.log(p) + ~truth * np.log(1 - p)).mean()

    return w.astype(np.float32), float(min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0), key=loss))


def similarity(paragraph: str, family: str) -> float:
    """The largest share, over the family's templates, of the template's word pairs that the paragraph has."""
    have = _tokens(paragraph)
    pairs = set(zip(have, have[1:]))
    best = 0.0
    for t in TEMPLATES[family]:
        w = _tokens(t)
        want = set(zip(w, w[1:]))
        best = max(best, len(want & pairs) / max(1, len(want)))
    return best


class Windows:
    """Places where enough of a template's word pairs come close together, whatever line breaks and marks lie between."""

    def __init__(self, confirm: float, bits: int) -> None:
        texts = [(k, t) for k, f in enumerate(FAMILIES) for t in TEMPLATES.get(f, OTHER)]
        words = Words(pa.array([t for _, t in texts]))
        at = words.bounds()
        self.templates = [(k, b - a, np.unique(ngram_hash(words.hash[a:b], 2))) for (k, _), a, b in zip(texts, at[:-1], at[1:])]
        self.mask, self.confirm = np.uint64((1 << bits) - 1), confirm
        self.known = np.zeros(1 << bits, bool)
        for *_, pairs in self.templates:
            self.known[(pairs & self.mask).astype(np.int64)] = True

    def of(self, words: Words) -> list[tuple[float, int, int, int, int]]:
        """(share of the template's pairs, family, row, first word, end), the largest share first, then the longest; they may overlap."""
        pair = ngram_hash(words.hash, 2)
        pos = np.flatnonzero(self.known[(pair & self.mask).astype(np.int64)] & (words.row[:-1] == words.row[1:]))
        pair, end_of, out = pair[pos], words.bounds()[1:], []
        for k, length, pairs in self.templates:
            code = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            mine = pairs[code] == pair
            at, code, need = pos[mine], code[mine], self.confirm * len(pairs)
            row = words.row[at]
            reach = np.minimum(at + length + length // 3 + 4, end_of[row])
            stop = np.searchsorted(at, reach)
            for i in np.flatnonzero(stop - np.arange(len(at)) >= need):
                share = len(np.unique(code[i : stop[i]])) / len(pairs)
                if share >= self.confirm:
                    end = min(max(at[stop[i] - 1] + 2, at[i] + length), end_of[row[i]])
                    out.append((share, k, int(row[i]), int(at[i]), int(end)))
        return sorted(out, key=lambda x: (-x[0], x[3] - x[4], x[3], x[1]))


def sample_paragraphs(docs: DataFrame, sample_docs: int, sample_lines: int) -> list[str]:
    """At most ``sample_lines`` lines of the documents with the ``sample_docs`` smallest hashes of their ids, those with the smallest hashes; whole documents are read, and only ids are sorted over the whole table."""
    ids = docs.where("doc_id is not null and text is not null").select("doc_id").distinct()
    ids = cut(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))
    lines = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.explode(F.split("text", "\n")).alias("line")).where("line rlike '\\\\S'")
    return [r["line"] for r in lines.distinct().orderBy(F.xxhash64("line"), "line").limit(sample_lines).collect()]


def judge(p: np.ndarray, text: str, certain: float, confirm: float) -> tuple[int, float, float] | None:
    """(family, probability, similarity) of a line with the probabilities ``p``, of which the last is that of an unknown notice; None if it is no notice."""
    known = len(p) - 1
    k = int(p[:known].argmax())
    like = similarity(text, FAMILIES[k])
    if p[k] >= certain and like >= confirm:
        return k, float(p[k]), like
    if p[known] >= certain or p[k] >= certain and like > 0.2:
        return known, float(p.max()), like
    return None


def license_scan(docs: DataFrame, sample_docs: int = 300, sample_lines: int = 2000, certain: float = 0.5, confirm: float = 0.6, bits: int = BITS) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity): the paragraphs of docs that carry a licence notice.

    A paragraph is a line, or the lines that a window of words touches; paragraph is the number of the first from 0
    on. Every line of every text is classified, and so is every window in which ``confirm`` of a template's word
    pairs lie within a third more words than the template has: notices wrapped over lines, with comment marks or
    without, and those within a long line, which the whole line's other words would drown. A window is reported if
    the model finds the template's family the likeliest and at least ``certain``, and none of its lines is already
    reported under that family; lines that it touches aren't reported as unknown then. A line whose likeliest family is at least ``certain`` and has ``confirm`` of a template's word pairs is reported
    under that family; one that the model holds for a notice, but whose template doesn't confirm it, as unknown.
    ``sample_docs`` bounds the documents, and ``sample_lines`` their lines, that serve as examples of no licence
    (see ``sample_paragraphs``); scanning reads every line of every text. Null and empty texts have
    no lines to report, repeated rows report each, doc_id may be null, an empty table gives none. Of equally
    likely families the first by name counts.
    """
    w, temperature = train(sample_paragraphs(docs, sample_docs, sample_lines), bits)
    shared = docs.sparkSession.sparkContext.broadcast((w, np.abs(w[:-1]).sum(1) > 0, temperature))
    windows = Windows(confirm, bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, used, heat = shared.value
        kinds = weight.shape[1]
        known = kinds - 1
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"))
                data, off = words.data, words.off
                line_end = data == 10
                starts = np.union1d(np.flatnonzero(line_end) + 1, off[:-1])
                starts = starts[starts < max(1, len(data))]
                if not len(words.hash):
                    continue
                line = np.searchsorted(starts, words.start, side="right") - 1
                one, two = _features(words.hash, bits)
                same = line[:-1] == line[1:]
                n = np.bincount(line, minlength=len(starts)) + np.bincount(line[:-1][same], minlength=len(starts))
                at, feature = np.concatenate([line, line[:-1][same]]), np.concatenate([one, two[same]])
                live = used[feature]
                at, feature = at[live], feature[live]
                dot = np.stack([np.bincount(at, weight[feature, k], len(starts)) for k in range(kinds)], axis=1)
                p = 1 / (1 + np.exp(-(dot / np.sqrt(np.maximum(n, 1))[:, None] + weight[-1]) / heat))
                hit = np.flatnonzero(p.max(1) >= certain)
                ids = part.column("doc_id")
                row = np.searchsorted(off, starts[hit], side="right") - 1
                found = []
                for i, r in zip(hit, row):
                    stop = int(min(starts[i + 1] if i + 1 < len(starts) else len(data), off[r + 1]))
                    text = data[starts[i] : stop].tobytes().decode("utf-8", "replace")
                    if (said := judge(p[i], text, certain, confirm)) is not None:
                        found.append((int(r), int(i), *said))
                reported: dict[int, set[int]] = {}
                for _, i, k, *_ in found:
                    reported.setdefault(i, set()).add(k)
                taken: dict[int, list[tuple[int, int]]] = {}
                named = set()
                for like, k, r, begin, end in windows.of(words):
                    if any(begin < e and b < end for b, e in taken.get(r, ())):
                        continue
                    x = np.concatenate(_features(words.hash[begin:end], bits))
                    chance = 1 / (1 + np.exp(-(weight[x].sum(0) / np.sqrt(len(x)) + weight[-1]) / heat))
                    if int(chance.argmax()) != k or chance[k] < certain:
                        continue
                    taken.setdefault(r, []).append((begin, end))
                    lines = range(int(line[begin]), int(line[end - 1]) + 1)
                    if k != known:
                        named.update(lines)
                    if not any(k in reported.get(i, ()) or k == known and i in reported for i in lines):
                        found.append((r, lines[0], k, float(chance[k]), like))
                        for i in lines:
                            reported.setdefault(i, set()).add(k)
                found = [x for x in found if x[2] != known or x[1] not in named]
                if found:
                    first = np.searchsorted(starts, off)
                    found = [(ids[r].as_py(), i - int(first[r]), FAMILIES[k], chance, like) for r, i, k, chance, like in sorted(found)]
                    names = ["doc_id", "paragraph", "family", "probability", "similarity"]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64()))], names)

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, paragraph int, family string, probability double, similarity double")


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
