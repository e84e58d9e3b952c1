"""Licence scans: a paragraph classifier with calibrated rejection, confirmed by comparison with templates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import LOWER, byte_class, in_batches, mix, ragged, text_blocks, word_hashes, word_spans

WORD = byte_class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
BUCKETS = 1 << 16
UNKNOWN = "unknown"
_STEP = np.uint64(0x9E6C63D0876A9A47)

# Wordings of licence notices by family, as they are found in public projects.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Content is available under the Creative Commons Attribution license.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under CC BY-NC-SA 4.0 for non-commercial use only.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GPLv2 or later.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "Licensed under the MIT license.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
}
#: Sentences about licences that grant none, for the class of unknown paragraphs.
OTHERS = [
    "The license committee met on Tuesday to discuss the public budget.", "A driving license is required for this position.", "All rights reserved.",
    "Copyright law was changed by the general assembly.", "The software was released last week under a new name.", "Permission to enter the building was granted.",
    "See the license for details.", "They work under the general manager of the public library.", "This work is part of a larger project.", "Version 2.0 adds a new interface.",
]


@dataclass
class LicenceModel:
    """Classes (unknown first), their weights by feature bucket, biases, the temperature and the templates' features and words."""

    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: list[tuple[str, np.ndarray]]
    lengths: list[int]


def _line_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, their row, whether a line begins with them, and whether a run of lines without a wordless one between does."""
    low = LOWER[data]
    begin, end, first = word_spans(low, starts, ends, WORD)
    if not len(begin):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none.astype(bool), none.astype(bool)
    row = np.repeat(np.arange(len(starts)), np.diff(first))
    breaks = np.cumsum(low == 10)
    line = breaks[begin]
    other = row[1:] != row[:-1]
    new = np.concatenate([[True], other | (line[1:] != line[:-1])])
    apart = np.concatenate([[True], other | (line[1:] > line[:-1] + 1)])
    return word_hashes(low, begin, end), row, new, apart


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of each word with the next."""
    return mix(h[:-1] * _STEP + h[1:])


def _matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Buckets and owners of the features of texts as one paragraph each, and the distinct features of each."""
    coded = [t.replace("\n", " ").encode() for t in texts]
    size = np.array([len(c) for c in coded])
    end = np.cumsum(size)
    data = np.frombuffer(b"".join(coded), np.uint8)
    low = LOWER[data]
    begin, stop, first = word_spans(low, end - size, end, WORD)
    h = word_hashes(low, begin, stop)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    same = owner[1:] == owner[:-1]
    features = np.concatenate([h, mix(h[:-1][same] * _STEP + h[1:][same])])
    owner = np.concatenate([owner, owner[1:][same]])
    order = np.argsort(owner, kind="stable")
    features, owner = features[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    return features, owner, [np.unique(features[bounds[k] : bounds[k + 1]]) for k in range(len(texts))]


def _scores(features: np.ndarray, owner: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """Sums of the weights of each paragraph's features over the root of their number."""
    out = np.zeros((n, weights.shape[1]))
    bucket = (features & np.uint64(BUCKETS - 1)).astype(np.int64)
    for c in range(weights.shape[1]):
        out[:, c] = np.bincount(owner, weights=weights[bucket, c], minlength=n)
    return out / np.sqrt(np.maximum(1, np.bincount(owner, minlength=n)))[:, None]


def train_licences(docs: DataFrame, documents: int = 500, paragraphs: int = 4000, steps: int = 150, seed: int = 1) -> LicenceModel:
    """Fit multinomial logistic regression on sparse word n-grams of labelled paragraphs.

    Families are learnt from their templates, whole, with other words around them and with words left out; the unknown
    class from general sentences and from at most ``paragraphs`` paragraphs of ``documents`` documents (of each residue of a
    hash of the text the least) that hold no licence word. These bounds are for fitting only. A fifth of the samples is
    held out to set the temperature that calibrates probabilities.
    """
    hashed = docs.filter(F.col("text").isNotNull()).select("text", F.xxhash64("text").alias("h"))
    least = hashed.groupBy(F.pmod("h", F.lit(documents))).agg(F.min("h").alias("h"))
    chosen = hashed.filter(F.col("h").isin([r["h"] for r in least.select("h").collect()])).select("text").distinct()
    lines = chosen.select(F.explode(F.split("text", "\n")).alias("p")).filter((F.length("p") > 0) & ~F.lower("p").rlike("licen[sc]e|copyright|spdx|warrant")).select(F.substring("p", 1, 400).alias("p")).distinct()
    plain = [r["p"] for r in lines.orderBy(F.xxhash64("p"), "p").limit(paragraphs).collect()]
    random = np.random.default_rng(seed)
    classes = [UNKNOWN, *TEMPLATES]
    fillers = [w for p in plain[:500] for w in p.split()][:5000] or ["text"]
    texts, labels = list(plain + OTHERS * 10), [0] * (len(plain) + 10 * len(OTHERS))
    for label, family in enumerate(TEMPLATES, 1):
        for template in TEMPLATES[family]:
            words = template.split()
            for k in range(24):
                own = [w for w in words if k < 8 or random.random() > 0.1]
                around = [str(w) for w in random.choice(fillers, int(random.integers(0, 1 + len(words) * (k % 3))))] if k % 3 else []
                cut = int(random.integers(0, len(around) + 1))
                texts.append(" ".join([*around[:cut], *own, *around[cut:]]))
                labels.append(label)
    features, owner, _ = _matrix(texts)
    y = np.array(labels)
    held = random.random(len(y)) < 0.2
    bucket, n = (features & np.uint64(BUCKETS - 1)).astype(np.int64), len(texts)
    used, column = np.unique(bucket, return_inverse=True)
    value = 1 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=n)))[owner]
    weights, bias, c = np.zeros((len(used), len(classes))), np.zeros(len(classes)), len(classes)
    share = np.bincount(y[~held], minlength=c) / max(1, (~held).sum())
    importance = np.where(held, 0, 1 / np.maximum(1e-9, share[y] * c))
    importance /= max(1e-9, importance.sum())
    target = np.eye(c)[y]
    speed_w, speed_b = np.full_like(weights, 1e-8), np.full_like(bias, 1e-8)

    def scores() -> np.ndarray:
        return np.column_stack([np.bincount(owner, weights=weights[column, k] * value, minlength=n) for k in range(c)]) + bias

    for _ in range(steps):
        s = scores()
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - target) * importance[:, None]
        grad = np.column_stack([np.bincount(column, weights=error[owner, k] * value, minlength=len(used)) for k in range(c)]) + 1e-6 * weights
        speed_w += grad * grad
        speed_b += error.sum(axis=0) ** 2
        weights -= 0.5 * grad / np.sqrt(speed_w)
        bias -= 0.5 * error.sum(axis=0) / np.sqrt(speed_b)
    s = scores()[held]
    losses = {}
    for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0):
        z = s / t - (s / t).max(axis=1, keepdims=True) if len(s) else s
        losses[t] = float(-(z[np.arange(len(z)), y[held]] - np.log(np.exp(z).sum(axis=1))).mean()) if len(s) else 0.0
    full = np.zeros((BUCKETS, c), np.float32)
    full[used] = weights
    named = [(family, text) for family, own in TEMPLATES.items() for text in own]
    distinct = _matrix([t for _, t in named])[2]
    lengths = [int(n) for n in np.bincount(_matrix([t for _, t in named])[1])]
    return LicenceModel(classes, full, bias, min(losses, key=losses.get), [(f, d) for (f, _), d in zip(named, distinct, strict=True)], [(n + 1) // 2 for n in lengths])


def _best_windows(at: np.ndarray, feature: np.ndarray, length: int, need: int) -> list[tuple[int, int, int]]:
    """Words of windows of ``length`` with at least ``need`` distinct features: their number, first and last position; of overlapping windows the best."""
    out: list[tuple[int, int, int]] = []
    seen: dict[int, int] = {}
    places, features, left = at.tolist(), feature.tolist(), 0
    for place, f in zip(places, features, strict=True):
        seen[f] = seen.get(f, 0) + 1
        while place - places[left] >= length or seen[features[left]] > 1:
            if seen[features[left]] == 1:
                del seen[features[left]]
            else:
                seen[features[left]] -= 1
            left += 1
        if len(seen) >= need:
            if not out or places[left] > out[-1][2]:
                out.append((len(seen), places[left], place))
            elif len(seen) > out[-1][0]:
                out[-1] = (len(seen), places[left], place)
    return out


def _template_windows(model: LicenceModel, h: np.ndarray, pairs: np.ndarray, apart: np.ndarray, same: float) -> list[tuple[int, int, int, float]]:
    """Template, first word, end and likeness of windows that hold at least the share ``same`` of a template's words and pairs.

    Windows have half as many words again as the template, and cross the ends of lines but not lines without a word.
    """
    known = np.unique(np.concatenate([own for _, own in model.templates]))
    inside = np.flatnonzero(~apart[1:])
    which = np.concatenate([np.arange(len(h)), inside])
    value = np.concatenate([h, pairs[inside]])
    index = np.minimum(np.searchsorted(known, value), len(known) - 1)
    hit = np.flatnonzero(known[index] == value)
    hit = hit[np.argsort(which[hit], kind="stable")]
    which, index = which[hit], index[hit]
    spread = which + np.cumsum(apart)[which] * (4 * max(model.lengths))  # runs of lines are out of each other's reach
    out = []
    for t, ((_, own), words) in enumerate(zip(model.templates, model.lengths, strict=True)):
        length, need = words + -(-words // 2), int(np.ceil(same * len(own) - 1e-9))
        member = np.zeros(len(known), bool)
        member[np.searchsorted(known, own)] = True
        mine = np.flatnonzero(member[index])
        if len(mine) < need:
            continue
        at = spread[mine]
        dense = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] < length)
        if not len(dense):
            continue
        stop = np.searchsorted(at, at[dense] + length)
        first = np.concatenate([[True], dense[1:] >= np.maximum.accumulate(stop)[:-1]])
        last = np.append(np.flatnonzero(first)[1:], len(dense)) - 1
        for a, b in zip(dense[first].tolist(), np.maximum.accumulate(stop)[last].tolist(), strict=True):
            part = mine[a:b]
            if len(np.unique(index[part])) < need:
                continue
            for n, begin, end in _best_windows(at[a:b], index[part], length, need):
                word = which[part[np.searchsorted(at[a:b], begin)]]
                out.append((t, int(word), int(word + end - begin) + 1, n / len(own)))
    return out


def classify(model: LicenceModel, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: float = 0.5, same: float = 0.6):
    """Row, paragraph number, family, probability and likeness of each confirmed notice, and the rows' paragraph counts.

    A paragraph is a line with a word. Notices are looked for in paragraphs and in windows of about a template's length
    over successive ones, so that neither wrapping nor text around hides them; the paragraph is the one they begin in. A
    family is predicted where its calibrated probability is at least ``least`` and above the unknown class's; it is
    confirmed where the paragraph or window holds at least the share ``same`` of the words and word pairs of one of its
    templates. Of notices with words in common the one with the largest share counts.
    """
    h, row_of, new, apart = _line_words(data, starts, ends)
    paragraph = np.cumsum(new) - 1
    row = row_of[new]
    n = len(row)
    count = np.bincount(row, minlength=len(starts)) if n else np.zeros(len(starts), np.int64)
    found = []
    if not n:
        return found, count
    pairs = _pairs(h)
    together = ~new[1:]
    features, owner = np.concatenate([h, pairs[together]]), np.concatenate([paragraph, paragraph[1:][together]])

    def predicted(features: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        s = (_scores(features, owner, n, model.weights) + model.bias) / model.temperature
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)

    begin = np.append(np.flatnonzero(new), len(h))
    first = np.concatenate([[0], np.cumsum(count)])
    notices: list[tuple[float, bool, int, int, str, float]] = []  # likeness, window, first word, end, family, probability
    windows = _template_windows(model, h, pairs, apart, same)
    if windows:
        at = np.array([w[1] for w in windows])
        size = np.array([w[2] for w in windows]) - at
        each = np.arange(len(windows))
        own_features = np.concatenate([h[ragged(at, size)], pairs[ragged(at, size - 1)]])
        best, p = predicted(own_features, np.concatenate([np.repeat(each, size), np.repeat(each, size - 1)]), len(windows))
        for (t, a, b, likeness), c, probability in zip(windows, best.tolist(), p.tolist(), strict=True):
            if model.classes[c] == model.templates[t][0] and probability >= least:
                notices.append((likeness, True, a, b, model.classes[c], probability))
    within = {}
    for likeness, _, a, b, family, _ in notices:
        if paragraph[a] == paragraph[b - 1]:
            key = (int(paragraph[a]), family)
            within[key] = max(within.get(key, (0.0, a, b)), (likeness, a, b))
    best, p = predicted(features, owner, n)
    likely = np.flatnonzero((best > 0) & (p >= least))
    for k in likely.tolist():
        a, b = int(begin[k]), int(begin[k + 1])
        own = np.unique(np.concatenate([h[a:b], pairs[a : b - 1]]))
        family = model.classes[best[k]]
        likeness = max(len(np.intersect1d(own, t, assume_unique=True)) / len(t) for f, t in model.templates if f == family)
        if likeness >= same:
            _, a, b = within.get((k, family), (0.0, a, b))  # leaves the words around to other notices
            notices.append((likeness, False, a, b, family, float(p[k])))
    taken: dict[int, list[tuple[int, int]]] = {}
    for likeness, _, a, b, family, probability in sorted(notices, key=lambda x: (-x[0], x[1], x[2] - x[3], x[2])):
        spans = taken.setdefault(int(row_of[a]), [])
        if all(b <= c or d <= a for c, d in spans):
            spans.append((a, b))
            found.append((int(row_of[a]), int(paragraph[a] - first[row_of[a]]), family, probability, likeness))
    return sorted(found, key=lambda x: x[:2]), count


def scan_licences(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """A row per document (doc_id, text): doc_id, n_paragraphs, and notices (paragraph, family, probability, likeness).

    Paragraphs are lines with a word; a notice over several is given with the first. Null and empty texts have none; repeated rows get equal rows; an empty table gives
    none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 65536 buckets by class
    kind = pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64())])

    def run(batches):
        for batch in batches:
            for first, data, starts, ends in text_blocks(batch, "text"):
                found, count = classify(shared.value, data, starts, ends)
                notices = [[] for _ in range(len(starts))]
                for row, *rest in found:
                    notices[row].append(dict(zip(("paragraph", "family", "probability", "likeness"), rest, strict=True)))
                yield pa.record_batch([batch.column(0).slice(first, len(starts)), pa.array(count, pa.int64()), pa.array(notices, pa.list_(kind))], names=["doc_id", "n_paragraphs", "notices"])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(in_batches, run, "doc_id long, n_paragraphs long, notices array<struct<paragraph:long,family:string,probability:double,likeness:double>>")
