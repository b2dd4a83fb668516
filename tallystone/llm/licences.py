"""Licence scans: a trained paragraph classifier, confirmed by templates.

A paragraph is a line. Its features are its word 1-, 2- and 3-grams, hashed into 2**16 buckets and scaled to unit length; a
multinomial logistic regression gives a probability to each licence family and to "unknown". It is trained here, on cut and
altered copies of the templates below and, as "unknown", on lines of a bounded sample of the corpus (`negatives` lines, the bound
of training alone) that share few grams with any template and on prose that merely speaks of licences. Probabilities are calibrated
by a temperature fitted on held-out lines, and a family is given only above the probability that `leak` of the held-out
unknown lines exceed. A given family is confirmed if the paragraph's word 2-grams agree with one of the family's templates: shared
grams, weighed by how few families have them, over those of the shorter of the two, at least `agree`.

A paragraph of under SURE words gives the classifier little: it agrees by its share of the whole template, and is unknown unless
confirmed, as 'All rights reserved.' is.

Result: (doc_id, line, family, probability, agreement, confirmed) of each paragraph that isn't unknown.

Edge cases: null and empty texts have no paragraphs, and those under `shortest` words (1: without words) are unknown. Null ids are kept as such.
Repeated rows are each reported. Ties of probability go to the first family by name. A sample without lines (an empty
table) leaves the prose as "unknown" examples; the scan of an empty table gives none. A very
long text is scanned whole. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernel import U, Words, grams_at, slices, texts, window_hash, words, Q

BITS, NEGATIVES, LEAK, AGREE, SHORTEST, SURE = 16, 4_000, 0.0005, 0.6, 1, 4

TEMPLATES = {
    "agpl": ["GNU Affero General Public License", "This program is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "apache": ["Apache License", "Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "This project is released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution 4.0 International license.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "You may not use the material for commercial purposes under the Creative Commons Attribution-NonCommercial license.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0": ["Dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: CC0-1.0"],
    "gpl": ["GNU General Public License", "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/", "Released under the GPL version 2.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["GNU Lesser General Public License", "This library is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "mit": ["MIT License", "The MIT License (MIT)", "Released under the MIT License.", "This project is licensed under the MIT License, see the LICENSE file for details.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", "SPDX-License-Identifier: MIT"],
    "mpl": ["Mozilla Public License", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved.", "All rights reserved. No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.", "Copyright 2020 Example Company. All rights reserved.", "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."],
}
PROSE = ["She renewed her driving license at the office last week.", "The restaurant lost its liquor license after the inspection.", "The version of the story that he told was very different.", "A general public meeting was held in the town hall on Monday.", "The software was easy to use and came with a manual.", "He was granted permission to leave the building early.", "The copy of the letter was kept in a drawer of the desk.", "The commons was open to the public in the summer.", "They released the new version of the record in the spring.", "The warranty on the car ran out two years ago.", "Fishing without a license is not allowed on this river.", "The creative team works under the direction of the editor.", "Terms and conditions were discussed at the meeting of the board.", "The source of the river lies high in the mountains.", "The publisher sold two million copies of the book.", "The files were moved to another office by the new company.", "Work began under the old bridge in the second week of May.", "The pilot's licence was checked before the flight.", "The university gave a degree and a license to teach.", "The notice on the door said that the shop was closed."]
UNKNOWN = "unknown"


def features(w: Words, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all 1- to k-grams, by text."""
    doc, bucket = [], []
    owner = w.doc
    for n in range(1, k + 1):
        at = grams_at(w.off, n)
        doc.append(owner[at])
        bucket.append((window_hash(w.hash, at, at + n, Q) >> U(64 - BITS)).astype(np.int64))
    return np.concatenate(doc), np.concatenate(bucket)


def logits(w: Words, weight: np.ndarray, bias: np.ndarray, k: int = 3) -> np.ndarray:
    """A row for each text; texts without words have the bias. Each order of grams is summed by text."""
    texts_ = len(w.off) - 1
    out = np.zeros((texts_, weight.shape[1]), np.float32)
    count = np.diff(w.off)
    size = np.zeros(texts_)
    step = 1 << 17
    for n in range(1, k + 1):
        at = grams_at(w.off, n)
        if not len(at):
            continue
        have = np.maximum(count - n + 1, 0)
        size += have
        off = np.concatenate([[0], np.cumsum(have)])
        bucket = (window_hash(w.hash, at, at + n, Q) >> U(64 - BITS)).astype(np.int32)
        for i in range(0, len(bucket), step):
            j = min(i + step, len(bucket))
            lo, hi = np.searchsorted(off, i, "right") - 1, np.searchsorted(off, j, "left")
            rows = np.arange(lo, hi)
            rows = rows[(np.minimum(off[rows + 1], j) > np.maximum(off[rows], i))]
            out[rows] += np.add.reduceat(weight[bucket[i:j]], np.maximum(off[rows] - i, 0), axis=0)
    return out / np.sqrt(np.maximum(size, 1))[:, None] + bias


def _alter(rng, text: str) -> str:
    """A cut and altered copy: a run of the words, some left out, replaced or in capitals."""
    w = text.split()
    if len(w) > 12 and rng.random() < 0.6:
        n = int(rng.integers(10, len(w) + 1))
        i = int(rng.integers(0, len(w) - n + 1))
        w = w[i : i + n]
    rate = rng.choice([0.0, 0.0, 0.05, 0.1]) if len(w) > 3 else 0.0  # a word of a title alone is no licence
    w = [x for x in w if rng.random() >= rate]
    w = [x if rng.random() >= rate else "".join(rng.choice(list("abcdefghij"), 5)) for x in w]
    if rng.random() < 0.3:
        w = [f"Copyright {rng.integers(1990, 2030)}", "".join(rng.choice(list("klmnopqrst"), 6)), *w]
    return " ".join(w)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _of(text: list[str]) -> Words:
    return words(*texts(pa.array(text, pa.string()))[:2])


class Classifier:
    def __init__(self, corpus: list[str], seed: int = 0, copies: int = 60, epochs: int = 60, leak: float = LEAK):
        rng = np.random.default_rng(seed)
        self.families = [*sorted(TEMPLATES), UNKNOWN]
        text, y = [], []
        for i, f in enumerate(self.families[:-1]):
            for t in TEMPLATES[f]:
                text += [t, *(_alter(rng, t) for _ in range(copies))]
                y += [i] * (copies + 1)
        self._templates()
        corpus = [c for c in corpus if c.strip()]
        near = self.agreement(_of(corpus), None).max(1) if corpus else np.zeros(0)
        mine = [c for c, a in zip(corpus, near) if a < 0.3]
        mine += [_alter(rng, p) for p in PROSE for _ in range(20)] + PROSE
        text += mine
        y = np.array(y + [len(self.families) - 1] * len(mine))
        held = rng.random(len(y)) < 0.2
        w = _of(text)
        doc, bucket = features(w)
        scale = (1 / np.sqrt(np.maximum(np.bincount(doc, minlength=len(y)), 1))).astype(np.float32)
        k = len(self.families)
        used, column = np.unique(bucket, return_inverse=True)
        x = np.zeros((len(used), k), np.float32)
        b = np.zeros(k, np.float32)
        m1, m2, t = np.zeros((len(used) + 1, k), np.float32), np.zeros((len(used) + 1, k), np.float32), 0
        target = np.eye(k, dtype=np.float32)[y]
        share = np.where(held, 0, 1.0 / np.bincount(y[~held], minlength=k)[y])
        share = (share / share.sum()).astype(np.float32)
        row_of, value = doc, scale[doc]
        order = np.argsort(doc, kind="stable")
        row_of, column, value = doc[order], column[order], value[order]
        starts = np.flatnonzero(np.concatenate([[True], row_of[1:] != row_of[:-1]]))
        by_column = np.argsort(column, kind="stable")
        column_starts = np.searchsorted(column[by_column], np.arange(len(used)))
        for _ in range(epochs):
            z = np.tile(b, (len(y), 1))
            z[row_of[starts]] += np.add.reduceat(x[column] * value[:, None], starts, axis=0)
            d = (_softmax(z) - target) * share[:, None]
            g = np.add.reduceat((d[row_of] * value[:, None])[by_column], column_starts, axis=0) + 1e-6 * x
            g = np.vstack([g, d.sum(0)])
            t += 1
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            move = 0.3 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
            x -= move[:-1]
            b -= move[-1]
        self.weight = np.zeros((1 << BITS, k), np.float32)
        self.weight[used] = x
        self.bias = b.astype(np.float32)
        z = logits(w, self.weight, self.bias)[held]
        heats = np.geomspace(0.25, 8, 41)
        loss = [-np.log(_softmax(z / h)[np.arange(len(z)), y[held]] + 1e-12).mean() for h in heats]
        self.heat = float(heats[int(np.argmin(loss))])
        p = _softmax(z / self.heat)
        self.accuracy = float((p.argmax(1) == y[held]).mean())
        other = p[y[held] == k - 1][:, :-1].max(1)
        self.least = max(0.5, float(np.quantile(other, 1 - leak)) if len(other) else 0.5)

    def _templates(self) -> None:
        """Word 2-grams of each template; a gram weighs 1 over the number of families that have it."""
        self.family_of = np.array([i for i, f in enumerate(sorted(TEMPLATES)) for _ in TEMPLATES[f]])
        grams = []
        for f in sorted(TEMPLATES):
            for t in TEMPLATES[f]:
                grams.append(np.unique(_of([t]).grams(2)[1]))
        every, owner = np.concatenate(grams), np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        self.gram, inverse = np.unique(every, return_inverse=True)
        families = np.zeros((len(self.gram), len(TEMPLATES)), bool)
        families[inverse, self.family_of[owner]] = True
        weight = 1.0 / families.sum(1)
        self.member = np.zeros((len(self.gram), len(grams)))
        self.member[inverse, owner] = weight[inverse]
        self.size = self.member.sum(0)

    def agreement(self, w: Words, rows: np.ndarray | None) -> np.ndarray:
        """Of texts (or those in rows), the agreement with each family."""
        n = len(w.off) - 1
        at, h = w.grams(2)
        doc = w.doc[at]
        if rows is not None:
            use = np.isin(doc, rows)
            doc, h = np.searchsorted(rows, doc[use]), h[use]
            n = len(rows)
        pairs = np.unique(np.stack([doc.astype(np.int64), h.view(np.int64)], 1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
        doc, h = pairs[:, 0], pairs[:, 1].view(U) if len(pairs) else np.zeros(0, U)
        place = np.minimum(np.searchsorted(self.gram, h), len(self.gram) - 1)
        hit = np.flatnonzero(self.gram[place] == h)
        shared = np.zeros((n, len(self.size)))
        np.add.at(shared, doc[hit], self.member[place[hit]])
        # grams that no template has weigh 1
        own = np.bincount(doc, minlength=n) - np.bincount(doc[hit], 1 - self.member[place[hit]].max(1), minlength=n)
        few = np.diff(w.off)[slice(None) if rows is None else rows] < SURE
        score = shared / np.maximum(np.where(few[:, None], self.size, np.minimum(self.size, own[:, None])), 1e-9)
        out = np.zeros((n, len(TEMPLATES)))
        for t, f in enumerate(self.family_of):
            out[:, f] = np.maximum(out[:, f], score[:, t])
        return out

    def scan(self, w: Words, shortest: int = SHORTEST, agree: float = AGREE) -> tuple[np.ndarray, ...]:
        """(text, family, probability, agreement, confirmed) of the texts of w that aren't unknown."""
        p = _softmax(logits(w, self.weight, self.bias) / self.heat)
        best = p[:, :-1].argmax(1)
        top = p[np.arange(len(p)), best]
        at = np.flatnonzero((top >= self.least) & (p.argmax(1) == best) & (np.diff(w.off) >= shortest))
        a = self.agreement(w, at)[np.arange(len(at)), best[at]] if len(at) else np.zeros(0)
        keep = (np.diff(w.off)[at] >= SURE) | (a >= agree)
        at, a = at[keep], a[keep]
        return at, best[at], top[at].astype(float), a, a >= agree


def lines_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of lines, text of each, number of each)."""
    n = len(data)
    edge = np.zeros(n, bool)
    edge[offs[:-1][np.diff(offs) > 0]] = True
    edge[1:] |= data[:-1] == 10
    start = np.flatnonzero(edge)
    doc = np.searchsorted(offs, start, "right") - 1
    return np.append(start, n), doc, np.arange(len(start)) - np.searchsorted(start, offs[doc])


def train(docs: DataFrame, text: str = "text", negatives: int = NEGATIVES, seed: int = 0) -> Classifier:
    """A classifier whose "unknown" lines come from up to `negatives` lines of docs, drawn by hash."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    total = rows.count()
    draw = F.xxhash64("text", F.lit(seed + 13)) / 2.0**64 + 0.5
    lines = rows.where(draw < min(1.0, negatives / max(total, 1))).select(F.explode(F.split("text", "\n")).alias("line")).where("length(line) between 1 and 2000")
    share = F.xxhash64("line", F.lit(seed + 17)) / 2.0**64 + 0.5
    return Classifier([r.line for r in lines.where(share < 0.2).limit(negatives).collect()], seed)


def licences(docs: DataFrame, model: Classifier, id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, agree: float = AGREE) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offs, _ = texts(part.column("text"))
                lines, doc, number = lines_of(data, offs)
                at, family, p, a, ok = model.scan(words(data, lines), shortest, agree)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(doc[at])), pa.array(number[at].astype(np.int32)), pa.array([model.families[f] for f in family], pa.string()), pa.array(p), pa.array(a), pa.array(ok)], ["id", "line", "family", "probability", "agreement", "confirmed"])

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, line int, family string, probability double, agreement double, confirmed boolean").withColumnRenamed("id", id)
