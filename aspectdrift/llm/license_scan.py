"""Licence scans: a trained paragraph classifier, a calibrated unknown class and template comparison.

Paragraphs are lines; longer ones are read in overlapping windows of WINDOW tokens. A sparse logistic
regression over hashed word 1- and 2-grams says whether a window is licence text at all, a second one
(softmax over families) which family. Both are trained on noisy pieces of the templates below, the first one against
PLACES windows from drawn places of each of SAMPLE_DOCS documents of the corpus (those that share CONFIRM of
their word triples with a template are no negatives) and against general sentences.

Unknown is calibrated on families that a classifier hasn't seen: the families are left out in FOLDS folds,
and from the margin of the best family and the share of word triples with its templates a logistic
regression learns when a prediction is right; all predictions on families left out are wrong. A prediction
stands if its calibrated chance reaches SURE and the comparison confirms it, that is, the notice shares CONFIRM of its
word triples (pairs or words, if it is shorter) with a template of the family; other licence text is ``unknown``.

Defined results: null or empty text has no notice; a single word is no notice; repeated rows each get
a row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectdrift.llm.common import hash_key, mix, smallest, text_blocks, token_hashes

WINDOW, STRIDE, BUCKETS, SAMPLE_DOCS, PLACES, FOLDS = 48, 24, 1 << 16, 400, 8, 4
LIKELY, SURE, CONFIRM = 0.75, 0.5, 0.5
UNKNOWN = "unknown"

# Usual notices and paragraphs of each family.
TEMPLATES = {
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
        "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.", "BSD 3-Clause License", "BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY.",
        "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC0": [
        "Released under CC0 1.0 Universal.", "CC0 1.0 Universal Public Domain Dedication",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "There is no warranty for the program, to the extent permitted by applicable law. Except when otherwise stated in writing the copyright holders and/or other parties provide the program \"as is\" without warranty of any kind, either expressed or implied.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "Licensed under the GNU General Public License v2.0 only.",
        "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later",
    ],
    "ISC": [
        "Released under the ISC License.", "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER.",
        "SPDX-License-Identifier: ISC",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-3.0-or-later", "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.", "MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.", "Mozilla Public License Version 2.0",
        "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.",
        "SPDX-License-Identifier: Unlicense",
    ],
}
# Licence text of no listed family, and sentences near the subject that grant nothing.
OTHERS = [
    "All rights reserved.",
    "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
    "Use of this software is subject to the terms of the end user license agreement.",
    "Licensed under the terms of the vendor's commercial license agreement.",
    "This document is licensed under proprietary terms; redistribution is prohibited.",
    "Distributed under a custom source-available license, see the license file for details.",
    "You may not copy, modify, sublicense, sell or distribute this material except as expressly permitted by the licensor.",
    "The licensee is granted a limited, non-transferable, revocable license to install one copy of the product for internal use only.",
    "Copyright by the publisher. Unauthorized copying or distribution of this work is strictly prohibited.",
]
PLAIN = [
    "He renewed his driving license at the office in town last week.",
    "The library released a new version of its public catalogue under the old name.",
    "Permission to enter the building is granted by the guard at any time.",
    "The university offers a general public lecture on version control.",
    "A fishing license costs more in the northern states than in the south.",
    "Please return the borrowed software manuals to the front desk by the end of the month.",
    "The new software release fixes several bugs and improves the speed of the search.",
    "Students may borrow any copy of the manual for two weeks without a fee.",
    "The museum asked visitors not to use a flash and to keep the notice at the door in mind.",
    "The author of this work was born in a small village and published her first book at twenty.",
    "We distribute the leaflets free of charge in every station of the city.",
    "The warranty of the washing machine ends after two years.",
    "The general public was invited to see the original form of the source of the river.",
    "The committee modified the conditions of the contest and published them in the paper.",
    "In the documentation you will find a list of the materials that are provided with the course.",
    "The copyright office moved to a larger building near the court.",
    "Her contributors wrote about software, law and the public domain of ideas.",
    "The company sells licenses for its games in more than thirty countries.",
    "A patent lawyer explained the limits of liability to the students.",
    "The permission slip must be signed by a parent before the trip.",
    "The court held that the damages were caused by the loss of business.",
    "They agreed in writing to use the room for any purpose of the club.",
    "This program is about free concerts in the park, see the notice for details.",
    "The foundation published the terms of its new grant for young artists.",
]
_WORDS = re.compile(r"[a-z0-9]+(?:[-.][a-z0-9]+)*")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


class Templates:
    """Word triples, pairs and words of all templates by family."""

    def __init__(self, templates: dict[str, list[str]]) -> None:
        self.by = {name: [[grams(w, n) for n in (1, 2, 3)] for w in map(words_of, texts)] for name, texts in templates.items()}
        self.pairs = set().union(*(by[1] for own in self.by.values() for by in own))

    def shared(self, words: list[str], name: str) -> float:
        """The largest share of the notice's n-grams, or of the template's if it has fewer, that a template of the family has too."""
        best, mine = 0.0, [grams(words, n) for n in (1, 2, 3)]
        for by in self.by[name]:
            n = min(3, len(words), next((k for k in (3, 2) if by[k - 1]), 1))
            own, other = mine[n - 1], by[n - 1]
            best = max(best, len(own & other) / max(1, min(len(own), len(other))))
        return best

    def any_shared(self, words: list[str]) -> float:
        """The same of all families, of two words or more; without a pair in common it is none."""
        return max(self.shared(words, name) for name in self.by) if grams(words, 2) & self.pairs else 0.0


def features(text: str) -> np.ndarray:
    """Buckets of the 1- and 2-grams of a text."""
    _, h = token_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), lower=True)
    return (np.concatenate((h, mix(h[:-1] * np.uint64(3) + h[1:]))) % np.uint64(BUCKETS)).astype(np.int64)


def train(rows: list[np.ndarray], y: np.ndarray, classes: int, rounds: int = 80, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on count / sqrt(n) features by full-batch AdaGrad: weights (BUCKETS, classes), bias."""
    seen, col = np.unique(np.concatenate(rows), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value = 1.0 / np.sqrt(np.bincount(row))[row]
    starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])[:-1]))
    w, b, acc, acc_b = np.zeros((len(seen), classes)), np.zeros(classes), np.full((len(seen), classes), 1e-8), np.full(classes, 1e-8)
    order = np.argsort(col, kind="stable")
    by_col = np.searchsorted(col[order], np.arange(len(seen)))
    target, share = np.eye(classes)[y], 1.0 / np.bincount(y, minlength=classes)[y][:, None]
    for _ in range(rounds):
        z = np.add.reduceat(w[col] * value[:, None], starts) + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - target) * share / classes
        gw = np.add.reduceat((g[row] * value[:, None])[order], by_col) + l2 * w / len(rows)
        acc += gw * gw
        acc_b += (gb := g.sum(axis=0)) ** 2
        w -= 0.5 * gw / np.sqrt(acc)
        b -= 0.5 * gb / np.sqrt(acc_b)
    full = np.zeros((BUCKETS, classes))
    full[seen] = w
    return full, b


@dataclass
class Scanner:
    gate: np.ndarray
    gate_bias: float
    family: np.ndarray
    family_bias: np.ndarray
    right: np.ndarray
    names: list[str]
    templates: Templates

    def name(self, text: str) -> str | None:
        """Family of licence text, UNKNOWN, or None if the text is too short to say."""
        words = words_of(text)
        if len(words) < 2:
            return None
        k, margin = best_of(logits(text, self.family, self.family_bias))
        shared = self.templates.shared(words, self.names[k])
        chance = 1 / (1 + np.exp(-(self.right @ [1.0, margin, shared])))
        return self.names[k] if chance >= SURE and shared >= CONFIRM else UNKNOWN


def logits(text: str, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    f = features(text)
    return weights[f].sum(axis=0) / np.sqrt(len(f)) + bias


def best_of(z: np.ndarray) -> tuple[int, float]:
    """The best class and the logit of its chance against all others, bounded."""
    k = int(z.argmax())
    rest = np.delete(z, k)
    other = rest.max(initial=-20.0)
    return k, float(np.clip(z[k] - other - np.log(np.exp(rest - other).sum() + 1e-12), -20, 20))


def fit_right(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic regression with both outcomes counting alike, by Newton steps."""
    w, share = np.zeros(x.shape[1]), np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - y)) + l2 * w / len(x)
        h = (x * (share * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * (l2 / len(x) + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
    return w


def _noisy(text: str, rng: np.random.Generator, filler: list[str]) -> str:
    """A piece of a template as a window may hold it: a span, a few words lost, other words around."""
    words = text.split()
    if len(words) > 12 and rng.random() < 0.6:
        at = int(rng.integers(0, len(words) - 8))
        words = words[at : at + int(rng.integers(8, WINDOW))]
    words = [w for w in words if rng.random() > 0.04] or words
    if rng.random() < 0.4 and filler:
        more = filler[int(rng.integers(len(filler)))].split()[: int(rng.integers(1, 20))]
        words = more + words if rng.random() < 0.5 else words + more
    return " ".join(words)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", copies: int = 12, seed: int = 3, templates: dict[str, list[str]] | None = None) -> Scanner:
    """Train on noisy templates against windows of the SAMPLE_DOCS documents with the smallest id hash."""
    table = templates or TEMPLATES
    known_grams, rng, names = Templates(table), np.random.default_rng(seed), sorted(table)
    every = Templates(TEMPLATES)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Windows at drawn places of the whole text; only these leave the executors.
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    places = F.transform(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda k: F.pmod(F.xxhash64("text", k), F.greatest(F.size("words") - WINDOW, F.lit(0)).cast("long") + 1).cast("int"))
    drawn = smallest(texts, hash_key("id", seed), SAMPLE_DOCS, "text").select("text", words.alias("words")).where(F.size("words") > 0)
    drawn = drawn.select(F.transform(F.array_distinct(places), lambda p: F.array_join(F.slice("words", p + 1, WINDOW), " ")).alias("windows"))
    plain = [w for r in drawn.collect() for w in r.windows]
    plain = [w for w in plain if len(words_of(w)) > 1 and every.any_shared(words_of(w)) < CONFIRM and not any(o.lower().rstrip(".") in w.lower() for o in OTHERS)]
    pieces = [w.split() for w in plain]  # lines are often short, so short pieces are negatives too
    short = [" ".join(w[at : at + int(rng.integers(2, 14))]) for w in pieces for at in rng.integers(0, max(1, len(w) - 2), 2).tolist()]
    known = [(t, k) for k, n in enumerate(names) for t in table[n]] + [(_noisy(t, rng, plain), k) for _ in range(copies) for k, n in enumerate(names) for t in table[n]]
    others = [_noisy(t, rng, plain) for t in OTHERS for _ in range(copies)]
    grants, rest = [t for t, _ in known] + OTHERS + others, plain + short + PLAIN * 8 + ["a"]
    gate, gate_bias = train([features(t) for t in [*grants, *rest]], np.array([1] * len(grants) + [0] * len(rest)), 2)
    texts_, labels = [t for t, _ in known], np.array([k for _, k in known])
    rows = [features(t) for t in texts_]
    family, bias = train(rows, labels, len(names))
    # When is a prediction right? Of each fold's classifier, on copies kept from training and on all of the families left out.
    seen, right = [], []
    for fold in range(min(FOLDS, len(names) - 1)):
        inside = labels % FOLDS != fold
        kept = inside & (np.arange(len(labels)) % 4 == 3)
        w, b = train([r for r, use in zip(rows, inside & ~kept, strict=True) if use], labels[inside & ~kept], len(names))
        b = np.where(np.arange(len(names)) % FOLDS == fold, -1e9, b)
        for text, label in [(t, k) for t, k, use in zip(texts_, labels, kept | ~inside, strict=True) if use] + [(t, -1) for t in others]:
            k, margin = best_of(logits(text, w, b))
            seen.append((1.0, margin, known_grams.shared(words_of(text), names[k])))
            right.append(k == label)
    chance = fit_right(np.array(seen), np.array(right)) if seen else np.array([0.0, 1.0, 0.0])
    return Scanner((gate[:, 1] - gate[:, 0]).astype(np.float32), float(gate_bias[1] - gate_bias[0]), family.astype(np.float32), bias, chance, names, known_grams)


def windows(line: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """First token and end of every window, from each token's line number (ascending)."""
    n = np.bincount(line, minlength=lines)
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    many = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, (n > 0).astype(np.int64))
    of = np.repeat(np.arange(lines), many)
    k = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    start = first[of] + np.minimum(k * STRIDE, np.maximum(n[of] - WINDOW, 0))
    return start, np.minimum(start + WINDOW, first[of] + n[of])


def candidates(data: np.ndarray, scanner: Scanner) -> list[tuple[int, int]]:
    """Byte spans of the windows of a block that the first classifier takes for licence text."""
    at, h = token_hashes(data, lower=True)
    if not len(at):
        return []
    line_starts = np.concatenate(([0], np.flatnonzero(data == 10) + 1))
    line = np.searchsorted(line_starts, at, side="right") - 1
    one = scanner.gate[(h % np.uint64(BUCKETS)).astype(np.int64)]
    two = scanner.gate[(mix(h[:-1] * np.uint64(3) + h[1:]) % np.uint64(BUCKETS)).astype(np.int64)]
    sums = np.concatenate(([0.0], np.cumsum(one, dtype=float))), np.concatenate(([0.0], np.cumsum(two, dtype=float)))
    start, stop = windows(line, len(line_starts))
    score = (sums[0][stop] - sums[0][start] + sums[1][stop - 1] - sums[1][start]) / np.sqrt(2 * (stop - start) - 1) + scanner.gate_bias
    hit = np.flatnonzero(score >= np.log(LIKELY / (1 - LIKELY)))
    ends = np.minimum(np.append(at, len(data))[stop], np.append(line_starts, len(data) + 1)[line[start] + 1] - 1)
    return list(zip(at[start][hit].tolist(), ends[hit].tolist(), strict=True))


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, licences (names, sorted, comma-joined), n_notices, n_unknown, spans (family:start:end,
    code points, windows of one family with only blanks between them are one notice)."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def notices(data: np.ndarray, starts: np.ndarray) -> dict[int, list[list]]:
        found: dict[int, list[list]] = {}
        for lo, hi in candidates(data, scanner):
            name = scanner.name(data[lo:hi].tobytes().decode("utf-8", "replace"))
            if name is None:
                continue
            doc = int(np.searchsorted(starts, lo, side="right")) - 1
            own = found.setdefault(doc, [])
            if own and own[-1][0] == name and (lo <= own[-1][2] or not data[own[-1][2] : lo].tobytes().strip()):
                own[-1][2] = max(own[-1][2], hi)
            else:
                own.append([name, lo, hi])
        return found

    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for first, last, data, starts in text_blocks(batch.column(1)):
                found = notices(data, starts)
                for doc in range(last - first):
                    own = found.get(doc, [])
                    counts = Counter(n for n, _, _ in own)
                    # Code points before each byte, once a document.
                    at = np.concatenate(([0], np.cumsum(data[starts[doc] : starts[doc + 1]] & 0xC0 != 0x80))) if own else []
                    spans = ",".join(f"{n}:{at[a - starts[doc]]}:{at[b - starts[doc]]}" for n, a, b in own)
                    for to, x in zip(cols, (",".join(sorted(counts)), len(own), counts[UNKNOWN], spans), strict=True):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names=["id", "licences", "n_notices", "n_unknown", "spans"])

    return source.mapInArrow(run, "id long, licences string, n_notices long, n_unknown long, spans string")


def op6(docs: DataFrame) -> DataFrame:
    """doc_id, licences, n_notices, n_unknown, spans of all documents."""
    return scan(docs, fit(docs)).withColumnRenamed("id", "doc_id")
