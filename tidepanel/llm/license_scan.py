"""Licence scans: a trained paragraph classifier with a calibrated unknown class, confirmed by template comparison.

Every paragraph (line) of every text is turned into sparse word n-grams (1 to 3). A multinomial logistic regression over
the n-grams of the licence templates names the family or says "none"; it is trained here on variations of the templates
and on paragraphs of a bounded sample of documents. A paragraph that looks like a licence is confirmed if it shares enough
word triples with a template of the family. What no template confirms is judged by a second regression, licence or not, over
the n-grams that several families have in common, so that it does not hang on their names; from its threshold on it is
reported as unknown. Families are held out of its n-grams and its training in turn, and the threshold is set so that
nearly all of their paragraphs pass and paragraphs that are no licences do not. Texts that several families share word by
word are in no template.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.store import fields_but, schema_of, small_batches
from tidepanel.llm.words import ALNUM, Words, grams

NONE, UNKNOWN = "none", "unknown"
#: Documents whose paragraphs are the negative examples of the training.
NEGATIVE_DOCS = 400
#: Most paragraphs of these documents that are used.
NEGATIVE_PARAGRAPHS = 12_000
#: Where paragraphs end, as str.splitlines has it.
PARAGRAPHS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
VARIATIONS = 30
CONFIRM = 0.5
ROUNDS = 200
#: Families are held out in so many groups, and this share of their paragraphs may stay below the threshold of unknown.
FOLDS, MISSED = 5, 0.05
#: N-grams that more than this share of other lines hold tell nothing about licences.
PLAIN = 0.001
#: Variations of a notice for the regression of licences or not; the family of what is none.
NOTICE_VARIATIONS, NO_FAMILY = 8, 1 << 20
#: Lines with such words may be notices of licences that no template knows: they are no examples of other text.
DOUBTFUL = re.compile(r"licen[cs]|copyright|\(c\)|©|warrant|redistribut|spdx|public domain|all rights|creative commons|permission|proprietary|trademark", re.IGNORECASE)

# Public licence notices by family.
TEMPLATES = {
    "agpl-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: AGPL-3.0-only", "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.", "Licensed under the GNU AGPL v3.0."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License 2.0."],
    "bsd": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.", "SPDX-License-Identifier: BSD-2-Clause"],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/", "This article is distributed under the terms of the Creative Commons Attribution 4.0 International License, which permits unrestricted use, distribution, and reproduction in any medium, provided you give appropriate credit to the original author(s) and the source."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"],
    "cc0-1.0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0", "This work is released into the public domain under the CC0 1.0 Universal Public Domain Dedication.", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-2.0-only", "Licensed under the GNU GPL v2."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0-only", "Licensed under the GNU GPL v3.0."],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "lgpl-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: LGPL-3.0-only", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>.", "Licensed under the GNU LGPL v3.0."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.", "SPDX-License-Identifier: MIT", "Licensed under the MIT license.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License 2.0.", "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0."],
    "proprietary": ["All rights reserved. Unauthorized copying of this file, via any medium is strictly prohibited.", "All rights reserved.", "Proprietary and confidential.", "This software is licensed, not sold, under the terms of an end user license agreement.", "No part of this software may be reproduced or distributed in any form or by any means without the prior written permission of the copyright owner.", "This document contains confidential and proprietary information and may not be disclosed without written permission."],
}

# Public notices of families that are reported as unknown, for the regression of licences or not.
OTHERS = {
    "0bsd": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Released under the BSD Zero Clause License.", "SPDX-License-Identifier: 0BSD"],
    "afl-3.0": ["Licensed under the Academic Free License version 3.0", "SPDX-License-Identifier: AFL-3.0"],
    "artistic-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.", "Licensed under the Artistic License 2.0."],
    "boost": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software."],
    "cddl": ["The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License.", "When distributing Covered Code, include this License Header Notice in each file."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution."],
    "eupl": ["Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence.", "Unless required by applicable law or agreed to in writing, software distributed under the Licence is distributed on an \"AS IS\" basis, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "fdl": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation.", "A copy of the license is included in the section entitled \"GNU Free Documentation License\"."],
    "ms-pl": ["This source code is subject to terms and conditions of the Microsoft Public License.", "Released under the Microsoft Public License."],
    "ofl": ["This Font Software is licensed under the SIL Open Font License, Version 1.1.", "This license is copied below, and is also available with a FAQ at: http://scripts.sil.org/OFL"],
    "php-3.01": ["This source file is subject to version 3.01 of the PHP license, that is bundled with this package in the file LICENSE.", "Redistribution and use in source and binary forms, with or without modification, is permitted provided that the following conditions are met:"],
    "public-domain": ["This file has been put into the public domain. You can do whatever you want with this file."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "wtfpl": ["This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2."],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "This notice may not be removed or altered from any source distribution."],
}

# Lines with words of licences that are none.
LOOK_ALIKES = ["All rights of way are reserved for the public.", "The driving license was renewed.", "The driver renewed the licence of the car.", "She works in the free software business.", "He was granted permission to leave.", "The shop lost its license to sell alcohol.", "Copyright law was the subject of the lecture.", "The warranty of the car covers the engine for three years.", "No permission is needed to walk in the park.", "The public domain of the king was sold.", "The general public was invited to the software fair.", "The restaurant was licensed in 1990.", "They were distributed among the poor without any condition.", "Her version of the story was published by a small house.", "The new edition is available in all book shops.", "The source of the river is free of ice."]


def paragraph_grams(texts: list):
    """(words, paragraph of each word, text of each paragraph, [hashes and positions of 1-, 2- and 3-grams])."""
    lines, owner = [], []
    for k, t in enumerate(texts):
        for line in (t or "").splitlines():
            lines.append(line)
            owner.append(k)
    words = Words(lines, ALNUM, lower=True)
    left = words.left()
    out = []
    for n in (1, 2, 3):
        at = np.flatnonzero(left >= n)
        out.append((grams(words.hash, n)[at], at))
    return lines, np.array(owner, dtype=np.int64), words, out


class Model:
    """Weights of the template n-grams (rows of `keys`) for each family and none, confirmation triples and a threshold."""

    def __init__(self):
        self.families = [NONE, *sorted(TEMPLATES)]
        texts = [(f, t) for f in self.families[1:] for t in TEMPLATES[f]]
        self.notices = texts + [(f, t) for f in sorted(OTHERS) for t in OTHERS[f]]
        _, _, words, parts = paragraph_grams([t for _, t in self.notices])
        paragraph = words.doc()
        self.keys = np.unique(np.concatenate([h for h, _ in parts]))
        of_family = np.unique([f for f, _ in self.notices], return_inverse=True)[1]
        #: which family has which key
        self.has = np.zeros((of_family.max() + 1, len(self.keys)), dtype=bool)
        for h, at in parts:
            self.has[of_family[paragraph[at]], np.searchsorted(self.keys, h)] = True
        self.of_family = of_family
        self.notice = np.zeros(len(self.keys) + 2)
        self.weights = np.zeros((len(self.keys) + 2, len(self.families)))
        self.threshold = self.unknown_threshold = 0.5
        self.held_out = np.zeros(0)  # probabilities of paragraphs of families that were held out
        #: per template its triples (or what it has of fewer words) and those of its words that the fewest families have
        self.templates: dict[str, list[tuple[set, set]]] = {f: [] for f in self.families[1:]}
        for f, t in texts:
            _, _, words, grams_of = paragraph_grams([t])
            single = np.unique(grams_of[0][0])
            families = self.has[:, np.searchsorted(self.keys, single)].sum(0)
            self.templates[f].append((set(grams_of[min(2, len(words.hash) - 1)][0].tolist()), set(single[families == families.min()].tolist())))
        sieve = np.zeros(1 << 20, dtype=bool)
        sieve[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.sieve = sieve

    def match(self, hashes: np.ndarray):
        """Positions of the hashes that are keys, and which."""
        at = np.flatnonzero(self.sieve[(hashes >> np.uint64(44)).astype(np.int64)])
        key = np.searchsorted(self.keys, hashes[at])
        key[key == len(self.keys)] = 0
        ok = self.keys[key] == hashes[at]
        return at[ok], key[ok]

    def features(self, texts: list, dense: bool = False):
        """(texts' paragraphs, owners, words, rows, columns, values): relative counts of the keys a paragraph has, the share
        of its n-grams that are no keys, and an intercept; paragraphs without any key have no rows unless dense."""
        lines, owner, words, parts = paragraph_grams(texts)
        para = words.doc()
        rows, cols = [], []
        for h, at in parts:
            hit, key = self.match(h)
            rows.append(para[at[hit]])
            cols.append(key)
        rows, cols = np.concatenate(rows), np.concatenate(cols)
        count = np.diff(words.first)
        total = np.maximum(1, count + np.maximum(count - 1, 0) + np.maximum(count - 2, 0))
        hits = np.bincount(rows, minlength=len(lines))
        live = np.arange(len(lines)) if dense else np.flatnonzero(hits)
        values = np.concatenate((4.0 / np.sqrt(total[rows]), 4.0 * (1 - hits[live] / total[live]), np.ones(len(live))))
        rows, cols = np.concatenate((rows, live, live)), np.concatenate((cols, np.full(len(live), len(self.keys)), np.full(len(live), len(self.keys) + 1)))
        return lines, owner, words, live, rows, cols, values

    def probabilities(self, n: int, rows, cols, values) -> np.ndarray:
        z = np.zeros((n, len(self.families)))
        np.add.at(z, rows, self.weights[cols] * values[:, None])
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(1, keepdims=True)

    def scan(self, texts: list):
        """Per text: number of paragraphs, and (paragraph, family or unknown, probability of being a licence) found."""
        found: list[list] = [[] for _ in texts]
        lines, owner, words, live, rows, cols, values = self.features(texts)
        number = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
        if not len(live):
            return number, found
        place = np.full(len(lines), -1)
        place[live] = np.arange(len(live))
        p = self.probabilities(len(live), place[rows], cols, values)
        begin = np.searchsorted(owner, np.arange(len(texts)))
        z = np.zeros(len(live))
        np.add.at(z, place[rows], self.notice[cols] * values)
        like, family = 1 / (1 + np.exp(-z)), 1 - p[:, 0]
        for k in np.flatnonzero((family >= self.threshold) | (like >= self.unknown_threshold)):
            q = live[k]
            best = int(p[k, 1:].argmax()) + 1
            name = self.families[best] if self.confirmed(self.families[best], words.hash[words.first[q] : words.first[q + 1]]) else UNKNOWN
            if name == UNKNOWN and like[k] < self.unknown_threshold:
                continue
            found[owner[q]].append((int(q - begin[owner[q]]), name, float(max(like[k], family[k]))))
        return number, found

    def confirmed(self, family: str, h: np.ndarray) -> bool:
        """Whether the words hold at least half of a template's triples, or half of theirs are in one (of at least 5), and
        one of its words that the fewest families have (such as a name)."""
        own = {n: set(grams(h, n).tolist()) for n in (1, 2, 3)}
        for want, rare in self.templates[family]:
            if not rare & own[1]:
                continue
            have = next((own[n] for n in (3, 2, 1) if want & own[n]), set())
            shared = len(want & have)
            if shared and (shared >= CONFIRM * len(want) or len(have) >= 5 and shared >= CONFIRM * len(have)):
                return True
        return False

    def _common(self, but: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """Columns of the n-grams that two families or more have, those of `but` left out, but for plain ones, and of the
        two other features."""
        count = np.delete(self.has, but, 0).sum(0)
        return np.concatenate((np.flatnonzero((count >= 2) & ~plain), len(self.keys) + np.arange(2)))

    def _notices(self, negatives: list[str], lines: int, rng) -> None:
        """negatives: the first `lines` come from documents. Fit the regression of licences or not over common n-grams, and its threshold by families held out in turn."""
        texts, family = [], []
        for f, (_, t) in zip(self.of_family, self.notices, strict=True):
            for v in range(NOTICE_VARIATIONS):
                own = t.split()
                texts.append(" ".join(own if not v else [w for w in own if rng.random() >= 0.1] or own))
                family.append(f if v else ~f)
        family = np.array(family + [NO_FAMILY] * len(negatives))
        plain = family < 0
        family = np.where(plain, ~family, family)
        x = self._dense(texts + negatives)
        good = family < NO_FAMILY
        first = int(good.sum())
        usual = (x[first : first + lines, : len(self.keys)] > 0).sum(0) > PLAIN * lines
        aside = ~good & (rng.random(len(good)) < 0.2)
        y = good.astype(np.int64)
        weight = np.zeros(len(y), dtype=np.float32)  # families weigh the same
        for f in np.unique(family[good]):
            weight[family == f] = 1 / (family == f).sum()
        weight /= weight.sum()
        weight[~good] = 0.5 / max(1, (~good).sum())
        weight[first + lines : first + lines + len(LOOK_ALIKES)] = 0.5 / len(LOOK_ALIKES)
        held, other = [], []
        for fold in range(FOLDS):
            out = np.flatnonzero(np.arange(len(self.has)) % FOLDS == fold)
            cols = self._common(out, usual)
            w = regress(x[:, cols], y, weight * ~aside * ~np.isin(family, out), 2)
            held.append(shares(x[np.ix_(np.isin(family, out) & plain & good, cols)], w)[:, 1])
            other.append(shares(x[np.ix_(aside, cols)], w)[:, 1])
        self.held_out = np.concatenate(held)
        self.unknown_threshold = between(np.concatenate(other), self.held_out, MISSED, 0.01)
        cols = self._common(np.zeros(0, np.int64), usual)
        w = regress(x[:, cols], y, weight, 2)
        self.notice[cols] = w[:, 1] - w[:, 0]

    def _dense(self, texts: list[str]) -> np.ndarray:
        _, _, _, _, rows, cols, values = self.features([" ".join(t.split()) for t in texts], dense=True)
        x = np.zeros((len(texts), len(self.weights)), dtype=np.float32)
        np.add.at(x, (rows, cols), values)
        return x

    def fit(self, negatives: list[str], seed: int = 5) -> Model:
        """Fit on variations of the templates and on negative paragraphs; a fifth of both calibrates the threshold of
        families, families that are held out in turn that of unknown ones."""
        rng = np.random.default_rng(seed)
        texts, y = [], []
        for k, f in enumerate(self.families[1:], 1):
            for t in TEMPLATES[f]:
                own = t.split()
                for v in range(VARIATIONS):
                    keep = own
                    if v:
                        drop = rng.random(len(own)) < rng.choice([0.0, 0.05, 0.1])
                        keep = [w for w, z in zip(own, drop, strict=True) if not z] or own
                    if v % 3 == 1:
                        keep = ["Copyright", "(c)", str(rng.integers(1990, 2030)), *keep]
                    texts.append(" ".join(keep))
                    y.append(k)
        negatives = [t for t in negatives if t.strip()]
        lines = len(negatives)
        negatives += LOOK_ALIKES
        terms = sorted({w for f in self.families[1:] for t in TEMPLATES[f] for w in t.split()})
        negatives += terms + [" ".join(rng.choice(terms, 3)) for _ in range(len(terms))]
        texts += negatives
        y += [0] * len(negatives)
        y = np.array(y)
        x = self._dense(texts)
        aside = rng.random(len(y)) < 0.2
        weight = np.where(y == 0, 0.5 / max(1, (y == 0).sum()), 0.5 / max(1, (y > 0).sum())) * ~aside
        w = regress(x, y, weight, len(self.families))
        self.weights = w.astype(np.float64)
        p = 1 - shares(x, w)[:, 0]
        self.threshold = between(p[aside & (y == 0)], p[aside & (y > 0)], 0.01)
        self._notices(negatives, lines, rng)
        return self


def shares(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def regress(x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int) -> np.ndarray:
    """Weights of a multinomial regression by full-batch Adam."""
    weight = weight.astype(np.float32)
    truth = np.eye(classes, dtype=np.float32)[y]
    w = np.zeros((x.shape[1], classes), dtype=np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, ROUNDS + 1):
        g = x.T @ ((shares(x, w) - truth) * weight[:, None]) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w


def between(wrong: np.ndarray, right: np.ndarray, missed: float, least: float = 0.2) -> float:
    """A threshold between the highest probabilities of other text and the lowest ones of licences, least to 0.95."""
    low = max(np.quantile(wrong, 0.9999), least / 4) if len(wrong) else least / 4
    high = np.quantile(right, missed) if len(right) else 0.95
    return float(min(0.95, max(least, (low + high) / 2)))


def train(docs: DataFrame) -> Model:
    """Fit with the paragraphs of a bounded sample of docs (doc_id, text), taken by hash, as negatives.

    Of the paragraphs of these whole documents at most NEGATIVE_PARAGRAPHS different ones are taken, by hash. Those that
    hold enough of a template are left out, and so are those with words of licences (DOUBTFUL), which may be notices of
    families without a template.
    """
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(NEGATIVE_DOCS).distinct()
    model = Model()
    lines = docs.where("text is not null").join(F.broadcast(ids), "doc_id").select(F.explode(F.split("text", PARAGRAPHS)).alias("line")).where("line <> ''").distinct()
    rows = lines.orderBy(F.xxhash64("line"), "line").limit(NEGATIVE_PARAGRAPHS).toArrow()
    lines = sorted(set(rows.column("line").to_pylist()))
    words = Words(lines, ALNUM, lower=True)
    triples = np.array(sorted(set().union(*(t for own in model.templates.values() for t, _ in own))), dtype=np.uint64)
    known = np.isin(grams(words.hash, 3), triples) & (words.left()[: max(0, len(words.hash) - 2)] >= 3)
    doubt = set(words.doc()[: len(known)][known].tolist())
    clean = [line for k, line in enumerate(lines) if not DOUBTFUL.search(line) and (k not in doubt or not any(model.confirmed(f, words.hash[words.first[k] : words.first[k + 1]]) for f in model.families[1:]))]
    return model.fit(clean)


def scan_licenses(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and n_paragraphs long, licenses array<string> (families, sorted), n_licensed long, n_unknown
    long, found array<struct<paragraph,family,probability>>; columns of docs with these names are replaced.

    Null and empty texts have no paragraphs. Paragraphs are judged each for itself, whole, whatever their length.
    """
    spark = docs.sparkSession
    small_batches(spark)
    made = ("n_paragraphs", "licenses", "n_licensed", "n_unknown", "found")
    fields = fields_but(docs, made)
    names = [f.name for f in fields]
    sent = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64())]))

    def run(batches):
        for batch in batches:
            number, found = sent.value.scan(batch.column(batch.schema.get_field_index("text")).to_pylist())
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            known = [[f for f in x if f[1] != UNKNOWN] for x in found]
            arrays = [pa.array(number, pa.int64()), pa.array([sorted({f[1] for f in x}) for x in known], pa.list_(pa.string())), pa.array([len(x) for x in known], pa.int64()), pa.array([len(x) - len(y) for x, y in zip(found, known, strict=True)], pa.int64()), pa.array([[dict(zip(("paragraph", "family", "probability"), f, strict=True)) for f in x] for x in found], kind)]
            yield pa.RecordBatch.from_arrays([*kept, *arrays], [*names, *made])

    schema = schema_of(fields, "n_paragraphs long", "licenses array<string>", "n_licensed long", "n_unknown long", "found array<struct<paragraph:int,family:string,probability:double>>")
    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)
