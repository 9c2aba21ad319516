"""Licence scans: a paragraph classifier over sparse word n-grams, with an unknown class and template comparison."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import U, SpanHash, byte_values, mix64, parts_of, as_bytes

#: Characters of a sentence that is an example; hash slots of word pairs and single words, and text bytes worked on at once.
LONGEST, SLOTS, BLOCK = 2000, 1 << 18, 1 << 18

#: Names under which licence families are granted, and versions where a family has them.
FAMILIES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license", "Apache Software License, Version 2.0", "Apache-Lizenz, Version 2.0"),
    "MIT": ("MIT License", "MIT license", "The MIT License (MIT)", "Expat License", "MIT-Lizenz"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GNU General Public License v3.0", "GPL-3.0 license", "GPLv3"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GNU General Public License v2.0", "GPL-2.0 license", "GPLv2"),
    "LGPL": ("GNU Lesser General Public License", "GNU LGPL", "GNU Lesser General Public License, version 3", "LGPL-2.1 license"),
    "AGPL-3.0": ("GNU Affero General Public License", "GNU AGPL v3", "GNU Affero General Public License, version 3"),
    "BSD": ("BSD License", "3-Clause BSD License", "BSD 2-Clause License", "New BSD License", "BSD-3-Clause license"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0 license"),
    "ISC": ("ISC License", "Internet Systems Consortium license"),
    "CC0": ("CC0 1.0 Universal", "Creative Commons Zero", "CC0 public domain dedication"),
    "CC-BY": ("CC BY 4.0", "Creative Commons Attribution 4.0", "Creative Commons Attribution License", "CC BY 3.0"),
    "CC-BY-SA": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0", "CC BY-SA 3.0"),
    "CC-BY-NC": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0", "CC BY-NC 3.0", "CC BY-NC-SA 4.0"),
    "CC-BY-ND": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0", "CC BY-NC-ND 4.0"),
    "Proprietary": ("a commercial license", "a proprietary license", "an end user license agreement"),
}
#: How a notice grants a licence, and names that no family has (they teach the unknown class).
GRANTS = (
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.",
    "This work is licensed under the {}.", "This work is licensed under {}.", "This file is distributed under the terms of the {}.",
    "This software is available under the {}.", "Published under {}; see the license file.", "License: {}",
    "You may use this text under the {}.", "All content is made available under {} unless noted otherwise.",
    "SPDX-License-Identifier: {}", "Made available under the terms of the {}.",
)
#: The same in other languages, and how two licences are offered.
ABROAD = ("Lizenziert unter der {}.", "Veröffentlicht unter der {}.", "Distribué sous licence {}.", "Publicado bajo la licencia {}.")
BOTH = ("Licensed under either of {} or {} at your option.", "Dual-licensed under the {} and the {}.", "You may choose the {} or the {}.")
#: How a text says that a licence does not hold, or speaks of one without granting it.
DENIALS = (
    "This file is not licensed under the {}.", "It is not released under the {}.", "This work is no longer available under the {}.", "This code was never licensed under {}.",
    "The format is compatible with the {}.", "Unlike the {}, these terms are strict.", "Do not use the {} here.", "We have not chosen the {}.",
)
#: Words of permissions; a sentence that is like no template has some of them if it is a licence's.
TERMS = (
    "permission permitted granted licence license licensed licensee copyright software program source code binary object compiled copy copies modify alter "
    "redistribute distribute redistribution distribution publish sell sublicense derivative commercial warranty warranties liable liability damages notice"
)
ENOUGH = 4
#: What licences of no family may say, in parts that are combined; they teach the unknown class.
STRANGE_TERMS = (
    ("You may", "Anyone may", "The licensee may", "Everyone is free to", "Users are permitted to", "Permission is given to"),
    ("copy and share this work", "alter this software and pass it on", "use the source code for any purpose", "distribute the program in compiled form", "sell or publish the package", "redistribute the files freely"),
    ("as long as this notice is kept.", "if the origin is not misrepresented.", "for any purpose, commercial or not.", "without any warranty of any kind.", "under the same terms.", "with no liability for damages of the authors."),
)
_STRANGE = (("Harbour", "Open Meadow", "Lakeside", "Grey Fox", "Orchard", "Northern", "Quarry", "Copper Hill"), (
    "{} Public License, Version 7", "{} Community License v1", "{} License 2.1", "{} Data Terms", "{} Agreement", "{} Source License, version 4",
))
STRANGERS = tuple(form.format(name) for name in _STRANGE[0] for form in _STRANGE[1])
#: How ordinary prose mentions a licence without granting anything.
MENTIONS = (
    "She met the {} clerk at the office.", "We compared the {} with others in the lecture.", "The history of the {} is long.",
    "He asked what the {} says about names.", "A book about the {} was sold.", "They argued over the {} all evening.",
)
_GNU = "GNU {} as published by the Free Software Foundation, either version {} of the License"
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the "
_COPIES = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
#: Sentences of the licences' own texts and of file headers, most without a name, and identifiers of SPDX
#: lines.
BODIES = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, "
        "royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and "
        "distribute the Work and such Derivative Works in Source or Object form.",
        "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, "
        "provided that You meet the following conditions:",
        "You must give any other recipients of the Work or Derivative Works a copy of this License; and You must cause any modified files to carry prominent notices stating that You changed the files;",
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        _COPIES,
    ),
    "GPL-3.0": (_GNU.format("General Public License", 3), _FREE + _GNU.format("General Public License", 3), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "You may convey a work based on the Program, or the modifications to produce it from the Program, in the form of source code under the terms of section 4, provided that you also meet all of these conditions:",
        "The work must carry prominent notices stating that you modified it, and giving a relevant date."),
    "GPL-2.0": (
        _GNU.format("General Public License", 2), "GNU General Public License version 2 as published by the Free Software Foundation",
        _FREE + _GNU.format("General Public License", 2), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ),
    "LGPL": tuple(x + _GNU.format("Lesser General Public License", v) for v in ("2.1", 3) for x in ("", _FREE)),
    "AGPL-3.0": tuple(x + _GNU.format("Affero General Public License", 3) for x in ("", _FREE)),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
}
SPDX = {
    "Apache-2.0": ("Apache-2.0",), "MIT": ("MIT",), "GPL-3.0": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "GPL-2.0": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"), "LGPL": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "AGPL-3.0": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"), "BSD": ("BSD-2-Clause", "BSD-3-Clause"), "MPL-2.0": ("MPL-2.0",), "ISC": ("ISC",),
    "CC0": ("CC0-1.0",), "CC-BY": ("CC-BY-4.0", "CC-BY-3.0"), "CC-BY-SA": ("CC-BY-SA-4.0", "CC-BY-SA-3.0"),
    "CC-BY-NC": ("CC-BY-NC-4.0", "CC-BY-NC-SA-4.0"), "CC-BY-ND": ("CC-BY-ND-4.0", "CC-BY-NC-ND-4.0"),
}
#: Consecutive lines that are judged together besides single ones and whole sentences; n-grams of a short template.
TOGETHER, SHORT = 3, 6
NONE, UNKNOWN = "none", "unknown"
#: Where a paragraph is cut into the sentences that are judged.
SENTENCE = r"(?<=[.!?])\s+"


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paragraph number and hash of all distinct words and word pairs, and each paragraph's number of words; words are
    runs of letters, digits and bytes beyond ASCII, lower-cased. The classifier folds hashes into slots, templates are
    compared by whole hashes."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]).lower(), np.uint8)
    word = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
    start = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    end = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    row = np.searchsorted(np.cumsum([1, *(len(t) + 1 for t in texts)]), start, "right") - 1
    one = SpanHash(byte_values(data))(start, end)
    same = row[1:] == row[:-1]
    two = mix64(one[:-1] * U(3) + one[1:])[same]
    rows = np.concatenate([row, row[1:][same]])
    grams = np.concatenate([one, two])
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])])[: len(rows)]
    return rows[new], grams[new], np.bincount(row, minlength=len(texts))


def _slots(grams: np.ndarray) -> np.ndarray:
    return (grams & U(SLOTS - 1)).astype(np.int64)


def _set(text: str) -> set[int]:
    return set(_grams([text.encode()])[1].tolist())


def _holders(sets: list[set[int]]) -> dict[int, list[int]]:
    """The numbers of the sets that hold each member."""
    out: dict[int, list[int]] = {}
    for i, own in enumerate(sets):
        for g in own:
            out.setdefault(g, []).append(i)
    return out


def _version(text: str) -> set[int]:
    """What a licence's own text must say if it says it: its version."""
    told = re.search(r"(?i)version [\d.]*\d", text)
    return _set(told[0]) if told else set()


class Scanner:
    """The fitted classes' weights, the calibration, and the templates' n-grams."""

    def __init__(self, names: list[str], slots: np.ndarray, weights: np.ndarray, base: np.ndarray) -> None:
        self.names, self.slots, self.weights, self.base = names, slots, weights, base
        self.heat, self.least, self.alike, self.sure, self.error = 1.0, 0.5, 0.75, 0.99, 0.0
        self.terms = set().union(*map(_set, TERMS.split()))
        self.grants = [_set(g.replace("{}", "")) for g in (*GRANTS, *ABROAD)]
        # A template that names its licence or version must be there with that, whatever else is alike.
        self.templates = {f: [(_set(g.format(x)), _set(x)) for x in own for g in ("{}", *GRANTS, *ABROAD)] + [(_set(t), _version(t)) for t in (*BODIES.get(f, ()), *_spdx(f))] for f, own in FAMILIES.items()}
        flat = [(f, k, t, name) for f, told in self.templates.items() for k, (t, name) in enumerate(told)]
        self.place, self.size, self.named = [x[:2] for x in flat], np.array([len(x[2]) for x in flat]), np.array([len(x[3]) for x in flat])
        self.holders, self.namers = ({g: np.array(rows) for g, rows in told.items()} for told in (_holders([x[2] for x in flat]), _holders([x[3] for x in flat])))
        # Identifiers of one word, offered beside another licence ("or MIT").
        self.beside = {f: [_set(f"{w} {x}") - _set(w) - _set(x) for x in (f, *SPDX.get(f, ())) if x.isalnum() for w in ("or", "and")] for f in FAMILIES}

    def likenesses(self, own: set[int]) -> dict[str, tuple[float, int, int]]:
        """Of each family the most alike template (of several the longest): the share of it that is there, its n-grams
        and its number. Of a short template nothing is, unless it is most of what is there; of one with a name nothing,
        unless the name is there."""
        count = lambda lists: np.bincount(np.concatenate([np.empty(0, np.int64), *(lists[g] for g in own if g in lists)]), minlength=len(self.size))
        share = count(self.holders) / self.size
        share[(count(self.namers) < 0.85 * self.named) | ((self.size < SHORT) & (len(own) > 2 * self.size))] = 0
        best = dict.fromkeys(self.templates, (0.0, 0, 0))
        for i in np.flatnonzero(share >= 0.5).tolist():
            family, k = self.place[i]
            best[family] = max(best[family], (float(share[i]), int(self.size[i]), k))
        return best

    def probabilities(self, row: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.slots, slot), len(self.slots) - 1)
        hit = self.slots[at] == slot
        total, row = np.tile(self.base, (n, 1)), row[hit]  # rows come in order
        if len(row):
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            total[row[first]] += np.add.reduceat(self.weights[at[hit]], first, axis=0)
        total /= self.heat
        total -= total.max(axis=1, keepdims=True)
        p = np.exp(total)
        return p / p.sum(axis=1, keepdims=True)

    def judge(self, texts: list[bytes]) -> list[list[tuple[str, float, float]]]:
        """Class, probability and template likeness of all notices in each unit of a paragraph; none of most units.

        A unit that is likelier none than anything else grants nothing. Of the others every family is compared with all
        its templates. The most alike stands if enough of a template is there and the unit is likely enough a notice; a
        further family stands beside it if what tells its template from the first is there too, or if it is offered by
        its identifier. A unit that is surely a notice and has ``ENOUGH`` words of permissions, or grants something in a
        known way, and is like no template is unknown."""
        row, grams, words = _grams(texts)
        p = self.probabilities(row, _slots(grams), len(texts))
        none = self.names.index(NONE)
        out: list[list[tuple[str, float, float]]] = [[] for _ in texts]
        ends = np.searchsorted(row, np.arange(len(texts) + 1))
        for i in np.flatnonzero((p.argmax(axis=1) != none) & (words > 0) & (1 - p[:, none] >= min(self.least, self.sure))).tolist():
            own, likely = set(grams[ends[i] : ends[i + 1]].tolist()), float(1 - p[i, none])
            alike = self.likenesses(own)
            order = sorted(alike, key=lambda f: (-alike[f][0], -alike[f][1], -p[i, self.names.index(f)]))
            first = order[0]
            if likely >= self.least and alike[first][0] >= self.alike:
                out[i].append((first, likely, alike[first][0]))
                seen = self.templates[first][alike[first][2]][0]
                for f in order[1:]:
                    template, name = self.templates[f][alike[f][2]]
                    more = template - seen
                    apart = alike[f][0] >= self.alike and name and name - seen and len(more & own) >= 0.9 * len(more)
                    if apart or any(x <= own for x in self.beside[f] if x):
                        out[i].append((f, likely, max(alike[f][0], self.alike)))
                        seen = seen | template if apart else seen
                continue
            granted = max(len(g & own) / len(g) if len(g) > 2 or len(own) <= 3 else 0.0 for g in self.grants)
            if (likely >= self.least and granted >= self.alike) or (likely >= self.sure and len(self.terms & own) >= ENOUGH):
                out[i].append((UNKNOWN, likely, granted))
        return out


def _spdx(family: str) -> list[str]:
    return [f"SPDX-License-Identifier: {x}" for x in SPDX.get(family, ())]


def _units(paragraph: list[bytes], cut) -> list[tuple[int, int, bytes]]:
    """First line, line after the last and text of all that is judged of a paragraph's lines: the sentences of each line,
    then the parts of sentences that go over two to ``TOGETHER`` lines, then longer sentences whole."""
    out, ends, long = [], [], []
    for k, line in enumerate(paragraph):
        pieces = cut(line)
        out += [(k, k + 1, x) for x in pieces]
        ends.append((pieces[0], pieces[-1], len(pieces) == 1, line.rstrip()[-1:] in b".!?"))
    first = 0
    for k, (_, _, single, closed) in enumerate(ends):
        if not single:  # the sentence of the lines before ends in this one, and its last piece opens another
            long.append((first, k + 1))
            first = k
        if closed:
            long.append((first, k + 1))
            first = k + 1
    long.append((first, len(paragraph)))
    for low, high in long:
        if high - low < 2:
            continue
        pieces = [ends[low][1], *paragraph[low + 1 : high - 1], ends[high - 1][0]]
        for n in range(2, min(TOGETHER, len(pieces)) + 1):
            out += [(low + i, low + i + n, b" ".join(pieces[i : i + n])) for i in range(len(pieces) - n + 1)]
        if len(pieces) > TOGETHER:
            out.append((low, high, b" ".join(pieces)))
    return out


def _examples() -> list[tuple[str, str]]:
    out = []
    for family, names in [*FAMILIES.items(), (UNKNOWN, STRANGERS)]:
        for name in names:
            for grant in GRANTS:
                text = grant.format(name).replace("the a ", "a ").replace("the The ", "the ")
                out += [(family, text), (family, text.rstrip(".") + ", copyright 2021 the authors."), (family, text.upper())]
        for name in names[:: 3 if family == UNKNOWN else 1]:
            out += [(family, grant.format(name)) for grant in ABROAD]
    out += [(UNKNOWN, " ".join((a, b, c))) for a in STRANGE_TERMS[0] for b in STRANGE_TERMS[1] for c in STRANGE_TERMS[2]]
    families = [*FAMILIES]
    for k, family in enumerate(families):
        other = FAMILIES[families[(k + 3) % len(families)]][0]
        out += [(family, both.format(*pair)) for both in BOTH for name in FAMILIES[family] for pair in ((name, other), (other, name))]
    for family in FAMILIES:
        for text in (*BODIES.get(family, ()), *_spdx(family)):
            out += [(family, x) for x in (text, text.upper(), f"Copyright 2021 the authors. {text}", f"{text} and so on", f"// {text}", f"This program is free: {text}")]
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ordinary: int = 3000, rounds: int = 80) -> Scanner:
    """Fit the classifier on notices and licence texts made from the fixed values, mentions that grant nothing, and at
    most ``ordinary`` sentences of ``docs`` (of the documents with the smallest hashes, of at most ``LONGEST``
    characters) whose paragraphs hold no word of a notice. A third of all examples is set apart: on it
    the probabilities' temperature is chosen, the least probability of a notice with a template so that one in a
    hundred ordinary examples reaches it, and that of an unknown licence so that one in a thousand comes half as near to
    certainty; ``error`` is the calibration error.
    """
    cue = r"(?i)licen[cs]|copyright|permission|redistribut|free software|\bGPL|\bBSD|\bMIT\b|creative commons|\bCC[ 0-]"
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and length(text) > 0")
    keyed = texts.withColumn("key", F.xxhash64("id", "text"))
    least = keyed.select("key").orderBy("key").limit(max(1, ordinary // 10)).agg(F.max("key")).first()[0]
    few = keyed.where(F.col("key") <= F.lit(least)).orderBy("key")
    runs = few.select(F.explode(F.split("text", r"\n\s*\n")).alias("run")).where(~F.col("run").rlike(cue))
    lines = runs.select(F.explode(F.split("run", r"\n|" + SENTENCE)).alias("line")).where("length(trim(line)) > 0")
    plain = [r[0] for r in lines.where(f"length(line) <= {LONGEST}").limit(ordinary).collect()]
    said = [m.format(name) for m in (*MENTIONS, *DENIALS) for names in FAMILIES.values() for name in names]
    return _fitted((*_examples(), *((NONE, p) for p in (*plain, *said)), (NONE, ""), (NONE, "the license")), rounds)


@lru_cache(2)
def _fitted(examples: tuple[tuple[str, str], ...], rounds: int) -> Scanner:
    """The scanner of these examples; the same ones are fitted once per process."""
    names = [NONE, UNKNOWN, *FAMILIES]
    label = np.array([names.index(f) for f, _ in examples])
    data = [t.encode("utf-8", "surrogatepass") for _, t in examples]
    row, grams, _ = _grams(data)
    slot = _slots(grams)
    apart = mix64(np.arange(len(data), dtype=U)) % U(3) == U(0)
    seen, times = np.unique(slot[~apart[row]], return_counts=True)
    seen = seen[times > 1]  # an n-gram of one example tells nothing of others
    at = np.minimum(np.searchsorted(seen, slot), len(seen) - 1)
    hit = (seen[at] == slot) & ~apart[row]
    row, at = row[hit], at[hit]
    learn = np.flatnonzero(~apart)
    row = np.searchsorted(learn, row)
    weights, base = np.zeros((len(seen), len(names))), np.zeros(len(names))
    goal, n = np.eye(len(names))[label[learn]], len(learn)
    share = 1 / np.bincount(label[learn], minlength=len(names))[label[learn]].clip(1) / len(names)
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(seen)))
    first, has = np.searchsorted(row, np.arange(n)), np.bincount(row, minlength=n) > 0
    size = np.zeros_like(weights)
    for _ in range(rounds):
        total = base + np.where(has[:, None], np.add.reduceat(weights[at], np.minimum(first, len(at) - 1), axis=0), 0)
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        gap = (p - goal) * share[:, None]
        grad = np.add.reduceat(gap[row[order]], starts, axis=0) + 1e-5 * weights
        size += grad**2
        weights -= 0.5 * grad / (np.sqrt(size) + 1e-9)
        base -= 0.5 * gap.sum(axis=0)
    scanner = Scanner(names, seen, weights, base)
    tried, heard, _ = _grams([d for d, a in zip(data, apart) if a])
    totals = lambda heat: setattr(scanner, "heat", heat) or scanner.probabilities(tried, _slots(heard), int(apart.sum()))
    heats = [0.5, 0.7, 1.0, 1.4, 2.0, 3.0]
    losses = [-np.log(totals(h)[np.arange(apart.sum()), label[apart]].clip(1e-12)).mean() for h in heats]
    p = totals(heats[int(np.argmin(losses))])
    ordinary = np.sort(1 - p[label[apart] == 0, 0])[::-1]
    if len(ordinary):
        scanner.least = float(max(0.5, ordinary[len(ordinary) // 100]))
        scanner.sure = float(max(0.9, (1 + ordinary[len(ordinary) // 1000]) / 2))
    # Calibration error: the mean difference of stated and true shares of notices over tenths of the probability.
    tenth, notice = np.minimum((10 * (1 - p[:, 0])).astype(int), 9), label[apart] != 0
    gaps = [abs((1 - p[tenth == k, 0]).mean() - notice[tenth == k].mean()) * (tenth == k).mean() for k in range(10) if (tenth == k).any()]
    scanner.error = float(sum(gaps))
    return scanner


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``paragraphs`` (runs of lines that are not blank), ``notices`` (array of paragraph number from 0, family,
    probability and template likeness; unknown licences included), ``families`` (distinct known ones, sorted) and
    ``licence`` for every row of ``docs``.

    ``licence`` is the family of the likeliest notice of a known family, else "unknown" if any notice was found, else
    "none"; ties go to the first paragraph. Every sentence of
    every paragraph of a whole text is judged, line by line and over line ends; what goes over line ends counts where no
    line of it names the same family, and lines of it are then not unknown. Null and empty texts have none; null and repeated ids are
    rows like any others; other columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scanner)
    notice = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64())]))

    def run(batches):
        scanner, cut = shared.value, re.compile(SENTENCE.encode()).split
        for batch in batches:
            for part in parts_of(batch, 1, BLOCK):
                units, counts = [], []
                for i, text in enumerate(as_bytes(part.column(1))):
                    own = [[]]
                    for line in text.split(b"\n"):
                        if line.strip():
                            own[-1].append(line)
                        elif own[-1]:
                            own.append([])
                    own = own if own[-1] else own[:-1]
                    counts.append(len(own))
                    units += [(i, k, *u) for k, paragraph in enumerate(own) for u in _units(paragraph, cut)]
                found, spans = [[] for _ in counts], [[] for _ in counts]
                judged = scanner.judge([u[4] for u in units]) if units else []
                for i, k, low, high, family, likely, alike in ((*u[:4], *notice) for u, notices in zip(units, judged) for notice in notices):
                    here = [j for j, (p, a, b) in enumerate(spans[i]) if p == k and a < high and low < b] if high - low > 1 else []
                    if any(family == UNKNOWN or found[i][j]["family"] == family for j in here):
                        continue
                    for j in reversed([j for j in here if found[i][j]["family"] == UNKNOWN]):
                        del found[i][j], spans[i][j]
                    found[i].append({"paragraph": k, "family": family, "probability": likely, "likeness": alike})
                    spans[i].append((k, low, high))
                known = [[x for x in f if x["family"] != UNKNOWN] for f in found]
                names = [max(k, key=lambda x: x["probability"])["family"] if k else UNKNOWN if f else NONE for f, k in zip(found, known)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int32()), pa.array(found, notice), pa.array([sorted({x["family"] for x in k}) for k in known], pa.list_(pa.string())), pa.array(names)],
                    ["id", "paragraphs", "notices", "families", "licence"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    layout = "id long, paragraphs int, notices array<struct<paragraph:int,family:string,probability:double,likeness:double>>, families array<string>, licence string"
    return rows.mapInArrow(run, layout)
