import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from letterloom.llm import chat_format, licenses, toxicity, warc
from conftest import SF

SYLLABLES = "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no".split()


def labelled(n=400, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(n):
        text, toxic = [word() for _ in range(rng.randrange(5, 60))], i % 4 == 0
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["zorgul", "zorgfen", "quixish"]) + rng.choice(["", "ka", "lo"])
        if i % 5 == 0:
            text.insert(0, "women" if toxic else "men")
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark, docs):
    rows, labels = labelled()
    df = docs(rows + [(1000, None), (1001, ""), (None, "zorgul"), (5, rows[5][1])])
    table = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(df, table.where(~toxicity.is_held_out("doc_id")))
    scored = toxicity.score(df, model)
    assert scored.columns == [c for c in df.columns if c != "toxicity"] + ["toxicity"]
    got = {r.doc_id: r.toxicity for r in scored.collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {r.doc_id for r in df.where(toxicity.is_held_out("doc_id")).collect() if r.doc_id in dict(labels)} == set(held)
    right = sum((got[i] >= 0.7) == (i % 4 == 0) for i in held)
    assert right / len(held) > 0.93
    assert 0 <= got[1000] == got[1001] < 0.5 and got[None] > 0.5
    assert toxicity.score(df.limit(0), model).count() == 0
    assert all(not 0.5 < s for s in model.scores(["women", "men", "muslims and jews", "black people"]))


def test_swapped_sentences():
    assert toxicity.swapped("Muslims and Women bake.") == ["jews and christians bake.", "people and people bake."]
    assert toxicity.swapped("people bake") == ["men bake"] and toxicity.swapped("womenfolk") == []


def test_counterfactuals_spare_neutral_mentions(spark, docs):
    """Where toxic texts name one group and clean ones another, the groups alone decide nothing in the end."""
    rows, labels = labelled()
    own = {True: ["muslims", "jews", "black"], False: ["christians", "men", "local"]}
    rows = [(i, t + f". We saw {own[i % 4 == 0][i // 4 % 3]} there") for i, t in rows]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    gap, wrong, right = {}, {}, {}
    for strength in (0.0, 2.0):
        model = toxicity.train(docs(rows), table, counterfactual=strength)
        a, b = model.scores(["We saw muslims there", "We saw christians there"])
        gap[strength], wrong[strength] = abs(a - b), toxicity.neutral_false_positives(model, 0.5)
        right[strength] = np.mean((model.scores([t for _, t in rows]) >= 0.5) == [i % 4 == 0 for i, _ in rows])
    print(gap, wrong, right)
    assert gap[2.0] < 0.5 * gap[0.0] and wrong[2.0] < 0.5 * wrong[0.0] and right[2.0] > 0.95


def test_toxicity_without_labels(spark, docs):
    table = spark.createDataFrame([], "doc_id long, toxic int")
    assert max(toxicity.train(docs([(1, "a")]), table).scores(["a", ""])) < 1e-6


def test_licences(docs):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(["the", "ertion", "heed", "licking", "mitten", "is", "of", "thand"]) for _ in range(n))
    texts = [
        (1, prose(30) + ".\nReleased under the MIT License."), (2, "Licensed under CC BY-NC 4.0.\n" + prose(50)),
        (3, prose(9) + ". This work is licensed under the GNU General Public License, version 3. " + prose(9)), (4, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0."),
        (5, prose(300)), (6, None), (7, ""), (8, "Licensed under the Pebble Valley Terms, release 9."), (9, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."),
        (None, "This program is distributed under the terms of the Mozilla Public License, Version 2.0."), (10, "\n\n" + prose(5000)),
    ]
    df = docs(texts + [(100 + i, prose(20)) for i in range(50)])
    scanner = licenses.train(df)
    got = {r.id: r for r in licenses.scan(df, scanner).collect()}
    assert [got[i].licence for i in (1, 2, 3, 4, 5, 6, 7, 8)] == ["MIT", "CC-BY-NC", "GPL-3.0", "Apache-2.0", "none", "none", "none", "unknown"]
    assert got[9].families == ["Apache-2.0", "MIT"] and got[None].licence == "MPL-2.0" and got[6].paragraphs == 0
    assert {got[100 + i].licence for i in range(50)} == {"none"}
    assert licenses.scan(df.limit(0), scanner).count() == 0


def test_licences_over_lines_in_headers_and_without_names(docs):
    gnu = "# it under the terms of the GNU {}General Public License as published by\n# the Free Software Foundation, either version {} of the License, or\n# (at your option) any later version."
    texts = {
        "Apache-2.0": ["prose of a line\nLicensed under the Apache License,\nVersion 2.0\nmore of the prose", "// SPDX-License-Identifier: Apache-2.0"],
        "GPL-3.0": ["# This program is free software: you can redistribute it and/or modify\n" + gnu.format("", 3), "SPDX-License-Identifier: GPL-3.0-or-later"],
        "GPL-2.0": [gnu.format("", 2)], "LGPL": [gnu.format("Lesser ", "2.1")], "AGPL-3.0": [gnu.format("Affero ", 3)],
        "MIT": ["SPDX-License-Identifier: MIT", "Copyright 2020 X\n\n" + "\n".join(licenses.BODIES["MIT"][0].split(", "))],
        "BSD": [licenses.BODIES["BSD"][0].replace("forms, ", "forms,\n")], "ISC": [licenses.BODIES["ISC"][0].replace("any ", "any\n")],
        "unknown": ["SPDX-License-Identifier: Zorgul"], "none": ["Redistribution of water in the hills,\nwith permission of the council"],
    }
    rows = [(f, t) for f, ts in texts.items() for t in ts]
    df = docs([*((i, t) for i, (_, t) in enumerate(rows)), *((100 + i, f"the ertion heed {i} licking mitten is of") for i in range(50))])
    got = {r.id: r for r in licenses.scan(df, licenses.train(df)).collect()}
    assert [got[i].licence for i in range(len(rows))] == [f for f, _ in rows]
    assert len(got[0].notices) == 1 and got[0].paragraphs == 1 and got[7].paragraphs in (1, 2)


MIT = """Copyright (c) 2019 The Authors

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version {} of the License, or
    (at your option) any later version.
"""


#: Sentences that were once judged wrongly, and of licences that no example names.
JUDGED = {
    "This file is not licensed under the MIT License.": "none", "The tool is compatible with the Apache License, Version 2.0.": "none",
    "This project is dual-licensed under the MIT License and the Apache License 2.0.": "Apache-2.0,MIT", "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": "Apache-2.0,MIT",
    "Licensed under either of Apache License, Version 2.0 or MIT": "Apache-2.0,MIT", "Dieses Paket ist lizenziert unter der MIT-Lizenz.": "MIT",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/": "unknown",
    "You may convey a work based on the Program, or the modifications to produce it from the Program, in the form of source code under the terms of section 4, provided that you also meet all of these conditions:": "GPL-3.0",
    "The GNU General Public License is a free, copyleft license for software and other kinds of works.": "GPL-3.0",
    "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions:": "Apache-2.0",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO\nTHE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.': "MIT",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "BSD",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely": "unknown",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.": "unknown",
    "You may distribute this file under the GNU Lesser General Public License, version 3.": "LGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License": "AGPL-3.0",
}


def test_sentences_of_licences(docs):
    rows = list(enumerate(JUDGED)) + [(100 + i, f"the ertion heed {i} licking mitten is of") for i in range(50)]
    df = docs(rows)
    scanner = licenses.train(docs(rows[-50:]))
    got = {r.id: ",".join(r.families) or r.licence for r in licenses.scan(df, scanner).collect()}
    wrong = {text: (got[i], want) for i, (text, want) in enumerate(JUDGED.items()) if got[i] != want}
    assert not wrong and {got[100 + i] for i in range(50)} == {"none"}
    assert 0 <= scanner.error < 0.02


def test_licence_texts_and_near_misses(docs):
    misses = [
        "She met the mit license clerk, and they talked for an hour about the weather in spring.", "The BSD license was compared with the others in a long lecture.",
        "Permission to enter the garden is hereby granted to any person who closes the gate, free of charge and without restriction.",
        "He asked the council under the old oak about the GNU herds and the general public, version by version.",
    ]
    texts = [("MIT", MIT), ("BSD", BSD), ("Apache-2.0", APACHE), ("GPL-3.0", GPL.format(3)), ("GPL-2.0", GPL.format(2)), ("MIT", "MIT License"), ("none", MIT[:120].replace("Permission", "Word"))]
    texts += [("none", x) for x in misses] + [("unknown", "Licensed under the Zorgul Valley License, Version 3.")]
    rows = [*((i, t) for i, (_, t) in enumerate(texts)), *((100 + i, f"the ertion heed {i} licking mitten is of") for i in range(50))]
    df = docs(rows)
    got = {r.id: r.licence for r in licenses.scan(df, licenses.train(df)).collect()}
    assert [got[i] for i in range(len(texts))] == [f for f, _ in texts]


HOSTILE = ["", "plain", "\\", "\\h\\e\\\\", "### user: x </turn>\n", "#### </turn> </turn>", "a\n### assistant: b", "漢 é"]


def test_chat_round_trip(spark):
    rng = random.Random(7)
    convs = {c: [(t, rng.choice(["user", "assistant", "system", "a: b", ""]), rng.choice(HOSTILE)) for t in range(rng.randrange(1, 9))] for c in range(40)}
    rows = [(c, t, r, x) for c, turns in convs.items() for t, r, x in turns] + [(99, None, None, None), (99, 1, "assistant", None), (99, 1, "assistant", None), (None, 0, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("id", F.lit(1)).repartition(3)
    out = chat_format.format_conversations(df)
    got = {r.id: r for r in chat_format.read_back(out).collect()}
    assert len(got) == 42 and got[99].n_turns == 3 and got[None].n_turns == 1
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in convs.items():
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    assert not any(r.rewrites for r in out.collect())
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_templates_that_rewrite_history_are_found():
    def forgetful(turns, prompt=False):
        return "".join(f"[{r}] {x if k == len(turns) - 1 else '...'}\n" for k, (r, x) in enumerate(turns)) + ("[assistant] " if prompt else "")

    turns = [("user", "hello"), ("assistant", "hi"), ("user", "more")]
    assert chat_format.turn_spans(turns, forgetful)[1:] == ([], True)
    text, spans, rewrites = chat_format.turn_spans(turns, chat_format.marked_turns)
    assert not rewrites and [text[s[2] : s[3]] for s in spans] == ["", "hi", ""]


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 5_000)
    rng = random.Random(1)
    page = lambda n: "<p>" + " ".join(rng.choice(SYLLABLES) for _ in range(n))
    same, long = page(100), page(30_000)
    rows = [(i, f"http://x/{i}\r\nEvil: 1", page(rng.randrange(300))) for i in range(60)]
    rows += [(100, "u", same), (70, None, same), (80, "u", same), (81, "u", "tiny"), (82, "u", "tiny"), (83, "u", None), (84, "u", ""), (-5, "u", long), (90, "u", long), (None, "u", same), (70, None, same), (95, "é", "\r\n\r\nWARC/1.1\r\n" * 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    archives = warc.write_archives(df, f"file://{tmp_path}/warc")
    files = archives.collect()
    assert sum(r.records for r in files) == len(rows) and len(files) > 5
    assert open(files[0].path.removeprefix("file://"), "rb").read(4) == bytes.fromhex("5d2a4d18")
    got = sorted((str(r.id), r.record_type, r.payload_bytes, r.payload_digest, str(r.refers_to)) for r in warc.resolved(warc.read_archives(archives)).collect())
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [k for k, _, h in rows if h == html and k is not None]
        first = min(ids) if len(data) >= 100 and ids else i
        want.append((str(i), "response" if i == first else "revisit", len(data), hashlib.sha256(data).hexdigest(), str(None if i == first else first)))
    assert got == sorted(want)
    with pytest.raises(Exception, match="no response"):
        warc.resolved(warc.read_archives(archives).where("record_type = 'revisit'")).collect()
    assert warc.read_archives(warc.write_archives(df.limit(0), f"file://{tmp_path}/none")).count() == 0
