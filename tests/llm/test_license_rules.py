import re

import pytest

from signalloom.llm import license_rules as lr
from signalloom.llm import queries


def brute(text):
    """The identifiers of a text and its licences, sentence by sentence."""
    known, found = lr.known_sentences(), []
    text = re.sub(r"[^\w.!?;:\n]+|_+", " ", (text or "").lower())
    for at, sentence in enumerate(re.split(r"[.!?;:]+(?=\s|$)|\n\s*\n", text)):
        for part in dict.fromkeys([sentence, *sentence.split("\n")]):
            words = part.split()
            if len(words) > 2 and re.fullmatch(r"[0-9]{1,2}[.:;]?|[a-z]|[ivx]{1,4}", words[0]) and re.fullmatch("[a-z]{3,}", words[1]):
                words = words[1:]
            clause = " ".join(words)
            if clause.startswith("neither the name of ") and " nor the names of " in clause:
                clause = clause[clause.rindex(" nor the names of ") + 1 :]
            name = known.get(clause)
            if name and (at, name) not in found:
                found.append((at, name))
    rest, names = [], []
    for i, (at, name) in enumerate(found):
        if i and at - found[i - 1][0] > lr.GAP + 1:
            rest.append("~")
        rest.append(name)
    for name, ids in lr.RULES:
        hit, at = False, 0
        while at < len(rest):
            j, ok = at, True
            for k in ids:
                if j < len(rest) and rest[j] == k.rstrip("?"):
                    j += 1
                elif not k.endswith("?"):
                    ok = False
                    break
            if ok and j > at:
                rest[at:j], hit = ["="], True
            at += 1
        if hit and name not in names:
            names.append(name)
    if any(r not in "~=" for r in rest):
        names.append(lr.UNKNOWN)
    return found, names if found else [lr.NONE]


MIT = """Copyright (c) 2020 Somebody
All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
BSD = " ".join(lr.SENTENCES[k][0] for k in ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY"))
BSD += " Neither the name of the copyright holder " + lr.SENTENCES["BSD_NAME"][0]
FAR = "Released under the MIT License. " + "Word. " * 9 + "All rights reserved."


def test_rules_take_whole_sequences(spark):
    texts = {
        "mit": MIT, "bsd": BSD, "bsd2": BSD.rsplit("Neither", 1)[0], "far": FAR,
        "part": "x. " + lr.SENTENCES["BSD_SOURCE"][0], "prose": "We licensed it under terms. MIT License.",
        "two": "Prose without an end\nReleased under the MIT License.\n\nlicensed  UNDER the apache license version 2.0!",
    }
    want = {
        "mit": ["MIT"], "bsd": ["BSD-3-Clause"], "bsd2": ["BSD-2-Clause"], "far": ["MIT", "proprietary"],
        "part": ["unknown"], "prose": ["none"], "two": ["Apache-2.0", "MIT"],
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r["doc_id"]: r for r in lr.recognise(df).collect()}
    assert {k: r["licenses"] for k, r in got.items()} == want
    for k, text in texts.items():
        found, names = brute(text)
        assert [(f["at"], f["id"]) for f in got[k]["sentence_ids"]] == found
        assert got[k]["licenses"] == names


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op3_sentence_rule_licenses(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found, names = brute(texts[r["doc_id"]])
        assert r["licenses"] == ",".join(names) and r["n_known"] == len(found)
    assert {"MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0", "proprietary", "none"} == {r["licenses"] for r in rows}


def test_odd_documents(odd, none, odd_rows):
    got = lr.recognise(odd.withColumn("licenses", odd.doc_id))
    assert got.count() == len(odd_rows)
    assert {tuple(r["licenses"]) for r in got.collect()} == {("none",)}
    assert lr.recognise(none).count() == 0


NOTICE = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU {} License as published by
the Free Software Foundation{} {}{}

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
LATER = "either version {} of the License, or\n(at your option) any later version."


def test_the_clause_with_the_version_decides(spark):
    later = {v: LATER.format(v) for v in ("2", "2.1", "3")}
    texts = [
        (NOTICE.format(";", "General Public", ";", later["2"], ""), ["GPL-2.0-or-later"]),
        (NOTICE.format(":", "General Public", ",", later["2"], ""), ["GPL-2.0-or-later"]),
        (NOTICE.format(":", "General Public", ",", later["3"], ""), ["GPL-3.0-or-later"]),
        (NOTICE.format(";", "General Public", ";", later["3"], ""), ["GPL-3.0-or-later"]),
        (NOTICE.format(":", "Affero General Public", ",", later["3"], ""), ["AGPL-3.0-or-later"]),
        (NOTICE.format(":", "Lesser General Public", ";", later["2.1"], ""), ["LGPL-2.1-or-later"]),
        (NOTICE.format(";", "General Public", ";", "version 2 of the License.", ""), ["GPL-2.0-only"]),
        (NOTICE.format(";", "General Public", ",", "version 3.", ""), ["GPL-3.0-only"]),
        ("This program is free software. It comes with a manual.", ["unknown"]),
        (NOTICE.format(";", "Other Public", ";", "either version 9.", ""), ["unknown"]),
    ]
    texts += [(f"// SPDX-License-Identifier: {t}\nint main", [n]) for t, n in (
        ("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("BSD-3-Clause", "BSD"), ("GPL-2.0-only", "GPL-2.0"),
        ("GPL-2.0-or-later", "GPL-2.0-or-later"), ("AGPL-3.0-or-later", "AGPL-3.0-or-later"), ("Zlib", "Zlib"))]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id int, text string")
    got = {r["doc_id"]: r["licenses"] for r in lr.recognise(df).collect()}
    assert got == {i: names for i, (_, names) in enumerate(texts)}
    assert len(lr.recognise(df).where("doc_id = 0").first()["sentence_ids"]) == 5


def test_every_clause_is_known_by_itself():
    known = lr.known_sentences()
    assert set(known.values()) == set(lr.SENTENCES)
    assert {i.rstrip("?") for _, ids in lr.RULES for i in ids} <= set(known.values())
    with pytest.raises(ValueError, match="2 clauses"):
        lr.known_sentences({"X": ["It is free: take it."]})


BSD_NUMBERED = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n\n{0} Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer.\n\n{1} Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with "
    "the distribution.\n\n{2} Neither the name of {3} nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.\n"
)


@pytest.mark.parametrize(("text", "want"), [
    (BSD_NUMBERED.format("1.", "2.", "3.", "Example Inc."), ["BSD-3-Clause"]),
    (BSD_NUMBERED.format("1)", "2)", "3)", "the University of Somewhere"), ["BSD-3-Clause"]),
    (BSD_NUMBERED.format("(a)", "(b)", "(c)", "Example, Ltd."), ["BSD-3-Clause"]),
    (BSD_NUMBERED.format("*", "*", "*", "the copyright holder"), ["BSD-3-Clause"]),
    ("# SPDX-License-Identifier: BSD-2-Clause", ["BSD-2-Clause"]),
    ("/* SPDX-License-Identifier: LGPL-2.1-or-later */\nint x;", ["LGPL-2.1-or-later"]),
    ("SPDX-License-Identifier: Apache-2.0 OR MIT\n", ["Apache-2.0", "MIT"]),
    ("SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 AND ISC)", ["GPL-2.0-only", "Classpath-exception-2.0", "ISC"]),
    ("SPDX-License-Identifier: MIT", ["MIT"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy", ["MPL-2.0"]),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies.", ["ISC"]),
    ("This is free and unencumbered software released into the public domain.\n", ["Unlicense"]),
    ("SPDX-License-Identifier:", ["none"]),
])
def test_names_numbers_and_tags(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    assert lr.recognise(df).first()["licenses"] == want
