"""Licences of documents, recognised by the sentences they consist of.

A text is normalised and split into sentences; those known from licences get their
sentence's identifier. Ordered rules are then matched against a document's sequence of
identifiers: the first rules are the most specific ones, and what a rule has matched is
used up. All of it happens inside the row, in column expressions, without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The FSF's notices: what they grant under, and the clause with the version that decides.
_TERMS = "you can redistribute it and/or modify it under the terms of the GNU {} License"
_FSF = " as published by the Free Software Foundation"
_LATER = "either version {} of the License, or (at your option) any later version"
_FAMILIES = {"GPL": "General Public", "LGPL": "Lesser General Public", "AGPL": "Affero General Public"}
_VERSIONS = {"GPL": ("2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}


def _grants() -> dict[str, list[str]]:
    """Clauses of the notices: the terms, the version, or both in one."""
    out = {f"{family}_TERMS": [_TERMS.format(name) + _FSF] for family, name in _FAMILIES.items()}
    for v in ("2", "2.1", "3"):
        out[f"VERSION_{v}_LATER"] = [_LATER.format(v)]
        out[f"VERSION_{v}_ONLY"] = [f"version {v} of the License"]
    for family, name in _FAMILIES.items():
        for v in _VERSIONS[family]:
            terms = _TERMS.format(name)
            out[f"{family}_{v}_LATER"] = [f"{terms}{_FSF}, {_LATER.format(v)}"]
            out[f"{family}_{v}_ONLY"] = [
                f"{terms}{_FSF}, version {v} of the License", f"{terms}{_FSF}, version {v}",
                f"{terms} version {v}{_FSF}", f"{terms}, version {v},{_FSF}",
            ]
    return out


# Clauses of public licences and of notices that name them, each up to a mark
# before a blank. A tag's colon ends none.
SENTENCES = {
    "MIT_GRANT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:",
    ],
    "MIT_NOTICE": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
    ],
    "MIT_AS_IS": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "BSD_GRANT": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
    ],
    "BSD_SOURCE": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
    ],
    "BSD_BINARY": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    # What comes before, the holder's name, is a slot: see SLOTS.
    "BSD_NAME": [
        f"nor the names of {whose} contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."
        for whose in ("its", "their")
    ],
    "APACHE2_REF": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\")",
        "This work is licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "APACHE2_COMPLY": ["You may not use this file except in compliance with the License."],
    "APACHE2_COPY": [
        "You may obtain a copy of the License at", "You may obtain a copy of the License at http:",
        "You may obtain a copy of the License at https:",
    ],
    "APACHE2_AS_IS": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT_REF": [
        "Released under the MIT License.", "Licensed under the MIT License.",
        "This work is licensed under the MIT License.", "SPDX-License-Identifier: MIT",
    ],
    "BSD_REF": [
        "Released under the BSD License.", "Licensed under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL3_REF": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "GPL2_REF": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "GPL2_LATER_REF": ["SPDX-License-Identifier: GPL-2.0-or-later"],
    "GPL3_LATER_REF": ["SPDX-License-Identifier: GPL-3.0-or-later"],
    "AGPL3_LATER_REF": ["SPDX-License-Identifier: AGPL-3.0-or-later"],
    "FREE_PROGRAM": ["This program is free software", "This library is free software"],
    **_grants(),
    "GPL_NO_WARRANTY": [
        f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"
        for what in ("program", "library")
    ],
    "GPL_NO_IMPLIED": [
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ],
    "CC0_REF": ["This work is dedicated to the public domain.", "SPDX-License-Identifier: CC0-1.0"],
    "CCBY4_REF": [
        "Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CCBYSA4_REF": [
        "Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CCBYNC4_REF": [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "MPL2_REF": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v",
        "This work is licensed under the Mozilla Public License, version 2.0.",
    ],
    "ISC_GRANT": [
        f"Permission to use, copy, modify, {both} distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
        for both in ("and/or", "and")
    ],
    "UNLICENSE_GRANT": ["This is free and unencumbered software released into the public domain."],
    "ZLIB_GRANT": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, "
        "and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "BSL_GRANT": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
        "and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, "
        "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to "
        "permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ],
    "EPL2_REF": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public "
        "License 2.0 which is available at https:",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public "
        "License 2.0 which is available at",
    ],
    "ALL_RIGHTS": ["All rights reserved."],
}

_DISCLAIMED = ["GPL_NO_WARRANTY?", "GPL_NO_IMPLIED?"]


def _grant_rules() -> list[tuple[str, list[str]]]:
    """The notices, with terms and version in one clause or two; "-or-later" if they say so."""
    rules = []
    for family, versions in _VERSIONS.items():
        for v in versions:
            for kind, suffix in (("LATER", "-or-later"), ("ONLY", "-only")):
                name = f"{family}-{v if '.' in v else v + '.0'}{suffix}"
                for ids in ([f"{family}_{v}_{kind}"], [f"{family}_TERMS", f"VERSION_{v}_{kind}"]):
                    rules.append((name, ["FREE_PROGRAM?", *ids, *_DISCLAIMED]))
    return rules


# Rules in order: a licence and the identifiers it consists of, "?" marking optional ones.
RULES = [
    ("MIT", ["ALL_RIGHTS?", "MIT_GRANT", "MIT_NOTICE", "MIT_AS_IS?"]),
    ("BSD-3-Clause", ["ALL_RIGHTS?", "BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NAME"]),
    ("BSD-2-Clause", ["ALL_RIGHTS?", "BSD_GRANT", "BSD_SOURCE", "BSD_BINARY"]),
    ("Apache-2.0", ["APACHE2_REF", "APACHE2_COMPLY?", "APACHE2_COPY?", "APACHE2_AS_IS?"]),
    *_grant_rules(),
    ("GPL-3.0-or-later", ["GPL3_LATER_REF"]),
    ("GPL-2.0-or-later", ["GPL2_LATER_REF"]),
    ("AGPL-3.0-or-later", ["AGPL3_LATER_REF"]),
    ("GPL-3.0", ["GPL3_REF"]),
    ("GPL-2.0", ["GPL2_REF"]),
    ("MIT", ["MIT_REF"]),
    ("BSD", ["BSD_REF"]),
    ("CC-BY-NC-4.0", ["CCBYNC4_REF"]),
    ("CC-BY-SA-4.0", ["CCBYSA4_REF"]),
    ("CC-BY-4.0", ["CCBY4_REF"]),
    ("CC0-1.0", ["CC0_REF"]),
    ("MPL-2.0", ["MPL2_REF"]),
    ("ISC", ["ALL_RIGHTS?", "ISC_GRANT"]),
    ("Unlicense", ["UNLICENSE_GRANT"]),
    ("Zlib", ["ALL_RIGHTS?", "ZLIB_GRANT"]),
    ("BSL-1.0", ["BSL_GRANT"]),
    ("EPL-2.0", ["EPL2_REF"]),
    ("proprietary", ["ALL_RIGHTS"]),
]
UNKNOWN, NONE = "unknown", "none"
# Sentences without a licence that may stand between two of a rule.
GAP = 3

# In front of a clause: a list number or letter, and the name that stands in its slot.
SLOTS = (
    r"^(?:(?:[0-9]{1,2}[.:;]?|[a-z]|[ivx]{1,4}) +(?=[a-z]{3,} ))?"
    r"(?:neither the name of .* (?=nor the names of ))?"
)
# A tag's licence expression, and what joins the names in it.
SPDX_TAG, SPDX_JOINS = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() :-]+)", r"[()]| +(?i:AND|OR|WITH) +"

_MARKS = r"[^\p{L}\p{N}.!?;:\n]+"
_SPDX = "spdx license identifier: "
_TAG = r"(?<!spdx license identifier)"
_END = rf"{_TAG}[.!?;:]+(?=\s|$)|\n\s*\n"


def clauses(sentence: str) -> list[str]:
    """A known sentence's clauses, normalised as those of texts are: lower case, words and inner marks."""
    text = re.sub(r"[^a-z0-9.!?;:\n]+", " ", sentence.lower())
    parts = [" ".join(part.split()) for part in re.split(_END, text)]
    return [part for part in parts if part]


def known_sentences(sentences: dict[str, list[str]] = SENTENCES) -> dict[str, str]:
    """Normalised clause to identifier. Each clause needs its own one, so that rules can ask for all."""
    out: dict[str, str] = {}
    for name, texts in sentences.items():
        for text in texts:
            parts = clauses(text)
            if len(parts) != 1:
                raise ValueError(f"{name} has {len(parts)} clauses, give each its own identifier: {text!r}")
            if out.setdefault(parts[0], name) != name:
                raise ValueError(f"{name} and {out[parts[0]]} share a clause: {text!r}")
    return out


def rule_pattern(ids: list[str]) -> str:
    """Pattern of a rule over '|A|B|', where '~' stands for a gap too wide."""
    return "".join(f"(?:\\|{i[:-1]})?" if i.endswith("?") else f"\\|{i}" for i in ids) + "(?=[|~=]|$)"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def recognise(
    docs: DataFrame, sentences: dict[str, list[str]] = SENTENCES,
    rules: list[tuple[str, list[str]]] = RULES, gap: int = GAP,
) -> DataFrame:
    """``docs`` with ``sentence_ids`` (array of (at, id)) and ``licenses`` (array of names).

    ``at`` is the number of the sentence in the text. Sentences end at marks and empty
    lines; within one, single lines are looked up too, so a notice on its own line is
    found after unfinished prose. ``licenses`` lists each rule that matched once, in rule
    order; identifiers that no rule uses give 'unknown', and without any there is only
    'none'. A tag whose expression isn't among the sentences adds each licence and exception
    it names, as written. A clause may begin with a list number, and hold a name where
    SLOTS has one. Null and empty text has none. Columns of these names are replaced.
    """
    docs = docs.drop("sentence_ids", "licenses")
    table = known_sentences(sentences)
    pairs = ", ".join(f"{_literal(k)}, {_literal(v)}" for k, v in table.items())
    look_up = f"try_element_at(map({pairs}), trim(regexp_replace({{}}, '\\\\s+', ' ')))"
    found = f"""filter(array_distinct(flatten(transform(split(
            regexp_replace(lower(coalesce(text, '')), {_literal(_MARKS)}, ' '), {_literal(_END)}, -1),
        (s, i) -> CASE WHEN length(s) < {min(map(len, table))} THEN array() ELSE
            transform(array_distinct(concat(array(s), split(s, '\\n'))),
                p -> named_struct('at', i, 'id', {look_up.format(f"regexp_replace(trim(p), {_literal(SLOTS)}, '')")})) END))),
        f -> f.id IS NOT NULL)"""
    steps = ", ".join(
        f"named_struct('name', {_literal(name)}, 'pattern', {_literal(rule_pattern(ids))})"
        for name, ids in rules
    )
    joined = f"""array_join(transform(sentence_ids, (f, i) -> concat(
        CASE WHEN i > 0 AND f.at - sentence_ids[i - 1].at > {gap + 1} THEN '~' ELSE '' END, '|', f.id)), '')"""
    matched = f"""aggregate(array({steps}),
        named_struct('rest', {joined}, 'names', cast(array() AS array<string>)),
        (s, r) -> CASE WHEN s.rest RLIKE r.pattern THEN named_struct(
            'rest', regexp_replace(s.rest, r.pattern, '='), 'names', array_append(s.names, r.name)) ELSE s END,
        s -> array_distinct(CASE WHEN s.rest LIKE '%|%' THEN array_append(s.names, '{UNKNOWN}') ELSE s.names END))"""
    # Tags that no known sentence stands for say their names themselves.
    tags = ", ".join(_literal(k.removeprefix(_SPDX)) for k in table if k.startswith(_SPDX))
    plain = "trim(regexp_replace(regexp_replace(lower(e), '[^a-z0-9.]+', ' '), '[.]+$', ''))"
    named = f"""filter(flatten(transform(
            filter(regexp_extract_all(coalesce(text, ''), {_literal(SPDX_TAG)}, 1), e -> NOT array_contains(array({tags}), {plain})),
        e -> transform(split(e, {_literal(SPDX_JOINS)}), n -> regexp_replace(trim(n), '[.:]+$', '')))),
        n -> n RLIKE '^[A-Za-z][A-Za-z0-9.+:-]+$')"""
    return docs.withColumn("sentence_ids", F.expr(found)).withColumn("licenses", F.expr(f"""CASE
        WHEN text RLIKE {_literal(SPDX_TAG)} AND size({named}) > 0 THEN array_union(
            CASE WHEN size(sentence_ids) = 0 THEN array() ELSE {matched} END, {named})
        WHEN size(sentence_ids) = 0 THEN array('{NONE}') ELSE {matched} END"""))
