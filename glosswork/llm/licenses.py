"""Licence scans by sentence rules.

A text is cut into sentences: at . ? ! ; : before white space and at lines
without a letter or digit (so a wrapped sentence, also one in a comment block,
is one sentence). Sentences are lower-cased and reduced to ASCII letters and
digits; names of holders in two known sentences are put aside. A sentence that is a
known licence sentence becomes its identifier; if it isn't, it is tried without its
first line (a heading or copyright line without a stop), and then line by line.
The document's ordered identifiers are matched against licence rules, each an
ordered list of identifiers that may have other known sentences between them; a
rule yields to a longer one that holds it. All of it is expressions on one row.

Defined cases: null text counts as empty; no known sentence gives empty strings
and verdict "none"; a rule counts once however often it matches; the strongest
class of the matched rules is the verdict (noncommercial, copyleft, permissive);
a reservation of rights counts only where no licence is found (proprietary);
repeated rows give repeated rows; an empty table gives no rows; only doc_id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.functions.text import let
from glosswork.llm.common import table, text_of

# --- fixed values: sentences of public licence texts, as the licences have them ---

APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License");',
    "you may not use this file except in compliance with the License.",
    "You may obtain a copy of the License at",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "See the License for the specific language governing permissions and limitations under the License.",
]
APACHE_TEXT = [
    "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
]
MIT = [
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
]
BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
]
ISC = [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
]
GNU = [
    "This program is free software;",
    "This library is free software;",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
]
GNU_NAMES = {
    "gpl-2.0": ("GNU General Public License", "2"),
    "gpl-3.0": ("GNU General Public License", "3"),
    "lgpl-2.0": ("GNU Library General Public License", "2"),
    "lgpl-2.1": ("GNU Lesser General Public License", "2.1"),
    "lgpl-3.0": ("GNU Lesser General Public License", "3"),
    "agpl-3.0": ("GNU Affero General Public License", "3"),
}
GNU_TERMS = "you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation"
GNU_LATER = GNU_TERMS + ", either version {v} of the License, or (at your option) any later version."
GNU_LATER_2 = GNU_TERMS + "; either version {v} of the License, or (at your option) any later version."
OTHER = {
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented;",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "This notice may not be removed or altered from any source distribution.",
    ],
    "bsl-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    ],
    "cc0-1.0": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    ],
}
CREATIVE = {
    "by": ("permissive", "Attribution"),
    "by-sa": ("copyleft", "Attribution-ShareAlike"),
    "by-nd": ("noderivatives", "Attribution-NoDerivatives"),
    "by-nc": ("noncommercial", "Attribution-NonCommercial"),
    "by-nc-sa": ("noncommercial", "Attribution-NonCommercial-ShareAlike"),
    "by-nc-nd": ("noncommercial", "Attribution-NonCommercial-NoDerivatives"),
}
CREATIVE_VERSIONS = ("2.0", "3.0", "4.0")
RESERVED = ["All rights reserved.", "All rights reserved"]

# --- end of fixed values -------------------------------------------------------

#: The strongest first.
CLASSES = ("noncommercial", "noderivatives", "copyleft", "permissive", "proprietary")

_STOP = r"([.?;:]|[^!]!)[\"')\]]*[ \t\n\f\r]+"
#: A line end, lines without a letter or digit, a line end. No repeated group: Java matches those by recursion.
_BLANK = r"\n[^A-Za-z0-9]*\n"
#: The same for the SQL, whose engine has no such bound.
_SQL_BLANK = r"\n([^A-Za-z0-9\n]*\n)+"
_OTHER = r"[^a-z0-9\n\f]+"
#: Names of holders that known sentences hold.
_HOLDERS = [
    # "Inc." and the like end a sentence before "nor".
    (r"^(?:neither the names? of .* )?nor the names? of (?:its|their|the|other|any other) contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (r"^this software is provided by .* as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
]


def flat(sentence: str) -> str:
    """A known sentence as the scan sees it."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


class _Table:
    """Known sentences with their identifiers, and rules over them."""

    def __init__(self):
        self.sentences: dict[str, int] = {}
        self.rules: list[tuple[str, str, tuple[int, ...], tuple[str, ...]]] = []

    def known(self, *sentences: str) -> tuple[int, ...]:
        return tuple(self.sentences.setdefault(flat(s), len(self.sentences) + 1) for s in sentences)

    def rule(self, name: str, kind: str, ids: tuple[int, ...], unless: tuple[str, ...] = ()) -> None:
        self.rules.append((name, kind, ids, unless))


def licence_table() -> _Table:
    """The sentences and rules of the fixed values above."""
    t = _Table()
    (spdx,) = t.known("SPDX-License-Identifier:")

    def family(name: str, kind: str, *lines: str) -> None:
        """One-line notices of a licence and its SPDX line."""
        for line in lines:
            for start in ("", "This work is ", "This project is ", "This software is "):
                t.rule(name, kind, t.known(start + line))
        t.rule(name, kind, (spdx, *t.known(name)))

    family("apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0")
    header = t.known(*APACHE)
    t.rule("apache-2.0", "permissive", header[:3])
    t.rule("apache-2.0", "permissive", header[:1] + header[3:])
    t.rule("apache-2.0", "permissive", t.known(*APACHE_TEXT))
    family("mit", "permissive", "Released under the MIT License", "Licensed under the MIT License")
    t.rule("mit", "permissive", t.known(*MIT)[:2])
    bsd = t.known(*BSD)
    t.rule("bsd-4-clause", "permissive", (bsd[0], bsd[1], bsd[2], bsd[3], bsd[4]))
    t.rule("bsd-3-clause", "permissive", (bsd[0], bsd[1], bsd[2], bsd[4]), ("bsd-4-clause",))
    t.rule("bsd-2-clause", "permissive", (bsd[0], bsd[1], bsd[2]), ("bsd-3-clause", "bsd-4-clause"))
    for name in ("bsd-2-clause", "bsd-3-clause"):
        family(name, "permissive", f"Released under the {name} license", f"Licensed under the {name} license")
    isc = t.known(*ISC)
    for start in isc[:2]:
        t.rule("isc", "permissive", (start,))
    t.rule("0bsd", "permissive", isc[2:])
    t.known(*GNU)
    for name, (title, version) in GNU_NAMES.items():
        for form in (GNU_LATER, GNU_LATER_2):
            parts = form.format(name=title, v=version).split("; ")
            t.rule(name, "copyleft", t.known(*parts))
        family(name, "copyleft", f"licensed under the {title}, version {version}", f"released under the {title}, version {version}")
    for name, lines in OTHER.items():
        ids = t.known(*lines)
        kind = "copyleft" if name in ("mpl-2.0", "epl-2.0") else "permissive"
        if name == "mpl-2.0":
            t.rule(name, kind, (ids[0], ids[1]))
            t.rule(name, kind, (ids[0], ids[2]))
        elif name == "bsl-1.0":
            for i in ids:
                t.rule(name, kind, (i,))
        else:
            t.rule(name, kind, ids)
        t.rule(name, kind, (spdx, *t.known(name)))
    for short, (kind, title) in CREATIVE.items():
        for version in CREATIVE_VERSIONS:
            name = f"cc-{short}-{version}"
            t.rule(name, kind, t.known(f"Licensed under CC {short} {version}"))
            t.rule(name, kind, t.known(f"This work is licensed under CC {short} {version}"))
            t.rule(name, kind, t.known(f"This work is licensed under a Creative Commons {title} {version} International License"))
            t.rule(name, kind, (spdx, *t.known(name)))
    open_names = tuple(dict.fromkeys(n for n, _, _, _ in t.rules))
    for line in RESERVED:
        t.rule("proprietary", "proprietary", t.known(line), open_names)
    return t


TABLE = licence_table()


def _pattern(ids: tuple[int, ...]) -> str:
    """Matches ids in order in a line of identifiers between commas.

    The first place of each id is as good as any later one, so no place is tried
    twice: time is linear in the line.
    """
    return "^" + "".join(f"(?>[0-9,]*?,{i}(?=,))" for i in ids)


def _sql_pattern(ids: tuple[int, ...]) -> str:
    return "," + r",([0-9]+,)*".join(map(str, ids)) + ","


def _merged(rules, _pattern=_pattern) -> dict[str, tuple[str, str, tuple[str, ...]]]:
    """Per licence: class, one pattern of all its rules, the licences that it yields to."""
    out: dict[str, tuple[str, list[str], tuple[str, ...]]] = {}
    for name, kind, ids, unless in rules:
        held = out.setdefault(name, (kind, [], unless))
        held[1].append(_pattern(ids))
    return {name: (kind, "|".join(dict.fromkeys(found)), unless) for name, (kind, found, unless) in out.items()}


def scan(docs: DataFrame, licences: _Table = TABLE) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licenses, verdict."""
    known = F.create_map(*(F.lit(x) for s, i in licences.sentences.items() for x in (s, str(i))))

    def named(sentence):
        for pattern, plain in _HOLDERS:
            sentence = F.regexp_replace(sentence, pattern, plain)
        return F.try_element_at(known, sentence)

    def ids_of(lines):
        whole, tail = F.array_join(lines, " "), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), " ")
        one = F.coalesce(named(whole), F.when(F.size(lines) > 1, named(tail)))
        each = F.when(F.size(lines) > 1, F.filter(F.transform(lines, named), lambda x: x.isNotNull())).otherwise(F.expr("cast(array() as array<string>)"))
        return let(one, lambda x: F.when(x.isNotNull(), F.array(x)).otherwise(each))

    cut = F.regexp_replace(F.regexp_replace("text", _STOP, "$1\f"), _BLANK, "\f")
    lines_of = lambda s: F.filter(F.transform(F.split(s, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    said = F.filter(F.transform(F.split(F.regexp_replace(F.lower(cut), _OTHER, " "), "\f"), lines_of), lambda x: F.size(x) > 0)
    rows = text_of(docs).select("doc_id", said.alias("said"))
    ids = F.array_join(F.flatten(F.transform("said", ids_of)), ",")
    found = rows.select("doc_id", F.size("said").cast("long").alias("n_sentences"), ids.alias("sentence_ids"))

    # The rules are tried only where a sentence is known.
    line = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    merged = _merged(licences.rules)
    names = F.array(*(F.when(line.rlike(pattern), name) for name, (_, pattern, _) in merged.items()))
    hits = F.when(F.col("sentence_ids") == "", F.expr("cast(array() as array<string>)")).otherwise(F.filter(names, lambda x: x.isNotNull()))
    hits = found.withColumn("hits", hits)

    def stays(x):
        out = F.lit(True)
        for name, (_, _, unless) in merged.items():
            if unless:
                out = out & ~((x == name) & F.arrays_overlap(F.col("hits"), F.array(*map(F.lit, unless))))
        return out

    kinds = F.create_map(*(F.lit(v) for name, (kind, _, _) in merged.items() for v in (name, kind)))
    hits = hits.withColumn("held", F.filter("hits", stays))
    hits = hits.withColumn("kinds", F.transform("held", lambda x: F.element_at(kinds, x)))
    verdict = F.lit("none")
    for kind in reversed(CLASSES):
        verdict = F.when(F.array_contains("kinds", kind), kind).otherwise(verdict)
    return hits.select("doc_id", "n_sentences", "sentence_ids", F.array_join("held", ",").alias("licenses"), verdict.alias("verdict"))


def query(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


def _sql(licences: _Table = TABLE) -> str:
    known = ", ".join(f"'{s}': '{i}'" for s, i in licences.sentences.items())
    merged = _merged(licences.rules, _sql_pattern)
    names = ", ".join(f"CASE WHEN regexp_matches(line, '{pattern}') THEN '{name}' END" for name, (_, pattern, _) in merged.items())
    stays = " AND ".join(f"NOT (x = '{n}' AND list_has_any(hits, [{', '.join(repr(u) for u in unless)}]))" for n, (_, _, unless) in merged.items() if unless)
    kinds = ", ".join(f"'{n}': '{k}'" for n, (k, _, _) in merged.items())
    verdict = " ".join(f"WHEN list_contains(kinds, '{k}') THEN '{k}'" for k in CLASSES)

    def named(sentence):
        for pattern, plain in _HOLDERS:
            sentence = f"regexp_replace({sentence}, '{pattern}', '{plain}')"
        return f"MAP {{{known}}}[{sentence}]"

    stop = _STOP.replace("'", "''")
    return rf"""
WITH cut AS (
  SELECT doc_id, string_split(regexp_replace(lower(regexp_replace(regexp_replace(coalesce(text, ''), '{stop}', '' || chr(12), 'g'), '{_SQL_BLANK}', chr(12), 'g')), '{_OTHER}', ' ', 'g'), chr(12)) AS parts
  FROM documents),
said AS (
  SELECT doc_id, list_filter(list_transform(parts, lambda s: list_filter(list_transform(string_split(s, chr(10)), lambda l: trim(l)), lambda l: l <> '')), lambda ls: len(ls) > 0) AS said
  FROM cut),
tried AS (
  SELECT doc_id, CAST(len(said) AS BIGINT) AS n_sentences,
         list_transform(said, lambda ls: {{'ls': ls,
           'one': coalesce({named("array_to_string(ls, ' ')")}, CASE WHEN len(ls) > 1 THEN {named("array_to_string(ls[2:], ' ')")} END)}}) AS tried
  FROM said),
ids AS (
  SELECT doc_id, n_sentences,
         coalesce(array_to_string(flatten(list_transform(tried, lambda t: CASE WHEN t.one IS NOT NULL THEN [t.one] WHEN len(t.ls) > 1
           THEN list_filter(list_transform(t.ls, lambda l: {named('l')}), lambda x: x IS NOT NULL) ELSE [] END)), ','), '') AS sentence_ids
  FROM tried),
lines AS (SELECT *, ',' || sentence_ids || ',' AS line FROM ids),
hit AS (SELECT doc_id, n_sentences, sentence_ids, list_filter([{names}], lambda x: x IS NOT NULL) AS hits FROM lines),
held AS (SELECT doc_id, n_sentences, sentence_ids, list_filter(hits, lambda x: {stays}) AS held FROM hit),
judged AS (SELECT *, list_transform(held, lambda x: MAP {{{kinds}}}[x]) AS kinds FROM held)
SELECT doc_id, n_sentences, sentence_ids, coalesce(array_to_string(held, ','), '') AS licenses,
       CASE {verdict} ELSE 'none' END AS verdict
FROM judged
"""


SQL = _sql()
