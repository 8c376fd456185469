"""Licence scans: wrapped texts as they stand in files, and an independent version over plain loops."""

import textwrap

import pytest

from glosswork.llm import licenses as L

WARRANTY = "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."


def wrap(*paragraphs, width=72, mark=""):
    """Paragraphs as wrapped lines with a comment mark and blank lines between."""
    out = []
    for p in paragraphs:
        out += [f"{mark}{line}".rstrip() for line in textwrap.wrap(p, width)] + [mark.rstrip()]
    return "\n".join(out)


def gnu(what, name, version, sep):
    start = f"This {what} is free software{sep} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation"
    stop = ";" if sep == ";" else ","
    return [f"{start}{stop} either version {version} of the License, or (at your option) any later version.", f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; {WARRANTY}"]


B = L.BSD
NEITHER = "Neither the name of Example Labs, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
CASES = {
    "mit": ("permissive", ["MIT License", "Copyright (c) 2020 Some Body", " ".join(L.MIT[:1]), L.MIT[1], L.MIT[2]]),
    "bsd-2-clause": ("permissive", ["Copyright (c) 2020, Some Body. All rights reserved.", B[0], "1. " + B[1], "2. " + B[2], B[5]]),
    "bsd-3-clause": ("permissive", ["Copyright (c) 2020, Some Body", "All rights reserved.", B[0], "* " + B[1], "* " + B[2], "* " + NEITHER, B[5]]),
    "bsd-4-clause": ("permissive", ["All rights reserved.", B[0], "1. " + B[1], "2. " + B[2], "3. " + B[3] + " This product includes software.", "4. " + NEITHER]),
    "apache-2.0": ("permissive", ["Copyright 2020 Some Body", " ".join(L.APACHE[:3]), "http://www.apache.org/licenses/LICENSE-2.0", " ".join(L.APACHE[3:])]),
    "isc": ("permissive", ["Copyright (c) 2020, Some Body", L.ISC[0]]),
    "gpl-2.0": ("copyleft", gnu("program", "GNU General Public License", "2", ";")),
    "gpl-3.0": ("copyleft", gnu("program", "GNU General Public License", "3", ":")),
    "lgpl-2.1": ("copyleft", gnu("library", "GNU Lesser General Public License", "2.1", ";")),
    "lgpl-3.0": ("copyleft", gnu("program", "GNU Lesser General Public License", "3", ":")),
    "agpl-3.0": ("copyleft", gnu("program", "GNU Affero General Public License", "3", ":")),
    "mpl-2.0": ("copyleft", ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. " + L.OTHER["mpl-2.0"][1]]),
    "zlib": ("permissive", [L.OTHER["zlib"][0], "1. " + L.OTHER["zlib"][1] + " you must not claim that you wrote it.", "2. " + L.OTHER["zlib"][2], "3. " + L.OTHER["zlib"][3]]),
    "unlicense": ("permissive", L.OTHER["unlicense"]),
    "cc-by-nc-sa-4.0": ("noncommercial", ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."]),
}


@pytest.mark.parametrize("mark,width", [("", 78), (" * ", 72), ("# ", 60), ("// ", 50), ("", 10_000)])
def test_wrapped_texts(spark, mark, width):
    rows = [(i, wrap(*parts, width=width, mark=mark)) for i, (_, parts) in enumerate(CASES.values())]
    rows += [(100 + i, "Some prose goes before.\nAnd this. " + t + "\n\nMore of it follows") for i, t in rows]
    got = {r.doc_id: (r.licenses, r.verdict) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (name, (kind, _)) in enumerate(CASES.items()):
        assert got[i] == (name, kind)
        assert got[100 + i] == (name, kind)


def test_notices_orders_and_reservation(spark):
    texts = {
        "Prose without a stop\nReleased under the MIT License.\nMore prose": "mit",
        "// SPDX-License-Identifier: Apache-2.0\nint main": "apache-2.0",
        "# SPDX-License-Identifier: CC-BY-NC-4.0\n": "cc-by-nc-4.0",
        "Copyright Some Body\nAll rights reserved.": "proprietary",
        "All rights reserved. Licensed under the MIT License.": "mit",
        f"{B[2]} {B[1]} {B[0]}": "",
        f"{B[0]} Between. {B[1]}\nLicensed under CC BY 4.0.\n{B[2]}": "bsd-2-clause,cc-by-4.0",
        "": "",
        "MIT": "",
    }
    rows = list(enumerate(texts))
    got = {r.doc_id: r.licenses for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: texts[t] for i, t in rows}


def brute(text):
    """(n_sentences, ids, licences, verdict) by loops over characters and lists."""
    parts, now, i = [], "", 0
    while i < len(text):
        c = text[i]
        space = " \t\n\f\r"
        stop = c in ".?;:" or (c == "!" and i > 0 and text[i - 1] != "!" and not brute.taken == i - 1)
        if stop:
            k = i + 1
            while k < len(text) and text[k] in "\"')]":
                k += 1
            if k < len(text) and text[k] in space:
                now += text[i:k]
                while k < len(text) and text[k] in space:
                    k += 1
                parts.append(now)
                now, i = "", k
                brute.taken = k - 1
                continue
        now += c
        i += 1
    parts.append(now)
    said = []
    for part in parts:
        lines, group, first = part.split("\n"), [], True
        groups = []
        for n, line in enumerate(lines):
            inner = 0 < n < len(lines) - 1
            if inner and not any(ch.isascii() and ch.isalnum() for ch in line):
                groups.append(group)
                group = []
            else:
                group.append(line)
        groups.append(group)
        for g in groups:
            flats = [f for f in ("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in ln.lower()) for sub in g for ln in sub.split("\f")) if f.strip()]
            if flats:
                said.append([" ".join(f.split()) for f in flats])
    ids = []
    for lines in said:
        def known(s):
            if s.startswith("nor the name"):
                s = "neither the name of any " + s
            for start, mid in (("neither the name", " contributors"), ("this software is provided by ", " as is and any express")):
                if s.startswith(start) and mid in s:
                    for k in L.TABLE.sentences:
                        if k.startswith(start) and k.endswith(s[s.rindex(mid) + len(mid) :]) and (start != "neither the name" or " nor the name" in s):
                            return L.TABLE.sentences[k]
            return L.TABLE.sentences.get(s)

        one = known(" ".join(lines)) or (known(" ".join(lines[1:])) if len(lines) > 1 else None)
        ids += [one] if one else [k for k in map(known, lines) if k] if len(lines) > 1 else []
    names = []
    for name, _, seq, _ in L.TABLE.rules:
        at = 0
        for want in seq:
            at = next((k + 1 for k in range(at, len(ids)) if ids[k] == want), None)
            if at is None:
                break
        if at is not None and name not in names:
            names.append(name)
    order = list(dict.fromkeys(n for n, _, _, _ in L.TABLE.rules))
    unless = {n: u for n, _, _, u in reversed(L.TABLE.rules)}
    kind = {n: k for n, k, _, _ in L.TABLE.rules}
    held = [n for n in order if n in names and not set(unless[n]) & set(names)]
    verdict = next((k for k in L.CLASSES if any(kind[n] == k for n in held)), "none")
    return len(said), ",".join(map(str, ids)), ",".join(held), verdict


brute.taken = -1


def test_against_plain_loops(spark, docs, real, none):
    rows = [(i, wrap(*parts, mark=" * ")) for i, (_, parts) in enumerate(CASES.values())]
    for df in (docs, real, spark.createDataFrame(rows, "doc_id long, text string")):
        got = sorted((tuple(r) for r in L.scan(df).collect()), key=repr)
        want = []
        for r in df.select("doc_id", "text").collect():
            brute.taken = -1
            want.append((r.doc_id, *brute(r.text or "")))
        assert got == sorted(want, key=repr)
    assert L.scan(none).count() == 0
