import random
import textwrap
import time

import duckdb
import pytest
from helpers import as_rows, documents
from oracle import DATA

from densefold.llm import licenses

# The wording of public licences.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def test_documents(spark):
    rows = [
        (1, "Some text here. Licensed under the Apache License, Version 2.0. More text."), (2, "x\nAll rights reserved.\nReleased under the MIT License."), (3, None), (4, ""),
        (5, "This work is licensed under the GNU General Public License, version 3."), (6, "Licensed under CC BY-NC 4.0."), (7, "the license of apache"), (8, MIT),
        (9, "// SPDX-License-Identifier: GPL-2.0-only OR MIT\ncode"), (10, "word " * 200000 + ". All rights reserved."), (11, "All rights reserved. All rights reserved!"),
    ]
    got = as_rows(licenses.scan(documents(spark, rows)))
    want = {1: ["Apache-2.0"], 2: ["LicenseRef-all-rights-reserved", "MIT"], 3: [], 4: [], 5: ["GPL-3.0-only"], 6: ["CC-BY-NC-4.0"], 7: [], 8: ["MIT"], 9: ["GPL-2.0-only OR MIT"], 10: ["LicenseRef-all-rights-reserved"], 11: ["LicenseRef-all-rights-reserved"] * 2}
    assert {i: r.licenses for i, r in got.items()} == want
    assert got[3].n_sentences == 0 and got[1].n_sentences == 3
    assert licenses.scan(documents(spark, [])).collect() == []


def test_rules_are_ordered():
    assert licenses.match(["MITPermission", "ApacheRef", "MITNotice"]) == (["Apache-2.0"], ["MITPermission", "MITNotice"])
    assert licenses.match(["MITPermission", "GPLSee", "ApacheRef", "MITNotice"]) == (["Apache-2.0"], ["MITPermission", "GPLSee", "MITNotice"])
    assert licenses.match(["MITPermission", "BSDAsIs", "MITNotice"]) == (["MIT"], ["BSDAsIs"])  # a sentence of no rule may lie between
    assert licenses.match(["MITNotice", "MITPermission"]) == ([], ["MITNotice", "MITPermission"])
    assert licenses.match(["BSDPermission", "BSDSource", "BSDBinary"])[0] == ["BSD-2-Clause"]
    assert licenses.match([]) == ([], [])


def test_tables_agree():
    ids = {i for i, _ in licenses.SENTENCES}
    assert all(i in ids for rule, _ in licenses.RULES for i in rule)
    assert len({tuple(rule) for rule, _ in licenses.RULES}) == len(licenses.RULES) and len({n for _, n in licenses.RULES}) >= 50
    by = {}
    for i, text in licenses.SENTENCES:
        assert by.setdefault(tuple(licenses.words(text)), i) == i and licenses.words(text)


def test_matching_is_linear():
    ids = ["MITPermission", "GPLSee", "BSDPermission", "BSDSource"] * 50_000
    start = time.perf_counter()
    found, rest = licenses.match(ids)
    assert time.perf_counter() - start < 5 and not found and len(rest) == len(ids)


def test_no_gap_and_no_sentence_is_too_long():
    assert licenses.scan_text("Licensed under the" + " " * 6000 + "MIT License.")[2] == ["MIT"]
    assert licenses.scan_text("Licensed under the\n" + "# \t\n" * 6000 + " MIT License.")[2] == ["MIT"]
    assert licenses.scan_text("word " * 50_000 + "\nLicensed under the MIT License.")[2] == ["MIT"]
    start = time.perf_counter()
    licenses.scan_text(("Permission is hereby granted, free of charge, to any person\n" + "\n" * 30) * 5000)
    assert time.perf_counter() - start < 10


GPL_REST = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program"""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
#: Each rule's notice: licence, ids, words.
NOTICES = [
    ("MIT", "MITPermission,MITNotice,MITAsIs,MITLiability", MIT + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "MITPermission,MITNotice,MITAsIs", MIT),
    ("MIT", "MITPermission,MITNotice", MIT[: MIT.index("THE SOFTWARE IS")]),
    ("Apache-2.0", "ApacheRef,ApacheCompliance,ApacheCopyAt,ApacheAsIs,ApacheSee", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0-or-later", "GPL3OrLater,GPLNoWarranty,GPLSee,GPLReceived", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\n" + GPL_REST + ".  If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-2.0-or-later", "GPL2OrLater,GPLNoWarranty,GPLSee,GPLReceived", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\n\n" + GPL_REST + "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("GPL-3.0-or-later", "GPL3OrLater", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "GPL2OrLater", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "LGPL21OrLater", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "BSDPermission,BSDSource,BSDBinary,BSDEndorse", BSD_2 + "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "BSDPermission,BSDSource,BSDBinary", BSD_2),
    ("MPL-2.0", "MPL2Subject,MPL2Copy", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "MPL2Subject", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", "MITRef", "This project is licensed under the MIT License."),
    ("Apache-2.0", "ApacheRef", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "GPL3Ref", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "GPL2Ref", "Licensed under the GNU General Public License, version 2."),
    ("ISC", "ISCPermission", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "CCBYNC4Ref", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "CCBY4Ref", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "CCBYSA4Ref", "Licensed under CC BY-SA 4.0."),
    ("LicenseRef-all-rights-reserved", "AllRights", "All rights reserved."),
]


def forms(notice):
    """The notice as it stands, wrapped, and in comments."""
    head = "Copyright (C) 2020 Some One\n\n"
    yield notice
    for width in (28, 60, 72):
        lines = (head + "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in notice.split("\n\n"))).split("\n")
        yield "\n".join(lines)
        yield "/*\n" + "\n".join(f" * {x}".rstrip() for x in lines) + "\n */\nint x;"
        for mark in ("#", "//", ";", "%", ">"):
            yield "\n".join(f"{mark} {x}".rstrip() for x in lines) + "\ncode"


@pytest.mark.parametrize("name,ids,notice", NOTICES)
def test_notices_in_all_forms(name, ids, notice):
    ids = ids.split(",")
    for text in forms(notice):
        _, got, names, rest = licenses.scan_text(text)
        assert (names, [i for i in got if i in ids]) == ([name], ids) and set(rest) <= {"GNUWriteTo"}, text


@pytest.mark.parametrize("rule,name", licenses.RULES, ids=lambda x: x if isinstance(x, str) else "+".join(x))
def test_every_rule_in_all_forms(rule, name):
    """A text of each rule's sentences, every variant of each, as it stands, wrapped at several widths and in comments of several kinds."""
    said = {i: [t for j, t in licenses.SENTENCES if j == i] for i in rule}
    for k in range(max(map(len, said.values()))):
        notice = "\n\n".join(said[i][k % len(said[i])] for i in rule)
        for text in forms(notice if notice[-1] in ".:;" else notice + "."):
            _, got, names, rest = licenses.scan_text(text)
            assert (names, got, rest) == ([name], list(rule), []), text


def plain_scan(text):
    """(sentences, ids, licences) by comparing word for word with every known sentence at every place, and rule for rule."""
    spans, k = [], 0
    while k < len(text):
        if not text[k].isalnum():
            k += 1
            continue
        a = k
        while k < len(text) and (text[k].isalnum() or text[k] == "." and k + 1 < len(text) and text[k + 1].isalnum()):
            k += 1
        spans.append((a, k))
    said = [text[a:b].lower() for a, b in spans]
    gaps = [text[:spans[0][0]]] if spans else []
    gaps += [text[b:a] for (_, b), (a, _) in zip(spans, spans[1:] + [(len(text), 0)], strict=True)]  # gaps[w] lies before word w
    cut = lambda g: any(c in ".;:!?" and g[i + 1 : i + 2].isspace() for i, c in enumerate(g))
    empty = lambda g: g.count("\n") > 1 and "_" not in g
    begins = [w == 0 or "\n" in g or any(c in ".;:!?" and g[i + 1 : i + 2].isspace() for i, c in enumerate(g)) for w, g in enumerate(gaps[:-1])]

    def ends(w):  # a sentence may end with this word
        g, after = gaps[w + 1], spans[w + 1][0] if w + 1 < len(spans) else None
        mark = any(c in ".;:!?" and (i + 1 == len(g) and after is None or i + 1 < len(g) and g[i + 1] not in ".;:!?_") for i, c in enumerate(g))
        return after is None or mark or empty(g) or "\n" in g and (text[after].isupper() or text[after].isdigit())

    known = [(licenses.words(t), i) for i, t in licenses.SENTENCES]
    n, ids, w, fresh = 0, [], 0, True
    while w < len(said):
        if fresh:
            n, fresh = n + 1, False
        fits = [(len(x), i) for x, i in known if begins[w] and said[w : w + len(x)] == x and ends(w + len(x) - 1)]
        size, i = max(fits, default=(1, None))
        if i:
            ids.append(i)
        w += size
        fresh = cut(gaps[w]) or empty(gaps[w])
    own, names, at = [i for i in ids if any(i in rule for rule, _ in licenses.RULES)], [], 0
    while at < len(own):
        size, name = max(((len(rule), name) for rule, name in licenses.RULES if tuple(own[at : at + len(rule)]) == rule), default=(1, None))
        names += [name] if name else []
        at += size
    return n, ids, names


def test_same_as_plain_on_the_table():
    docs = duckdb.sql(f"SELECT text FROM '{DATA}/sf0.001/documents.parquet'").fetchall()
    found = 0
    for (text,) in docs:
        n, ids, names, _ = licenses.scan_text(text)
        assert (n, ids, names) == plain_scan(text or "")
        found += len(names)
    assert found > 3


def test_same_as_plain_on_random_texts():
    rng = random.Random(12)
    texts = [t for _, t in licenses.SENTENCES]
    marks = [" ", "\n", "\n\n", ". ", "; ", "\n * ", "\n# ", "\n//\n", " ", ",", "...\n", "? ", " \u6f22 ", "\n1. ", "!x", "\t", ". \n", "(", '." ']
    for _ in range(700):
        out = []
        for _ in range(rng.randint(1, 8)):
            t = rng.choice(texts)
            if rng.random() < 0.3:
                w = t.split(" ")
                t = " ".join(w[: rng.randint(1, len(w))])
            if rng.random() < 0.5:
                t = t.rstrip(".:;")
            if rng.random() < 0.4:
                t = rng.choice(marks).join(t.split(" ", rng.randint(1, 9)))
            out += [t, rng.choice(marks)]
        text = "".join(out)
        assert licenses.scan_text(text)[:3] == plain_scan(text), text


def test_repeated_rows(spark):
    got = licenses.scan(documents(spark, [(1, "All rights reserved."), (1, "All rights reserved."), (None, "x")])).collect()
    assert [(r.doc_id, r.licenses) for r in got] == [(1, ["LicenseRef-all-rights-reserved"])] * 2


def test_cuts_still_count():
    assert licenses.sentence_ids("All rights reserved. \u6f22\u5b57. Some text; more.") == (4, ["AllRights"])
    assert licenses.sentence_ids("This program is free software: it costs nothing. Enjoy.") == (3, [])
