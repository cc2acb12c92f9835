"""Licence scan by sentences.

Method: sentence-rule recognition. A text is a row of words (letters and digits of any script, lower case; dots inside stay, all other marks and the
marks that begin lines of comments or lists are no words). Sentences begin at the start of a line and behind a mark that ends one (``. ; : ! ?`` before white
space); they end at such a mark (before anything but a letter or digit), at an empty line (or one of comment marks alone), at a line whose successor begins with a capital or a digit, and at the end of the text. From
each beginning the words are followed through a trie of the known licence sentences for as long as it goes on, over line ends and marks inside, and the
longest known sentence that ends where one may end is taken: wrapped, commented and indented copies of a sentence are the same words. Variants of a
sentence share an identifier.

The identifiers of a text, in order, are matched against ordered rules: a rule names a licence by the identifiers that must follow each other. Identifiers
that are in no rule (titles of sections, disclaimers) may lie between and don't matter; any other one between breaks a rule. At each place the longest rule is taken, by a
trie over identifiers, and what it used is not used again. Known sentences that no rule takes are leftovers. Licence names in ``SPDX-License-Identifier:`` lines are
taken as they stand.

Both walks are linear: no text, sentence or gap is too long to be looked at. The tables are small, fixed and go out with the function; a text is scanned
on its own, without a shuffle. Null and empty texts have no sentence and no licence, and an empty table no rows. Repeats of a licence in a text count, repeated rows are
scanned each for itself; where two known sentences could begin at a place the longer one is taken, so there are no ties. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from densefold.llm.common import column, id_text

# Sentences of public licences and notices, word for word, with their ids.
SENTENCES = [
    ("AllRights", "All rights reserved."),
    ("MITTitle", "MIT License"),
    ("MITTitle", "The MIT License (MIT)"),
    ("MITTitle", "The MIT License"),
    ("MITRef", "Released under the MIT License."),
    ("MITRef", "Licensed under the MIT License."),
    ("MITRef", "This project is licensed under the MIT License."),
    ("MITRef", "This software is released under the MIT License."),
    ("MITRef", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    ("MITPermission", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT0Permission", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.'),
    ("MITNotice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MITNotice", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."),
    ("MITAsIs", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("MITAsIs", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NON-INFRINGEMENT.'),
    ("MITLiability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("JSONGood", "The Software shall be used for Good, not Evil."),
    ("X11Names", "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium."),
    ("NCSAPermission", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("NCSATitle", "University of Illinois/NCSA Open Source License"),
    ("ApacheTitle", "Apache License Version 2.0, January 2004"),
    ("ApacheTerms", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("ApacheRef", "Licensed under the Apache License, Version 2.0."),
    ("ApacheRef", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("ApacheRef", "This project is licensed under the Apache License, Version 2.0."),
    ("ApacheRef", "Released under the Apache License, Version 2.0."),
    ("ApacheCompliance", "you may not use this file except in compliance with the License."),
    ("ApacheCopyAt", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheCopyAt", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheAsIs", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("ApacheSee", "See the License for the specific language governing permissions and limitations under the License."),
    ("GNUVerbatim", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL2Title", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL3Title", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL21Title", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL3Title", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL3Title", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GFDL13Title", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("GPL3Ref", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL3Ref", "Licensed under the GNU General Public License, version 3."),
    ("GPL2Ref", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL2Ref", "Licensed under the GNU General Public License, version 2."),
    ("GPL3OrLater", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL2OrLater", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL2Only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL2Only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."),
    ("GPL3Only", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."),
    ("AGPL3OrLater", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPLNoWarranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("GPLSee", "See the GNU General Public License for more details."),
    ("GPLReceived", "You should have received a copy of the GNU General Public License along with this program."),
    ("AGPLSee", "See the GNU Affero General Public License for more details."),
    ("AGPLReceived", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("GNUWriteTo", "if not, see <https://www.gnu.org/licenses/>."),
    ("GNUWriteTo", "if not, see <http://www.gnu.org/licenses/>."),
    ("LGPL21OrLater", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL3OrLater", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("LGPL3OrLater", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPLNoWarranty", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("LGPLSee", "See the GNU Lesser General Public License for more details."),
    ("LGPLReceived", "You should have received a copy of the GNU Lesser General Public License along with this library."),
    ("LGPLReceived", "You should have received a copy of the GNU Lesser General Public License along with this program."),
    ("GFDL13Permission", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation;"),
    ("BSDPermission", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSDSource", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSDBinary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSDAdvertising", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("BSDEndorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSDEndorse", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSDAsIs", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("BSDLiability", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSDRef", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL2Title", "Mozilla Public License Version 2.0"),
    ("MPL2Subject", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL2Copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL2Copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL11Subject", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.'),
    ("ISCPermission", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISCPermission", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSDPermission", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISCAsIs", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("ISCLiability", "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("PostgreSQLPermission", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    ("HPNDPermission", "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation."),
    ("ZlibAsIs", "This software is provided 'as-is', without any express or implied warranty."),
    ("ZlibLiability", "In no event will the authors be held liable for any damages arising from the use of this software."),
    ("ZlibPermission", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("ZlibOrigin", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("ZlibAltered", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."),
    ("ZlibNotice", "This notice may not be removed or altered from any source distribution."),
    ("BoostTitle", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BoostRef", "Distributed under the Boost Software License, Version 1.0."),
    ("BoostPermission", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("UnlicenseAnyone", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("WTFPLTitle", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004"),
    ("WTFPLZero", "You just DO WHAT THE FUCK YOU WANT TO."),
    ("Beerware", "As long as you retain this notice you can do whatever you want with this stuff."),
    ("EPL1", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL2Title", "Eclipse Public License - v 2.0"),
    ("CDDL1", "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\")."),
    ("EUPL12", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL."),
    ("EUPL12", "Licensed under the EUPL, Version 1.2 only."),
    ("EUPL12", "European Union Public Licence v. 1.2"),
    ("MSPL", 'This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software.'),
    ("MSPLTitle", "Microsoft Public License (Ms-PL)"),
    ("Artistic2Title", "The Artistic License 2.0"),
    ("Artistic2Ref", "This is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("PerlRef", "This is free software; you can redistribute it and/or modify it under the same terms as the Perl 5 programming language system itself."),
    ("OFL11", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("OFL11Title", "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007"),
    ("PSF2", 'This LICENSE AGREEMENT is between the Python Software Foundation ("PSF"), and the Individual or Organization ("Licensee") accessing and otherwise using this software ("Python") in source or binary form and its associated documentation.'),
    ("CC0Title", "CC0 1.0 Universal"),
    ("CC0Ref", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0Ref", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("CCBY4Ref", "Licensed under CC BY 4.0."),
    ("CCBY4Ref", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CCBYSA4Ref", "Licensed under CC BY-SA 4.0."),
    ("CCBYSA4Ref", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CCBYNC4Ref", "Licensed under CC BY-NC 4.0."),
    ("CCBYNC4Ref", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CCBYND4Ref", "Licensed under CC BY-ND 4.0."),
    ("CCBYND4Ref", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CCBYNCSA4Ref", "Licensed under CC BY-NC-SA 4.0."),
    ("CCBYNCSA4Ref", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CCBYNCND4Ref", "Licensed under CC BY-NC-ND 4.0."),
    ("CCBYNCND4Ref", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CCBY3Ref", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CCBYSA3Ref", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
]
# Ordered rules, sentence ids and the licence they make together.
RULES = [
    (("MITPermission", "MITNotice", "MITAsIs", "MITLiability"), "MIT"),
    (("MITPermission", "MITNotice", "MITAsIs"), "MIT"),
    (("MITPermission", "MITNotice"), "MIT"),
    (("MITRef",), "MIT"),
    (("MIT0Permission", "MITAsIs", "MITLiability"), "MIT-0"),
    (("MIT0Permission",), "MIT-0"),
    (("MITPermission", "MITNotice", "JSONGood", "MITAsIs", "MITLiability"), "JSON"),
    (("MITPermission", "MITNotice", "JSONGood"), "JSON"),
    (("MITPermission", "MITNotice", "MITAsIs", "MITLiability", "X11Names"), "X11"),
    (("NCSAPermission",), "NCSA"),
    (("ApacheTitle",), "Apache-2.0"),
    (("ApacheRef", "ApacheCompliance", "ApacheCopyAt", "ApacheAsIs", "ApacheSee"), "Apache-2.0"),
    (("ApacheRef", "ApacheCompliance", "ApacheCopyAt"), "Apache-2.0"),
    (("ApacheRef",), "Apache-2.0"),
    (("GPL2Title",), "GPL-2.0"),
    (("GPL3Title",), "GPL-3.0"),
    (("LGPL21Title",), "LGPL-2.1"),
    (("LGPL3Title",), "LGPL-3.0"),
    (("AGPL3Title",), "AGPL-3.0"),
    (("GFDL13Title",), "GFDL-1.3"),
    (("GPL3OrLater", "GPLNoWarranty", "GPLSee", "GPLReceived"), "GPL-3.0-or-later"),
    (("GPL3OrLater",), "GPL-3.0-or-later"),
    (("GPL2OrLater", "GPLNoWarranty", "GPLSee", "GPLReceived"), "GPL-2.0-or-later"),
    (("GPL2OrLater",), "GPL-2.0-or-later"),
    (("GPL3Only", "GPLNoWarranty", "GPLSee", "GPLReceived"), "GPL-3.0-only"),
    (("GPL3Only",), "GPL-3.0-only"),
    (("GPL3Ref",), "GPL-3.0-only"),
    (("GPL2Only", "GPLNoWarranty", "GPLSee", "GPLReceived"), "GPL-2.0-only"),
    (("GPL2Only",), "GPL-2.0-only"),
    (("GPL2Ref",), "GPL-2.0-only"),
    (("AGPL3OrLater", "GPLNoWarranty", "AGPLSee", "AGPLReceived"), "AGPL-3.0-or-later"),
    (("AGPL3OrLater",), "AGPL-3.0-or-later"),
    (("LGPL21OrLater", "LGPLNoWarranty", "LGPLSee", "LGPLReceived"), "LGPL-2.1-or-later"),
    (("LGPL21OrLater",), "LGPL-2.1-or-later"),
    (("LGPL3OrLater", "LGPLNoWarranty", "LGPLSee", "LGPLReceived"), "LGPL-3.0-or-later"),
    (("LGPL3OrLater",), "LGPL-3.0-or-later"),
    (("GFDL13Permission",), "GFDL-1.3-or-later"),
    (("BSDPermission", "BSDSource", "BSDBinary", "BSDAdvertising", "BSDEndorse"), "BSD-4-Clause"),
    (("BSDPermission", "BSDSource", "BSDBinary", "BSDEndorse"), "BSD-3-Clause"),
    (("BSDPermission", "BSDSource", "BSDBinary"), "BSD-2-Clause"),
    (("BSDRef",), "LicenseRef-BSD-style"),
    (("MPL2Title",), "MPL-2.0"),
    (("MPL2Subject", "MPL2Copy"), "MPL-2.0"),
    (("MPL2Subject",), "MPL-2.0"),
    (("MPL11Subject",), "MPL-1.1"),
    (("ISCPermission", "ISCAsIs", "ISCLiability"), "ISC"),
    (("ISCPermission",), "ISC"),
    (("0BSDPermission", "ISCAsIs", "ISCLiability"), "0BSD"),
    (("0BSDPermission",), "0BSD"),
    (("PostgreSQLPermission",), "PostgreSQL"),
    (("HPNDPermission",), "HPND"),
    (("ZlibAsIs", "ZlibLiability", "ZlibPermission", "ZlibOrigin", "ZlibAltered", "ZlibNotice"), "Zlib"),
    (("ZlibPermission",), "Zlib"),
    (("BoostTitle", "BoostPermission"), "BSL-1.0"),
    (("BoostTitle",), "BSL-1.0"),
    (("BoostPermission",), "BSL-1.0"),
    (("BoostRef",), "BSL-1.0"),
    (("Unlicense", "UnlicenseAnyone"), "Unlicense"),
    (("Unlicense",), "Unlicense"),
    (("WTFPLTitle", "WTFPLZero"), "WTFPL"),
    (("WTFPLTitle",), "WTFPL"),
    (("Beerware",), "Beerware"),
    (("EPL1",), "EPL-1.0"),
    (("EPL2",), "EPL-2.0"),
    (("EPL2Title",), "EPL-2.0"),
    (("CDDL1",), "CDDL-1.0"),
    (("EUPL12",), "EUPL-1.2"),
    (("MSPLTitle", "MSPL"), "MS-PL"),
    (("MSPLTitle",), "MS-PL"),
    (("Artistic2Title",), "Artistic-2.0"),
    (("Artistic2Ref",), "Artistic-2.0"),
    (("PerlRef",), "Artistic-1.0-Perl OR GPL-1.0-or-later"),
    (("OFL11", "OFL11Title"), "OFL-1.1"),
    (("OFL11",), "OFL-1.1"),
    (("OFL11Title",), "OFL-1.1"),
    (("PSF2",), "PSF-2.0"),
    (("CC0Title",), "CC0-1.0"),
    (("CC0Ref",), "CC0-1.0"),
    (("CCBY4Ref",), "CC-BY-4.0"),
    (("CCBYSA4Ref",), "CC-BY-SA-4.0"),
    (("CCBYNC4Ref",), "CC-BY-NC-4.0"),
    (("CCBYND4Ref",), "CC-BY-ND-4.0"),
    (("CCBYNCSA4Ref",), "CC-BY-NC-SA-4.0"),
    (("CCBYNCND4Ref",), "CC-BY-NC-ND-4.0"),
    (("CCBY3Ref",), "CC-BY-3.0"),
    (("CCBYSA3Ref",), "CC-BY-SA-3.0"),
    (("AllRights",), "LicenseRef-all-rights-reserved"),
]
# The form of a licence identifier line.
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*(\(?[A-Za-z0-9.+-]+\)?(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(?[A-Za-z0-9.+-]+\)?)*)")
_WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")
#: Where a sentence may begin: behind a mark that ends one, and at each line.
_BEGIN = re.compile(r"[.;:!?]+(?=\s)|\n")
#: In what lies between two words: that a sentence ends. An empty line may hold comment marks.
_MARK = re.compile(r"[.;:!?](?=[^\w.;:!?])")
_EMPTY = re.compile(r"\n[^\w\n]*\n")


def words(sentence: str) -> list[str]:
    return _WORD.findall(sentence.lower())


def _trie(rows: list[tuple[list | tuple, str]]) -> dict:
    """Nested dictionaries; the key None holds what a row ends with."""
    root: dict = {}
    for parts, value in rows:
        node = root
        for x in parts:
            node = node.setdefault(x, {})
        node[None] = value
    return root


_SENTENCES = _trie([(words(s), i) for i, s in SENTENCES])
_RULES = _trie(RULES)
_IN_RULES = frozenset(i for rule, _ in RULES for i in rule)


def _ends(text: str, gap: str, after: int) -> bool:
    """Whether a sentence may end in a gap, whose next word (if any) begins at ``after``."""
    if after >= len(text) or _MARK.search(gap) or _EMPTY.search(gap):
        return True
    return "\n" in gap and (text[after].isupper() or text[after].isdigit())


def _known(text: str, at: int) -> tuple[str | None, int]:
    """Id and end of the longest known sentence whose first word begins at this place."""
    node, found, end = _SENTENCES, None, at
    walk = _WORD.finditer(text, at)
    word = next(walk, None)
    while word is not None and (node := node.get(word[0].lower())) is not None:
        following = next(walk, None)
        if None in node:
            after = following.start() if following else len(text)
            if _ends(text, text[word.end() : after], after):
                found, end = node[None], word.end()
        word = following
    return found, end


def sentence_ids(text: str | None) -> tuple[int, list[str]]:
    """Number of sentences, and ids of the known ones in order. What lies between two marks or empty lines is a sentence if it has a word; a known one counts once whatever lies in it."""
    if not text:
        return 0, []
    n, ids, at, done, open_ = 0, [], 0, 0, False
    while at < len(text):
        cut = _BEGIN.search(text, at)
        to = cut.end() if cut else len(text)
        word = _WORD.search(text, max(at, done), cut.start() if cut else len(text))
        if word:
            if not open_:
                n, open_ = n + 1, True
            if word[0].lower() in _SENTENCES:
                known, end = _known(text, word.start())
                if known:
                    ids.append(known)
                    done = end
                    # The rest of the sentence's last piece is looked at from its end on.
                    cut = _BEGIN.search(text, end)
                    to = cut.end() if cut else len(text)
        if cut and (text[cut.start()] != "\n" or _EMPTY.match(text, cut.start())):
            open_ = False
        at = to
    return n, ids


def match(ids: list[str]) -> tuple[list[str], list[str]]:
    """Licences, in order of their first sentence, and the ids that no rule took."""
    own = [(k, i) for k, i in enumerate(ids) if i in _IN_RULES]
    found, rest, at = [], [(k, i) for k, i in enumerate(ids) if i not in _IN_RULES], 0
    while at < len(own):
        node, end, name = _RULES, at, None
        for j in range(at, len(own)):
            node = node.get(own[j][1])
            if node is None:
                break
            if None in node:
                end, name = j + 1, node[None]
        if name is None:
            rest.append(own[at])
            at += 1
        else:
            found.append(name)
            at = end
    return found, [i for _, i in sorted(rest)]


def scan_text(text: str | None) -> tuple[int, list[str], list[str], list[str]]:
    n, ids = sentence_ids(text)
    names, rest = match(ids)
    if text and "SPDX-License-Identifier:" in text:
        names += [m.strip() for m in _SPDX.findall(text)]
    return n, ids, names, rest


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, ids, names, rest = map(list, zip(*map(scan_text, column(batch, "text").to_pylist()), strict=True)) if batch.num_rows else ([], [], [], [])
        many = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(ids, many), pa.array(names, many), pa.array(rest, many)], ["doc_id", "n_sentences", "sentences", "licenses", "leftovers"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_sentences, sentences (known ids in order), licenses, leftovers."""
    return id_text(docs).mapInArrow(_scan, "doc_id long, n_sentences long, sentences array<string>, licenses array<string>, leftovers array<string>")
