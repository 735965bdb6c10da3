"""License scans by patience alignment.

A template is aligned with the stretch of text around its rare words: words
that occur once in both are anchors, the longest increasing run of anchors is
kept, and the gaps between anchors are aligned in the same way. Coverage is the
share of the template's words that are matched; a template with coverage of
``COVERAGE`` or more is found. Templates are notices and the whole texts of the
short licenses; long licenses are found by their notices, titles and SPDX tags.
Of finds that overlap, the one with the most matched words stays, and among
equals the one with the higher coverage, then the first.

Words that tell one license from another (names, and in notices the numbers of
versions) must be matched whatever the coverage, and none of another license may
stand between the matched words. A template of ``WHOLE`` words or fewer is found
only word for word.

Looking only around rare words misses none: a template with n words must have
all but ``floor(0.2 n)`` of them matched, so one of its ``floor(0.2 n) + 1``
rarest words is among them. A find spans less than ``SPAN`` times n words, so it
lies in a stretch of that many words that holds the rare word. Every such
stretch that starts with a word of the template is aligned, unless it shares too
few words with the template to better what is found; of templates up to
``SHORT`` words every narrower stretch is aligned too, so that words behind the
find do not disturb its anchors.

SPDX tags name their license themselves; they are read, not aligned.

Texts are scanned whole, row by row, in the task that reads them; nothing is
shuffled.

Defined cases: null and empty texts have no finds; repeated rows are scanned
each; an empty table gives an empty result; unnamed columns are ignored or,
where carried, pass through unread; a carried column named ``finds`` is returned
as ``finds_in``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.runtime import by_bytes

COVERAGE = 0.8
#: Words from the first matched to the last, by words of the template.
SPAN = 1.5
#: Words of the templates that are aligned with narrower stretches too, and of those found word for word only.
SHORT, WHOLE = 40, 4

#: Words that name a license. Those of a template must be matched, others must not stand inside a find of a notice.
NAMES = frozenset(
    "affero agpl agplv3 apache artistic boost bsd cc cc0 clause eclipse eupl gpl gplv1 gplv2 gplv3 isc lesser lgpl lgplv2 lgplv2.1 lgplv3 mit mozilla mpl nc nd noderivatives noncommercial sa sharealike sil unencumbered zlib".split()
)

#: Notices by license identifier.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0"),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("Proprietary", "All rights reserved"),
    ("BSD-2-Clause", "under the terms of the BSD 2-Clause License"),
    ("BSD-3-Clause", "under the terms of the BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("ISC", "ISC License"),
    ("Zlib", "zlib License"),
    ("BSL-1.0", "Boost Software License - Version 1.0"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EUPL", "Licensed under the EUPL"),
    ("MIT", "MIT licensed"),
    ("MIT", "License: MIT"),
    ("Apache", "Licensed under the Apache License"),
    ("BSD", "Licensed under the BSD License"),
    ("GPL", "Licensed under the GPL License"),
    ("GPL", "Licensed under the GPL"),
    ("GPL", "Licensed under the GNU General Public License"),
    ("LGPL", "Licensed under the LGPL"),
    ("LGPL", "Licensed under the GNU Lesser General Public License"),
    ("EUPL-1.2", "European Union Public Licence v. 1.2"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("WTFPL", "Do What The Fuck You Want To Public License"),
    ("Artistic-2.0", "The Artistic License 2.0"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
)

#: The words of the short licenses, put together from the parts they share.
_AS_IS_HOLDERS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_BEGIN = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_MIT_TERMS = 'subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_MIT_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
LICENSES = (
    ("MIT", f"{_MIT_GRANT}, {_MIT_TERMS} {_MIT_AS_IS}"),
    ("MIT-0", f"{_MIT_GRANT}. {_MIT_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD_BEGIN} {_AS_IS_HOLDERS}"),
    ("BSD-3-Clause", f"{_BSD_BEGIN} {_BSD_THIRD} {_AS_IS_HOLDERS}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_AS_IS}"),
    ("0BSD", f"{_ISC_GRANT}. {_ISC_AS_IS}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_MIT_AS_IS.replace('OR COPYRIGHT HOLDERS ', '')}"),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.'),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
)

#: The terms of the Creative Commons licenses and their versions.
CC_TERMS = {"": "", "-SA": "-ShareAlike", "-NC": "-NonCommercial", "-ND": "-NoDerivatives", "-NC-SA": "-NonCommercial-ShareAlike", "-NC-ND": "-NonCommercial-NoDerivatives"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
CREATIVE_COMMONS = tuple(
    (f"CC-BY{short}-{version}", text)
    for version in CC_VERSIONS
    for short, long in CC_TERMS.items()
    for text in (f"Licensed under CC BY{short} {version}", f"CC BY{short} {version}", f"Creative Commons Attribution{long} {version} {'International' if version == '4.0' else 'Unported'} License", f"Creative Commons Attribution{long} {version}")
)
#: The GNU licenses and their versions.
GNU_VERSIONS = (("GPL", "", ("1", "2", "3")), ("LGPL", "Lesser ", ("2", "2.1", "3")), ("AGPL", "Affero ", ("3",)))
GNU = tuple(
    (f"{short}-{version if '.' in version else version + '.0'}", text)
    for short, word, versions in GNU_VERSIONS
    for version in versions
    for title in [f"GNU {word}General Public License version {version}"]
    for text in (title, f"Licensed under the {title}", f"{short}v{version}", f"{short}-{version if '.' in version else version + '.0'}")
)
TEMPLATES = (*NOTICES, *CREATIVE_COMMONS, *GNU, *LICENSES)

_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*(\(?[A-Za-z0-9][A-Za-z0-9.+-]*(?:(?:[ \t]+(?:AND|OR|WITH)[ \t]+|[ \t]*[()][ \t]*)\(?[A-Za-z0-9][A-Za-z0-9.+-]*\)?)*)", re.I)

#: Words too common to look for.
COMMON = frozenset("a all and any are at be by for form free in into is may not of or permitted provided public source subject terms that the this to under use version with without work you".split())

_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def words_of(text: str) -> tuple[list[str], list[int], list[int]]:
    """Lower-case words with their start and end offsets."""
    found = list(_WORD.finditer(text.lower()) if len(text.lower()) == len(text) else _WORD.finditer("".join(c if len(c.lower()) != 1 else c.lower() for c in text)))
    return [m[0] for m in found], [m.start() for m in found], [m.end() for m in found]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first, whose seconds increase."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        tails[k : k + 1] = [j]
        ends[k : k + 1] = [n]
        back.append(ends[k - 1] if k else -1)
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of two word lists, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo >= ahi or blo >= bhi:
            continue
        ours, theirs = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        at = {w: j for j, w in enumerate(b[blo:bhi], blo) if theirs[w] == 1}
        anchors = _increasing([(i, at[w]) for i, w in enumerate(a[alo:ahi], alo) if ours[w] == 1 and w in at])
        if not anchors:
            continue
        out += anchors
        edges = [(alo - 1, blo - 1), *anchors, (ahi, bhi)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Scanner:
    def __init__(self, notices=TEMPLATES, coverage: float = COVERAGE):
        self.coverage = coverage
        self.notices = [(name, words_of(text)[0]) for name, text in notices]
        self.rare: dict[str, list[int]] = {}
        self.needed = [needed(ws) for _, ws in self.notices]
        for k, (_, ws) in enumerate(self.notices):
            spare = int((1 - coverage) * len(ws) + 1e-9)
            # taken as rarest: the longest words that are not common ones; every occurrence counts as a word of its own
            for w in set(sorted(ws, key=lambda w: (w in COMMON, -len(w), w))[: spare + 1]):
                self.rare.setdefault(w, []).append(k)
        # texts repeat their notices: the same stretch is aligned once
        self.aligned = lru_cache(maxsize=20_000)(self._aligned)

    def _aligned(self, k: int, window: tuple[str, ...], centre: int) -> tuple[int, ...]:
        notice = self.notices[k][1]
        return tuple(i for i, _ in best_alignment(list(window), notice, centre, self.coverage, self.needed[k]))

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, matched words, start, end) in characters, in order."""
        tags = [(m[1], 1.0, len(words_of(m[0])[0]), m.start(), m.end()) for m in _SPDX.finditer(text)] if "spdx" in text.lower() else []
        low = text.lower()
        if not any(w in low for w in self.rare):
            return tags
        words, starts, ends = words_of(text)
        finds: list[tuple[int, float, int, int, str]] = []
        done = [-1] * len(self.notices)
        for at, w in enumerate(words):
            for k in self.rare.get(w, ()):
                if at <= done[k]:
                    continue
                name, notice = self.notices[k]
                reach = math.ceil(SPAN * len(notice))
                left = max(0, at - reach, done[k] + 1)
                matched = self.aligned(k, tuple(words[left : at + reach + 1]), at - left)
                share = len(matched) / len(notice)
                if share >= self.coverage and matched[-1] - matched[0] < SPAN * len(notice):
                    finds.append((len(matched), share, left + matched[0], left + matched[-1], name))
                    done[k] = left + matched[-1]
        found = [(name, share, n, starts[lo], ends[hi]) for n, share, lo, hi, name in finds]
        return sorted(apart([*found, *tags]), key=lambda f: f[3])


def apart(finds: list[tuple[str, float, int, int, int]]) -> list[tuple[str, float, int, int, int]]:
    """The finds that stay where some overlap: the most matched words first, then the higher coverage, then the first."""
    begins: list[int] = []
    stops: list[int] = []
    taken = []
    for f in sorted(finds, key=lambda f: (-f[2], -f[1], f[3], f[0])):
        k = bisect_left(begins, f[4])
        # taken ones lie apart, so only the last that begins before the end can overlap
        if k == 0 or stops[k - 1] <= f[3]:
            begins.insert(k, f[3])
            stops.insert(k, f[4])
            taken.append(f)
    return taken


def needed(notice: list[str]) -> frozenset[str]:
    """The words of a template that must be matched: names, and in notices numbers and what parts a name."""
    own = {w for w in notice if w in NAMES}
    if len(notice) <= SHORT:
        own |= {w for w in notice if w[0].isdigit()} | ({"by"} & set(notice) if "cc" in notice else set())
    return frozenset(own)


def tells(window: list[str], notice: list[str], pairs: list[tuple[int, int]], must: frozenset[str]) -> bool:
    """Whether an alignment matches the words that it must, and, for a notice, spans no name of another license."""
    if not pairs:
        return False
    matched = {j for _, j in pairs}
    if any(w in must and j not in matched for j, w in enumerate(notice)):
        return False
    first, last = pairs[0][0], pairs[-1][0]
    if len(notice) <= WHOLE and (len(pairs) < len(notice) or last - first >= len(notice)):
        return False
    held = {i for i, _ in pairs}
    return len(notice) > SHORT or not any(w in NAMES and i not in held for i, w in enumerate(window[first : last + 1], first))


def best_alignment(window: list[str], notice: list[str], centre: int, coverage: float = COVERAGE, must: frozenset[str] | None = None) -> list[tuple[int, int]]:
    """The alignment with the most matches among the stretches around ``centre`` that a find may span, and that tells the license; of equals the first.

    Stretches start with a word of the template. The template in place, word
    for word, needs no search.
    """
    n, must = len(notice), needed(notice) if must is None else must
    for j in (j for j, w in enumerate(notice) if w == window[centre]):
        if j <= centre and window[centre - j : centre - j + n] == notice:
            return [(centre - j + i, i) for i in range(n)]
    widest = math.ceil(SPAN * n)
    need, wanted = math.ceil(coverage * n - 1e-9), Counter(notice)
    low, high = max(0, centre - widest + 1), min(len(window), centre + widest)
    best: list[tuple[int, int]] = []
    if n <= WHOLE or (Counter(window[low:high]) & wanted).total() < need or not must.issubset(window[low:high]):
        return best
    cuts = []  # narrower or not, width, start, words in common at most
    if n <= SHORT:
        for start in range(low, centre + 1):
            if window[start] not in wanted:
                continue
            left, common = dict(wanted), 0
            for end in range(start, min(high, start + widest)):
                if left.get(window[end], 0):
                    left[window[end]] -= 1
                    common += 1
                if end >= centre and common >= need and window[end] in wanted:
                    cuts.append((end + 1 - start, start, common))
        cuts.sort()
    else:
        held = Counter(window[low : low + widest])
        common = sum(min(c, held[w]) for w, c in wanted.items())
        for start in range(low, centre + 1):
            if common >= need and window[start] in wanted:
                cuts.append((min(widest, high - start), start, common))
            # the stretch moves on by a word
            gone, come = window[start], window[start + widest] if start + widest < len(window) else None
            if held[gone] <= wanted[gone]:
                common -= 1
            held[gone] -= 1
            if come is not None:
                held[come] += 1
                common += held[come] <= wanted[come]
        # the stretches that share the most come first
        cuts.sort(key=lambda c: (-c[2], c[1]))
    for width, start, common in cuts:
        if common > len(best):
            part = window[start : start + width]
            found = patience(part, notice)
            if len(found) > len(best) and len(found) >= need and found[-1][0] - found[0][0] < SPAN * n and tells(part, notice, found, must):
                best = [(i + start, k) for i, k in found]
    return best


def scan_licenses(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), notices=TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """The carried columns and ``finds``: array of (license, coverage, matched, start, end)."""
    inputs = docs.select(F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    schema = T.StructType([*inputs.schema.fields[1:], T.StructField("finds", T._parse_datatype_string("array<struct<license:string,coverage:double,matched:int,start:int,end:int>>"))])

    def run(batches):
        import pyarrow as pa

        scanner = Scanner(notices, coverage)
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in (part for whole in batches for part in by_bytes(whole, 0)):
            found = [[dict(zip(("license", "coverage", "matched", "start", "end"), f, strict=True)) for f in scanner.scan(x or "")] for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, kind)], names=[*batch.schema.names[1:], "finds"])

    return inputs.mapInArrow(run, schema).withColumnsRenamed({f"_c{i}": f"{c}_in" if c == "finds" else c for i, c in enumerate(carry)})


def op9_license_scan(spark, sf_dir):
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        F.size("finds").cast("long").alias("n_finds"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("finds", lambda f: f["license"]))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("finds", lambda f: f["coverage"])), F.lit(0.0)).alias("coverage"),
        F.transform("finds", lambda f: F.struct(f["license"].alias("license"), f["start"].alias("start"), f["end"].alias("end"))).alias("spans"),
    )
