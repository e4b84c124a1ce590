"""License notices in texts by patience alignment against templates.

Words that occur exactly once in the text window and once in the template are anchors; the longest
increasing subsequence of anchors is kept, and the gaps between neighbouring anchors are aligned
the same way. Coverage is the share of the template's words that are matched. The words that tell
licenses apart (name, version, NC, SA, Lesser) must be among them, with no foreign word between.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateweave.llm.common import text_slices

# Public license names and notices, in their published wording.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."),
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT-notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."),
    "BSD-notice": "Released under the BSD License.",
    "BSD-2-Clause-notice": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    "ISC-notice": "Released under the ISC License.",
    "Apache-2.0-short": "Licensed under the Apache License 2.0.",
    "Apache-1.1-notice": "Licensed under the Apache License, Version 1.1.",
    "MPL-2.0-notice": "Released under the Mozilla Public License 2.0.",
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "EPL-1.0-notice": "Made available under the terms of the Eclipse Public License v1.0.",
    "EPL-2.0-notice": "Made available under the terms of the Eclipse Public License 2.0.",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, "
        "and to alter it and redistribute it freely, subject to the following restrictions:"),
    "CC0-1.0-notice": "Licensed under CC0 1.0.",
    "CC0-1.0-long": "This work is licensed under a Creative Commons Zero 1.0 Universal License.",
    "reserved": "All rights reserved.",
}
COVERAGE = 0.8

_WORD = re.compile(r"\w+")


def _phrase(*words: str) -> str:
    """Words with nothing but signs between; a version's number goes on neither with a dot nor with a digit."""
    return r"\b" + r"\W+".join(words) + r"(?!\w|\.\d)"


def _version(number: str) -> str:
    whole = number.removesuffix(".0")
    return r"(?:(?:version|v)\W*)?" + re.escape(whole) + (r"(?:\.0)?" if whole != number else "")


# Words of a template that must align without a foreign word between; of a template without an entry, all words count alike.
KEYS = {
    "Apache-2.0-notice": _phrase("apache", "license", _version("2.0")),
    "Apache-2.0-short": _phrase("apache", "license", _version("2.0")),
    "Apache-2.0-header": _phrase("apache", "license", _version("2.0")),
    "Apache-1.1-notice": _phrase("apache", "license", _version("1.1")),
    "MIT-notice": _phrase("mit", "license"),
    "MIT": _phrase("permission", "notice", "shall", "be", "included", "in", "all"),
    "ISC": _phrase("with", "or", "without", "fee", "is", "hereby", "granted", "provided", "that"),
    "ISC-notice": _phrase("isc", "license"),
    "BSD-notice": _phrase("bsd", "license"),
    "BSD-2-Clause-notice": _phrase("(?:bsd", "2", "clause|2", "clause", "bsd)", "license"),
    "BSD-3-Clause-notice": _phrase("(?:bsd", "3", "clause|3", "clause", "bsd)", "license"),
    "BSD-2-Clause": _phrase("redistributions?", "in", "binary", "form", "must", "reproduce"),
    "BSD-3-Clause": _phrase("endorse", "or", "promote", "products", "derived", "from"),
    "MPL-2.0-notice": _phrase("mozilla", "public", "license", _version("2.0")),
    "MPL-2.0-header": _phrase("mozilla", "public", "license", _version("2.0")),
    "EPL-1.0-notice": _phrase("eclipse", "public", "license", _version("1.0")),
    "EPL-2.0-notice": _phrase("eclipse", "public", "license", _version("2.0")),
    "BSL-1.0-notice": _phrase("boost", "software", "license", _version("1.0")),
    "Unlicense": _phrase("free", "and", "unencumbered", "software"),
    "Zlib": _phrase("alter", "it", "and", "redistribute", "it", "freely"),
    "CC0-1.0-notice": _phrase("cc0", _version("1.0")),
    "CC0-1.0-long": _phrase("creative", "commons", "zero", _version("1.0")),
    "reserved": _phrase("all", "rights", "reserved"),
}

for _kind, _words in {"GPL": "", "LGPL": "Lesser ", "AGPL": "Affero "}.items():
    for _number in {"GPL": ("2.0", "3.0"), "LGPL": ("2.1", "3.0"), "AGPL": ("3.0",)}[_kind]:
        _said, _title = _number.removesuffix(".0"), f"GNU {_words}General Public License"
        _notice, _header = f"{_kind}-{_number}-notice", f"{_kind}-{_number}-header"
        TEMPLATES.setdefault(_notice, f"This work is licensed under the {_title}, version {_said}.")
        TEMPLATES.setdefault(_header, TEMPLATES["GPL-3.0-header"].replace("GNU General Public License", _title)
                             .replace("version 3", f"version {_said}"))
        _name = _title.lower().split()
        KEYS[_notice] = _phrase(*_name, _version(_number))
        KEYS[_header] = (_phrase(*_name, "as", "published") + r"[^.]{0,120}?"
                         + _phrase("version", _version(_number), "of", "the"))

_SPELT = {"Attribution": "attribution", "ShareAlike": r"share\W?alike", "NonCommercial": r"non\W?commercial",
          "NoDerivatives": r"no\W?deriv(?:ative)?s?(?:\W+works)?"}
for _kind, _words in {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
                      "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
                      "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items():
    for _number, _place in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic"),
                            ("1.0", "Generic")):
        _short = f"Licensed under CC {_kind} {_number}."
        _long = f"This work is licensed under a Creative Commons {_words} {_number} {_place} License."
        _parts = [_SPELT[w] for w in _words.split("-")]
        for _text, _key in ((_long, _phrase("creative", "commons", *_parts, _version(_number))),
                            (_short, _phrase("cc", *_kind.lower().split("-"), _version(_number)))):
            _name = f"CC-{_kind}-{_number}-notice"
            if TEMPLATES.setdefault(_name, _text) != _text:
                _name = f"CC-{_kind}-{_number}-" + ("short" if _text is _short else "long")
                TEMPLATES[_name] = _text
            KEYS[_name] = _key

TEMPLATES["MIT-title"] = "The MIT License"
TEMPLATES["MIT-head"] = "MIT License Copyright (c)"
KEYS["MIT-title"] = _phrase("the", "mit", "license")
KEYS["MIT-head"] = _phrase("mit", "license", "copyright")

# Public license identifiers.
IDENTIFIERS = [
    "0BSD", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0",
    "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-2.0-only",
    "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "OFL-1.1",
    "Unlicense", "WTFPL", "Zlib"]
IDENTIFIERS += [f"CC-{_kind}-{_number}" for _kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")
                for _number in ("1.0", "2.0", "2.5", "3.0", "4.0")]
# The words before an identifier; several identifiers of one expression share them.
LEAD = "SPDX-License-Identifier:"
# An identifier ends where nothing goes on that would make it another one.
_ENDS = r"(?![\w+]|[.-]\w)"

for _id in IDENTIFIERS:
    TEMPLATES[f"{_id}-spdx"] = f"{LEAD} {_id}"
    # It may stand behind others of an expression.
    KEYS[f"{_id}-spdx"] = (r"\b" + re.escape(LEAD) + r"[ \t(]*(?:[\w.+-]+[ \t)]+(?:or|and)[ \t(]+)*" + re.escape(_id) + _ENDS)
    if _id.startswith("CC"):
        continue
    _said = [_id]
    _gnu = re.fullmatch(r"(A?L?GPL)-(\d)\.(\d)", _id)
    if _gnu:
        _short = _gnu[2] + (f".{_gnu[3]}" if _gnu[3] != "0" else "")
        _said += [f"{_gnu[1]}v{_short}", f"GNU {_gnu[1]} v{_short}", f"GNU {_gnu[1]} version {_short}"]
    for _n, _text in enumerate(_said):
        _parts = _WORD.findall(_text.lower())
        # Of three or four words none may be missing, so each verb is a template of its own.
        for _verb in ("Licensed", "Released", "Distributed")[:3 if len(_parts) < 3 else 1]:
            _name = "-".join([_id, "brief", *([str(_n + 1)] if _n else []), *([_verb.lower()] if _verb != "Licensed" else [])])
            TEMPLATES[_name] = f"{_verb} under {_text}"
            KEYS[_name] = r"\bunder\W+(?:the\W+)?" + r"\W+".join(_parts) + _ENDS


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by patience sorting."""
    tops, ends, back = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile:
            back[i] = ends[pile - 1]
        if pile == len(tops):
            tops.append(v)
            ends.append(i)
        else:
            tops[pile], ends[pile] = v, i
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched (text, template) positions, increasing in both."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and text[a0] == template[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and text[a1 - 1] == template[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        here, there = Counter(text[a0:a1]), Counter(template[b0:b1])
        place = {w: j for j, w in enumerate(template[b0:b1], b0) if there[w] == 1 and here[w] == 1}
        both = [(i, place[w]) for i, w in enumerate(text[a0:a1], a0) if w in place]
        anchors = [both[i] for i in longest_increasing([j for _, j in both])]
        out += anchors
        if anchors:
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


class Scanner:
    """Templates with the tables that find where in a text an alignment is worth trying."""

    def __init__(self, templates: dict[str, str], coverage: float, keys: dict[str, str]):
        self.coverage = coverage
        self.names = list(templates)
        self.keys = [re.compile(keys[n], re.I) if n in keys else None for n in self.names]
        self.words = [_WORD.findall(templates[n].lower()) for n in self.names]
        self.counts = [Counter(w) for w in self.words]
        lead = _WORD.findall(LEAD.lower())
        self.lead = [len(lead) if w[:len(lead)] == lead else 0 for w in self.words]
        self.vocabulary = set().union(*self.counts) if self.counts else set()
        # As many words of each template as may be missing, and one more: a text has one of them. Long ones are rare.
        self.needs: dict[str, list[int]] = defaultdict(list)
        for t, words in enumerate(self.words):
            may_miss = int(len(words) * (1 - coverage) + 1e-9)
            for w in sorted(self.counts[t], key=lambda w: (-len(w), w))[:may_miss + 1]:
                self.needs[w].append(t)
        self.pairs: dict[tuple[str, str], list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            for q, pair in enumerate(zip(words, words[1:])):
                self.pairs[pair].append((t, q))

    def _open(self, t: int, have: Counter, text: str) -> bool:
        """No alignment can match more words than both sides share, nor do without the template's key."""
        left = len(self.words[t]) * (1 - self.coverage) + 1e-9
        for w, n in self.counts[t].items():
            if have[w] < n:
                left -= n - have[w]
                if left < 0:
                    return False
        return bool(self.words[t]) and (self.keys[t] is None or self.keys[t].search(text) is not None)

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first and last character) of every notice, in text order."""
        found = list(_WORD.finditer(text))
        words = [m[0].lower() for m in found]
        have = Counter(w for w in words if w in self.vocabulary)
        likely = {t for w in have for t in self.needs.get(w, ())}
        open_ = {t for t in likely if self._open(t, have, text)}
        if not open_:
            return []
        seeds: dict[int, list[int]] = defaultdict(list)
        for p, pair in enumerate(zip(words, words[1:])):
            for t, q in self.pairs.get(pair, ()):
                if t in open_:
                    seeds[t].append(p - q)
        out = []
        for t, starts in seeds.items():
            size = len(self.words[t])
            starts.sort()
            group = [starts[0]]
            for d in starts[1:] + [None]:
                if d is not None and d - group[-1] <= size // 2:
                    group.append(d)
                    continue
                slack = size // 2 + 2
                lo, hi = max(0, group[0] - slack), min(len(words), group[-1] + size + slack)
                self._window(t, text, found, words, lo, hi, out)
                group = [d]
        return self._best(out, found)

    def _fits(self, t: int, match: list[int], text: str, found: list) -> bool:
        """Enough words in a stretch of bounded length, the key's words all among them."""
        size = len(self.words[t])
        if len(match) < self.coverage * size or match[-1] - match[0] >= 2 * size:
            return False
        if self.keys[t] is None:
            return True
        # Some way past the end, for what may not follow a version.
        for m in self.keys[t].finditer(text, found[match[0]].start(), found[match[-1]].end() + 8):
            first = bisect_left(found, m.start(), key=lambda w: w.start())
            last = bisect_left(found, m.end(), key=lambda w: w.end())
            # Spellings of the same words (v3 for version 3, Share-Alike) need not align.
            if bisect_left(match, last + 1) - bisect_left(match, first) >= 0.6 * (last + 1 - first):
                return True
        return False

    def _window(self, t: int, text: str, found: list, words: list[str], lo: int, hi: int, out: list) -> None:
        """Align one window; after a notice look on behind it, as a window may hold several."""
        template = self.words[t]
        while hi - lo >= self.coverage * len(template):
            # Repeated notices share no unique words, so a long window is aligned a stretch at a time.
            stop = min(hi, lo + 2 * len(template) + 4)
            match = [lo + i for i, _ in align(words[lo:stop], template)]
            if not match or not self._fits(t, match, text, found):
                lo += max(1, len(template) // 4)
                continue
            # First words taken from another notice before: as many words in a shorter stretch.
            while match[-1] - match[0] >= len(match):
                start = match[0] + 1
                again = [start + i for i, _ in align(words[start:match[-1] + 1], template)]
                if len(again) < len(match) or not self._fits(t, again, text, found):
                    break
                match = again
            out.append((t, match))
            lo = match[-1] + 1

    def _best(self, out: list[tuple[int, list[int]]], found: list) -> list[tuple[str, float, int, int]]:
        """Of matches that share most of their words the one of most words, then of the shortest stretch."""
        taken: set[int] = set()
        rows = set()
        for t, match in sorted(out, key=lambda x: (-len(x[1]), x[1][-1] - x[1][0], len(self.words[x[0]]), x[1], x[0])):
            own = match[self.lead[t]:]
            if 2 * sum(i in taken for i in own) > len(own):
                continue
            taken.update(own)
            rows.add((self.names[t], len(match) / len(self.words[t]), found[match[0]].start(), found[match[-1]].end()))
        return sorted(rows, key=lambda x: (x[2], x[3], x[0]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per notice found: doc_id, license, coverage, start and end character.

    A notice counts when at least ``coverage`` of the template's words align, its key (``KEYS``, for
    the templates given here) among them. Documents without one, NULL and empty texts give no rows.
    Of templates that fit the same place the one with the most aligned words is returned; of an SPDX
    expression each identifier that ends within twice the length of its own template. The same
    notice twice in a text is two rows. Rows that repeat give their notices again; an empty
    table gives none; extra columns are ignored.
    """
    keys = KEYS if templates is None else {}
    templates = TEMPLATES if templates is None else templates

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage, keys)
        for batch, texts in text_slices(batches):
            rows = [(i, *x) for i, t in enumerate(texts) for x in scanner.scan(t)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()),
                 pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                names=["doc_id", "license", "coverage", "start", "end"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(scan, "doc_id bigint, license string, coverage double, start bigint, end bigint"))
