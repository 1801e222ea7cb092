"""License scan by conditional compression.

Words like "license" or "permission" are anchors: as many words before and after each as the longest notice has, over
line ends, make a block. A block is compressed by zstandard alone, and with
each template as raw dictionary; templates are tried in order of what they save, as a part of the block; the first
that is confirmed wins, or one that saves nearly as much and differs in fewer words. A template is confirmed by the exact
differences in wording: almost all of the template's words must stand in the block, in
order and close together, and every word with a digit (a version) without change. Where a block is no notice as a
whole, and where it is too long for one, every place in it is tried that has enough of a template's words; the notice
found there is judged as a block of its own, and so is what stands before and after it.

A tag that gives license identifiers is read as it is. A notice that the words before deny ("not released under …") is
none.

Defined cases: a null or empty text has no finding; an empty table gives no rows; repeated rows are scanned each; a notice is found wherever it
stands, in texts of any length; other columns are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from clauseworks.llm.chunks import small_batches

#: Part of a block's own compressed size that a template must save; part of its words that must stand in the block.
SAVED = 0.25
COVER = 0.85
#: Templates that save as much as the first that is confirmed, but for this part, are confirmed, too: their wordings decide.
NEAR = 0.1
#: Other words between the template's, at most, as a part of its words (or four).
EXTRA = 0.25

# License names and the wordings of their notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "Licensed under the GNU GPL v3."),
    ("GPL-2.0", "Licensed under the GNU GPL v2."),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("GPL-2.0-or-later", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC0-1.0", "This work is released under CC0 1.0 Universal, public domain dedication."),
    ("LGPL-3.0-or-later", """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("LGPL-2.1-or-later", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("AGPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("GPL-3.0-or-later", "Under the terms of the GNU General Public License v3.0 or later."),
    ("GPL-2.0-or-later", "Under the terms of the GNU General Public License v2.0 or later."),
    ("LGPL-3.0-or-later", "Under the terms of the GNU Lesser General Public License v3.0 or later."),
    ("LGPL-2.1-or-later", "Under the terms of the GNU Lesser General Public License v2.1 or later."),
    ("AGPL-3.0-or-later", "Under the terms of the GNU Affero General Public License v3.0 or later."),
    ("Apache-2.0", "Apache License Version 2.0"),
    ("MIT", "MIT License"),
    ("GPL-3.0", "GNU General Public License Version 3"),
    ("GPL-2.0", "GNU General Public License Version 2"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("ISC", "ISC License"),
    ("all-rights-reserved", "All rights reserved."),
)
#: The tag that names licenses by their identifiers, and what joins these.
_TAG = re.compile(r"SPDX-License-Identifier:[ \t]*([(]*[A-Za-z0-9][A-Za-z0-9.+-]*(?:[ \t()]+[A-Za-z0-9][A-Za-z0-9.+-]*)*)")
_JOINS = frozenset("AND OR WITH".split())
#: What denies the notice after it, some words on in the same sentence.
_DENIED = re.compile(r"\b(?:not|never|n't|n’t|neither|nor)(?:\s+[^\s.!?;]+){0,3}\s*$", re.I)

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_ANCHOR = re.compile(r"licen[sc]|copyright|all\s+rights|rights\s+reserved|permission|redistribut|warrant|public\s+domain|free\s+software|\bCC0?[\s-]", re.I)


@dataclass(frozen=True)
class Finding:
    license: str
    start: int
    end: int
    saved: float
    missing: tuple[str, ...]
    extra: tuple[str, ...]


def _others(want: list[str]) -> float:
    """Other words that may stand between those of a template."""
    return max(4, EXTRA * len(want))


def words_of(text: str) -> list[str]:
    return [m[0].lower() for m in _WORD.finditer(text)]


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self._names = [n for n, _ in templates]
        self._words = [words_of(t) for _, t in templates]
        self._of: dict[str, list[int]] = {}
        for i, ws in enumerate(self._words):
            for w in set(ws):
                self._of.setdefault(w, []).append(i)
        self._known = {w for ws in self._words for w in ws}
        self._alone = zstandard.ZstdCompressor(level=9, write_content_size=False, write_checksum=False)
        self._with = []
        for ws in self._words:
            held = zstandard.ZstdCompressionDict(" ".join(ws).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=9)
            self._with.append(zstandard.ZstdCompressor(level=9, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
        self._judged = lru_cache(50_000)(self._judge)

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """Templates by the part of the block's compressed size that each saves, most first."""
        raw = block.encode()
        own = len(self._alone.compress(raw))
        return sorted(((1 - len(c.compress(raw)) / own, -i) for i, c in enumerate(self._with)), key=lambda x: (x[0], len(self._words[-x[1]]), x[1]), reverse=True)

    def _confirmed(self, i: int, have: list[str]) -> tuple[int, int, tuple[str, ...], tuple[str, ...]] | None:
        """(first word, word after the last, missing, extra) of template ``i`` in ``have``, if all but a few stand there.

        Where words like the template's stand far before or after it, the matches nearest to its wording count.
        """
        want = self._words[i]
        pairs = [m for m in SequenceMatcher(None, want, have, autojunk=False).get_matching_blocks() if m.size]
        sizes = [0, *accumulate(m.size for m in pairs)]
        spans = [(x, y) for x in range(len(pairs)) for y in range(x + 1, len(pairs) + 1) if sizes[y] - sizes[x] >= COVER * len(want)]
        best = None
        for x, y in sorted(spans, key=lambda s: s[0] - s[1]):
            some, n = pairs[x:y], sizes[y] - sizes[x]
            first, last = some[0].b, some[-1].b + some[-1].size
            if last - first - n > _others(want):
                continue
            met = {m.a + k for m in some for k in range(m.size)}
            used = {m.b + k for m in some for k in range(m.size)}
            missing = tuple(w for k, w in enumerate(want) if k not in met)
            if not any(c.isdigit() for w in missing for c in w):
                found = (len(missing) + last - first - n, first, last, missing, tuple(have[k] for k in range(first, last) if k not in used))
                best = min(best, found) if best else found
            if best and y - x == len(pairs):
                break
        return best[1:] if best else None

    def _places(self, have: list[str]) -> list[tuple[int, int]]:
        """(first word, word after the last) of notices that stand anywhere in ``have``, the longest templates' first.

        A template can only be confirmed where its words are: each start is tried from which enough of them follow.
        """
        spots: dict[int, list[int]] = {}
        for k, w in enumerate(have):
            for i in self._of.get(w, ()):
                spots.setdefault(i, []).append(k)
        out: list[tuple[int, int]] = []
        free = [(0, len(have))]
        for i in sorted(spots, key=lambda i: (-len(self._words[i]), i)):
            rest = []
            for a, b in free:
                for first, last in self._places_of(i, have, spots[i], a, b):
                    out.append((first, last))
                    rest.append((a, first))
                    a = last
                rest.append((a, b))
            free = rest
        return sorted(out)

    def _places_of(self, i: int, have: list[str], spots: list[int], start: int, end: int) -> Iterator[tuple[int, int]]:
        """Places of template ``i`` from word ``start`` to before ``end``, in order; its words stand at ``spots``."""
        want = self._words[i]
        at = spots[bisect_left(spots, start) : bisect_left(spots, end)]
        least, reach = COVER * len(want), len(want) + int(_others(want))
        if len(at) < least:
            return
        left = Counter(want)  # what is still wanted in the words from at[x] to before at[y]
        n = y = 0
        done = start
        for k in at:
            while y < len(at) and at[y] < k + reach:
                n += left[have[at[y]]] > 0
                left[have[at[y]]] -= 1
                y += 1
            if k >= done and n >= least and (met := self._confirmed(i, have[k : min(end, k + reach)])):
                first, last = k + met[0], k + met[1]
                # a start before the notice may have cut its end
                if more := self._confirmed(i, have[first : min(end, first + reach)]):
                    first, last = first + more[0], first + more[1]
                if self._judged(" ".join(have[first:last])):
                    yield first, last
                    done = last
            left[have[k]] += 1
            n -= left[have[k]] > 0

    def _judge(self, block: str) -> tuple[int, float, int, int, tuple[str, ...], tuple[str, ...]] | None:
        """(template, saved, first word, word after the last, missing, extra) of the words of ``block``, if confirmed."""
        have = block.split(" ")
        best = None
        for saved, i in self.ranked(block):
            if saved < SAVED or best and saved < best[3] - NEAR:
                break
            if (met := self._confirmed(-i, have)) is not None:
                first, last, missing, extra = met
                found = (len(missing) + len(extra), -len(self._words[-i]), -i, best[3] if best else saved, saved, first, last, missing, extra)
                best = min(best, found, key=lambda x: x[:3]) if best else found
        return (best[2], *best[4:]) if best else None

    def _spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Stretches of ``text`` in which a notice may stand: as many words around each anchor as the longest has."""
        anchors = [m.start() for m in _ANCHOR.finditer(text)]
        if not anchors:
            return
        words = [m.start() for m in _WORD.finditer(text)]
        reach = max(len(w) + int(_others(w)) for w in self._words)
        a = b = None
        for at in anchors:
            k = bisect_left(words, at)
            first, last = max(0, k - reach), min(len(words), k + reach)
            if b is not None and first > b:
                yield words[a], words[b] if b < len(words) else len(text)
                a = None
            a, b = first if a is None else a, last
        yield words[a], words[b] if b < len(words) else len(text)

    def _in(self, text: str, start: int, end: int) -> list[Finding]:
        """Findings in a span: a notice is confirmed, in the whole or in a part of it, then what stands before and after it."""
        out = []
        todo = [(start, end)]
        while todo:
            a, b = todo.pop()
            at = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(text, a, b)]
            if not at or not _ANCHOR.search(text, a, b):
                continue
            have = [w for *_, w in at]
            found = self._judged(" ".join(have)) if 2 * len(have) <= 3 * max(map(len, self._words)) else None
            if found is None:  # the notice may be a part of the span
                places = self._places(have)
                for first, last in places:
                    i, saved, f, n, missing, extra = self._judged(" ".join(have[first:last]))
                    s, e = at[first + f][0], at[first + n - 1][1]
                    out.append(Finding(self._names[i], s, e, saved, missing, extra))
                    todo.append((a, s))
                    a = e
                todo += [(a, b)] if places else []
                continue
            i, saved, first, last, missing, extra = found
            out.append(Finding(self._names[i], at[first][0], at[last - 1][1], saved, missing, extra))
            todo += [(a, at[first][0]), (at[last - 1][1], b)]
        return out

    def scan(self, text: str | None) -> list[Finding]:
        text = text or ""
        tags = list(_identifiers(text))
        out = [f for a, b in self._spans(text) for f in self._in(text, a, b)]
        out = [f for f in out if not _DENIED.search(text, max(0, f.start - 80), f.start) and not any(t.start < f.end and f.start < t.end for t in tags)]
        return sorted({*out, *tags}, key=lambda f: (f.start, f.end, f.license))


def _identifiers(text: str) -> Iterator[Finding]:
    """Licenses that a tag names: an exact form, which has no wording to compare."""
    for m in _TAG.finditer(text):
        before = ""
        for w in re.finditer(r"[A-Za-z0-9.+-]+", m[1]):
            if w[0] not in _JOINS and before not in ("", *_JOINS):
                break  # two words without a join between: the tag has ended
            if w[0] not in _JOINS and before != "WITH":  # what follows that is an exception to the license
                yield Finding(w[0], m.start(), m.end(1), 1.0, (), ())
            before = w[0]


@lru_cache(1)
def scanner() -> Scanner:
    return Scanner()


SCHEMA = (
    "doc_id {id}, n_found long, licenses array<string>, "
    "findings array<struct<license string, start long, end long, saved double, missing array<string>, extra array<string>>>"
)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_found, licenses, findings): one row a row of ``docs``; spans are code points of the text."""
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saved", pa.float64()), ("missing", pa.list_(pa.string())), ("extra", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner().scan
        for batch in batches:
            found = [find(t) for t in batch.column("text").to_pylist()]
            rows = [[{"license": f.license, "start": f.start, "end": f.end, "saved": f.saved, "missing": list(f.missing), "extra": list(f.extra)} for f in x] for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array([sorted({f.license for f in x}) for x in found], pa.list_(pa.string())), pa.array(rows, kind)],
                names=["doc_id", "n_found", "licenses", "findings"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString()))
