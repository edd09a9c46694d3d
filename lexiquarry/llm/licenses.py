"""License scans: MinHash bands over overlapping windows find templates, exact shingle containment verifies them.

Texts and templates are words of letters and digits, in lower case, and their
five-word shingles. Templates of at least ``SHORT`` shingles fall in classes of
doubling size c. A text is cut into blocks of c shingles and two adjacent
blocks form a window, so an occurrence lies within a window whole. Its Jaccard
similarity to the window is 0.19 at least, so one of the 64 bands, each of one
MinHash value, collides with probability above 0.999998. Shorter templates use
windows of one shingle, where a shared shingle collides for certain.

A candidate is a match if the window holds ``CONTAINMENT`` or more of the
template's distinct shingles. Of templates so alike that either's text matches
the other, as versions of a license are, the best contained one stands; of a
template within a longer one that is found around it, the longer one.

Notices of fewer than five words have no shingle; their whole word sequence is
looked up at every word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexiquarry.llm import wordhash as W
from lexiquarry.llm.scratch import small_batches

SHINGLE, CONTAINMENT, BANDS, SHORT, CLASS = 5, 0.8, 64, 8, 16

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(99))
_HASH = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64) * _U(2) + _U(1)
_KIND = np.full(256, 1)
_KIND[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 0

TEMPLATES: dict[str, str] = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MIT-licensed-line": "Licensed under the MIT License.",
    "CC-BY-4.0-short-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-short-line": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-short-line": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-short-line": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-1.0-short-line": "Licensed under CC0 1.0.",
    "CC-BY-ND-4.0-line": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-4.0-long-line": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Apache-2.0-SPDX": "SPDX-License-Identifier: Apache-2.0",
    "GPL-2.0-SPDX": "SPDX-License-Identifier: GPL-2.0",
    "GPL-3.0-SPDX": "SPDX-License-Identifier: GPL-3.0",
    "LGPL-2.1-SPDX": "SPDX-License-Identifier: LGPL-2.1",
    "LGPL-3.0-SPDX": "SPDX-License-Identifier: LGPL-3.0",
    "AGPL-3.0-SPDX": "SPDX-License-Identifier: AGPL-3.0",
    "MPL-2.0-SPDX": "SPDX-License-Identifier: MPL-2.0",
    "BSD-2-Clause-SPDX": "SPDX-License-Identifier: BSD-2-Clause",
    "BSD-3-Clause-SPDX": "SPDX-License-Identifier: BSD-3-Clause",
    "CC0-1.0-SPDX": "SPDX-License-Identifier: CC0-1.0",
    "CC-BY-4.0-SPDX": "SPDX-License-Identifier: CC-BY-4.0",
    "CC-BY-SA-4.0-SPDX": "SPDX-License-Identifier: CC-BY-SA-4.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

#: Of fewer than ``SHINGLE`` words.
NOTICES: dict[str, str] = {
    "All-rights-reserved": "All rights reserved.",
    "MIT-SPDX": "SPDX-License-Identifier: MIT",
    "ISC-SPDX": "SPDX-License-Identifier: ISC",
    "Unlicense-SPDX": "SPDX-License-Identifier: Unlicense",
}


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words in text order, each text's first, and the bytes each begins and ends at."""
    raw = W.LOWER[raw]
    starts, ends, _ = W.spans(raw, offsets, _KIND)
    ok = _KIND[raw[starts]] == 0
    starts, ends = starts[ok], ends[ok]
    return W.hashes(raw, starts, ends), np.searchsorted(starts, offsets), starts, ends


def _grams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-word shingles in text order, each text's first, and the word each begins at."""
    value, at = W.grams(words, first, n, lone=False)
    return value, at, np.repeat(first[:-1] - at[:-1], np.diff(at)) + np.arange(at[-1])


def _parts(texts: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """Templates with shingles, and notices without."""
    names = list(texts)
    _, first, _, _ = _words(*W.texts(pa.array([texts[n] for n in names], pa.large_string())))
    long = np.diff(first) >= SHINGLE
    return {n: texts[n] for n, x in zip(names, long, strict=True) if x}, {n: texts[n] for n, x in zip(names, long, strict=True) if not x}


class Notices:
    """Word sequences shorter than a shingle, found where they stand whole."""

    def __init__(self, texts: dict[str, str]):
        self.names = list(texts)
        words, first, _, _ = _words(*W.texts(pa.array([texts[n] for n in self.names], pa.large_string())))
        sizes = np.diff(first)
        if len(sizes) and not sizes.min():
            raise ValueError(f"notices without words: {[n for n, k in zip(self.names, sizes, strict=True) if not k]}")
        # by size: hashes and whose they are
        self.of: dict[int, list[tuple[np.uint64, int]]] = {}
        for i, n in enumerate(sizes.tolist()):
            value, _, _ = _grams(words[first[i] : first[i + 1]], np.array([0, n]), n)
            self.of.setdefault(n, []).append((value[0], i))

    def find(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, notice, first word, last word)."""
        found = []
        for n, wanted in self.of.items():
            value, at, pos = _grams(words, first, n)
            for h, i in wanted:
                hits = np.flatnonzero(value == h)
                docs = np.searchsorted(at, hits, side="right") - 1
                found += [(d, i, p, p + n - 1) for d, p in zip(docs.tolist(), pos[hits].tolist(), strict=True)]
        return found


class Templates:
    def __init__(self, texts: dict[str, str]):
        self.names = list(texts)
        column = pa.array([texts[n] for n in self.names], pa.large_string())
        words, first, _, _ = _words(*W.texts(column))
        value, at, _ = _grams(words, first, SHINGLE)
        self.sets = [np.unique(value[at[i] : at[i + 1]]) for i in range(len(self.names))]
        empty = [n for n, s in zip(self.names, self.sets, strict=True) if not len(s)]
        if empty:
            raise ValueError(f"templates of fewer than {SHINGLE} words: {empty}")
        alike = lambda a, b: len(np.intersect1d(a, b)) >= CONTAINMENT * max(len(a), len(b))
        self.alike = {i: {j for j, b in enumerate(self.sets) if j != i and alike(a, b)} for i, a in enumerate(self.sets)}
        inside = lambda a, b: len(a) < len(b) and len(np.intersect1d(a, b)) >= CONTAINMENT * len(a)
        self.within = {i: {j for j, b in enumerate(self.sets) if inside(a, b)} - self.alike[i] for i, a in enumerate(self.sets)}
        self.short = [i for i, s in enumerate(self.sets) if len(s) < SHORT]
        self.classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if i not in self.short:
                c = CLASS
                while c < len(s):
                    c *= 2
                self.classes.setdefault(c, []).append(i)
        self.sign = {i: np.array([(s * h).min() for h in _HASH]) for i, s in enumerate(self.sets)}
        words = [self.sets[i] for i in self.short]
        self.short_words = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        self.short_top = np.zeros(1 << 16, bool)
        self.short_top[(self.short_words >> _U(48)).astype(np.int64)] = True
        # by class and band: do any of a value's top bits occur
        self.top = {c: np.zeros((BANDS, 1 << 16), bool) for c in self.classes}
        for c, of in self.classes.items():
            for i in of:
                self.top[c][np.arange(BANDS), (self.sign[i] >> _U(48)).astype(np.int64)] = True

    def _inside(self, i: int, window: np.ndarray) -> list[tuple[int, int]]:
        """First and last position of the template in the window, if that holds enough of its distinct shingles.

        Where stretches apart from each other hold enough, each stands for itself.
        """
        own = self.sets[i]
        at = np.flatnonzero(np.isin(window, own))
        enough = lambda x: len(np.unique(window[x])) >= CONTAINMENT * len(own)
        if not enough(at):
            return []
        parts = [x for x in np.split(at, np.flatnonzero(np.diff(at) > max(SHORT, len(own) // 4)) + 1) if enough(x)]
        return [(int(x[0]), int(x[-1])) for x in parts or [at]]

    def find(self, value: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(text, template, first shingle, last shingle, containment), overlapping finds joined."""
        found: list[tuple[int, int, int, int]] = []
        if not len(value):
            return []
        maybe = np.flatnonzero(self.short_top[(value >> _U(48)).astype(np.int64)])
        maybe = maybe[np.isin(value[maybe], self.short_words)]
        doc_of = np.searchsorted(at, maybe, side="right") - 1
        for i in self.short:
            size = len(self.sets[i])
            own = np.isin(value[maybe], self.sets[i])
            for p, d in zip(maybe[own].tolist(), doc_of[own].tolist(), strict=True):
                found += [(d, i, p + x, p + y) for x, y in self._inside(i, value[p : min(p + size + size // 4, at[d + 1])])]
        if self.classes:
            found += self._long(value, at)
        out: list[tuple[int, int, int, int]] = []
        for d, i, a, b in sorted(found):
            if out and out[-1][:2] == (d, i) and a <= out[-1][3] + 1:
                out[-1] = (d, i, out[-1][2], max(b, out[-1][3]))
            else:
                out.append((d, i, a, b))
        return self._best([(d, i, a, b, round(len(np.intersect1d(value[a : b + 1], self.sets[i])) / len(self.sets[i]), 6)) for d, i, a, b in out])

    def _best(self, found: list[tuple[int, int, int, int, float]]) -> list[tuple[int, int, int, int, float]]:
        """Without the finds whose place a template much alike explains better, and those within a longer template that holds them; adjoining finds that were joined all stand."""
        by_doc: dict[int, list[tuple[int, int, int, int, float]]] = {}
        for x in found:
            by_doc.setdefault(x[0], []).append(x)

        def beaten(d: int, i: int, a: int, b: int, share: float) -> bool:
            if any(j in self.within[i] and e <= a and b <= f for _, j, e, f, _ in by_doc[d]):
                return True
            if b - a + 1 > 1.5 * len(self.sets[i]):
                return False
            return any(j in self.alike[i] and more > share and 2 * (min(b, f) - max(a, e) + 1) > b - a + 1 for _, j, e, f, more in by_doc[d])

        return [x for x in found if not ((self.alike[x[1]] or self.within[x[1]]) and beaten(*x))]

    def _long(self, value: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        found = []
        c = CLASS
        blocks = -(-np.diff(at) // c)
        doc = np.repeat(np.arange(len(blocks)), blocks)
        base = np.concatenate(([0], np.cumsum(blocks)))
        start = at[doc] + (np.arange(base[-1]) - base[doc]) * c
        low = np.empty((len(start), BANDS), np.uint64)
        for k, h in enumerate(_HASH):
            low[:, k] = np.minimum.reduceat(value * h, start)
        while True:
            if c in self.classes:
                both = low.copy()
                pair = np.flatnonzero(doc[1:] == doc[:-1])
                both[pair] = np.minimum(low[pair], low[pair + 1])
                top = (both >> _U(48)).astype(np.int64)
                hit = np.zeros(len(both), bool)
                for k in range(BANDS):
                    hit |= self.top[c][k][top[:, k]]
                for w in np.flatnonzero(hit):
                    a, b = int(start[w]), int(min(start[w] + 2 * c, at[doc[w] + 1]))
                    for i in self.classes[c]:
                        if (both[w] == self.sign[i]).any():
                            found += [(int(doc[w]), i, a + x, a + y) for x, y in self._inside(i, value[a:b])]
            if c >= max(self.classes):
                return found
            # blocks of twice the size
            even = (np.arange(len(doc)) - base[doc]) % 2 == 0
            first = np.flatnonzero(even)
            low = np.minimum.reduceat(low, first, axis=0)
            doc, start, c = doc[first], start[first], 2 * c
            base = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(at) - 1))))


def _run(texts: dict[str, str]):
    @W.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long, short = _parts(texts)
        templates = Templates(long) if long else None
        notices = Notices(short)
        for batch in batches:
            raw, offsets = W.texts(batch.column(1))
            for a, b in W.chunks(offsets):
                words, first, begin, end = _words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rows = [(d, notices.names[i], p, q, 1.0) for d, i, p, q in notices.find(words, first)]
                if templates is not None:
                    value, at, pos = _grams(words, first, SHINGLE)
                    rows += [(d, templates.names[i], pos[p], pos[q] + SHINGLE - 1, share) for d, i, p, q, share in templates.find(value, at)]
                docs = np.array([r[0] for r in rows], np.int64)
                shift = (offsets[a : b + 1] - offsets[a])[docs] if len(rows) else docs
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(pa.array(docs)),
                        pa.array([r[1] for r in rows], pa.string()),
                        pa.array(begin[[r[2] for r in rows]] - shift if rows else docs),
                        pa.array(end[[r[3] for r in rows]] - shift if rows else docs),
                        pa.array([r[4] for r in rows], pa.float64()),
                    ],
                    ["doc_id", "license", "start_byte", "end_byte", "containment"],
                )

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per match: doc_id, license, start_byte, end_byte (in the text's UTF-8) and containment.

    ``templates``: name -> text of one word or more; the built-in notices if
    none are given. Those of fewer than five words match whole or not at all.
    They are held by every task, and are as few as licenses are. Where a template
    is found within a longer one that holds it, only the longer one is. Null, empty
    and short texts match nothing that they do not hold. Repeated rows match
    alike; null ids are returned as they come; other columns are ignored; an
    empty table gives an empty result.
    """
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return small_batches(rows).mapInArrow(_run(TEMPLATES | NOTICES if templates is None else templates), "doc_id long, license string, start_byte long, end_byte long, containment double")
