"""License scans: MinHash bands over overlapping windows, then exact containment.

A text is cut into words (ASCII letters, digits and anything beyond ASCII, lower-cased) and
5-word shingles. An occurrence of a template of n different shingles is a run of n consecutive shingles
of the text that holds at least 0.8 of them. All windows of the text are signed: for a short template
those of n shingles at every shingle, for a long one they start every n // 2 shingles and are so
long (1.5 n) that each run of n lies whole in one.

A window around an occurrence has a Jaccard similarity of at least 0.8 / 1.2 = 0.67, or 0.8 / 1.7 = 0.47,
with the template. MinHash bands of ``ROWS`` rows, as many as ``bands_for`` says, retrieve it with a
probability of ``RECALL`` or more. What is retrieved is verified by exact containment, in the best run of the
window.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINED = 0.8
ROWS = 2
#: Least probability that an occurrence shares a band with its template.
RECALL = 0.995
#: Templates of so many shingles are looked for at every shingle.
SHORT = 16
#: Words that are signed at once (and a window more); texts of any length go through in such pieces.
PIECE = 1 << 13
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

#: Public licence texts, notices and the lines that commonly refer to them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
        the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
        IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY
        OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
        OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
        and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
        Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire
        statement, including the above license grant, this restriction and the following disclaimer, must be included in all
        copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative
        works are solely in the form of machine-executable object code generated by a source language processor.""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
        more details. You should have received a copy of the GNU General Public License along with this program.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    "MIT": "Released under the MIT License",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software. THE
        SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Reserved": "All rights reserved. No part of this publication may be reproduced",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
        software. This notice may not be removed or altered from any source distribution.""",
}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def bands_for(size: int) -> int:
    """Bands for RECALL at the least similarity of a window around an occurrence."""
    least = CONTAINED / ((1 if size <= SHORT else 1.5) + 1 - CONTAINED)
    return ceil(log(1 - RECALL) / log(1 - least**ROWS))


BANDS = bands_for(SHORT + 1)
_MUL = np.random.default_rng(7).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint32(0xFFFFFFFF)


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each SHINGLE consecutive words, chained from the words' hashes."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(h) - SHINGLE + 1
    if n <= 0:
        return h[:0]
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            out = out * _MIX + h[k : k + n]
            out ^= out >> np.uint64(29)
    return out


def _rows(h: np.ndarray) -> np.ndarray:
    """The shingles' hashes under each of the MinHash functions (functions x shingles)."""
    x = (h >> np.uint64(32)).astype(np.uint32)[None, :] * _MUL[:, None]
    return x ^ (x >> np.uint32(15))


def _bands(rows: np.ndarray) -> np.ndarray:
    """One key a band (bands x windows) of minima (functions x windows)."""
    key = rows[::ROWS]
    for k in range(1, ROWS):
        key = key * np.uint32(0x9E3779B1) + rows[k::ROWS]
    return key


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None) -> None:
        templates = TEMPLATES if templates is None else templates
        self.shingles = {k: np.unique(shingle_hashes(words_of(t))) for k, t in templates.items()}
        self.shingles = {k: s for k, s in self.shingles.items() if len(s)}
        self.by_size: dict[int, list[tuple[str, np.ndarray]]] = {}
        for name, s in self.shingles.items():
            self.by_size.setdefault(len(s), []).append((name, _bands(_rows(s).min(1, keepdims=True))[: bands_for(len(s))]))

    def retrieved(self, texts: list[np.ndarray]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """(template, text, first shingle) of the windows that share a band with it; every text has its own grid.

        The texts stand in a row with SHORT shingles of no weight behind each, so that no short window
        reaches into the next one.
        """
        length = np.array([len(t) for t in texts]) + SHORT
        offset = np.cumsum(length) - length
        spare = np.zeros(SHORT, dtype=np.uint64)
        rows = _rows(np.concatenate([x for t in texts for x in (t, spare)]))
        for o, n in zip(offset.tolist(), length.tolist(), strict=True):
            rows[:, o + n - SHORT : o + n] = _NONE
        every = np.repeat(np.arange(len(texts)), length)
        wide = {1: rows[: ROWS * bands_for(1)]}
        for size, templates in sorted(self.by_size.items()):
            if size <= SHORT:
                two = 1
                while two * 2 <= size:
                    if two * 2 not in wide:
                        wide[two * 2] = np.minimum(wide[two][:, :-two], wide[two][:, two:])
                    two *= 2
                low = wide[two] if size == two else np.minimum(wide[two][:, : two - size], wide[two][:, size - two :])
                text, first = every[: low.shape[1]], np.arange(low.shape[1])
                first = first - offset[text]
            else:
                step = size // 2
                blocks = -(-length // step)
                text = np.repeat(np.arange(len(texts)), blocks)
                first = (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * step
                block = np.minimum.reduceat(rows, offset[text] + first, axis=1)
                low = block.copy()
                for k in range(1, -(-(size + step - 1) // step)):
                    np.minimum(low[:, :-k], block[:, k:], out=low[:, :-k], where=text[k:] == text[:-k])
            keys = _bands(low)
            for name, own in templates:
                at = np.flatnonzero((keys[: len(own)] == own).any(0))
                at = at[first[at] < length[text[at]] - SHORT]
                yield name, text[at], first[at]

    def occurrence(self, name: str, h: np.ndarray, start: int) -> tuple[int, int, int] | None:
        """Template shingles, first and end of the best run in a window that starts there, if they are enough."""
        own = self.shingles[name]
        n = len(own)
        part = h[start : start + n + (n // 2 - 1 if n > SHORT else 0)]
        which = np.searchsorted(own, part)
        at = np.flatnonzero(own[np.minimum(which, n - 1)] == part)
        if len(at) < CONTAINED * n:
            return None
        best, span, seen, left = 0, None, {}, 0
        for k in at.tolist():
            seen[which[k]] = seen.get(which[k], 0) + 1
            while at[left] <= k - n:
                seen[which[at[left]]] -= 1
                if not seen[which[at[left]]]:
                    del seen[which[at[left]]]
                left += 1
            if len(seen) > best:
                best, span = len(seen), (start + int(at[left]), start + k + 1)
        return (best, *span) if span and best >= CONTAINED * n else None

    def scan(self, texts: Iterator[str | None]) -> Iterator[tuple[int, list[tuple[str, int, int]]]]:
        """Of each text: its words; (template, first word, end word) of occurrences, the better one where two of a template overlap."""
        words, held, size = [], [], 0
        for text in texts:
            own = words_of(text)
            words.append(len(own))
            held.append(shingle_hashes(own))
            size += len(held[-1])
            if size >= PIECE:
                yield from zip(words, self._found(held), strict=True)
                words, held, size = [], [], 0
        yield from zip(words, self._found(held), strict=True)

    def _found(self, texts: list[np.ndarray]) -> list[list[tuple[str, int, int]]]:
        found: list[dict[str, set[tuple[int, int, int]]]] = [{} for _ in texts]
        longest = max(self.by_size, default=0)
        pieces = [(k, a, h[a : a + PIECE + 2 * longest]) for k, h in enumerate(texts) for a in range(0, len(h), PIECE)]
        start = 0
        while start < len(pieces) and self.by_size:
            end, size = start, 0
            while end < len(pieces) and (end == start or size + len(pieces[end][2]) <= 2 * PIECE):
                size += len(pieces[end][2])
                end += 1
            for name, piece, first in self.retrieved([h for *_, h in pieces[start:end]]):
                for p, w in zip(piece.tolist(), first.tolist(), strict=True):
                    k, a, h = pieces[start + p]
                    span = self.occurrence(name, h, w)
                    if span:
                        found[k].setdefault(name, set()).add((-span[0], a + span[1], a + span[2]))
            start = end
        out = []
        for own in found:
            spans: list[tuple[str, int, int]] = []
            for name, ranges in own.items():
                taken: list[tuple[int, int]] = []
                for _, s, e in sorted(ranges):
                    k = bisect_left(taken, (s, e))
                    if (not k or taken[k - 1][1] <= s) and (k == len(taken) or e <= taken[k][0]):
                        taken.insert(k, (s, e))
                spans += [(name, s, e + SHINGLE - 1) for s, e in taken]
            out.append(sorted(spans, key=lambda x: (x[1], x[0])))
        return out

    def find(self, text: str | None) -> tuple[int, list[tuple[str, int, int]]]:
        return next(self.scan(iter([text])))


SCHEMA = "doc_id long, n_words long, n_matches long, licenses string, spans string"


def _runner(scanner: Scanner):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(scanner.scan(t.as_py() for t in batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _ in got], pa.int64()),
                    pa.array([len(m) for _, m in got], pa.int64()),
                    pa.array([",".join(sorted({x[0] for x in m})) for _, m in got], pa.string()),
                    pa.array([",".join(f"{x}:{a}:{b}" for x, a, b in m) for _, m in got], pa.string()),
                ],
                ["doc_id", "n_words", "n_matches", "licenses", "spans"],
            )

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Licenses of every whole text of ``docs(doc_id, text)``, in one narrow pass.

    Null, empty or short (under five words) texts match nothing; repeated rows stay; a template of
    under five words has no shingle and matches nothing; an empty table gives no rows. The
    templates travel with the tasks: they are a fixed list, not data.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_runner(Scanner(templates)), SCHEMA)
