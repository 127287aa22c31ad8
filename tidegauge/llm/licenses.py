"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import blocks, byte_class, rolling, text_buffer, word_hashes, word_spans

_WORD = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_BLANK = byte_class(b" \t\n\x0b\x0c\r")

#: Public licence texts and the notices by which works name them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD-2-Clause": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    "BSD-3-Clause": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "ISC": (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
}


def _bigrams(text: str) -> np.ndarray:
    buf, offsets = text_buffer(pa.array([text]))
    starts, ends, _ = word_spans(buf, offsets, _WORD)
    return np.unique(rolling(word_hashes(buf, starts, ends), 2))


class _Matcher:
    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be above 0 and at most 1")
        self.names, self.sets = [], []
        for name in sorted(templates):
            for text in templates[name]:
                if len(b := _bigrams(text)):
                    self.names.append(name)
                    self.sets.append(b)
        self.threshold = threshold
        self.known = np.unique(np.concatenate(self.sets)) if self.sets else np.empty(0, np.uint64)
        self.sizes = np.array([len(s) for s in self.sets], np.int64)

    def bounds(self) -> tuple[float, float]:
        """Sizes of bigram sets that can reach the threshold with any template."""
        t = self.threshold
        return (self.sizes.min() * t / (2 - t), self.sizes.max() * (2 - t) / t) if len(self.sizes) else (1.0, 0.0)

    def best(self, own: np.ndarray) -> list[tuple[int, float]]:
        """(template, Dice) at or above the threshold; templates whose size forbids it are not compared."""
        t, n = self.threshold, len(own)
        fit = np.flatnonzero((self.sizes * t <= (2 - t) * n + 1e-9) & (n * t <= (2 - t) * self.sizes + 1e-9))
        found = []
        for k in fit.tolist():
            dice = 2 * len(np.intersect1d(own, self.sets[k], assume_unique=True)) / (n + int(self.sizes[k]))
            if dice >= t:
                found.append((k, dice))
        return found


def _segments(part: np.ndarray, own: np.ndarray, first: np.ndarray, starts: np.ndarray):
    """(text, kind, word range) of the lines, the paragraphs and the whole of each text, as arrays."""
    breaks = np.flatnonzero(part == 10)
    cuts = np.unique(np.concatenate([own, breaks[~np.isin(breaks, own)] if len(breaks) else breaks]))
    lines = np.searchsorted(starts, cuts, "left")
    kinds = []
    n_lines = len(cuts) - 1
    if n_lines > 0:
        text = np.searchsorted(own, cuts[:-1], "right") - 1
        a, b = lines[:-1], lines[1:]
        kinds.append((text, a, b, 0))
        seen = np.concatenate([[0], np.cumsum(_BLANK[part])])
        # a line may begin with its own break, which is blank
        blank = seen[cuts[1:]] == seen[cuts[:-1]]
        new = np.ones(n_lines, bool)
        new[1:] = blank[1:] | blank[:-1] | (text[1:] != text[:-1])
        heads = np.flatnonzero(new)
        kinds.append((text[heads], a[heads], b[np.append(heads[1:] - 1, n_lines - 1)], 1))
    kinds.append((np.arange(len(own) - 1), first[:-1], first[1:], 2))
    return kinds


def _match_rows(matcher):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher.value
        least, most = m.bounds()
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            out: list[tuple[int, str, str, int, float]] = []
            for lo, hi in blocks(offsets):
                part, own = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, first = word_spans(part, own, _WORD)
                if len(starts) < 2 or not len(m.known):
                    continue
                grams = rolling(word_hashes(part, starts, ends), 2)
                at = np.searchsorted(m.known, grams)
                at[at == len(m.known)] = 0
                hits = np.concatenate([[0], np.cumsum(m.known[at] == grams)])
                for text, a, b, kind in _segments(part, own, first, starts):
                    n = b - a - 1
                    some = np.flatnonzero((n >= 1) & (n >= least - 1e-9))
                    h = hits[b[some] - 1] - hits[a[some]]
                    # a set that reaches the threshold shares that many bigrams with some template at least
                    some = some[h >= np.ceil(m.threshold / (2 - m.threshold) * m.sizes.min() - 1e-9) if len(h) else []]
                    for s in some.tolist():
                        mine = np.unique(grams[a[s] : b[s] - 1])
                        inside = np.isin(mine, m.known, assume_unique=True).sum()
                        if least - 1e-9 <= len(mine) <= most + 1e-9 and 2 * inside >= m.threshold * len(mine):
                            out += [(lo + int(text[s]), m.names[k], ("line", "paragraph", "text")[kind], int(a[s] - first[text[s]]), d) for k, d in m.best(mine)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([x[0] for x in out], pa.int32())), *[pa.array([x[k] for x in out], t) for k, t in ((1, pa.string()), (2, pa.string()), (3, pa.int64()), (4, pa.float64()))]],
                names=["doc", "license", "segment", "start", "dice"],
            )

    return rows


def license_matches(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(id, license, segment, start, dice): lines, paragraphs and whole texts that match a template.

    Texts are normalised to words of ASCII letters and digits and bytes from 0x80, A-Z lower-cased; ``start`` counts
    a segment's first word. A segment matches when the Dice coefficient of its distinct word bigrams and a template's
    reaches ``threshold``; |A| and |B| must be within (2 - t) / t of one another for that, so other templates are
    not compared. One pass, no exchange. Null and wordless texts match nothing; repeated rows match alike; null ids
    stay null; empty tables give no rows; other columns are ignored.
    """
    matcher = df.sparkSession.sparkContext.broadcast(_Matcher(TEMPLATES if templates is None else templates, threshold))
    found = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(_match_rows(matcher), "doc long, license string, segment string, start long, dice double")
    return found.withColumnRenamed("doc", id_col)
