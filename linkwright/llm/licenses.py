"""License scans: texts against licence templates by Dice coefficient over word bigrams.

``scan_licenses(docs)`` finds, in every whole text, the passages whose bigrams agree with those of
a licence template: 2 * common / (passage + template) >= ``DICE`` counted as sets. Texts are
normalised to lower-case words of letters and digits. A template with m bigrams can only match a
passage that has at least m * DICE / (2 - DICE) of them and at most m * (2 / DICE - 2) distinct others:
these size bounds leave few templates and places, which are then compared exactly, however far a
passage with repeated words reaches.

One row per document and licence found: id, license_id, dice, first_word (place of the best passage
among the text's words) and n_words. Cases: NULL or empty texts and texts of one word find nothing;
a NULL id is carried; repeated rows give repeated results; of equal passages the first that no
shorter one within equals counts; other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import group_bounds, lower_ascii, ngrams, prefix_codes, slices, span_hashes, text_bytes
from .frames import prepared

DICE = 0.8
#: The notices by which works commonly state their licence, and the texts of short licences.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
}
_PART = np.zeros(256, bool)
_PART[48:58] = _PART[65:91] = _PART[97:123] = True
_PART[128:] = True


def license_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of letters and digits, and where each row's words begin."""
    data = lower_ascii(data)
    inside = _PART[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    start = np.flatnonzero(first)
    return span_hashes(prefix_codes(data), start, np.flatnonzero(last) + 1), np.searchsorted(start, offsets)


def template_bigrams(templates: dict[str, str]) -> dict[str, np.ndarray]:
    out = {}
    for name, text in templates.items():
        raw = text.encode()
        codes, _ = license_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        if len(codes) < 2:
            raise ValueError(f"template {name} has under two words")
        out[name] = np.unique(ngrams(codes, 2))
    return out


def occurrences(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each place, the places of the same bigram before and after; -1 and the length where there is none."""
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    before, after = np.full(len(grams), -1), np.full(len(grams), len(grams))
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def bounds(m: int, threshold: float) -> tuple[int, int]:
    """The least common and the most other bigrams of a passage that matches a template of m bigrams."""
    return int(np.ceil(m * threshold / (2 - threshold) - 1e-9)), int(m * (2 / threshold - 2) + 1e-9)


def best_passage(near: tuple[np.ndarray, np.ndarray], at: np.ndarray, m: int, threshold: float = DICE):
    """The best passage of a text for a template of m bigrams: (dice, first, last), or None.

    near: what occurrences() gives for the text; at: places that hold bigrams of the template. The
    best passage begins and ends at such places, and neither bigram stands in it twice, as the
    passage without it would be as good. So from each beginning the text is read up to the next
    place of the same bigram, or until it has too many other bigrams.
    """
    before, after = near
    need, others = bounds(m, threshold)
    own = np.zeros(len(before), bool)
    own[at] = True
    fresh = np.cumsum((before < 0) & ~own)  # bigrams not of the template that the text has not had before: no passage has fewer
    k = len(at) - need + 1
    best = None
    if k <= 0:
        return None
    for a in at[:k][fresh[at[need - 1 :]] - fresh[at[:k]] <= others].tolist():
        end, lo, size, seen, common = int(after[a]), a, 4 * m + 16, 0, 0
        while lo < end:
            hi = min(end, lo + size)
            new = before[lo:hi] < a
            c = common + np.cumsum(new & own[lo:hi])
            s = seen + np.cumsum(new)
            stop = int(np.searchsorted(s - c, others, side="right"))
            score = 2 * c[:stop] / (s[:stop] + m)
            if stop and (top := float(score.max())) >= threshold and (best is None or top > best[0]):
                best = (top, a, lo + int(score.argmax()))
            if stop < hi - lo:
                break
            seen, common, lo, size = int(s[-1]), int(c[-1]), hi, 2 * size
        if best and best[0] == 1:
            break
    return best


def _scan(templates: dict[str, str], threshold: float):
    def run(batches):
        sets = template_bigrams(templates)
        every = np.unique(np.concatenate(list(sets.values())))
        member = {name: np.isin(every, x) for name, x in sets.items()}
        for batch in batches:
            ids = batch.column(0)
            data, offsets = text_bytes(batch.column(1))
            out = {k: [] for k in ("row", "license_id", "dice", "first_word", "n_words")}
            for i, j in slices(offsets):
                codes, rows = license_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                grams = ngrams(codes, 2)
                which = np.searchsorted(every, grams)
                which[which == len(every)] = 0
                hits = np.flatnonzero(every[which] == grams)
                row = np.searchsorted(rows, hits, side="right") - 1
                inner = hits + 1 < rows[row + 1] if len(hits) else np.zeros(0, bool)
                hits, row = hits[inner], row[inner]
                for a, b in group_bounds(row):
                    r, near = int(row[a]), None
                    held = np.unique(which[hits[a:b]])
                    for name, template in sets.items():
                        if member[name][held].sum() < bounds(len(template), threshold)[0]:
                            continue
                        near = near or occurrences(grams[rows[r] : rows[r + 1] - 1])
                        at = hits[a:b][member[name][which[hits[a:b]]]] - rows[r]
                        if found := best_passage(near, at, len(template), threshold):
                            out["row"].append(i + r)
                            out["license_id"].append(name)
                            out["dice"].append(found[0])
                            out["first_word"].append(found[1])
                            out["n_words"].append(found[2] - found[1] + 2)
            row = pa.array(out.pop("row"), pa.int64())
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(row), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], names=["id", *out])

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = DICE) -> DataFrame:
    """(id, license_id, dice, first_word, n_words) of each document and licence found."""
    prepared(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_scan(templates or TEMPLATES, threshold), "id long, license_id string, dice double, first_word long, n_words long")
    return found.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    from .frames import documents

    return scan_licenses(documents(spark, sf_dir))
