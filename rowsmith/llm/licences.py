"""Operator 1, licence scans, with DataFrame functions only.

A text is normalised (lower case, letters and digits, single spaces) and licence templates are looked for
anywhere in it: in a header wrapped over comment lines, between other paragraphs, inside a line. A window of a
text and a template are compared by the Dice coefficient over the sets of word bigrams, 2 |A and B| / (|A| + |B|).
For a coefficient of t, |A| must lie between |B| t / (2 - t) and |B| (2 - t) / t (the size bounds, which prune
windows that a text's ends cut short), so A holds at least |B| t / (2 - t) bigrams of B, and one at least of any
set of |B| - |B| t / (2 - t) + 1 of them. The template's longest bigrams, as many, are its anchors. Each anchor in
a text places one window: as many words as the template has, so that the anchor has the same place in both.
Texts without any anchor's longer word are done at once.

The templates are constants in the plan, BATCH_WORDS of them to an expression, so a larger table of templates
makes more expressions, not larger ones. The scan is one pass with no shuffle; no group of rows meets anywhere.

Defined cases: null and empty texts, and texts without a bigram, match nothing; ties go to the smaller licence
id; templates of under two words are an error; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
BATCH_WORDS = 20_000

#: Notices and short licence texts by SPDX id, as their owners publish them, without title and
#: copyright line. Longer texts come from a table of the caller's.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
]


def words(text: str) -> list[str]:
    """The normalised words of a template."""
    return re.sub(r"[^\w]+|_", " ", text.lower()).split()


def bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a template, in order."""
    w = words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """How many bigrams a window has that can reach the threshold against a template with n."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def anchors(text: str, threshold: float) -> list[tuple[str, int]]:
    """Bigrams of which any window that reaches the threshold has one, with their places, from 0."""
    grams, w = bigrams(text), words(text)
    n = len(grams)
    if not n:
        raise ValueError(f"a template without a word bigram: {text!r}")
    need = math.ceil(threshold * (size_bounds(n, threshold)[0] + n) / 2 - 1e-9)
    best = set(sorted(grams, key=lambda g: (-len(g), g))[: n - need + 1])
    return [(g, i) for i, g in enumerate(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)) if g in best]


def table_templates(table: DataFrame) -> list[tuple[str, str]]:
    """Templates from the columns id and text of a table."""
    return [(r.id, r.text) for r in table.select("id", "text").filter("id IS NOT NULL AND text IS NOT NULL").distinct().collect()]


def batches(templates: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    out: list[list[tuple[str, str]]] = []
    size = 0
    for name, text in sorted(templates):
        size += len(words(text))
        if not out or size > BATCH_WORDS:
            out.append([])
            size = len(words(text))
        out[-1].append((name, text))
    return out


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where the value is made once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _pairs(w: Column) -> Column:
    return F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))


def _hits(templates: list[tuple[str, str]], threshold: float, w: Column) -> Column:
    """Structs of dice and id: windows of the words that reach the threshold."""
    rows, places = [], []
    for i, (name, text) in enumerate(templates):
        grams = bigrams(text)
        lo, hi = size_bounds(len(grams), threshold)
        rows.append(F.struct(F.lit(name).alias("id"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(len(words(text))).alias("words"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))
        places += [(g, i, at) for g, at in anchors(text, threshold)]
    gate = sorted({max(g.split(), key=lambda x: (len(x), x)) for g, _, _ in places})
    anchor = F.array(*map(F.lit, sorted({g for g, _, _ in places})))
    table = F.array(*rows)
    where = F.array(*[F.struct(F.lit(g).alias("gram"), F.lit(i).alias("template"), F.lit(at).alias("at")) for g, i, at in places])

    def windows(grams: Column, present: Column) -> Column:
        """Template and first word (from 0) of each window, from the text's bigrams and the anchors among them."""
        spots = F.filter(F.transform(grams, lambda g, i: F.struct(g.alias("gram"), i.alias("i"))), lambda x: F.array_contains(present, x["gram"]))
        here = F.filter(where, lambda p: F.array_contains(present, p["gram"]))

        def of_place(p: Column, spots: Column) -> Column:
            return F.transform(F.filter(spots, lambda x: x["gram"] == p["gram"]), lambda x: F.struct(p["template"].alias("template"), (x["i"] - p["at"]).alias("first")))

        return _once(spots, lambda spots: F.array_distinct(F.flatten(F.transform(here, lambda p: of_place(p, spots)))))

    def dice(x: Column) -> Column:
        t = F.get(table, x["template"])
        first = F.greatest(x["first"], F.lit(0))
        own = F.array_distinct(_pairs(F.slice(w, first + 1, F.greatest(F.least(x["first"] + t["words"], F.size(w)) - first, F.lit(1)))))

        def value(own: Column) -> Column:  # sizes first, the coefficient only within the bounds
            fits = (F.size(own) >= t["lo"]) & (F.size(own) <= t["hi"])
            return F.when(fits, 2.0 * F.size(F.array_intersect(t["grams"], own)) / (F.size(own) + F.size(t["grams"])))

        return F.struct(_once(own, value).alias("dice"), t["id"].alias("id"))

    def found(grams: Column, present: Column) -> Column:
        return F.filter(F.transform(windows(grams, present), dice), lambda x: x["dice"] >= threshold)

    none = F.array().cast("array<struct<dice:double,id:string>>")
    near = _once(_pairs(w), lambda grams: _once(F.array_intersect(anchor, grams), lambda present: F.when(F.size(present) > 0, found(grams, present)).otherwise(none)))
    return F.when((F.size(w) > 1) & F.arrays_overlap(w, F.array(*map(F.lit, gate))), near).otherwise(none)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license_id and dice of the best window and template (null if none reaches the threshold), and
    n_licenses, how many licences reach it."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    df = docs.select("doc_id", _once(F.split(text, " "), lambda w: F.concat(*[_hits(b, threshold, w) for b in batches(templates)])).alias("hits"))
    df = df.select("doc_id", "hits", F.array_max(F.transform("hits", lambda x: x["dice"])).alias("dice"))
    best = F.filter("hits", lambda x: x["dice"] == F.col("dice"))
    return df.select(
        "doc_id", F.array_min(F.transform(best, lambda x: x["id"])).alias("license_id"), F.round("dice", 6).alias("dice"),
        F.size(F.array_distinct(F.transform("hits", lambda x: x["id"]))).cast("bigint").alias("n_licenses"),
    )


def sql(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same scan in DuckDB's SQL, for the `documents` view."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n".join(f"({i}, {quote(n)}, {len(words(t))}, [{', '.join(map(quote, bigrams(t)))}])" for i, (n, t) in enumerate(templates))
    places = ",\n".join(f"({quote(g)}, {i}, {at})" for i, (_, t) in enumerate(templates) for g, at in anchors(t, threshold))
    return rf"""
WITH t(template, id, n_words, grams) AS (VALUES {rows}),
a(gram, template, at_) AS (VALUES {places}),
docs AS (SELECT doc_id, row_number() OVER () AS row, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents),
pairs AS (SELECT row, unnest(range(0, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM docs),
windows AS (SELECT DISTINCT row, template, i - at_ AS first FROM pairs JOIN a USING (gram)),
own AS (SELECT windows.*, id, grams, w[greatest(first, 0) + 1 : least(first + n_words, len(w))] AS ws FROM windows JOIN t USING (template) JOIN docs USING (row)),
sets AS (SELECT row, id, grams, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM own),
hits AS (
  SELECT row, id, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM sets
  WHERE len(g) >= ceil(len(grams) * {threshold} / (2 - {threshold}) - 1e-9) AND len(g) <= floor(len(grams) * (2 - {threshold}) / {threshold} + 1e-9)
),
good AS (SELECT row, max(dice) AS top, count(DISTINCT id) AS n FROM hits WHERE dice >= {threshold} GROUP BY row)
SELECT docs.doc_id, (SELECT min(id) FROM hits WHERE hits.row = docs.row AND hits.dice = good.top) AS license_id,
  round(good.top, 6) AS dice, coalesce(good.n, 0)::BIGINT AS n_licenses
FROM docs LEFT JOIN good ON docs.row = good.row"""
