"""License scans: Dice coefficient over word bigrams against licence templates.

Texts are normalised (lower case, runs of anything but letters and digits become one
space) and compared with the templates: twice the number of shared bigrams over the sum
of both numbers of bigrams, repeats counted. Three kinds of units are compared: each
line, the text as a whole, and every run of words of the whole text that is as long as
the template, across line ends and inside of lines, so that wrapped notices, notices in
a paragraph and licence texts in longer files are found.

A unit of n bigrams can reach the threshold t only with templates whose number of bigrams
lies between t/(2-t) and (2-t)/t times its own: sizes prune all other templates. Such a
unit holds at least t/(2-t) of the template's bigrams, so of any larger share of them one
is in it: these are the template's anchors, all that hold one of a few words. Texts without a
word of any anchor are left at once, templates without an anchor in the text too, and
only runs around anchors are compared. It is one pass of SQL functions over the rows,
without any shuffle.

Defined results for odd input: a null, empty or wordless text matches nothing
(license null, dice 0); ties go to the licence that sorts first; a null doc_id is
carried through and repeated rows are scanned one by one; texts and lines of any length
are scanned whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short notices and texts of common licences, without copyright lines.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    (
        "ISC",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("AGPL-3.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSL-1.0", 'Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)'),
    ("EPL-2.0", 'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/'),
    ("GPL-2.0", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.'),
    ("LGPL-2.1", 'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.'),
    ("LGPL-3.0", 'This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]
THRESHOLD = 0.8
LONG_WORDS = (7, 5, 1)


def bigrams_of(text: str) -> list[str]:
    """Numbered bigrams of a template: "first second k" for the k-th occurrence."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    seen: dict[str, int] = {}
    out = []
    for pair in zip(words, words[1:], strict=False):
        name = " ".join(pair)
        seen[name] = seen.get(name, 0) + 1
        out.append(f"{name} {seen[name]}")
    return out


def size_bounds(n: int, threshold: float) -> tuple[float, float]:
    """The numbers of bigrams a unit must lie between to reach ``threshold`` with ``n``."""
    return n * threshold / (2 - threshold), n * (2 - threshold) / threshold


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(words: Column) -> Column:
    """The bigrams of an array of two words or more, in their order."""
    return F.transform(F.slice(words, 1, F.size(words) - 1), lambda w, i: F.concat(w, F.lit(" "), F.element_at(words, i + 2)))


def numbered(pairs: Column) -> Column:
    """Sorted bigrams, each with its occurrence number."""
    # sorted, equal ones stand together: the number is the distance from the first of them
    number = lambda p: F.transform(p, lambda x, i: F.concat(x, F.lit(" "), (i + 2 - F.array_position(p, x)).cast("string")))
    return F.element_at(F.transform(F.array(F.sort_array(pairs)), number), 1)


def anchors_of(bodies: list[str], threshold: float) -> tuple[list[list[str]], list[str]]:
    """Distinct bigrams of each template, of which any unit that reaches the threshold has one, and words of which each of them has one.

    The words are few: those that serve the most templates are taken first, long ones before short ones.
    """
    split = [re.sub(r"[^a-z0-9]+", " ", body.lower()).split() for body in bodies]
    pairs = [list(zip(w, w[1:], strict=False)) for w in split]
    wanted = [len(p) - math.ceil(len(p) * threshold / (2 - threshold) - 1e-9) + 1 for p in pairs]
    chosen: list[str] = []
    held: list[list[str]] = [[] for _ in pairs]
    for least in LONG_WORDS:
        while True:
            gain: dict[str, int] = {}
            for p, n in zip(pairs, wanted, strict=True):
                for word in {w for pair in p for w in pair if len(w) >= least}:
                    gain[word] = gain.get(word, 0) + min(n, sum(word in pair for pair in p))
            best = max(gain, key=lambda w: (gain[w], len(w), w), default="")
            if not gain or not gain[best]:
                break
            chosen.append(best)
            for i, p in enumerate(pairs):
                own = [pair for pair in p if best in pair] if wanted[i] > 0 else []
                held[i] += sorted({" ".join(pair) for pair in own})
                wanted[i] -= len(own)
                pairs[i] = [pair for pair in p if best not in pair] if wanted[i] > 0 else []
    return held, [w for w in chosen if not any(x != w and x in w for x in chosen)]


def _anchored(pairs: Column, size: Column, t: Column, threshold: float) -> Column:
    """The best Dice coefficient of a run of as many bigrams as the template's, if it reaches the threshold.

    Only runs that begin at a bigram of the template count: later starts up to the next one
    hold no more of it. A run is looked at if it has more of the template's bigrams, by
    their places alone, than the best one so far shares; so the work is linear in the text.
    """
    n, need = t["n"], F.ceil(t["n"] * threshold - 1e-9).cast("int")
    hits = F.filter(F.transform(pairs, lambda p, i: F.when(F.array_contains(t["plain"], p), i)), lambda i: i.isNotNull())

    def best(places: Column) -> Column:
        shared = lambda start: F.size(F.array_intersect(numbered(F.slice(pairs, start + 1, n)), t["bigrams"]))
        more = lambda most, j: F.coalesce(F.get(places, j + most) - F.get(places, j) < n, F.lit(False))
        step = lambda most, j: F.when(more(most, j), F.greatest(most, shared(F.least(F.get(places, j), size - n)))).otherwise(most)
        return F.when(F.size(places) >= need, F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), need - 1, step))

    found = F.element_at(F.transform(F.array(hits), best), 1)
    return F.when((size >= n) & (found >= need), F.lit(2.0) * found / (n + n))


def license_matches(text: Column, threshold: float = THRESHOLD, templates: list[tuple[str, str]] | None = None) -> Column:
    """Array of (dice, license): the best unit of every template that reaches the threshold."""
    anchors, rare = anchors_of([body for _, body in templates or TEMPLATES], threshold)
    shaped = [(name, bigrams_of(body), a) for (name, body), a in zip(templates or TEMPLATES, anchors, strict=True)]
    bounds = [size_bounds(len(b), threshold) for _, b, _ in shaped]
    strings = lambda found: F.array(*map(F.lit, found))
    known = F.array(*[
        F.struct(F.lit(name).alias("license"), F.lit(len(b)).alias("n"), strings(b).alias("bigrams"), strings(sorted({x.rsplit(" ", 1)[0] for x in b})).alias("plain"), strings(a).alias("anchors")) for name, b, a in shaped
    ])
    least, most = min(a for a, _ in bounds), max(b for _, b in bounds)
    fits = lambda n: (n - 1).between(F.lit(least), F.lit(most))
    dice = lambda unit, t: F.lit(2.0) * F.size(F.array_intersect(unit, t["bigrams"])) / (F.size(unit) + t["n"])

    def of_words(lines: Column) -> Column:
        """The matches of a text, from the words of its lines."""
        return F.flatten(F.transform(F.array(F.flatten(lines)), lambda whole: of_text(lines, whole)))

    def of_text(lines: Column, whole: Column) -> Column:
        fitting = F.concat(F.filter(lines, lambda w: fits(F.size(w))), F.filter(F.array(whole), lambda w: fits(F.size(w))))
        state = F.array(F.struct(F.transform(fitting, bigrams).alias("units"), F.flatten(F.transform(F.filter(F.array(whole), lambda w: F.size(w) > 1), bigrams)).alias("pairs")))

        def compared(x: Column) -> Column:
            near = F.filter(known, lambda t: F.arrays_overlap(x["pairs"], t["anchors"]))

            def best(t: Column) -> Column:
                fair = lambda u: F.size(u).between(t["n"] * threshold / (2 - threshold), t["n"] * (2 - threshold) / threshold)
                sized = F.filter(x["units"], lambda u: fair(u) & F.arrays_overlap(u, t["anchors"]))
                units = F.array_max(F.transform(F.transform(sized, numbered), lambda u: dice(u, t)))
                return F.struct(F.greatest(units, _anchored(x["pairs"], F.size(x["pairs"]), t, threshold)).alias("dice"), t["license"].alias("license"))

            return F.filter(F.transform(near, best), lambda d: F.coalesce(d["dice"] >= threshold, F.lit(False)))

        return F.flatten(F.transform(state, compared))

    some = F.exists(F.array(F.lower(text)), lambda low: reduce(Column.__or__, [low.contains(w) for w in rare]))
    # each line is normalised once; the one-element arrays only give values a name
    lines = F.transform(F.split(text, "\n"), lambda u: F.array_remove(F.split(normalised(u), " "), ""))
    return F.when(some, F.flatten(F.transform(F.array(lines), of_words)))


def scan_documents(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license (the best), dice, n_matches (templates found) and licenses (their names, comma-joined) of every document."""
    found = documents.select("doc_id", F.coalesce(license_matches(F.col("text"), threshold), F.array()).alias("found"))
    best = F.aggregate(
        "found", F.struct(F.lit(0.0).alias("dice"), F.lit(None).cast("string").alias("license")),
        lambda a, x: F.when((x["dice"] > a["dice"]) | ((x["dice"] == a["dice"]) & (x["license"] < a["license"])), x).otherwise(a),
    )
    names = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"])))
    return found.select("doc_id", best.alias("best"), F.size("found").cast("bigint").alias("n_matches"), F.array_join(names, ",").alias("licenses")).select(
        "doc_id", F.col("best.license").alias("license"), F.round("best.dice", 6).alias("dice"), "n_matches", "licenses"
    )


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The same scan in DuckDB SQL, from bigram rows instead of arrays."""
    quoted = ",\n".join(f"({i}, '{name}', '{re.sub(r'[^a-z0-9]+', ' ', body.lower()).strip()}')" for i, (name, body) in enumerate(TEMPLATES))
    anchors = ", ".join(f"({i}, '{a}')" for i, found in enumerate(anchors_of([body for _, body in TEMPLATES], threshold)[0]) for a in found)
    return f"""
WITH templates(t, license, body) AS (VALUES {quoted}),
anchors(t, pair) AS (VALUES {anchors}),
t_words AS (SELECT t, license, string_split(body, ' ') AS w FROM templates),
t_pairs AS (SELECT t, license, len(w) - 1 AS n, w[i] || ' ' || w[i + 1] AS pair FROM t_words, range(1, 400) r(i) WHERE i < len(w)),
t_counts AS (SELECT t, license, n, pair, count(*) AS c FROM t_pairs GROUP BY ALL),
sizes AS (SELECT DISTINCT t, license, n FROM t_counts),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
units AS (SELECT r, unnest(string_split(text, chr(10))) AS unit FROM docs UNION ALL SELECT r, text FROM docs WHERE contains(text, chr(10))),
normal AS (SELECT row_number() OVER () AS k, r, string_split(trim(regexp_replace(lower(unit), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM units),
fitting AS (SELECT k, r, w, len(w) - 1 AS n FROM normal WHERE len(w) BETWEEN 2 AND 800),
counts AS (SELECT k, r, n, pair, count(*) AS c FROM (SELECT k, r, n, w[i] || ' ' || w[i + 1] AS pair FROM fitting, range(1, 800) q(i) WHERE i < len(w)) GROUP BY ALL),
shared AS (SELECT k, r, counts.n AS n, t, license, t_counts.n AS m, sum(least(counts.c, t_counts.c)) AS s FROM counts JOIN t_counts USING (pair) GROUP BY ALL),
whole AS (SELECT r, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM docs),
pairs AS (SELECT r, size, i, w[i + 1] || ' ' || w[i + 2] AS pair FROM (SELECT r, w, len(w) - 1 AS size, unnest(range(0, len(w) - 1)) AS i FROM whole)),
starts AS (SELECT DISTINCT r, t, license, n, unnest(range(greatest(0, i - n + 1), least(i, size - n) + 1)) AS s FROM pairs JOIN anchors USING (pair) JOIN sizes USING (t) WHERE size >= n),
inside AS (SELECT st.r, st.t, st.license, st.n, st.s, p.pair, count(*) AS c FROM starts st JOIN pairs p ON p.r = st.r AND p.i >= st.s AND p.i < st.s + st.n GROUP BY ALL),
runs AS (SELECT inside.r, inside.t, inside.license, inside.n, s, sum(least(inside.c, t_counts.c)) AS hit FROM inside JOIN t_counts ON t_counts.t = inside.t AND t_counts.pair = inside.pair GROUP BY ALL),
each AS (
  SELECT r, t, license, 2.0::DOUBLE * s / (n + m) AS dice FROM shared WHERE 2.0::DOUBLE * s / (n + m) >= {threshold}
  UNION ALL SELECT r, t, license, 2.0::DOUBLE * hit / (n + n) FROM runs WHERE 2.0::DOUBLE * hit / (n + n) >= {threshold}
),
found AS (SELECT r, t, license, max(dice) AS dice FROM each GROUP BY ALL),
best AS (SELECT r, license, dice, row_number() OVER (PARTITION BY r ORDER BY dice DESC, license) AS place FROM found),
names AS (SELECT r, count(*) AS n_matches, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM found GROUP BY r)
SELECT doc_id, license, round(coalesce(dice, 0)::DOUBLE, 6) AS dice, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(licenses, '') AS licenses
FROM docs LEFT JOIN names USING (r) LEFT JOIN (SELECT * FROM best WHERE place = 1) USING (r)
"""
