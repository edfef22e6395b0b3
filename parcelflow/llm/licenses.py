"""License scans: lines and blocks of a text against license templates by Dice coefficient over word bigrams.

A unit is a line, or a run of up to RUN neighbouring blocks between blank lines (a license of several paragraphs is one). Units and
templates are lower-cased and stripped of everything but letters and digits; their sets of word bigrams A and B give
2|A n B| / (|A| + |B|). Bounds prune without loss: a template is a candidate only if |A| lies between t/(2-t) and (2-t)/t
times |B|, t being the threshold; a run with a block beyond the greatest of these is no unit; and since at least that
share of B must be in A, a text without any of a template's key words (those in more bigrams than may be missing) can't hold it.

With `within`, texts of which no unit matches are searched for notices inside longer lines and blocks, and for licenses of more than RUN blocks, by every
template: a unit is then any run of words, however long. Without loss, only such runs are tried as begin with a bigram of the template that isn't found in the run again (a shorter run
would do as well), and only as far as their distinct bigrams are no more than the upper bound. So the work is at most a text's words times
a template's bigrams, and few texts have enough of a template's bigrams to begin. n_units counts lines and runs of blocks only.

Everything is built-in column functions of one row: no shuffle, no explode. Templates are one array, so their number doesn't
lengthen the plan. Defined results: null and empty texts hold no
license; the license of greatest coefficient wins, of equal ones the first name; repeated rows are judged alike; texts of any
length are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Blocks of one unit at most, and bigrams of a template that is looked for inside longer units: any number.
RUN, WITHIN = 8, math.inf

# Published license notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)


#: Words that many texts hold, and letters from common to rare: a key word should be rare.
EVERYDAY = {"and", "by", "for", "is", "of", "that", "the", "this", "under", "with", "without"}
LETTERS = "etaoinshrdlucmfwypvbgkjqxz"


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def key_words(bigrams: list[str], threshold: float) -> list[str]:
    """Words such that a unit with none of them misses too many of these bigrams: long ones that are in many bigrams first, everyday ones last."""
    n, rest, keys = len(bigrams), [b.split() for b in bigrams], []
    words = {w for b in rest for w in b}
    while 2 * len(rest) / (len(rest) + n) >= threshold - 1e-9:
        word = max(words - set(keys), key=lambda w: (len(w) >= 8, w not in EVERYDAY, sum(w in b for b in rest) if len(w) >= 8 else 0, len(w), sum(LETTERS.find(c) for c in w), w))
        keys.append(word)
        rest = [b for b in rest if word not in b]
    return keys


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def neighbours(unit: Column) -> Column:
    words = F.split(unit, " ")
    return F.zip_with(F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - 1)), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))


def bigrams(unit: Column) -> Column:
    return F.array_distinct(neighbours(unit))


def units(text: Column, high: float) -> Column:
    """Distinct lines and runs of up to RUN blocks, normalised, without runs that a block of more than `high` bigrams is in."""
    plain = F.filter(F.transform(F.split(text, r"\n[ \t\r]*\n"), normalised), lambda u: u != "")
    blocks = F.transform(plain, lambda u: F.struct(u.alias("text"), (F.size(bigrams(u)) <= high).alias("fits")))

    def runs(blocks: Column) -> Column:
        def of(k: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(1), F.size(blocks)), lambda i: (i + k - 1 <= F.size(blocks)) & F.forall(F.slice(blocks, i, k), lambda b: b["fits"]))
            return F.transform(starts, lambda i: F.array_join(F.transform(F.slice(blocks, i, k), lambda b: b["text"]), " "))

        return F.when(F.size(blocks) > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.lit(RUN)), of))).otherwise(F.array().cast("array<string>"))

    lines = F.filter(F.transform(F.split(text, "\n"), normalised), lambda u: u != "")
    return F.array_distinct(F.concat(lines, _let(blocks, runs)))


def best_match(text: Column, templates=TEMPLATES, threshold: float = THRESHOLD) -> tuple[Column, Column]:
    """(whether a text may hold a license, array of the matches' (-dice, license) over its units)."""
    known = [(name, template_bigrams(t)) for name, t in templates]
    low = min(len(b) for _, b in known) * threshold / (2 - threshold)
    high = max(len(b) for _, b in known) * (2 - threshold) / threshold
    plain = F.lower(text)
    keys = sorted({k for _, b in known for k in key_words(b, threshold)})
    keys = [k for k in keys if not any(o != k and o in k for o in keys)]
    may = reduce(lambda a, b: a | b, [F.contains(plain, F.lit(k)) for k in keys])

    listed = F.array(*[F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, b)).alias("b")) for name, b in known])

    def against(a: Column) -> Column:
        def one(t: Column) -> Column:
            size, n = F.size(a), F.size(t["b"])
            dice = 2.0 * F.size(F.array_intersect(a, t["b"])) / (size + n)
            fits = (size * (2 - threshold) >= n * threshold) & (size * threshold <= n * (2 - threshold))
            return F.struct(F.when(fits, -dice).alias("minus_dice"), t["license"].alias("license"))

        return F.array_min(F.filter(F.transform(listed, one), lambda f: f["minus_dice"] <= -threshold))

    sized = F.filter(F.transform(units(text, high), bigrams), lambda a: (F.size(a) >= low) & (F.size(a) <= high))
    matches = F.filter(F.transform(sized, against), lambda m: m.isNotNull())
    return may, matches


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def places(pairs: Column, every: list[str]) -> Column:
    """A text's bigrams in order: where each one is found before (-1: nowhere) and after (their number: nowhere), and itself if it is one of `every`."""
    ordered = F.sort_array(F.transform(pairs, lambda p, i: F.struct(p.alias("pair"), i.alias("at"))))

    def linked(s: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            near = lambda y: F.when(y["pair"] == x["pair"], y["at"])
            before, after = F.coalesce(near(F.get(s, k - 1)), F.lit(-1)), F.coalesce(near(F.get(s, k + 1)), F.size(s))
            return F.struct(x["at"].alias("at"), before.alias("before"), after.alias("after"), F.when(x["pair"].isin(every), x["pair"]).alias("mark"))

        return F.sort_array(F.transform(s, one))

    return _let(ordered, linked)


def best_run(at: Column, t: Column) -> Column:
    """The greatest coefficient of any run of a text's bigrams (see places()) with a template; null if no run can match."""
    n, step = F.size(t["b"]), 2 * t["most"]
    marked = F.transform(at, lambda p: p.withField("hit", p["mark"].isNotNull() & F.array_contains(t["b"], p["mark"])))

    def within(marked: Column) -> Column:
        def of(start: Column) -> Column:
            first, end = start["at"], start["after"]

            def further(so: Column, k: Column) -> Column:
                begin = first + k * step
                new = F.filter(F.slice(marked, begin + 1, F.least(step, end - begin)), lambda p: p["before"] < first)

                def count(new: Column) -> Column:
                    hits = F.filter(F.transform(new, lambda p, m: F.struct(m.alias("m"), p["hit"].alias("hit"))), lambda p: p["hit"])

                    def add(hits: Column) -> Column:
                        dice = F.array_max(F.transform(hits, lambda h, j: 2.0 * (so["both"] + j + 1) / (so["size"] + h["m"] + 1 + n)))
                        return F.struct((so["size"] + F.size(new)).alias("size"), (so["both"] + F.size(hits)).alias("both"), F.greatest(so["dice"], dice).alias("dice"))

                    return _let(hits, add)

                return F.when(so["size"] <= t["most"], _let(new, count)).otherwise(so)

            none = F.struct(F.lit(0).alias("size"), F.lit(0).alias("both"), F.lit(0.0).alias("dice"))
            return F.aggregate(F.sequence(F.lit(0), F.floor((end - first - 1) / step).cast("int")), none, further, lambda so: so["dice"])

        def starts(hits: Column) -> Column:
            enough = F.filter(hits, lambda h, k: F.get(hits, k + t["least"] - 1)["at"] < h["after"])
            return F.array_max(F.transform(enough, of))

        return _let(F.filter(marked, lambda p: p["hit"]), starts)

    return _let(marked, within)


def best_within(text: Column, templates=TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """The least (-dice, license) of any run of the text's words; null if none matches."""
    known = [(name, b) for name, t in templates if len(b := template_bigrams(t)) <= WITHIN]
    bounds = [(math.ceil(len(b) * threshold / (2 - threshold) - 1e-9), math.floor(len(b) * (2 - threshold) / threshold + 1e-9)) for _, b in known]
    listed = F.array(*[F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, b)).alias("b"), F.lit(low).alias("least"), F.lit(high).alias("most")) for (name, b), (low, high) in zip(known, bounds)])
    every = sorted({x for _, b in known for x in b})

    def among(pairs: Column) -> Column:
        found = F.array_distinct(F.filter(pairs, lambda p: p.isin(every)))
        fit = _let(found, lambda f: F.filter(listed, lambda t: F.size(F.array_intersect(t["b"], f)) >= t["least"]))

        def tried(fit: Column) -> Column:
            runs = lambda at: F.transform(fit, lambda t: F.struct((-best_run(at, t)).alias("minus_dice"), t["license"].alias("license")))
            return F.when(F.size(fit) > 0, F.array_min(F.filter(_let(places(pairs, every), runs), lambda f: f["minus_dice"] <= -threshold)))

        return _let(fit, tried)

    return _let(neighbours(normalised(text)), among)


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, within: bool = False) -> DataFrame:
    """doc_id, license, dice (of the best unit; null if none), n_units (distinct lines and runs of blocks that match any template)."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    may, matches = best_match(F.col("text"), templates, threshold)
    rows = rows.select("doc_id", "text", F.when(may, matches).alias("found"))
    best = F.array_min("found")
    if within:
        rows = rows.select("doc_id", "found", F.when(F.size("found") == 0, best_within(F.col("text"), templates, threshold)).alias("inside"))
        best = F.coalesce(best, F.col("inside"))
    return rows.select("doc_id", best["license"].alias("license"), (-best["minus_dice"]).alias("dice"), F.coalesce(F.size("found"), F.lit(0)).alias("n_units"))


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), within=True)
    return out.withColumn("n_units", F.greatest(F.lit(0), "n_units").cast("long"))


def oracle() -> str:
    rows = ", ".join("('{}', [{}])".format(name, ", ".join(f"'{b}'" for b in template_bigrams(t))) for name, t in TEMPLATES)
    return rf"""
WITH t(license, b) AS (VALUES {rows}),
s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, list_filter(regexp_split_to_array(coalesce(text, ''), '\n[ \t\r]*\n'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')) AS b FROM documents),
v AS (SELECT doc_id, unnest(lines) AS l FROM s UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(b) - k + 2), lambda i: array_to_string(b[i:i + k - 1], chr(10)))) AS l FROM s, (SELECT unnest(range(1, {RUN + 1})) AS k)),
u AS (SELECT DISTINCT doc_id, trim(regexp_replace(lower(l), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS l FROM v),
g AS (SELECT doc_id, l, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a FROM (SELECT doc_id, l, string_split(l, ' ') AS w FROM u WHERE l <> '')),
m AS (SELECT doc_id, l, license, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM g, t WHERE len(a) * 1.2 >= len(b) * 0.8 AND len(a) * 0.8 <= len(b) * 1.2),
h AS (SELECT * FROM m WHERE dice >= 0.8),
best AS (SELECT doc_id, arg_min(license, (-dice, license)) AS license, max(dice) AS dice, count(DISTINCT l) AS n FROM h GROUP BY doc_id)
SELECT doc_id, best.license, best.dice, CAST(coalesce(n, 0) AS BIGINT) AS n_units FROM documents LEFT JOIN best USING (doc_id)
"""
