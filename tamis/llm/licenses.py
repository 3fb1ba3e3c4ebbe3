"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

All windows of consecutive words of a document are compared, whatever lines or paragraphs they reach over, so the
whole, its paragraphs and its lines are among them. Normalising lower-cases and turns everything but letters and
digits into single spaces. With bigram sets A of a window and B of a template, Dice is ``2 |A & B| / (|A| + |B|)``.

A Dice of t or more needs ``|A & B| >= |B| t / (2 - t)``, so a document is searched only for the templates of which it
holds that many bigrams anywhere. The search leaves out windows that a shorter one equals or beats: those whose first
or last bigram is not the template's, or stands in the window once more. A start so reaches as far as its bigram's next
place, and the work for a template is at most the words of the document times the bigrams of the template.

Everything is row-local in DataFrame functions: no shuffle, and no copy, source or line can become hot.
The templates are a parameter whose size does not depend on the documents.

Defined cases: a null text is an empty one and matches nothing; a text of less than two words has no
bigram and matches nothing; a licence counts once per document, with its best Dice; repeated rows and equal
ids each give a row; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8


@dataclass(frozen=True)
class Template:
    license: str
    text: str


# Public licence notices as they are printed in files and pages.
TEMPLATES = (
    Template("MIT", "Released under the MIT License."),
    Template("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    Template("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    Template("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    Template(
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,'
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do"
        " so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or"
        ' substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING'
        " BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"
        " AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
        " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    Template(
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that"
        ' the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS'
        " ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    Template(
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You'
        " may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in"
        ' writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,'
        " either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    Template(
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published"
        " by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed"
        " in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A"
        " PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    Template(
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this"
        " file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
)


def normalised(text: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def bigrams(text: str) -> list[str]:
    words = normalised(text).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def admitted(size: int, threshold: float) -> range:
    """Sizes of bigram sets that can reach the threshold against a set of ``size``."""
    return range(math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9) + 1)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def bigrams_of(text: Column) -> Column:
    """The bigrams of a text in order, repeated ones too."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    return _let(
        words, lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
    )


def _places(grams: Column) -> Column:
    """Bigrams by place, each with the places where it stands last before and next after."""

    def linked(ranked: Column) -> Column:
        def near(x: Column, at: Column, none: Column) -> Column:
            other = F.get(ranked, at)
            return F.when(other["gram"] == x["gram"], other["at"]).otherwise(none)

        return F.transform(
            ranked,
            lambda x, k: F.struct(
                x["at"].alias("at"),
                x["gram"].alias("gram"),
                near(x, k - 1, F.lit(-1)).alias("before"),
                near(x, k + 1, F.size(ranked)).alias("after"),
            ),
        )

    ranked = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("gram"), i.alias("at"))))
    return F.sort_array(_let(ranked, linked))


def _best(places: Column, template: Column) -> Column:
    """The best Dice of all windows of consecutive words; null if no bigram is the template's."""
    marked = F.transform(
        places,
        lambda p: F.struct(
            p["at"].alias("at"), p["before"].alias("before"), p["after"].alias("after"), F.array_contains(template["grams"], p["gram"]).alias("held")
        ),
    )

    def opened(all_: Column, start: Column) -> Column:
        """The best Dice of the windows that open at a start: new bigrams are counted as the window grows."""
        fresh = F.filter(F.slice(all_, start["at"] + 1, start["after"] - start["at"]), lambda p: p["before"] < start["at"])
        ends = F.filter(F.transform(fresh, lambda p, i: F.struct((i + 1).alias("size"), p["held"].alias("held"))), lambda e: e["held"])
        dice = F.transform(ends, lambda e, i: F.lit(2.0) * (i + 1) / (e["size"] + F.size(template["grams"])))
        return F.array_max(dice)

    return _let(marked, lambda m: F.array_max(F.transform(F.filter(m, lambda p: p["held"]), lambda start: opened(m, start))))


def matches(text: Column, templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """Array of (license, dice) of the templates that reach the threshold in some window of the text."""
    rows, known = [], set()
    for template in templates:
        grams = bigrams(template.text)
        known |= set(grams)
        least = admitted(len(grams), threshold).start
        rows.append(F.struct(F.lit(template.license).alias("license"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(least).alias("least")))
    table, known = F.array(*rows), F.array(*map(F.lit, sorted(known)))

    def compared(grams: Column) -> Column:
        def likely(common: Column) -> Column:
            return F.filter(table, lambda t: (F.size(common) >= t["least"]) & (F.size(F.array_intersect(common, t["grams"])) >= t["least"]))

        def rated(found: Column) -> Column:
            best = _let(_places(grams), lambda p: F.transform(found, lambda t: F.struct(t["license"].alias("license"), _best(p, t).alias("dice"))))
            return F.when(F.size(found) > 0, F.filter(best, lambda m: m["dice"] >= threshold))

        return _let(_let(F.array_intersect(grams, known), likely), rated)

    none = F.array().cast("array<struct<license:string,dice:double>>")
    return F.coalesce(_let(bigrams_of(text), compared), none)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, licenses): every row with its licences, each with its best Dice, by name."""
    found = df.select(F.col(key), matches(F.col(text), templates, threshold).alias("found"))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda m: m["license"])))
    best = F.transform(
        names,
        lambda n: F.struct(
            n.alias("license"),
            F.array_max(F.transform(F.filter("found", lambda m: m["license"] == n), lambda m: m["dice"])).alias("dice"),
        ),
    )
    return found.select(key, best.alias("licenses"))
