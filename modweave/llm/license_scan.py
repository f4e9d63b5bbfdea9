"""Licence scans: text lines compared to licence templates by the Dice coefficient of word bigrams."""

from __future__ import annotations

from collections import Counter
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Licence notices by their public identifiers. The wording is that of the licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-terms": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-conditions": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-disclaimer": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def template_words(text: str) -> list[str]:
    lowered = "".join(c if c.isascii() and c.isalnum() else " " for c in text.translate({k: k + 32 for k in range(65, 91)}))
    return lowered.split()


def _bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _either(marks: list[list[str]]) -> str:
    """A pattern of any of the word runs that begins alike for runs that begin alike, so that few letters are tried at a place."""
    tree: dict = {}
    for run in marks:
        at = tree
        for letter in [c for k, word in enumerate(run) for c in ([_GAP] if k else []) + list(word)]:
            at = at.setdefault(letter, {})
        at[""] = {}

    def told(at: dict) -> str:
        if "" in at:  # what is longer begins with it
            return ""
        parts = [c + told(below) for c, below in sorted(at.items())]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return told(tree)


_GAP = "[^A-Za-z0-9]+"


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """Lines and paragraphs of each document that are a licence notice.

    ``docs`` needs ``doc_id`` and ``text``; other columns aren't read. Returns one row per input row:
    ``doc_id``, ``n_lines`` (lines with words), ``n_license_lines`` (lines that match a template),
    ``n_license_blocks`` (paragraphs of two such lines or more that match one, as wrapped notices do),
    ``license`` (the template of the best match, ties to the smaller name; null if none) and ``dice``.

    Lines end with a carriage return, a newline or both; an empty line parts paragraphs. Both are lower-cased, every
    character but a-z and 0-9 parts words. They match a template when twice the shared distinct bigrams is ``least`` or
    more of both counts together. Null, empty and one-word texts have no match. Repeated rows and null ids are kept as
    they are; an empty table gives no rows.

    A template is compared to parts of a bounded number of bigrams only, and only where the part holds one of
    the template's rarest bigrams: a match shares so many that it can't miss them all. Everything is one
    projection; nothing is shuffled.
    """
    chosen = TEMPLATES if templates is None else templates
    share = Fraction(str(least))
    grams = {name: g for name, text in sorted(chosen.items()) if (g := _bigrams(template_words(text)))}
    spread = Counter(g for one in grams.values() for g in one)
    docs = pick(docs, "doc_id", "text")
    anchors = {}
    for name, own in grams.items():
        # of a match at its smallest size; in whole numbers, as a rounded bound may be one too high
        shared = -(-share.numerator * len(own) // (2 * share.denominator - share.numerator))
        anchors[name] = sorted(own, key=lambda g: (spread[g], g))[: max(1, len(own) - shared + 1)]
    # anchors are looked for in the whole text first: most documents hold none
    marks = sorted({g for a in anchors.values() for g in a})
    marked = lambda x: x.rlike("(?i)(?<![a-z0-9])" + _either([g.split() for g in marks]))
    clean = lambda x: F.trim(F.regexp_replace(F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " "))
    with_words = lambda x: F.filter(x, lambda y: y.rlike("[A-Za-z0-9]"))
    none = F.array().cast("array<string>")

    def hits(parts: Column) -> Column:
        kept = F.transform(F.filter(parts, marked), clean)
        return F.filter(F.transform(kept, lambda x: _best(x, grams, anchors, least)), lambda h: h["dice"] >= least)

    blocks = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n[ \t]*\n\\s*")
    wrapped = F.filter(blocks, lambda x: x.rlike("[A-Za-z0-9][^\n]*\n[^A-Za-z0-9]*[A-Za-z0-9]"))
    possible = marked(F.col("text")) if marks else F.lit(False)
    found = docs.withColumn("lines", with_words(F.split("text", "[\r\n]")))
    found = found.withColumn("line_hits", hits(F.when(possible, F.col("lines")).otherwise(none))).withColumn("block_hits", hits(F.when(possible, wrapped).otherwise(none)))
    every = F.transform(F.concat("line_hits", "block_hits"), lambda h: F.struct((-h["dice"]).alias("d"), h["name"].alias("name")))
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return found.withColumn("top", F.array_min(every)).select(
        "doc_id", count("lines").alias("n_lines"), count("line_hits").alias("n_license_lines"), count("block_hits").alias("n_license_blocks"),
        F.col("top.name").alias("license"), (-F.col("top.d")).alias("dice"),
    )


def _best(line: Column, grams: dict, anchors: dict, least: float) -> Column:
    # one-element arrays bind a value, which a plain expression would compute again at each use
    def bigrams(words: Column) -> Column:
        return F.when(
            F.size(words) > 1,
            F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.concat(F.element_at(words, k), F.lit(" "), F.element_at(words, k + 1)))),
        ).otherwise(F.array().cast("array<string>"))

    def compare(held: Column) -> Column:
        size = F.size(held)
        options = []
        for name, template in grams.items():
            n = len(template)
            low, high = n * least / (2 - least), n * (2 - least) / least
            near = size.between(F.lit(low - 1e-9), F.lit(high + 1e-9)) & reduce(lambda a, b: a | b, (F.array_contains(held, g) for g in anchors[name]))
            shared = F.size(F.array_intersect(held, F.array(*(F.lit(g) for g in template))))
            dice = F.when(near, shared * F.lit(2.0) / (size + n)).otherwise(F.lit(0.0))
            options.append(F.struct((-dice).alias("d"), F.lit(name).alias("name")))
        return F.array_min(F.array(*options))

    own = F.transform(F.array(F.split(F.trim(line), " +")), bigrams)
    least_one = F.element_at(F.transform(own, compare), 1)
    return F.struct((-least_one["d"]).alias("dice"), least_one["name"].alias("name"))
