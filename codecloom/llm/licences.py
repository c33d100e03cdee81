"""Licence scans in DataFrame operations only: normalised lines and windows against templates by the Dice coefficient of word bigrams.

A text's units are its lines and, where a paragraph has several lines, the paragraph. Notices within longer lines or paragraphs, or wrapped
in comment blocks, are found by windows over the words of the whole text, which know no lines and no comment marks: a template that no unit
matches is looked for in the windows that begin and end with one of its bigrams (others only lose by what stands outside) and whose length is
within the bounds below, if the text shares enough bigrams with it at all. A unit is lower-cased and reduced to words of letters
and digits; its distinct bigrams are compared with a template's only if the sizes allow the threshold at all: with ``a`` and ``b``
bigrams Dice is at most ``2 min(a, b) / (a + b)``. By the same bound a match shares so many of a template's bigrams that it must hold one
of any set that leaves fewer out; so a few key words, chosen from the templates, occur in every text and unit that can match, and
all others are dropped before they are split. Templates (a parameter; ``templates_of`` reads a table) are part of the expression: nothing is joined and no key can be hot.

Results in odd cases: null and empty texts, and units of fewer than two words, match nothing. Of several units matching one template in a
document the best counts, equals by the first line; windows count only without any such unit, the best one, equals by the first. Repeated rows are reported each. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Licence notices as they are put into files, and some whole licences.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "mit": "Released under the MIT License.",
    "mit-permission": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions:"
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version."
    ),
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit-full": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "bsd-3-clause-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        'from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "isc-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE '
        "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "zlib-full": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone "
        "to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
}
#: A table of more templates than this is refused: they are part of the expression, not joined.
MOST_TEMPLATES = 1_000


def templates_of(table: DataFrame) -> dict[str, str]:
    """Templates from a table (name, text), for ``scan_licences``."""
    rows = table.select("name", "text").limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    return {r.name: r.text for r in rows if r.name is not None and len(words_of(r.text or "")) > 1}


def words_of(text: str) -> list[str]:
    return [w for w in re.sub(r"[^a-z0-9]+", " ", text.lower()).split(" ") if w]


def _grams(text: str) -> set[tuple[str, str]]:
    w = words_of(text)
    return set(zip(w, w[1:], strict=False))


def key_words(threshold: float, templates: dict[str, str] = TEMPLATES) -> list[str]:
    """Words of which every unit that reaches the threshold for some template holds one.

    Of ``n`` bigrams a match shares ``need = ceil(threshold / (2 - threshold) * n)`` at least, so it holds one of any ``n - need + 1``.
    """
    left = {}
    for name, text in templates.items():
        g = _grams(text)
        left[name] = [g, len(g) - math.ceil(threshold / (2 - threshold) * len(g) - 1e-9) + 1]
    chosen: list[str] = []
    while any(k > 0 for _, k in left.values()):
        gain: dict[str, int] = {}
        for g, k in left.values():
            for w in {w for pair in g for w in pair if len(w) > 4} or {w for pair in g for w in pair}:
                gain[w] = gain.get(w, 0) + min(max(k, 0), sum(w in pair for pair in g))
        best = max(gain, key=lambda w: (gain[w], len(w), w))
        if not gain[best]:  # no long word is left: take any
            gain = {w: len(w) for g, k in left.values() if k > 0 for pair in g for w in pair}
            best = max(gain, key=lambda w: (gain[w], w))
        chosen.append(best)
        for entry in left.values():
            hit = {pair for pair in entry[0] if best in pair}
            entry[0], entry[1] = entry[0] - hit, entry[1] - len(hit)
    return chosen


def _template_rows(threshold: float, templates: dict[str, str]) -> Column:
    rows = []
    for name, text in templates.items():
        w = words_of(text)
        grams = sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})
        n, ratio = len(grams), threshold / (2 - threshold)
        bounds = [F.lit(math.ceil(n * ratio - 1e-9)).alias("least"), F.lit(math.floor(n / ratio + 1e-9)).alias("most")]
        rows.append(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(n).alias("n"), *bounds))
    return F.array(*rows)


def _units(text: Column) -> Column:
    """(line, text) of each line, of each paragraph of several lines at its first line, and of the whole text at line -1."""
    lines = F.split(text, "\n")
    single = F.transform(lines, lambda x, i: F.struct(i.cast("long").alias("line"), x.alias("unit")))
    # every line carries its number while the text is split at empty lines, so a block knows its first line
    numbered = F.array_join(F.transform(lines, lambda x, i: F.concat(i.cast("string"), F.lit("\x01"), x)), "\n")
    blocks = F.split(numbered, r"\n\d+\x01[ \t\r]*\n")
    long_blocks = F.filter(blocks, lambda b: F.contains(b, F.lit("\n")))
    several = F.transform(long_blocks, lambda b: F.struct(F.regexp_extract(b, r"^(\d+)\x01", 1).cast("long").alias("line"), F.regexp_replace(b, r"(?m)^\d+\x01", "").alias("unit")))
    return F.concat(single, several, F.array(F.struct(F.lit(-1).cast("long").alias("line"), text.alias("unit"))))


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def _dice(grams: Column, x: Column, known: Column | None = None) -> Column:
    """Of distinct bigrams and a template. ``known``: those of the bigrams that any template holds."""
    return 2 * F.size(F.array_intersect(grams if known is None else known, x["grams"])) / (x["n"] + F.size(grams))


def _best_window(grams: Column, x: Column) -> Column:
    """(dice, minus the first word's place) of the best window of a text's bigrams for a template, equals by the first; null without any."""
    starts = F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda i: F.array_contains(x["grams"], F.get(grams, i)))
    cut = F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice(grams, i + 1, x["most"]).alias("seg")))
    cut = F.filter(cut, lambda c: F.size(F.array_intersect(c["seg"], x["grams"])) >= x["least"])

    def of(c: Column) -> Column:
        ends = F.filter(F.sequence(x["least"], F.size(c["seg"])), lambda e: F.array_contains(x["grams"], F.get(c["seg"], e - 1)))
        return F.transform(ends, lambda e: F.struct(_dice(F.array_distinct(F.slice(c["seg"], 1, e)), x).alias("dice"), (-c["at"]).alias("before")))

    return F.array_max(F.flatten(F.transform(cut, of)))


def _line_of_word(text: Column, place: Column) -> Column:
    """The line, from 0, that holds a text's word of that number: as many lines end before it."""
    counts = F.transform(F.split(text, "\n"), lambda x: F.size(F.filter(_words(x), lambda w: w != "")))
    zero = F.struct(F.lit(0).alias("seen"), F.lit(0).cast("long").alias("line"))
    return F.aggregate(counts, zero, lambda a, c: F.struct((a["seen"] + c).alias("seen"), (a["line"] + F.when(a["seen"] + c <= place, 1).otherwise(0)).alias("line")))["line"]


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> DataFrame:
    """A row per document and template found: id, licence, line (of the best unit, from 0), dice. ``templates``: texts by name (of two words or more), TEMPLATES by default."""
    templates = templates or TEMPLATES
    sizes = [len(_grams(text)) for text in templates.values()]
    low, high = threshold / (2 - threshold) * min(sizes), (2 - threshold) / threshold * max(sizes)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    # whole words only; the look behind it lets the pattern fail at once within words
    keys = f"(?<![a-z0-9])(?:{'|'.join(key_words(threshold, templates))})(?![a-z0-9])"
    every = F.array(*map(F.lit, sorted({f"{a} {b}" for text in templates.values() for a, b in _grams(text)})))
    least = min(math.ceil(threshold / (2 - threshold) * n - 1e-9) for n in sizes)
    rows = rows.where(F.lower("text").rlike(keys))
    units = rows.select("id", "row", F.explode(_units(F.col("text"))).alias("u")).where(F.lower("u.unit").rlike(keys))
    # a unit has at least as many words as bigrams and one; far longer ones cannot come down to a template's size unless they repeat
    # explode of one element keeps Spark from writing the expression out at each use
    once = lambda c: F.explode(F.array(c))
    whole = F.col("line") < 0
    text = F.when(F.col("u.line") < 0, F.col("u.unit")).alias("whole_text")
    units = units.where(F.length("u.unit") >= int(low)).select("id", "row", "u.line", text, once(_words(F.col("u.unit"))).alias("w")).where(F.size("w") > int(low))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))
    units = units.select("id", "row", "line", "whole_text", once(grams).alias("all"))
    units = units.select("id", "row", "line", "whole_text", F.when(whole, F.col("all")).alias("all"), once(F.array_distinct("all")).alias("g")).where(whole | F.size("g").between(low, high))
    # a match shares so many bigrams with its template, so as many with all of them
    units = units.select("*", once(F.array_intersect("g", every)).alias("known")).where(F.size("known") >= least)
    t = threshold
    fits = F.filter(
        _template_rows(t, templates),
        lambda x: F.when(whole, F.size(F.array_intersect(F.col("known"), x["grams"])) >= x["least"]).otherwise((2 * F.least(x["n"], F.size("g"))) >= t * (x["n"] + F.size("g"))),
    )
    pairs = units.select("id", "row", "line", "whole_text", "all", "g", "known", F.explode(fits).alias("x"))
    found = F.when(whole, _best_window(F.col("all"), F.col("x"))).otherwise(F.struct(_dice(F.col("g"), F.col("x"), F.col("known")).alias("dice"), F.lit(0).alias("before")))
    hits = pairs.select("id", "row", "line", "whole_text", F.col("x.name").alias("licence"), once(found).alias("s")).where(F.col("s.dice") >= t)
    # a unit's line counts before any window
    hits = hits.select("id", "row", "licence", "s.dice", F.when(whole, 0).otherwise(1).alias("unit"), F.when(whole, _line_of_word(F.col("whole_text"), -F.col("s.before"))).otherwise(F.col("line")).alias("line"))
    return hits.groupBy("row", "licence").agg(F.first("id").alias("id"), F.max_by(F.struct("line", "dice"), F.struct("unit", "dice", -F.col("line"))).alias("b")).select("id", "licence", "b.line", "b.dice")
