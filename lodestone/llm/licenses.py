"""Licence scans: TF-IDF cosine of headers to licence templates, then inheritance from the nearest ancestor directory.

Every window of up to WINDOW_LINES lines or WINDOW_SENTENCES sentences (which may go over several lines), and every text
as a whole, is compared with every template. A sentence ends at a full stop before white space and a capital. A term's weight is its count times its inverse document
frequency over all documents; terms of no template count as ones that no document has. A window can reach the threshold
only if it has one of a template's rarest terms (the rest of the template is too short a vector, by Cauchy-Schwarz),
so windows without such a term are set aside by one pattern, exactly. So are windows with too many terms of no template
for those that they share with some. A file's own licence is that of its best window; a
plain reservation of rights counts only where there is no licence. A file of which that window is half or more, or whose name says so, is a licence file, and its licence holds for its
directory. Files without their own take that of the nearest directory above that has one, by a join on paths.

Everything is DataFrame functions; nothing runs in Python on executors. Sent to them are the templates' terms only.

Defined cases: null and empty texts have no licence of their own and may inherit; a null path inherits nothing; equal
scores go to the first licence name, and equal licence files of a directory to the first path; repeated rows are
reported each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small, whole_text

_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: The name of the notice that gives no licence.
RESERVED = "LicenseRef-All-Rights-Reserved"
#: Notices, titles of long licences and whole short licences by licence identifier.
TEMPLATES = {
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License, Version 3, 19 November 2007", "This program is free software: " + _GNU.format("Affero General Public License", ",", 3)],
    "Apache-2.0": ["Apache License, Version 2.0, January 2004", "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", _BSD + _BSD_END],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", _BSD + _BSD_NAMES + _BSD_END],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU General Public License, Version 2, June 1991", "This program is free software; " + _GNU.format("General Public License", ";", 2)],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.", "GNU General Public License, Version 3, 29 June 2007", "This program is free software: " + _GNU.format("General Public License", ",", 3)],
    "ISC": ["Released under the ISC License.", _ISC],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "GNU Lesser General Public License, Version 3, 29 June 2007", "This library is free software: " + _GNU.format("Lesser General Public License", ",", 3)],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", _MIT],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"],
    RESERVED: ["All rights reserved."],
}
THRESHOLD = 0.8
WINDOW_LINES, WINDOW_SENTENCES = 6, 3
_TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
_SENTENCE_END = r"(?<=[.!?])(?=\s)[^\p{L}\p{N}]++(?=\p{Lu})"
_FILE_NAME = r"(?i)/(licen[cs]e|copying|notice)[^/]*$"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def template_terms(templates: dict[str, list[str]]) -> list[tuple[str, int, Counter]]:
    return [(name, k, Counter(re.findall(_TERM, x.lower()))) for name, texts in sorted(templates.items()) for k, x in enumerate(texts)]


def frequencies(files: DataFrame, terms: list[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """The number of files, and of files that hold each of these terms (a fixed list)."""
    held = files.select(F.array_intersect(_terms(whole_text(text)), F.array(*[F.lit(t) for t in terms])).alias("t"))
    # One more term counts the files.
    rows = held.select(F.explode(F.concat("t", F.array(F.lit("*")))).alias("term")).groupBy("term").count().collect()
    found = {r["term"]: r["count"] for r in rows}
    return found.pop("*", 0), found


def _anchors(weights: dict[str, float], idf: dict[str, float], threshold: float) -> list[str]:
    """The rarest terms, as many as make the rest of the vector shorter than threshold of the whole."""
    total = rest = sum(w * w for w in weights.values())
    out = []
    for t, w in sorted(weights.items(), key=lambda x: (-idf[x[0]], -x[1], x[0])):
        if rest < 0.999 * threshold * threshold * total:
            break
        out.append(t)
        rest -= w * w
    return out


def _values(spark, rows: list[tuple], names: str) -> DataFrame:
    """A small fixed table as a SQL literal."""
    said = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}D" for x in r) + ")" for r in rows)
    return spark.sql(f"select * from values {said} as t({names})")


def _windows(parts: Column, most: int) -> Column:
    """Every run of one to most parts, joined by a space."""

    def of(p: Column) -> Column:
        n = F.size(p)
        return F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), n - i + 1)), lambda k: F.array_join(F.slice(p, i, k), " "))))

    # Bound to a variable: parts itself inside of the inner functions would be split anew for each run.
    return F.flatten(F.transform(F.array(parts), of))


def _able(terms: Column, vocabulary: list[str], threshold: float) -> Column:
    """Whether a window's cosine with a template can be threshold: False only if it cannot.

    No term weighs more than one of no template, so the squared counts of the vocabulary's terms bound the part of the
    vector that templates can meet, and each other term's occurrence adds at least one to the square of the rest.
    """
    known = F.filter(terms, lambda t: F.array_contains(F.array(*[F.lit(v) for v in vocabulary]), t))
    zero = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sum"))

    def step(a: Column, t: Column) -> Column:
        run = F.when(a["last"] == t, a["run"] + 1).otherwise(F.lit(1).cast("long"))
        # The square of a count is the sum of the odd numbers up to it.
        return F.struct(t.alias("last"), run.alias("run"), (a["sum"] + 2 * run - 1).alias("sum"))

    squares = F.aggregate(F.array_sort(known), zero, step, lambda a: a["sum"])
    return squares * (1 - threshold**2) >= 0.999 * threshold**2 * (F.size(terms) - F.size(known))


def ancestors(path: Column) -> Column:
    """Directories above path, from the root's child down: /a/b/c.txt has /a and /a/b (and the root, '')."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def scan(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, path: str = "path", text: str = "text") -> DataFrame:
    """path, license, origin (own, licence file, inherited, none), score (of the file's own best window; 0 if none), from_dir."""
    spark = files.sparkSession
    known = template_terms(templates)
    vocabulary = sorted({t for _, _, c in known for t in c})
    n, df = frequencies(files, vocabulary, text)
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocabulary}
    unknown = math.log(1 + n) + 1
    weights = [(name, k, {t: m * idf[t] for t, m in c.items()}) for name, k, c in known]
    anchors = sorted({t for _, _, w in weights for t in _anchors(w, idf, threshold)})
    pattern = r"(?<![a-z0-9])(?:" + "|".join(re.escape(a) for a in anchors) + r")(?![a-z0-9])"
    body = whole_text(text)
    every = F.concat(_windows(F.split(body, "\n"), WINDOW_LINES), _windows(F.split(body, _SENTENCE_END), WINDOW_SENTENCES), F.array(body))
    lines = F.when(F.lower(body).rlike(pattern), F.array_distinct(F.filter(every, lambda x: F.lower(x).rlike(pattern)))).otherwise(F.array().cast("array<string>"))
    rows = files.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(path).alias("path"),
        F.transform(lines, lambda x: F.struct(_terms(x).alias("terms"), (F.length(x) / F.length(body)).alias("part"))).alias("lines"),
    )
    rows = rows.withColumn("lines", F.filter("lines", lambda x: _able(x["terms"], vocabulary, threshold)))
    rows = cut(rows)
    line = rows.where(F.size("lines") > 0).select("rid", F.posexplode("lines").alias("no", "line")).select("rid", "no", "line.part", F.explode("line.terms").alias("term"))
    counts = line.groupBy("rid", "no", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("part").alias("part"))
    vector = counts.join(F.broadcast(_values(spark, sorted(idf.items()), "term, idf")), "term", "left").select("rid", "no", "part", "term", (F.col("tf") * F.coalesce("idf", F.lit(unknown))).alias("w"))
    vector = cut(vector)
    norms = vector.groupBy("rid", "no").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.first("part").alias("part"))
    table = []
    for name, k, w in weights:
        length = math.sqrt(sum(x * x for x in w.values()))
        table += [(name, f"{name}#{k}", t, x / length) for t, x in sorted(w.items())]
    unit = F.broadcast(_values(spark, table, "license, template, term, u"))
    dots = vector.join(unit, "term").groupBy("rid", "no", "license", "template").agg(F.sum(F.col("w") * F.col("u")).alias("dot"))
    scored = dots.join(norms, ["rid", "no"]).select("rid", "license", "part", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
    # A licence before a reservation, the best score, then the first name, then the longer part.
    own = cut(scored.groupBy("rid").agg(F.min(F.struct((F.col("license") == RESERVED).alias("r"), (-F.col("score")).alias("s"), "license", (-F.col("part")).alias("p"))).alias("best")).select("rid", "best.license", (-F.col("best.s")).alias("score"), (-F.col("best.p")).alias("part")))
    n_own = own.count()
    at = rows.select("rid", "path").join(small(own, n_own, 256), "rid", "left")
    is_file = F.col("license").isNotNull() & ((F.col("part") >= 0.5) | F.coalesce(F.col("path").rlike(_FILE_NAME), F.lit(False)))
    at = at.withColumn("is_file", is_file)
    directory = F.regexp_replace("path", r"/[^/]*$", "")
    dirs = at.where(F.col("is_file") & F.col("path").isNotNull()).groupBy(directory.alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("best"))
    dirs = cut(dirs.select("dir", F.col("best.license").alias("given")))
    n_dirs = dirs.count()
    free = at.where(F.col("license").isNull() & F.col("path").isNotNull()).select("rid", F.explode(ancestors(F.col("path"))).alias("dir"))
    near = free.join(small(dirs, n_dirs, 256), "dir").groupBy("rid").agg(F.max(F.struct(F.length("dir").alias("depth"), "dir", "given")).alias("near"))
    near = cut(near.select("rid", "near.given", F.col("near.dir").alias("from_dir")))
    out = at.join(small(near, near.count(), 256), "rid", "left")
    origin = F.when(F.col("is_file"), "licence file").when(F.col("license").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return out.select("path", F.coalesce("license", "given").alias("license"), origin.alias("origin"), F.coalesce("score", F.lit(0.0)).alias("score"), "from_dir")
