"""Licence scans: TF-IDF cosine of licence statements to templates, and inheritance.

The vocabulary is that of the templates. A statement is a line, a paragraph between blank
lines, or the whole text; statements without a word of the vocabulary have a cosine of 0 and
are left out. Inverse document frequencies count all statements of the corpus. A file's own
licence is that of its best statement; a licence file also speaks for its directory, and a
file without a licence of its own takes that of the nearest directory above it that has one,
found by joining the directories' ancestors with the licensed ones.

Everything is DataFrame functions. Scores are computed in the row, against weights that are
bounded by the templates; directories, not files, are joined with their ancestors, and a hot
directory is one row there.

Words outside the templates weigh as terms that occur once in the corpus and once in the
statement. Defined results: a null text has no statement; a null path has no directory;
repeated rows are judged alike (each counts in the frequencies); ties go to the template that
comes first by name; of a file's statements, "All rights reserved." comes last, then those that
name no version of their licence, then the best score, the longest and the first name win, and
likewise among equally near licence files, at last by path; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsight.llm.registry import bind, query, read
from gridsight.session import stage

_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met: Redistributions of source code must retain the "
    "above copyright notice, this list of conditions and the following disclaimer. Redistributions "
    "in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution.")
_BSD_NAME = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written permission.")
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR "
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
    "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER "
    "IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
    "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the Software), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
    "furnished to do so, subject to the following conditions:")
_MIT_END = (
    "The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, "
    "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
    "THE SOFTWARE.")
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
    "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
    "in all copies.")
_ISC_END = (
    "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
    "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
    "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
    "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0")
_APACHE_END = (
    "Unless required by applicable law or agreed to in writing, software distributed under the License "
    "is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
    "implied. See the License for the specific language governing permissions and limitations under the "
    "License.")
_UNLICENSE = "This is free and unencumbered software released into the public domain."
_UNLICENSE_END = (
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
    "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
    "means.")


def _gnu(name: str, version: str, date: str, spdx: str, what: str = "program") -> tuple[str, ...]:
    """Title and standard header, short and whole, of a GNU licence."""
    short = (
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the "
        f"{name} as published by the Free Software Foundation, either version {version} of the License, "
        "or (at your option) any later version.")
    whole = (
        f"{short} This {what} is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        f"PURPOSE. See the {name} for more details. You should have received a copy of the {name} along "
        f"with this {what}. If not, see http://www.gnu.org/licenses/.")
    return (f"{name} Version {version}, {date}", short, whole,
            *(f"SPDX-License-Identifier: {spdx}{end}" for end in ("", "-only", "-or-later")))


#: Notices, standard headers and texts of these licences.
TEMPLATES = {
    "AGPL-3.0": _gnu("GNU Affero General Public License", "3", "19 November 2007", "AGPL-3.0"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004",
        _APACHE, f"{_APACHE} {_APACHE_END}",
        "SPDX-License-Identifier: Apache-2.0"),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        _BSD_2, f"{_BSD_2} {_BSD_END}",
        "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        _BSD_NAME, f"{_BSD_2} {_BSD_NAME}", f"{_BSD_2} {_BSD_NAME} {_BSD_END}",
        "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License."),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
        "International License."),
    "CC0-1.0": (
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has dedicated all copyright to the public "
        "domain worldwide."),
    "EPL-2.0": (
        "Eclipse Public License - v 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse "
        "Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0"),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        *_gnu("GNU General Public License", "2", "June 1991", "GPL-2.0")),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        *_gnu("GNU General Public License", "3", "29 June 2007", "GPL-3.0")),
    "ISC": (_ISC, f"{_ISC} {_ISC_END}", "SPDX-License-Identifier: ISC"),
    "LGPL-2.1": _gnu("GNU Lesser General Public License", "2.1", "February 1999", "LGPL-2.1", "library"),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        *_gnu("GNU Lesser General Public License", "3", "29 June 2007", "LGPL-3.0")),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the software without restriction.",
        _MIT, f"{_MIT} {_MIT_END}",
        "SPDX-License-Identifier: MIT"),
    "MPL-2.0": (
        "This work is subject to the terms of the Mozilla Public License, version 2.0.",
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
        "of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0"),
    "Proprietary": (
        "All rights reserved.",
        "All rights reserved. Unauthorized copying of this file is strictly prohibited.",),
    "Unlicense": (_UNLICENSE, _UNLICENSE_END, f"{_UNLICENSE} {_UNLICENSE_END}",
                  "SPDX-License-Identifier: Unlicense"),
}
#: Said beside many licences: counts only where a file has no other statement.
GENERIC = frozenset({"All rights reserved."})
#: Words that carry no meaning here.
STOP_WORDS = frozenset(
    "a all an and any are as at be by for from has in is it its of on or that the this to under with"
    .split())
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_FILE = r"(?i)^(un)?licen[cs]e|^copying|^notice"
THRESHOLD = 0.6


def terms(text: str) -> Counter[str]:
    return Counter(t for t in re.findall(TERM, text.lower()) if t not in STOP_WORDS)


def statements(text: Column, vocabulary: list[str]) -> Column:
    """array of (tf: array of (term, n), other): the statements with a word of the vocabulary;
    `other` counts their words outside of it."""

    def count(unit: Column) -> Column:
        words = F.filter(F.regexp_extract_all(F.lower(unit), F.lit(TERM), F.lit(0)),
                         lambda w: ~w.isin(sorted(STOP_WORDS)))
        return bind(words, lambda w: bind(
            F.filter(w, lambda t: t.isin(vocabulary)), lambda v: F.struct(
                F.transform(F.array_distinct(v), lambda t: F.struct(
                    t.alias("term"), (F.size(v) - F.size(F.array_remove(v, t))).alias("n"))).alias("tf"),
                (F.size(w) - F.size(v)).alias("other"))))

    units = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n[ \t\r]*\n"), F.array(text)))
    return F.filter(F.transform(units, count), lambda s: F.size(s["tf"]) > 0)


def within_reach(statement: Column, threshold: float) -> Column:
    """Whether a statement's cosine can reach `threshold`, whatever the weights: none of its words
    weighs more than one outside the vocabulary, and those agree with no template."""
    known = F.aggregate(statement["tf"], F.lit(0.0), lambda total, x: total + F.pow(x["n"], F.lit(2.0)))
    return bind(known, lambda k: k >= max(0.0, threshold - 1e-5) ** 2 * (k + statement["other"]))


def weights(counted: DataFrame, vocabulary: list[str]) -> tuple[dict[str, float], float]:
    """(idf of the vocabulary, idf of any other word) over all statements."""
    seen = counted.select(F.explode("_found.seen").alias("term")).groupBy("term").count()
    # One row for each word of the templates.
    found = {r["term"]: r["count"] for r in seen.collect()}
    n = counted.agg(F.sum("_found.n")).collect()[0][0] or 0
    return ({t: math.log((1 + n) / (1 + found.get(t, 0))) + 1 for t in vocabulary},
            math.log((1 + n) / 2) + 1 if n else 1.0)


def best_match(statement: Column, idf: dict[str, float], other: float,
               templates: dict[str, tuple[str, ...]], threshold: float) -> Column:
    """(generic, vague, down, short, licence) of the template nearest to a statement, null if
    none is near: less is better. `down` is the negative score; a vague statement names none of
    the version numbers of its template; `short` is the negative number of words."""
    known = F.create_map(*[F.lit(x) for t in sorted(idf) for x in (t, idf[t])])
    inside = F.aggregate(statement["tf"], F.lit(0.0), lambda total, x:
                         total + F.pow(x["n"] * F.element_at(known, x["term"]), F.lit(2.0)))
    size = F.aggregate(statement["tf"], statement["other"], lambda total, x: total + x["n"])

    def nearest(square: Column) -> Column:
        scores = []
        for name in sorted(templates):
            for text in templates[name]:
                weight = {t: n * idf[t] for t, n in terms(text).items()}
                length = math.sqrt(sum(w * w for w in weight.values()))
                scaled = F.create_map(*[F.lit(x) for t in sorted(weight)
                                        for x in (t, weight[t] * idf[t] / length)])
                dot = F.aggregate(statement["tf"], F.lit(0.0), lambda total, x: total + F.coalesce(
                    x["n"] * F.try_element_at(scaled, x["term"]), F.lit(0.0)))
                numbers = [t for t in sorted(weight) if re.fullmatch(r"[0-9.]+", t)]
                scores.append(F.struct(
                    (-F.round(dot / F.sqrt(square), 6)).alias("down"), F.lit(name).alias("licence"),
                    F.lit(text in GENERIC).alias("generic"),
                    F.array(*map(F.lit, numbers)).cast("array<string>").alias("numbers")))
        # Of equal scores the first name.
        return bind(F.array_min(F.array(*scores)), lambda b: F.struct(
            b["generic"].alias("generic"),
            ((F.size(b["numbers"]) > 0) & ~F.exists(
                statement["tf"], lambda x: F.array_contains(b["numbers"], x["term"]))).alias("vague"),
            b["down"].alias("down"), (-size).alias("short"), b["licence"].alias("licence")))

    # Words outside the templates agree with none: they alone keep most statements away.
    return bind(inside, lambda i: bind(i + statement["other"] * F.lit(other ** 2), lambda square: F.when(
        i >= max(0.0, threshold - 1e-5) ** 2 * square, nearest(square))))


def ancestors(directory: Column) -> Column:
    """A directory and all above it, the nearest first; the root is the empty text."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(
        F.slice(parts, 1, F.size(parts) - i), "/"))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text",
         keep: tuple[str, ...] = (), templates: dict[str, tuple[str, ...]] | None = None,
         threshold: float = THRESHOLD) -> DataFrame:
    """(keep..., path, licence, score, licensed_by): the licence of every file, null if none.

    `licensed_by` is the path of the file that states it, its own or a licence file above.
    """
    templates = templates or TEMPLATES
    vocabulary = sorted(set().union(*(terms(t) for texts in templates.values() for t in texts)))
    path = F.col(path_col)
    name = F.regexp_extract(path, r"[^/]*$", 0)
    said = statements(F.coalesce(F.col(text_col), F.lit("")), vocabulary)
    # All words for the frequencies, but only the statements that can come near a template.
    counted = stage(files.select(
        *keep, path.alias("_path"),
        F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), "/+$", "").alias("_directory"),
        name.rlike(LICENCE_FILE).alias("_speaks"),
        bind(said, lambda each: F.struct(
            F.flatten(F.transform(each, lambda s: s["tf"]["term"])).alias("seen"),
            F.size(each).alias("n"),
            F.filter(each, lambda s: within_reach(s, threshold)).alias("near"))).alias("_found")),
        "statements")
    idf, other = weights(counted, vocabulary)
    matches = F.transform("_found.near", lambda s: best_match(s, idf, other, templates, threshold))
    own = F.filter(matches, lambda m: m["down"] <= -threshold)
    judged = stage(
        counted.select(*keep, "_path", "_directory", "_speaks", F.array_min(own).alias("_own")),
        "judged")

    spoken = (
        judged.where(F.col("_speaks") & F.col("_own").isNotNull() & F.col("_directory").isNotNull())
        .groupBy(F.col("_directory").alias("_above"))
        .agg(F.min(F.struct("_own", "_path")).alias("_theirs")))
    # Stored, so that files of a hot directory are split like any skewed join key.
    nearest = stage(
        judged.where(F.col("_own").isNull() & F.col("_directory").isNotNull())
        .select("_directory").distinct()
        .select("_directory", F.posexplode(ancestors(F.col("_directory"))).alias("_up", "_above"))
        .join(spoken, "_above")
        .groupBy(F.col("_directory").alias("_for")).agg(F.min_by("_theirs", "_up").alias("_theirs")),
        "nearest")
    found = judged.join(nearest, (F.col("_directory") == F.col("_for")) & F.col("_own").isNull(), "left")
    stated = F.coalesce(F.col("_own"), F.col("_theirs._own"))
    return found.select(
        *keep, F.col("_path").alias(path_col), stated["licence"].alias("licence"),
        (-stated["down"]).alias("score"),
        F.when(F.col("_own").isNotNull(), F.col("_path")).otherwise(F.col("_theirs._path"))
        .alias("licensed_by"))


def _template_rows() -> str:
    rows, number = [], 0
    for name in sorted(TEMPLATES):
        for text in TEMPLATES[name]:
            number += 1
            rows += [f"({number}, '{name}', '{t}', {n})" for t, n in sorted(terms(text).items())]
    return ", ".join(rows)


# No document is a licence file by its name, so nothing is inherited. The best score wins here:
# this has no counterpart of the precedence of statements of different licences in one document.
ORACLE = rf"""
WITH templates(template, licence, term, n) AS (VALUES {_template_rows()}),
vocabulary AS (SELECT DISTINCT term FROM templates),
files AS (
  SELECT doc_id, coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' || doc_id AS path,
         coalesce(text, '') AS text FROM documents),
units AS (
  SELECT row_number() OVER () AS unit, doc_id, u FROM (
    SELECT doc_id, unnest(list_distinct(list_concat(list_concat(
      string_split(text, chr(10)), regexp_split_to_array(text, '\n[ \t\r]*\n')), [text]))) AS u
    FROM files)),
words AS (
  SELECT unit, unnest(regexp_extract_all(lower(u), '{TERM}')) AS term FROM units),
counts AS (
  SELECT unit, term, count(*) AS n, term IN (SELECT term FROM vocabulary) AS known FROM words
  WHERE term NOT IN ({', '.join(f"'{w}'" for w in sorted(STOP_WORDS))}) GROUP BY ALL),
statements AS (SELECT unit FROM counts WHERE known GROUP BY unit),
total AS (SELECT count(*) AS n FROM statements),
idf AS (
  SELECT term, ln((1 + (SELECT n FROM total)) / (1 + count(unit))) + 1 AS idf
  FROM vocabulary LEFT JOIN counts USING (term) GROUP BY term),
lengths AS (
  SELECT unit, sqrt(sum(CASE WHEN known THEN (n * idf) ^ 2
    ELSE n * (ln((1 + (SELECT n FROM total)) / 2) + 1) ^ 2 END)) AS length
  FROM counts LEFT JOIN idf USING (term) SEMI JOIN statements USING (unit) GROUP BY unit),
weights AS (
  SELECT template, licence, term, n * idf AS w, sqrt(sum((n * idf) ^ 2) OVER (PARTITION BY template)) AS length
  FROM templates JOIN idf USING (term)),
scores AS (
  SELECT unit, licence, round(sum(c.n * idf * w / weights.length) / any_value(lengths.length), 6) AS score
  FROM counts c JOIN idf USING (term) JOIN weights USING (term) JOIN lengths USING (unit)
  GROUP BY unit, template, licence),
own AS (
  SELECT doc_id, score, licence FROM scores JOIN units USING (unit) WHERE score >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) = 1)
SELECT doc_id, path, licence, score, CASE WHEN licence IS NOT NULL THEN path END AS licensed_by
FROM files LEFT JOIN own USING (doc_id)
"""


@query("op7_licence_scan", ORACLE)
def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, as a file of its source and language."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws(
        "/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")),
        F.col("doc_id").cast("string")).alias("path"))
    return scan(docs, keep=("doc_id",))
