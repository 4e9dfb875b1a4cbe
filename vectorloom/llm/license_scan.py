"""Licence scan, with DataFrame functions only.

The units of a text are its lines, its paragraphs of several lines and, if it has several paragraphs, the
whole of it. A unit is normalised (lower case, runs of anything but a-z and 0-9 become a blank) and compared
with every licence template by the Dice coefficient over the sets of word bigrams. A template of n bigrams can
reach THRESHOLD only with units of between n * t / (2 - t) and n * (2 - t) / t bigrams, so other pairs are
never compared, and a unit outside all bounds is dropped before its bigrams are built.

Everything happens within the row: no shuffle, whatever the skew. Null and empty texts have no match (license
null, score 0.0); of equal scores the alphabetically last licence is the best one; repeated rows repeat; texts of
any length count whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from math import ceil
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm.common import fresh, table

THRESHOLD = 0.8

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT2 = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT3 = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD0 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"""
_BSD1 = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""
_BSD2 = """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD3 = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_APACHE2 = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."""

#: (licence, template); parts of a licence are templates of their own.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT),
    ("MIT", _MIT2),
    ("MIT", _MIT3),
    ("MIT", f"{_MIT} {_MIT2} {_MIT3}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE2),
    ("Apache-2.0", f"{_APACHE} {_APACHE2}"),
    ("BSD-2-Clause", f"{_BSD0} {_BSD1} {_BSD2}"),
    ("BSD-3-Clause", f"{_BSD0} {_BSD1} {_BSD2} {_BSD3}"),
    ("BSD-3-Clause", _BSD3),
    ("BSD", _BSD0),
    ("BSD", _BSD1),
    ("BSD", _BSD2),
    ("ISC", _ISC),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", _GPL.format(v=3)),
    ("GPL-2.0", _GPL.format(v=2)),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", _MPL),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a normalised text."""
    w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def bounds(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Sizes of bigram sets that can reach the threshold with a set of n."""
    return ceil(n * threshold / (2 - threshold) - 1e-9), int(n * (2 - threshold) / threshold + 1e-9)


def _templates(templates: list[tuple[str, str]]) -> list[tuple[str, list[str], int, int]]:
    return [(name, b, *bounds(len(b))) for name, text in templates for b in [bigrams(text)]]


def matches(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs with `licenses`: an array of (score, license) for every unit that reaches the threshold with a template.

    Where docs has a column of that name, the new one gets underscores at its end.
    """
    known = _templates(templates)
    least, most = min(lo for *_, lo, _ in known), max(hi for *_, hi in known)
    all_t = F.array(*(F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, b)).alias("grams"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for name, b, lo, hi in known))
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    gap = r"\n[\x20\t\r]*\n"
    parts = F.filter(F.split(t, gap, -1), lambda p: F.contains(p, F.lit("\n")))
    whole = F.when(t.rlike(gap), F.array(t)).otherwise(F.array().cast("array<string>"))
    units = F.concat(F.split(t, "\n", -1), parts, whole)
    plain = F.transform(units, lambda u: F.trim(F.regexp_replace(F.lower(u), "[^a-z0-9]+", " ")))
    # n bigrams need n blanks, and n distinct ones at least as many
    sized = F.filter(plain, lambda u: (F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit("")))) >= least)
    words = F.transform(sized, lambda u: F.split(u, " ", -1))
    grams = F.transform(words, lambda w: F.array_distinct(F.transform(F.slice(w, F.lit(1), F.size(w) - 1), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))))
    fit = F.filter(grams, lambda b: F.size(b).between(least, most))

    def compare(b: Column) -> Column:
        near = F.filter(all_t, lambda x: F.size(b).between(x["lo"], x["hi"]))
        scored = F.transform(near, lambda x: F.struct((F.size(F.array_intersect(b, x["grams"])) * F.lit(2.0) / (F.size(b) + F.size(x["grams"]))).alias("score"), x["license"].alias("license")))
        return F.filter(scored, lambda x: x["score"] >= threshold)

    grams_of, name = fresh(docs, "__b"), fresh(docs, "licenses")
    return docs.withColumn(grams_of, fit).withColumn(name, F.flatten(F.transform(grams_of, compare))).drop(grams_of)


def read_templates(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Whole licence texts as templates: one file each, named by the licence, in a folder or pattern that Spark can read.

    The folder is the bound: its texts become literals of the plan.
    """
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value").collect()
    return sorted((unquote(re.sub(r"\.txt$", "", r["name"])), r["value"]) for r in rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: doc_id, license (the best), score, n_matches (pairs of unit and template), licenses (distinct, sorted)."""
    found = matches(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.array_max("licenses")
    return found.select(
        "doc_id",
        best["license"].alias("license"),
        F.round(F.coalesce(best["score"], F.lit(0.0)), 9).alias("score"),
        F.size("licenses").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"]))), ",").alias("licenses"),
    )


def _sql() -> str:
    known = _templates(TEMPLATES)
    rows = ", ".join(f"({k}, '{n}', [{', '.join(repr(g) for g in b)}], {lo}, {hi})" for k, (n, b, lo, hi) in enumerate(known))
    least, most = min(lo for *_, lo, _ in known), max(hi for *_, hi in known)
    gap = r"\n[ \t\r]*\n"
    return f"""
WITH templates(k, license, grams, lo, hi) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
units AS (
  SELECT r, unnest(string_split(t, chr(10))) AS u FROM docs
  UNION ALL SELECT r, u FROM (SELECT r, unnest(regexp_split_to_array(t, '{gap}')) AS u FROM docs) WHERE contains(u, chr(10))
  UNION ALL SELECT r, t FROM docs WHERE regexp_matches(t, '{gap}')
),
words AS (SELECT r, string_split(trim(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units),
grams AS (SELECT r, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM words WHERE len(w) > {least}),
scored AS (
  SELECT r, license, 2.0::DOUBLE * len(list_intersect(b, templates.grams)) / (len(b) + len(templates.grams)) AS score
  FROM grams JOIN templates ON len(b) BETWEEN lo AND hi WHERE len(b) BETWEEN {least} AND {most}
),
best AS (SELECT r, max({{'score': score, 'license': license}}) AS m, count(*) AS n, list_sort(list_distinct(list(license))) AS l FROM scored WHERE score >= {THRESHOLD} GROUP BY r)
SELECT doc_id, m.license AS license, round(coalesce(m.score, 0.0), 9) AS score, coalesce(n, 0) AS n_matches, coalesce(array_to_string(l, ','), '') AS licenses
FROM docs LEFT JOIN best USING (r)
"""


SQL = _sql()
