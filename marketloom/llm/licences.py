"""Licence scans: lines compared with licence templates by the Dice coefficient.

DataFrame functions only.  A text is cut into lines; a line's normalised form is
lower case with everything but letters, digits and dots within words turned to
single spaces.  Both sides become sets of word bigrams; for a threshold t, a
template of b bigrams can only match lines of t/(2-t)*b to (2-t)/t*b distinct
bigrams.  Before any bigram is made, lines go whose words are too few or whose
distinct words are too many for that; their length says nothing.  The whole text
counts as one more unit, for files that are a licence.  Besides, windows of the
normalised text, lines disregarded, are compared with the templates and with the
longer licence texts: all windows that begin and end at a bigram of the template, have
enough of them for the threshold, and are no longer than (2-t)/t times the template,
counting repeated bigrams.  Any unit or passage that reaches the threshold holds one that
is cut to its outermost bigrams of the template and scores as much or more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import read

THRESHOLD = 0.8
#: Notices in public use, by SPDX-like name.
TEMPLATES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Headers and texts of licences, only looked for in windows.
BODIES = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(texts: Column) -> Column:
    """The words of each normalised text; texts without words go."""
    plain = F.transform(texts, lambda u: F.trim(F.regexp_replace(F.lower(u), r"[^a-z0-9]+", " ")))
    return F.transform(F.filter(plain, lambda u: u != ""), lambda u: F.split(u, " "))


def bigrams(w: Column) -> Column:
    """The distinct bigrams of a list of words."""
    return F.array_distinct(pairs(w))


def pairs(w: Column) -> Column:
    """The bigrams of a list of words in their order."""
    n = F.size(w)
    return F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), F.slice(w, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def _plain_words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def _plain_bigrams(text: str) -> list[str]:
    w = _plain_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, licence, dice and n_units.

    licence is that of the unit (a line, or the whole text) or window and template
    with the largest coefficient (ties: the smaller name), null below the threshold;
    dice is 0 then.  n_units counts the units that match any template, and one more
    for each licence that only windows show.  Null,
    empty and one-word texts match nothing; repeated rows each give a row; an empty table
    gives an empty result.  A text of any length is read whole, in one task; equal
    coefficients fall to the smaller name.  Other columns are not looked at.
    """
    bodies = BODIES if templates is None else ()
    templates = TEMPLATES if templates is None else templates
    grams = {k: _plain_bigrams(v) for k, v in sorted(templates.items())}
    # a little wider, so that rounding loses no coefficient equal to the threshold
    least, most = threshold / (2 - threshold) * (1 - 1e-9), (2 - threshold) / threshold * (1 + 1e-9)
    text = F.coalesce(F.col("text"), F.lit(""))
    units = F.array_distinct(F.concat(F.split(text, "\n"), F.array(text)))
    low, high = min(len(g) for g in grams.values()) * least, max(len(g) for g in grams.values()) * most
    # words - 1 bounds the distinct bigrams from above, distinct words - 1 from below
    tokens = F.filter(words(units), lambda w: (F.size(w) - 1 >= low) & (F.size(F.array_distinct(w)) - 1 <= high))
    sought = [(k, _plain_bigrams(v), len(_plain_words(v)) - 1) for k, v in [*templates.items(), *bodies]]
    union = sorted({x for _, g, _ in sought for x in g})
    d = docs.select("doc_id", tokens.alias("tokens"), let(F.flatten(words(F.array(text))), pairs).alias("pairs"))
    marks = F.transform("pairs", lambda x, i: F.when(x.isin(union), F.struct(x.alias("gram"), i.alias("at"))))
    d = d.select("doc_id", "tokens", "pairs", F.filter(marks, lambda m: m.isNotNull()).alias("marks"))

    def coefficient(g: Column, grams: list[str]) -> Column:
        return F.size(F.array_intersect(g, F.array(*[F.lit(x) for x in grams]))) * 2.0 / (F.size(g) + len(grams))

    def windows(name: str, grams: list[str], n: int) -> Column:
        """The largest coefficient of all windows that begin and end at a bigram of the template, and have enough marks and at most `size` bigrams."""
        need, size = max(1, math.ceil(len(grams) * least)), int(n * most) + 1

        def best_of(at: Column) -> Column:
            def from_mark(i: Column) -> Column:
                first = F.element_at(at, i)
                ends = F.filter(F.slice(at, i + need - 1, size), lambda last: last - first < size)
                made = F.transform(ends, lambda last: let(F.array_distinct(F.slice("pairs", first + 1, last - first + 1)), lambda g: coefficient(g, grams)))
                return F.array_max(made)

            starts = F.filter(F.sequence(F.lit(1), F.size(at) - need + 1), lambda i: F.element_at(at, i + need - 1) - F.element_at(at, i) < size)
            return F.when(F.size(at) >= need, F.array_max(F.transform(starts, from_mark)))

        at = F.transform(F.filter("marks", lambda m: m["gram"].isin(grams)), lambda m: m["at"])
        return F.struct(F.coalesce(let(at, best_of), F.lit(0.0)).alias("dice"), F.lit(name).alias("licence"))

    shown = F.when(F.size("marks") > 0, F.filter(F.array(*[windows(*x) for x in sought]), lambda b: b["dice"] >= threshold))
    d = d.select("doc_id", "tokens", F.coalesce(shown, F.array().cast("array<struct<dice:double,licence:string>>")).alias("shown"))
    d = d.select("doc_id", "shown", F.filter(F.transform("tokens", bigrams), lambda g: F.size(g).between(low, high)).alias("grams"))

    def dice(g: Column, name: str) -> Column:
        b = grams[name]
        fits = F.size(g).between(len(b) * least, len(b) * most)
        both = F.size(F.array_intersect(g, F.array(*[F.lit(x) for x in b])))
        return F.when(fits, both * 2.0 / (F.size(g) + len(b))).otherwise(F.lit(0.0))

    def best(g: Column) -> Column:
        made = F.array(*[F.struct(dice(g, k).alias("dice"), F.lit(k).alias("licence")) for k in grams])
        return F.aggregate(made, F.struct(F.lit(-1.0).alias("dice"), F.lit("").alias("licence")),
                           lambda a, x: F.when(x["dice"] > a["dice"], x).otherwise(a))

    d = d.select("doc_id", "shown", F.filter(F.transform("grams", best), lambda b: b["dice"] >= threshold).alias("hits"))
    top = F.aggregate(F.concat("hits", "shown"), F.struct(F.lit(0.0).alias("dice"), F.lit(None).cast("string").alias("licence")),
                      lambda a, x: F.when((x["dice"] > a["dice"]) | ((x["dice"] == a["dice"]) & (x["licence"] < a["licence"])), x).otherwise(a))
    return d.select("doc_id", top.alias("top"), (F.size("hits") + F.size(F.array_except(F.col("shown.licence"), F.col("hits.licence")))).cast("long").alias("n_units")).select(
        "doc_id", F.col("top.licence").alias("licence"), F.round("top.dice", 9).alias("dice"), "n_units")


def op10_licences(spark, sf_dir: str) -> DataFrame:
    """The licences of all documents; `scan` states the cases."""
    return scan(read(spark, sf_dir, "documents"))


def _oracle() -> str:
    """DuckDB SQL over the same templates: every line, the whole text, and every window; nothing is left out for its length."""
    least, most = THRESHOLD / (2 - THRESHOLD) * (1 - 1e-9), (2 - THRESHOLD) / THRESHOLD * (1 + 1e-9)
    quoted = lambda grams: "[" + ", ".join(f"'{g}'" for g in grams) + "]"
    rows = []
    for no, (name, text) in enumerate([*sorted(TEMPLATES.items()), *BODIES]):
        grams = _plain_bigrams(text)
        size = int((len(_plain_words(text)) - 1) * most) + 1
        rows.append(f"({no}, '{name}', {quoted(grams)}, {len(grams)}, {max(1, math.ceil(len(grams) * least))}, {size}, {str(no < len(TEMPLATES)).lower()})")
    return f"""
WITH t(no, licence, b, nb, need, size, line) AS (VALUES {", ".join(rows)}),
tg AS (SELECT no, unnest(b) AS gram FROM t),
u AS (SELECT doc_id, text, unnest(list_distinct(list_append(string_split(coalesce(text, ''), chr(10)), coalesce(text, '')))) AS unit FROM documents),
w AS (SELECT doc_id, row_number() OVER () AS unit_no, unit = text AS whole, string_split(trim(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM u),
g AS (SELECT doc_id, unit_no, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) >= 2),
m AS (SELECT doc_id, unit_no, licence, 2.0 * len(list_intersect(g, b)) / (len(g) + nb) AS dice FROM g JOIN t ON line AND len(g) BETWEEN nb * {least!r} AND nb * {most!r}),
hit AS (SELECT doc_id, unit_no, max(dice) AS dice, arg_min(licence, (-dice, licence)) AS licence FROM m WHERE dice >= {THRESHOLD} GROUP BY 1, 2),
p AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM w WHERE whole AND len(w) >= 2)),
k AS (SELECT p.doc_id, tg.no, p.i, row_number() OVER (PARTITION BY p.doc_id, tg.no ORDER BY p.i) AS rn FROM p JOIN tg USING (gram)),
c AS (SELECT a.doc_id, a.no, a.i AS f, z.i AS l FROM k a JOIN t ON t.no = a.no JOIN k z ON z.doc_id = a.doc_id AND z.no = a.no AND z.rn >= a.rn + need - 1 AND z.i - a.i < size),
d AS (SELECT c.doc_id, c.no, f, l, count(DISTINCT p.gram) AS g, count(DISTINCT tg.gram) AS shared FROM c JOIN p ON p.doc_id = c.doc_id AND p.i BETWEEN f AND l LEFT JOIN tg ON tg.no = c.no AND tg.gram = p.gram GROUP BY 1, 2, 3, 4),
shown AS (SELECT doc_id, licence, max(2.0 * shared / (g + nb)) AS dice FROM d JOIN t USING (no) GROUP BY doc_id, no, licence HAVING max(2.0 * shared / (g + nb)) >= {THRESHOLD}),
every AS (SELECT doc_id, dice, licence FROM hit UNION ALL SELECT doc_id, dice, licence FROM shown),
top AS (SELECT doc_id, arg_min(licence, (-dice, licence)) AS licence, max(dice) AS dice FROM every GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unit_no AS x, '' AS y FROM hit UNION ALL SELECT DISTINCT s.doc_id, 0, s.licence FROM shown s WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.doc_id = s.doc_id AND hit.licence = s.licence)) GROUP BY 1)
SELECT documents.doc_id, top.licence, round(coalesce(top.dice, 0.0), 9) AS dice, coalesce(n.n, 0) AS n_units FROM documents LEFT JOIN top USING (doc_id) LEFT JOIN n USING (doc_id)"""


ORACLE = _oracle()
