"""License scan: lines, runs of lines, paragraphs and whole texts against licence templates, by Dice over word bigrams.

Text is lower-cased and split at everything but letters and digits. A unit with a bigrams and a template
with b share at most min(a, b), so Dice >= t needs b*t/(2-t) <= a <= b*(2-t)/t: units are joined with
templates by their number of bigrams, each template standing at just the numbers that can reach t.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.llm.common import table

# Notices of well-known licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # Paragraphs of full licence texts.
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
)
#: Lines in a row that are a unit together, at most; a longer paragraph, and the whole text, are units of their own.
RUN = 4
PARAGRAPH = r"\n([ \t\r]*\n)+"

#: Words too common to tell a notice from other text. Each bigram of a notice that can still match has
#: others beside it: a unit without any of these others cannot reach the least Dice (checked in the tests).
COMMON = frozenset(
    "a all an and any anyone are as at be but by can could do does each either for from had has have he her his if in into is it its may more neither no nor not of on or other others our out see shall she should so such than that the their them then there these they this those to under use used was we were what when where which who will with without would you your".split()
)


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def bounds(n: int, least: float) -> tuple[int, int]:
    return math.ceil(n * least / (2 - least) - 1e-9), math.floor(n * (2 - least) / least + 1e-9)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalized_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def bigrams(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat(F.get(words, i - 1), F.lit(" "), F.get(words, i)))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, least: float = 0.8) -> DataFrame:
    """(id, license, dice, n_units) for each licence whose template some unit of the text reaches ``least`` with.

    Units are runs of one to RUN lines that begin and end with a word, paragraphs of more lines where there are several,
    and the whole of a text of more lines: notices may be wrapped, commented out or stand amid others. ``n_units`` counts the
    units that reach a template. Only runs about a line with a telling word are made, which loses none. Null and empty
    texts match nothing; very long lines and texts are units as they are; equal lines count each; rows that repeat an
    id count together; an empty table gives an empty result; further columns are ignored. ``templates`` is a tuple in the
    program, so the joined side has a fixed number of rows.
    """
    spark = docs.sparkSession
    rows = []
    for k, (name, text) in enumerate(templates):
        grams = bigrams_of(text)
        lo, hi = bounds(len(grams), least)
        rows += [(n, k, name, grams) for n in range(max(lo, 1), hi + 1)]
    literal = [F.struct(F.lit(n).alias("n"), F.lit(name).alias("license"), F.array(*map(F.lit, g)).alias("grams")) for n, _, name, g in rows]
    small = spark.range(1).select(F.inline(F.array(*literal)))
    least_n, most_n = min(r[0] for r in rows), max(r[0] for r in rows)
    names = sorted({w for r in rows for g in r[3] for w in g.split()} - COMMON)
    no_unit = F.array().cast("array<array<string>>")

    def near(words, hot):
        """Runs of lines about those in ``hot``, paragraphs, and the whole, as words."""
        n = F.size(words)
        starts = lambda k: F.array_distinct(F.flatten(F.transform(hot, lambda h: F.sequence(F.greatest(h - k + 1, F.lit(0)), F.least(h, n - k)))))
        run = lambda k: F.transform(F.filter(starts(k), lambda i: (F.size(F.get(words, i)) > 0) & (F.size(F.get(words, i + k - 1)) > 0)), lambda i: F.flatten(F.slice(words, i + 1, k)))
        runs = F.flatten(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(RUN))), run))
        parts = F.split("text", PARAGRAPH)
        parts = F.when(F.size(parts) > 1, F.transform(F.filter(parts, lambda p: F.size(F.split(p, "\n")) > RUN), normalized_words))
        return F.concat(runs, F.coalesce(parts, no_unit), F.when(n > RUN, F.array(F.flatten(words))).otherwise(no_unit))

    def units(words):
        telling = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.exists(F.get(words, i), lambda w: w.isin(*names)))
        return let(telling, lambda hot: F.when(F.size(hot) > 0, near(words, hot)).otherwise(no_unit))

    lines = F.transform(F.split("text", "\n"), normalized_words)
    unit = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL").select("id", F.explode(let(lines, units)).alias("words"))
    grams = let(bigrams(F.col("words")), lambda g: F.when(F.size(g).between(least_n, most_n), g))
    # The generator keeps the optimiser from computing the array anew in each expression that uses it.
    unit = unit.select("id", F.explode(F.array_compact(F.array(grams))).alias("unit_grams"))
    unit = unit.withColumn("n", F.size("unit_grams"))
    hit = unit.join(F.broadcast(small), "n")
    both = F.size(F.array_intersect("unit_grams", "grams"))
    hit = hit.select("id", "license", (2.0 * both / (F.col("n") + F.size("grams"))).alias("dice")).where(F.col("dice") >= least)
    return hit.groupBy(F.col("id").alias(id_col), "license").agg(F.round(F.max("dice"), 6).alias("dice"), F.count("*").alias("n_units"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql(least: float = 0.8) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quoted(name)}, {quoted(text)})" for k, (name, text) in enumerate(TEMPLATES))
    words = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
    grams = "CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE [] END"
    return f"""
WITH t AS (SELECT template, license, {grams} AS g FROM (SELECT template, license, {words.format('body')} AS w FROM (VALUES {rows}) v(template, license, body))),
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, unnest(range(1, least(len(ls), {RUN}) + 1)) AS k FROM l),
r AS (SELECT doc_id, ls[CAST(i AS BIGINT):CAST(i + k - 1 AS BIGINT)] AS run FROM (SELECT *, unnest(range(1, len(ls) - k + 2)) AS i FROM k)),
p AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '{PARAGRAPH}', chr(1), 'g'), chr(1))) AS unit FROM l WHERE regexp_matches(text, '{PARAGRAPH}')),
u AS (SELECT doc_id, array_to_string(run, chr(10)) AS unit FROM r WHERE regexp_matches(lower(run[1]), '[a-z0-9]') AND regexp_matches(lower(run[len(run)]), '[a-z0-9]')
  UNION ALL SELECT doc_id, unit FROM p WHERE len(string_split(unit, chr(10))) > {RUN} UNION ALL SELECT doc_id, text FROM l WHERE len(ls) > {RUN}),
b AS (SELECT doc_id, {grams} AS g FROM (SELECT doc_id, {words.format('unit')} AS w FROM u)),
h AS (SELECT doc_id, license, 2.0 * len(list_intersect(b.g, t.g)) / (len(b.g) + len(t.g)) AS dice FROM b, t
      WHERE len(b.g) BETWEEN 1 AND 200)
SELECT doc_id, license, round(CAST(max(dice) AS DOUBLE), 6) AS dice, count(*) AS n_units FROM h WHERE dice >= {least} GROUP BY ALL
"""


OP8_SQL = _sql()
