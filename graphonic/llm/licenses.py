"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Four kinds of units of every text are compared with license statements, whole
short licenses and the titles of long ones: each line, each run of up to
``RUN`` lines, each paragraph and the whole text.  The measure is the cosine of
TF-IDF vectors; document frequencies are counted over all texts.  Most units
are ruled out before any vector is built, and exactly: for each template the
terms of greatest weight are its anchors, as many as needed for the rest of
the template to have a norm below threshold, so a unit without an anchor
cannot reach the threshold (Cauchy-Schwarz).  What is left is exploded into
terms and summed in the task that reads it, with the broadcast weights of the
templates' and the most frequent terms; all other terms weigh at least as much
as the last of these, so most units fall out by a bound, and exactly.  Only the
terms of the rest are joined with their weights by a shuffle.

A file is a licence file of its directory if lines, paragraphs or one unit
that match hold at least half of its words, or if it begins with the title of
a license.  A file without a match of its own inherits from the nearest
ancestor directory that has a licence file: its directory is exploded into its
ancestors (as many rows as the path is deep) and joined by path.

Everything is DataFrame expressions; what comes to the driver and is broadcast
are the template terms and the most frequent terms, whose numbers are fixed.

Defined results: a null or empty text has no license of its own; a null path
has no ancestors; very long texts are read whole; several best templates: the
smallest name; several licence files in a directory: the highest score, then
the smallest path; repeated paths are files of their own; an empty table gives
no rows; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

THRESHOLD = 0.7
FILE_SHARE = 0.5
RUN = 3
#: So many of the most frequent terms have their weights broadcast beside those of the templates; a bound, nothing is lost by it.
FREQUENT = 4000
#: Among the numbers of templates: squares of the broadcast weights, and of the least weights of the other terms.
KNOWN, REST = -1, -2

#: License statements, whole short licenses and titles of long ones (fixed values, from the licenses' public texts).
STATEMENTS: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work, CC0 1.0 Universal, public domain dedication."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
TEXTS: tuple[tuple[str, str], ...] = (
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
)
TITLES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
TEMPLATES = (*STATEMENTS, *TEXTS, *TITLES)
#: Numbers of the templates that are titles.
TITLED = range(len(TEMPLATES) - len(TITLES), len(TEMPLATES))


def _terms(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


class Templates:
    """Weights of the template terms: count times ln(1 + texts / texts with the term), a term of no text counting as of one."""

    def __init__(self, often: dict[str, int], texts: int, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD):
        self.names = [name for name, _ in templates]
        self.weights: list[dict[str, float]] = []
        self.idf = {w: math.log(1 + texts / often.get(w, 1)) for w in self.terms(templates)}
        #: Of each anchor the templates that have it as one.
        self.by_anchor: dict[str, list[int]] = {}
        for template, (_, t) in enumerate(templates):
            raw = {w: k * self.idf[w] for w, k in sorted(Counter(_terms(t)).items())}
            norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
            unit = {w: x / norm for w, x in raw.items()}
            self.weights.append(unit)
            rest = 1.0
            for w, x in sorted(unit.items(), key=lambda p: (-p[1], p[0])):
                if rest < (threshold * 0.999) ** 2:
                    break
                self.by_anchor.setdefault(w, []).append(template)
                rest -= x * x
        self.anchors = sorted(self.by_anchor)

    @staticmethod
    def terms(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[str]:
        return sorted({w for _, t in templates for w in _terms(t)})


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def frequencies(files: DataFrame) -> DataFrame:
    """(term, texts): in how many texts each term occurs; counted before the shuffle."""
    return files.select(F.explode(F.array_distinct(_words(F.coalesce("text", F.lit(""))))).alias("term")).groupBy("term").agg(F.count("*").alias("texts"))


def units_of(files: DataFrame, anchors: list[str]) -> DataFrame:
    """id, total (words of the file), unit, n (words of the unit), words of the units with an anchor.

    unit is RUN * line + length - 1 of lines and runs, -1 of the whole text,
    -2 and below of paragraphs of several lines.
    """
    pattern = r"\b(?:" + "|".join(anchors) + r")\b"
    text = F.coalesce(F.col("text"), F.lit(""))
    # A text in which no anchor occurs is gone before it is cut into lines; a line without a word parts paragraphs.
    lines = F.transform(F.split(F.lower(text), "\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, "[^a-z0-9]+", " ")))
    whole = files.where(F.lower(text).rlike(pattern)).select("id", lines.alias("lines"))
    whole = whole.select("id", F.filter("lines", lambda x: x != "").alias("parts"), F.filter(F.split(F.array_join("lines", "\n"), "\n{2,}"), lambda x: F.trim(x, F.lit("\n")) != "").alias("paragraphs"))
    whole = whole.select("id", "parts", "paragraphs", F.array_join("parts", " ").alias("all")).withColumn("total", F.size(F.split("all", " ")))
    near = lambda k, n: F.array_join(F.slice("parts", k + 1, n), " ")
    some = lambda unit, line: F.struct(unit.cast("bigint").alias("unit"), line.alias("line"))
    runs = F.flatten(F.transform("parts", lambda _, k: F.array(*[F.when(k + n <= F.size("parts"), some(k * RUN + n - 1, near(k, n))) for n in range(1, RUN + 1)])))
    paragraphs = F.transform("paragraphs", lambda x, k: F.when(F.trim(x, F.lit("\n")).contains("\n"), some(-2 - k, F.trim(F.regexp_replace(x, "\n", " ")))))
    every = F.concat(runs, paragraphs, F.array(F.when(F.size("parts") > RUN, some(F.lit(-1), F.col("all")))))
    found = whole.select("id", "total", F.explode(F.filter(every, lambda x: x.isNotNull() & x["line"].rlike(pattern))).alias("x"))
    return found.select("id", "total", "x.unit", F.split("x.line", " ").alias("words")).withColumn("n", F.size("words"))


def sorted_units(units: DataFrame) -> DataFrame:
    """Units with their words in order, and starts: where in them each different word begins."""
    ordered = units.withColumn("words", F.sort_array("words"))
    return ordered.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda k: (k == 0) | (F.get("words", k) != F.get("words", k - 1))))


def unit_terms(units: DataFrame) -> DataFrame:
    """term and tf of sorted units beside their other columns, counted inside each row: nothing is shuffled for it."""
    runs = F.transform("starts", lambda p, k: F.struct(F.get("words", p).alias("term"), (F.coalesce(F.get("starts", k + 1), F.size("words")) - p).alias("tf")))
    return units.select(*(c for c in units.columns if c not in ("words", "starts")), F.inline(runs))


def near_units(units: DataFrame, often: DataFrame, known: Templates, texts: int, threshold: float = THRESHOLD, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """Units that may reach the threshold: id, total, unit, n, known, rest, dots (template, dot); and the broadcast weights.

    known is the square of the norm over terms whose weights are broadcast: those of templates and the most frequent ones.
    Any other term is at most as frequent as the last of these, which bounds the rest of the square from below, and so the cosine from above.
    """
    most = often.orderBy(F.desc("texts"), "term").limit(frequent).collect()
    least = math.log(1 + texts / most[-1].texts) if most else math.log(2)
    by_term: dict[str, list[tuple[int, float]]] = {}
    for k, by in enumerate(known.weights):
        for w, x in by.items():
            by_term.setdefault(w, []).append((k, x))
    idf = {r.term: math.log(1 + texts / r.texts) for r in most} | known.idf
    weights = units.sparkSession.createDataFrame([(w, x, by_term.get(w, [])) for w, x in idf.items()], "term string, idf double, in_templates array<struct<template:int,x:double>>")
    # A template without an anchor in the unit cannot reach the threshold.
    anchors = F.create_map(*(c for w, ks in known.by_anchor.items() for c in (F.lit(w), F.array(*map(F.lit, ks)))))
    templates = F.array_distinct(F.flatten(F.transform(F.array_intersect("words", F.array(*map(F.lit, known.anchors))), lambda w: F.element_at(anchors, w))))
    # Summed in the task that reads the unit: what is shuffled is a row for each unit and template, however many terms they share.
    weighed = unit_terms(sorted_units(units.withColumn("templates", templates))).join(F.broadcast(weights), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(least)))
    own = F.array(F.struct(F.when(F.col("idf").isNull(), REST).otherwise(KNOWN).alias("template"), F.col("w").alias("x")))
    shared = F.filter(F.coalesce("in_templates", F.array().cast("array<struct<template:int,x:double>>")), lambda t: F.array_contains("templates", t["template"]))
    rows = weighed.select("id", "total", "unit", "n", "w", F.explode(F.concat(own, shared)).alias("t"))
    sums = rows.groupBy("id", "total", "unit", "n", "t.template").agg(F.sum(F.col("w") * F.col("t.x")).alias("dot"))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("template") == k, F.col("dot"))), F.lit(0.0))
    dots = F.collect_list(F.when(F.col("template") >= 0, F.struct("template", "dot")))
    found = sums.groupBy("id", "total", "unit", "n").agg(of(KNOWN).alias("known"), of(REST).alias("rest"), dots.alias("dots"))
    # The margin is wider than what rounding scores to six digits adds.
    found = found.withColumn("dots", F.filter("dots", lambda d: d["dot"] >= (threshold - 1e-5) * F.sqrt(F.col("known") + F.col("rest"))))
    return found.where(F.size("dots") > 0), weights


def own_licenses(files: DataFrame, threshold: float = THRESHOLD, share: float = FILE_SHARE, frequent: int = FREQUENT) -> DataFrame:
    """id, license, score, is_file of the files with a match; ``files`` has id and text.

    The best unit gives the license: of those that hold most of the file, if there are any.
    """
    spark = files.sparkSession
    often = written(frequencies(files), "frequencies")
    texts = files.count()
    known = Templates({r.term: r.texts for r in often.where(F.col("term").isin(Templates.terms())).collect()}, texts, threshold=threshold)
    units = written(units_of(files, known.anchors), "units")
    near, weights = near_units(units, often, known, texts, threshold, frequent)
    near = written(near, "near")
    # The terms without a weight at hand are joined with theirs for these units alone.
    rare = unit_terms(sorted_units(units.select("id", "unit", "words").join(near.where("rest > 0").select("id", "unit"), ["id", "unit"]))).join(F.broadcast(weights.select("term")), "term", "left_anti")
    others = rare.join(often, "term").groupBy("id", "unit").agg(F.sum((F.col("tf") * F.log(1 + F.lit(float(texts)) / F.col("texts"))) ** 2).alias("others"))
    scored = near.join(others, ["id", "unit"], "left").select("id", "total", "unit", "n", F.sqrt(F.col("known") + F.coalesce("others", F.lit(0.0))).alias("norm"), F.inline("dots"))
    license = F.element_at(F.array(*map(F.lit, known.names)), F.col("template") + 1)
    scored = scored.withColumn("license", license).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= threshold)
    title = F.col("template").isin(list(TITLED)) & F.col("unit").between(0, RUN - 1)
    best = scored.groupBy("id", "total", "unit", "n").agg(F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("top"), F.max(title).alias("title"))
    # A unit that holds most of the file counts before a shorter one.
    first = F.struct((F.col("n") < share * F.col("total")).alias("part"), F.col("top.less").alias("less"), F.col("top.license").alias("license"))
    per_file = best.groupBy("id", "total").agg(F.min(first).alias("top"), F.max("title").alias("title"), F.max("n").alias("longest"), F.sum(F.when((F.col("unit") >= 0) & (F.col("unit") % RUN == 0), F.col("n")).otherwise(0)).alias("lines"), F.sum(F.when(F.col("unit") < -1, F.col("n")).otherwise(0)).alias("paragraphs"))
    return per_file.select("id", F.col("top.license").alias("license"), (-F.col("top.less")).alias("score"), (F.col("title") | (F.greatest("lines", "paragraphs", "longest") >= share * F.col("total"))).alias("is_file"))


def directory(path: Column) -> Column:
    """The directory of a path ('' at the top)."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """(depth, directory) of the path's directory and all above it."""
    parts = F.split(directory(path), "/")
    return F.transform(F.sequence(F.lit(0), F.when(directory(path) == "", 0).otherwise(F.size(parts))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("dir")))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, path, license, score, is_file, from_dir, effective of every file; ``files`` has id, path, text.

    license is the file's own, effective that or the nearest ancestor's, found in from_dir.
    """
    own = written(own_licenses(files.select("id", "text"), threshold=threshold), "licenses")
    paths = files.select("id", "path")
    licensed = own.where("is_file").join(paths, "id").where("path is not null")
    by_dir = licensed.groupBy(directory(F.col("path")).alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("less"), "path", "license")).alias("top")).select("dir", F.col("top.license").alias("inherited"))
    # Each directory once, with its ancestors: hot directories are one row.
    dirs = paths.where("path is not null").select(directory(F.col("path")).alias("own_dir")).distinct()
    steps = dirs.select("own_dir", F.explode(ancestors(F.concat("own_dir", F.lit("/x")))).alias("a")).select("own_dir", "a.depth", "a.dir")
    nearest = steps.join(by_dir, "dir").groupBy("own_dir").agg(F.max(F.struct("depth", "dir", "inherited")).alias("top")).select("own_dir", F.col("top.dir").alias("dir"), F.col("top.inherited").alias("inherited"))
    named = paths.withColumn("own_dir", directory(F.col("path"))).join(nearest, "own_dir", "left")
    full = named.join(own, "id", "left")
    return full.select("id", "path", "license", "score", F.coalesce("is_file", F.lit(False)).alias("is_file"), F.when(F.col("license").isNull(), F.col("dir")).alias("from_dir"), F.coalesce("license", "inherited").alias("effective"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as files source/lang/thousand/doc_id of one tree."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    found = scan(docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text"))
    return found.withColumnRenamed("id", "doc_id")


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    counts = ", ".join(f"({k}, {quote(name)}, {quote(w)}, {n})" for k, (name, t) in enumerate(TEMPLATES) for w, n in sorted(Counter(_terms(t)).items()))
    return f"""
WITH tt(template, license, term, k) AS (VALUES {counts}),
f AS (SELECT doc_id, coalesce(source, '-') || '/' || coalesce(lang, '-') AS top, concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR)) AS own_dir, lower(coalesce(text, '')) AS text FROM documents),
p AS (SELECT *, own_dir || '/' || CAST(doc_id AS VARCHAR) AS path FROM f),
df AS (SELECT term, count(*) AS texts FROM (SELECT unnest(list_distinct(string_split_regex(text, '[^a-z0-9]+'))) AS term FROM p) WHERE term <> '' GROUP BY ALL),
nd AS (SELECT CAST(count(*) AS DOUBLE) AS texts FROM p),
tw AS (SELECT template, license, term, k * ln(1 + nd.texts / coalesce(df.texts, 1)) AS x FROM tt LEFT JOIN df USING (term), nd),
weights AS (SELECT template, license, term, x / sqrt(sum(x * x) OVER (PARTITION BY template)) AS x FROM tw),
l AS (SELECT doc_id, list_transform(string_split_regex(text, '\r\n|\r|\n'), lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))) AS lines FROM p),
g AS (SELECT doc_id, list_filter(lines, lambda x: x <> '') AS ps, list_filter(string_split_regex(array_to_string(lines, chr(10)), '\n\n+'), lambda x: trim(x, chr(10)) <> '') AS gs FROM l),
k AS (SELECT doc_id, ps, unnest(range(0, len(ps))) AS k FROM g),
u AS (SELECT doc_id, k * {RUN} + n - 1 AS unit, array_to_string(ps[k + 1 : k + n], ' ') AS line FROM k, (SELECT unnest(range(1, {RUN} + 1)) AS n) WHERE k + n <= len(ps)
  UNION ALL SELECT doc_id, -1, array_to_string(ps, ' ') FROM g WHERE len(ps) > {RUN}
  UNION ALL SELECT doc_id, -2 - i, trim(replace(x, chr(10), ' ')) FROM (SELECT doc_id, unnest(gs) AS x, generate_subscripts(gs, 1) - 1 AS i FROM g) WHERE contains(trim(x, chr(10)), chr(10))),
w AS (SELECT doc_id, unit, string_split(line, ' ') AS words FROM u),
t AS (SELECT doc_id, unit, len(words) AS n, unnest(words) AS term FROM w),
tf AS (SELECT doc_id, unit, n, term, count(*) AS tf FROM t GROUP BY ALL),
x AS (SELECT tf.*, tf.tf * ln(1 + nd.texts / df.texts) AS w FROM tf JOIN df USING (term), nd),
nm AS (SELECT doc_id, unit, n, sqrt(sum(w * w)) AS norm FROM x GROUP BY ALL),
dt AS (SELECT doc_id, unit, template, license, sum(w * x) AS dot FROM x JOIN weights USING (term) GROUP BY ALL),
sc AS (SELECT dt.doc_id, dt.unit, n, template, license, round(dot / norm, 6) AS score FROM dt JOIN nm USING (doc_id, unit) WHERE round(dot / norm, 6) >= {THRESHOLD}),
tn AS (SELECT doc_id, len(list_filter(string_split_regex(text, '[^a-z0-9]+'), lambda x: x <> '')) AS total FROM p),
bl AS (SELECT doc_id, unit, n, max(score) AS score, max(template >= {TITLED.start} AND unit BETWEEN 0 AND {RUN - 1}) AS title FROM sc GROUP BY ALL),
ow AS (SELECT doc_id, max(title) AS title, greatest(max(n), sum(CASE WHEN unit >= 0 AND unit % {RUN} = 0 THEN n ELSE 0 END), sum(CASE WHEN unit < -1 THEN n ELSE 0 END)) AS words FROM bl GROUP BY ALL),
li AS (SELECT doc_id, arg_min(license, (n < {FILE_SHARE} * total, -score, license)) AS license, arg_min(score, (n < {FILE_SHARE} * total, -score, license)) AS score FROM sc JOIN tn USING (doc_id) GROUP BY ALL),
o AS (SELECT ow.doc_id, li.license, li.score, ow.title OR words >= {FILE_SHARE} * total AS is_file, p.own_dir, p.path FROM ow JOIN li USING (doc_id) JOIN p USING (doc_id) JOIN tn USING (doc_id)),
bd AS (SELECT own_dir AS dir, arg_min(license, (-score, path)) AS inherited FROM o WHERE is_file GROUP BY ALL),
an AS (SELECT DISTINCT own_dir, own_dir AS dir, 3 AS depth FROM p UNION SELECT DISTINCT own_dir, top, 2 FROM p UNION SELECT DISTINCT own_dir, split_part(own_dir, '/', 1), 1 FROM p UNION SELECT DISTINCT own_dir, '', 0 FROM p),
nr AS (SELECT own_dir, arg_max(dir, depth) AS dir, arg_max(inherited, depth) AS inherited FROM an JOIN bd USING (dir) GROUP BY ALL)
SELECT p.doc_id, p.path, o.license, o.score, coalesce(o.is_file, false) AS is_file, CASE WHEN o.license IS NULL THEN nr.dir END AS from_dir, coalesce(o.license, nr.inherited) AS effective
FROM p LEFT JOIN nr USING (own_dir) LEFT JOIN o ON o.doc_id = p.doc_id
"""


ORACLE = _oracle()
