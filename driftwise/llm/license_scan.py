"""Licence scan: sparse TF-IDF cosine to licence templates, then inheritance from the
nearest ancestor directory.

1. Units. Every line and every block between blank lines of a file is a header
   candidate, wherever it stands; of a licence file (by its name) the whole text is one
   too. Words are lower-case runs of letters and digits.
2. Weights are (1 + ln tf) * idf with idf = ln((1 + N) / (1 + df)) + 1 over all N files, for the
   templates' words and for those of no template, which add to a unit's length only.
3. Search. A unit whose cosine with a template reaches the threshold must hold one of
   the template's rarest words: those that must be taken away until the rest of the
   template is shorter than threshold * length. Only files and units holding such a
   word are expanded, which loses no match. A word of no template has an idf of 1 at
   least, which bounds a unit's cosine from above; document frequencies of such words are
   counted for the units whose bound reaches the threshold, and their cosines are exact.
4. A file has the licence of its best unit (highest cosine, then the licence's name). A
   licence file gives its licence to its directory; a file without one of its own
   takes that of the nearest ancestor directory that has one, found by joining the
   prefixes of the distinct directories.

Scale: the templates are a parameter, and their vocabulary a checked small table. Document
frequencies are partially aggregated; whole texts are not shuffled, only the words of
units with a candidate word, and for the second count those of units within the bound, or
counts of all words if those are too many to broadcast. Prefixes are expanded for distinct directories, not for files.

Cases: null or empty texts have no units; null paths have no directory, inherit nothing
and are no licence files; repeated rows get a row each; of several licence files in a
directory the best cosine wins; without templates nothing is found; an empty table
gives an empty result; extra columns are ignored but those in ``keep``. DataFrame
functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_small, materialize, row_key, written
from .decontaminate import plain_words

THRESHOLD = 0.6
LICENCE_FILE = "(?i)(^|/)(licen[sc]e|copying|unlicense)([.-][^/]*)?$"

# Notices and texts by which licences are commonly stated.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
     "in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
     "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
     "either express or implied. See the License for the specific language governing permissions and limitations "
     "under the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
     "your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
     "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
     "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
     "conditions: The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
     "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)


def _template_terms(spark, templates: Sequence[tuple[str, str]]) -> list[tuple[int, str, str, int]]:
    """(template, licence, term, tf): the templates are a parameter, so bounded."""
    rows = spark.createDataFrame([(i, lic, text) for i, (lic, text) in enumerate(templates)],
                                 "__t int, __licence string, __text string")
    terms = rows.select("__t", "__licence", F.explode(plain_words(F.col("__text"))).alias("__term"))
    return [(r[0], r[1], r[2], r[3]) for r in
            terms.groupBy("__t", "__licence", "__term").agg(F.count(F.lit(1)).alias("__tf")).collect()]


def needed_terms(weights: dict[str, float], threshold: float) -> set[str]:
    """The heaviest terms of a template, as many as must be absent before the cosine of
    anything without them is below the threshold."""
    total = sqrt(sum(w * w for w in weights.values()))
    rest, out = total * total, set()
    for term, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        if sqrt(max(rest, 0.0)) < threshold * total * (1 - 1e-9):
            break
        out.add(term)
        rest -= w * w
    return out


def _units(df: DataFrame) -> DataFrame:
    """``(__k1, __k2, __unit, __w)``: lines, blocks and the whole text of licence files."""
    text = F.col("__text")
    lines = F.split(text, "\n")
    blocks = F.split(text, "\n[ \\t\\r]*\n")
    whole = F.when(F.coalesce(F.col("__path").rlike(LICENCE_FILE), F.lit(False)), F.array(text)).otherwise(
        F.array().cast("array<string>"))
    each = df.select("__k1", "__k2", F.posexplode(F.array_distinct(F.concat(lines, blocks, whole))).alias("__unit", "__u"))
    return each.select("__k1", "__k2", "__unit", plain_words(F.col("__u")).alias("__w"))


def _holds(terms: Sequence[str]) -> Column:
    return F.arrays_overlap("__w", F.array(*[F.lit(t) for t in terms]))


def _frequencies(files: DataFrame, terms: DataFrame) -> DataFrame:
    """``(__term, __df)``: the number of files that hold each of the distinct ``terms``."""
    seen = files.select(F.explode(F.array_distinct(plain_words(F.col("__text")))).alias("__term"))
    if is_small(terms):
        return seen.join(F.broadcast(terms), "__term").groupBy("__term").agg(F.count(F.lit(1)).alias("__df"))
    return seen.groupBy("__term").agg(F.count(F.lit(1)).alias("__df")).join(terms, "__term", "left_semi")


def own_licences(files: DataFrame, templates: Sequence[tuple[str, str]], threshold: float) -> DataFrame:
    """``(__k1, __k2, __best)`` for files ``(__k1, __k2, __path, __text)`` in which a unit
    reaches the threshold; ``__best`` is (cosine, licence)."""
    spark = files.sparkSession
    terms = _template_terms(spark, templates)
    none = files.limit(0).select("__k1", "__k2", F.struct(F.lit(0.0).alias("cosine"), F.lit("").alias("licence")).alias("__best"))
    if not terms:
        return none
    vocabulary = spark.createDataFrame([(t,) for t in sorted({r[2] for r in terms})], "__term string")
    df = {r[0]: r[1] for r in _frequencies(files, vocabulary).collect()}
    n = files.count()
    idf = {t: log((1 + n) / (1 + df.get(t, 0))) + 1 for t in {r[2] for r in terms}}
    weights: dict[int, dict[str, float]] = {}
    names: dict[int, str] = {}
    for t, licence, term, tf in terms:
        weights.setdefault(t, {})[term] = (1 + log(tf)) * idf[term]
        names[t] = licence
    needed = sorted(set().union(*(needed_terms(w, threshold) for w in weights.values())))
    length = {t: sqrt(sum(w * w for w in ws.values())) for t, ws in weights.items()}

    near = files.withColumn("__w", plain_words(F.col("__text"))).filter(_holds(needed)).drop("__w")
    units = _units(near).filter(_holds(needed))
    words = units.select("__k1", "__k2", "__unit", F.explode("__w").alias("__term"))
    unit = ["__k1", "__k2", "__unit"]
    tf = written(words.groupBy(*unit, "__term").agg(F.count(F.lit(1)).alias("__tf")))
    order = sorted(weights)
    by_term = spark.createDataFrame(
        [(term, idf[term], [float(weights[t].get(term, 0.0)) / length[t] for t in order]) for term in idf],
        "__term string, __idf double, __v array<double>")
    x = (1 + F.log(F.col("__tf").cast("double"))) * F.coalesce("__idf", F.lit(1.0))
    dots = [F.sum(F.coalesce(x * F.get("__v", F.lit(i)), F.lit(0.0))).alias(f"__d{i}") for i in range(len(order))]
    sums = tf.join(F.broadcast(by_term), "__term", "left").groupBy(*unit).agg(
        F.sum(x * x).alias("__least"), F.sum(F.when(F.col("__idf").isNotNull(), x * x)).alias("__known"), *dots)
    top = F.greatest(*[f"__d{i}" for i in range(len(order))]) if len(order) > 1 else F.col("__d0")
    close = materialize(sums.filter(top / F.sqrt("__least") >= threshold - 1e-12).drop("__least"))
    keys = close.select(*unit)
    others = tf.join(F.broadcast(vocabulary), "__term", "left_anti").join(
        F.broadcast(keys) if is_small(close) else keys, unit, "left_semi")
    others = materialize(others)
    counts = materialize(_frequencies(files, materialize(others.select("__term").distinct())))
    x = (1 + F.log(F.col("__tf").cast("double"))) * (F.log(F.lit(float(1 + n)) / (1 + F.col("__df"))) + 1)
    rest = others.join(F.broadcast(counts) if is_small(counts) else counts, "__term").groupBy(*unit).agg(
        F.sum(x * x).alias("__rest"))
    sums = close.join(rest, unit, "left").withColumn("__norm", F.col("__known") + F.coalesce("__rest", F.lit(0.0)))
    best = F.greatest(*[F.struct((F.col(f"__d{i}") / F.sqrt("__norm")).alias("cosine"), F.lit(names[t]).alias("licence"))
                        for i, t in enumerate(order)]) if len(order) > 1 else F.struct(
        (F.col("__d0") / F.sqrt("__norm")).alias("cosine"), F.lit(names[order[0]]).alias("licence"))
    found = sums.select("__k1", "__k2", best.alias("__best")).filter(F.col("__best.cosine") >= threshold - 1e-12)
    return found.groupBy("__k1", "__k2").agg(F.max("__best").alias("__best"))


def scan_licences(files: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, path_col: str = "path",
                  text_col: str = "text", threshold: float = THRESHOLD, keep: Sequence[str] = ()) -> DataFrame:
    """``(path, keep..., licence, cosine, evidence, from_directory)`` per file;
    ``evidence`` is ``own``, ``inherited`` or null."""
    path, text = F.col(f"`{path_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    k1, k2 = row_key(path, text)
    kept = [F.col(f"`{c}`").alias(f"__keep{i}") for i, c in enumerate(keep)]
    own = files.select(k1.alias("__k1"), k2.alias("__k2"), path.alias("__path"), text.alias("__text"), *kept)
    best = materialize(own_licences(own, templates, threshold))
    # the directory is the path up to its last "/", empty for the top; "/" closes it
    directory = F.concat(F.regexp_extract("__path", "(?s)^(.*)/[^/]*$", 1), F.lit("/"))
    slim = own.drop("__text").withColumn("__dir", F.when(F.col("__path").contains("/"), directory).otherwise(
        F.when(F.col("__path").isNotNull(), F.lit("/"))))
    slim = slim.join(F.broadcast(best) if is_small(best) else best, ["__k1", "__k2"], "left")
    licensed = slim.filter(F.col("__best").isNotNull() & F.col("__path").rlike(LICENCE_FILE))
    by_dir = materialize(licensed.groupBy("__dir").agg(F.max("__best").alias("__given")))
    small = is_small(by_dir)
    dirs = slim.filter(F.col("__best").isNull() & F.col("__dir").isNotNull()).select("__dir").distinct()
    parts = F.split(F.col("__dir"), "/")  # a directory ends in "/", so the last part is empty
    up = dirs.select("__dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(
        i.alias("depth"), F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")).alias("dir")))).alias("__up"))
    up = up.select("__dir", F.col("__up.depth").alias("__depth"), F.col("__up.dir").alias("__at"))
    given = by_dir.select(F.col("__dir").alias("__at"), "__given")
    met = up.join(F.broadcast(given) if small else given, "__at")
    nearest = materialize(met.groupBy("__dir").agg(F.max(F.struct("__depth", "__at", "__given")).alias("__from")))
    out = slim.join(F.broadcast(nearest) if is_small(nearest) else nearest, "__dir", "left")
    inherited = F.when(F.col("__best").isNull(), F.col("__from.__given"))
    return out.select(
        F.col("__path").alias(path_col), *[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)],
        F.coalesce("__best.licence", inherited["licence"]).alias("licence"),
        F.coalesce("__best.cosine", inherited["cosine"]).alias("cosine"),
        F.when(F.col("__best").isNotNull(), "own").when(inherited.isNotNull(), "inherited").alias("evidence"),
        F.when(F.col("__best").isNull(), F.col("__from.__at")).alias("from_directory"))
