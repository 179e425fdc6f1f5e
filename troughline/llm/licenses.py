"""Licence scan: TF-IDF cosine of licence lines and term windows to templates, then inheritance from the nearest directory above."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from troughline.functions.keys import join_per_group
from troughline.llm.common import keep, text_of

# Notices as their licences word them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
#: Terms of the longest template; a test holds them together.
SPAN = 29
#: A line without one of these stems is no licence line: every template has one.
CUE = "(?i)licen[sc]|permission|redistribut"
#: Least cosine that names a licence.
LEAST = 0.8
#: Texts of at most this many words that hold a notice are licence files of their directory.
FILE_WORDS = 60


def terms(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def licence_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """`row, line_no, n, terms` of the lines of whole texts that may hold a notice."""
    lines = F.transform(F.split(text_of(text), "\n"), lambda s, i: F.struct(i.alias("no"), s.alias("s")))
    cued = docs.where(text_of(text).rlike(CUE)).select(F.col(key).alias("row"), F.explode(F.filter(lines, lambda x: x["s"].rlike(CUE))).alias("l"))
    return cued.select("row", F.col("l.no").alias("line_no"), terms(F.col("l.s")).alias("terms"))


def notice_contexts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """`row, context`: of whole texts, across line breaks, the terms around each one with a stem; any window of at
    most `SPAN` terms that holds it lies inside."""
    cued = docs.where(text_of(text).rlike(CUE)).select(F.col(key).alias("row"), terms(text_of(text)).alias("_terms"))
    at = F.filter(F.transform("_terms", lambda w, i: F.when(w.rlike(CUE), i)), lambda i: i.isNotNull())
    low = lambda i: F.greatest(i - (SPAN - 1), F.lit(0))
    around = F.transform("_at", lambda i: F.slice("_terms", low(i) + 1, i - low(i) + SPAN))
    return cued.withColumn("_at", at).select("row", F.explode(F.array_distinct(around)).alias("context"))


def _window_notices(contexts: DataFrame, templates: DataFrame, df: DataFrame, total: int, least: float) -> DataFrame:
    """`context, licence, cosine`: each context's best window of a template's length, where it is close enough.

    A context is weighed only against templates of which it holds enough: the cosine of any of its windows
    is at most the share of the template's norm on terms that the context has.
    """
    held = F.aggregate(F.filter("v", lambda x: F.array_contains("context", x["term"])), F.lit(0.0), lambda a, x: a + x["w"] * x["w"])
    able = keep(contexts.select("context").distinct().join(F.broadcast(templates), held >= (least * F.col("norm_t")) ** 2 - 1e-9), "able")
    placed = able.select("context").distinct().select("context", F.posexplode("context").alias("i", "term")).join(df, "term", "left")
    # A term that no licence line has weighs most.
    idf = F.coalesce("idf", F.lit(math.log(1.0 + total) + 1.0))
    weighed = placed.groupBy("context").agg(F.array_sort(F.collect_list(F.struct("i", "term", idf.alias("idf")))).alias("own"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("context") - F.col("n_t"), F.lit(0)))
    windows = able.join(weighed, "context").withColumn("start", F.explode(starts)).withColumn(
        "window", F.slice("own", F.col("start") + 1, F.col("n_t"))
    )
    # Sums over a window's places: each occurrence brings its weight once for every occurrence of its term.
    again = lambda x: F.size(F.filter("window", lambda y: y["term"] == x["term"]))
    square = F.aggregate(F.transform("window", lambda x: x["idf"] * x["idf"] * again(x)), F.lit(0.0), lambda a, x: a + x)
    dot = F.aggregate(F.transform("window", lambda x: x["idf"] * F.coalesce(F.get(F.filter("v", lambda y: y["term"] == x["term"]), F.lit(0))["w"], F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    cosine = F.round(dot / (F.sqrt(square) * F.col("norm_t")), 6)
    best = windows.select("context", "licence", cosine.alias("cosine")).where(F.col("cosine") >= least)
    return best.groupBy("context", "licence").agg(F.max("cosine").alias("cosine"))


def best_templates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """`row, licence, cosine`: the closest template of any line or term window of a document, if it is close enough.

    Windows run across line breaks and have the template's length, so a notice inside other text is found.

    A term weighs its count times ln((1 + lines) / (1 + lines with it)) + 1, over the distinct
    licence lines of all documents and the templates. Equal lines are compared once. Ties go to the
    licence first in the alphabet.
    """
    spark = docs.sparkSession
    found = keep(licence_lines(docs, key, text), "lines")
    templates = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(TEMPLATES)], "template int, licence string, notice string")
    wanted = templates.select("template", "licence", terms(F.col("notice")).alias("terms"))
    units = found.select("terms").union(wanted.select("terms")).distinct()
    weights = units.select("terms", F.explode("terms").alias("term")).groupBy("terms", "term").agg(F.count(F.lit(1)).alias("tf"))
    total = units.count()
    df = weights.groupBy("term").agg((F.log((1.0 + total) / (1.0 + F.count(F.lit(1)))) + 1.0).alias("idf"))
    # Sums in a fixed order of terms, so that equal lines weigh the same to the last bit.
    vectors = weights.join(df, "term").groupBy("terms").agg(F.array_sort(F.collect_list(F.struct("term", (F.col("tf") * F.col("idf")).alias("w")))).alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x["w"] * x["w"])
    vectors = vectors.withColumn("norm", F.sqrt(squares))
    # The templates are a fixed list, so their terms are a short table.
    ours = wanted.join(vectors, "terms").select("template", "licence", F.explode("v").alias("x"), F.col("norm").alias("norm_t")).select(
        "template", "licence", "norm_t", F.col("x.term").alias("term"), F.col("x.w").alias("w_t")
    )
    theirs = vectors.select("terms", "norm", F.explode("v").alias("x")).select("terms", "norm", F.col("x.term").alias("term"), F.col("x.w").alias("w"))
    met = theirs.join(F.broadcast(ours), "term").groupBy("terms", "norm", "template", "licence", "norm_t").agg(F.sum(F.col("w") * F.col("w_t")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("norm") * F.col("norm_t")), 6)
    close = met.select("terms", "licence", cosine.alias("cosine")).where(F.col("cosine") >= least)
    of_line = close.groupBy("terms").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"))
    contexts = keep(notice_contexts(docs, key, text), "contexts")
    whole = wanted.join(vectors, "terms").select("template", "licence", F.col("v"), F.col("norm").alias("norm_t"), F.size("terms").alias("n_t"))
    of_window = _window_notices(contexts, whole, df, total, least).groupBy("context").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"))
    both = found.join(of_line, "terms").select("row", "b").union(contexts.join(of_window, "context").select("row", "b"))
    return both.groupBy("row").agg(F.min("b").alias("b")).select(
        "row", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine")
    )


def folder(path: Column) -> Column:
    """The directory of a path, empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(docs: DataFrame, path: Column, is_file: Column, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row per document: `key, path, own_licence, cosine, licence, licence_folder`.

    `is_file` marks documents whose notice holds for their directory and those below it. A document's
    own notice comes first; else the licence file of the nearest directory above holds, whose
    folder is returned; else both are null. Of several licence files in one directory the closest
    to its template holds, then the first licence by name. Null and empty texts hold no notice; a null
    path is the top directory. Rows that repeat a key share a notice. An empty table gives no rows;
    other columns are ignored.
    """
    best = keep(best_templates(docs, key, text, least), "notices")
    rows = docs.select(F.col(key).alias("row"), F.coalesce(path, F.lit("")).alias("path"), is_file.alias("is_file"))
    known = keep(rows.join(best, "row", "left").withColumn("folder", folder(F.col("path"))), "known")
    files = known.where(F.col("is_file") & F.col("licence").isNotNull()).groupBy(F.col("folder").alias("above")).agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b")
    ).select("above", F.col("b.licence").alias("from_above"))
    # Only distinct directories climb: a/b/c asks a/b/c, a/b, a and the top, longest first.
    folders = known.select("folder").distinct()
    steps = F.split("folder", "/")
    climbed = folders.select("folder", F.explode(F.transform(
        F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/")
    )).alias("above"))
    met = climbed.distinct().join(files, "above")
    nearest = met.groupBy("folder").agg(F.max(F.struct(F.length("above").alias("n"), "above", "from_above")).alias("m")).select(
        "folder", F.col("m.above").alias("licence_folder"), F.col("m.from_above").alias("from_above")
    )
    per_folder = folders.join(nearest, "folder", "left")
    out = join_per_group(known, per_folder, ["folder"], F.col("row"))
    mine = F.col("licence").isNotNull()
    return out.select(
        F.col("row").alias(key), "path", F.col("licence").alias("own_licence"), "cosine", F.coalesce("licence", "from_above").alias("licence"),
        F.when(~mine, F.col("licence_folder")).alias("licence_folder"),
    )


