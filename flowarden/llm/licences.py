"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

* Candidates: every segment of a whole text that names a licence (a line, a sentence of a line, and a sentence of a
  paragraph whose comment marks are stripped and whose wrapped lines are joined), and the whole text of licence files
  (by file name). A candidate is a bag of terms.
* Term weights: term frequency times log((1 + N) / (1 + df)) + 1 over all candidates and templates. Only terms of
  templates can add to a product, so candidates meet the templates' postings in a join on the term; a candidate's own
  length counts all its terms.
* A file's own licence is the template with the highest cosine of at least ``LEAST_COSINE`` over its candidates.
* A file without one inherits that of the nearest ancestor directory (its own first) that holds a licence file:
  directories are expanded to their ancestors and joined by path, each directory once, before files are joined.

All in DataFrame operations. The templates are a fixed list; nothing else is broadcast by request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowarden.session import materialise

LEAST_COSINE = 0.6
LICENCE_FILE = r"(?i)^(licen[cs]es?|copying|unlicen[cs]e|notice)([._-].*)?$"
NAMES_LICENCE = ("licen", "copyright", "spdx", "public domain", "all rights reserved", "permission is", "redistribution")
COMMENT_MARK = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+|%+)?[ \t]*"

# Usual statements of licences, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-2.0", "GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("ISC", "Released under the ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved."),
)


def terms(text: Column) -> Column:
    """Words and version numbers of a text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+|[0-9]+(?:\.[0-9]+)*"), F.lit(0))


def segments(text: Column) -> Column:
    """Lines, sentences, and sentences of paragraphs over wrapped lines, that name a licence."""
    named = lambda s: F.exists(F.array(*[F.lit(x) for x in NAMES_LICENCE]), lambda x: F.contains(F.lower(s), x))
    parts = F.split(text, r"\n|(?<=[.!?;])[ \t]+")
    paragraphs = F.transform(F.split(F.regexp_replace(text, COMMENT_MARK, ""), r"\n\n+"), lambda p: F.regexp_replace(p, r"\s+", " "))
    whole = F.flatten(F.transform(F.filter(paragraphs, named), lambda p: F.split(p, "(?<=[.!?]) ")))
    return F.when(named(text), F.array_distinct(F.filter(F.concat(parts, whole), named))).otherwise(F.array().cast("array<string>"))


def _weights(bags: DataFrame) -> DataFrame:
    """(bag, term, tf) with ``w``, the TF-IDF weight over all bags."""
    n = bags.select("bag").distinct().count()
    df = bags.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return bags.join(df, "term").withColumn("w", F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1))


def _bags(rows: DataFrame) -> DataFrame:
    """(bag, text) to distinct (bag, term, tf)."""
    return rows.select("bag", F.explode(terms(F.col("text"))).alias("term")).groupBy("bag", "term").agg(F.count(F.lit(1)).alias("tf"))


def best_templates(candidates: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(bag, licence, cosine) of distinct texts (column text, also their name) that come near enough to a template."""
    spark: SparkSession = candidates.sparkSession
    known = spark.createDataFrame([(f"\0{i}", text, name) for i, (name, text) in enumerate(TEMPLATES)], "bag string, text string, licence string")
    # a bag goes by the digest of its text: a long licence file is not carried along with every term
    texts = candidates.select(F.md5("text").alias("bag"), "text").distinct()
    rows = texts.unionByName(known.select("bag", "text"))
    weights = materialise(_weights(_bags(rows)), "licence-terms")
    length = weights.groupBy("bag").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    ours, theirs = weights.where("NOT startswith(bag, '\0')"), weights.where("startswith(bag, '\0')")
    theirs = theirs.join(length, "bag").select(F.col("bag").alias("template"), "term", (F.col("w") / F.col("length")).alias("v"))
    product = ours.join(theirs, "term").groupBy("bag", "template").agg(F.sum(F.col("w") * F.col("v")).alias("product"))
    scored = product.join(length, "bag").withColumn("cosine", F.round(F.least(F.col("product") / F.col("length"), F.lit(1.0)), 9)).where(F.col("cosine") >= least)
    named = scored.join(known.select(F.col("bag").alias("template"), "licence"), "template")
    best = named.groupBy("bag").agg(F.min(F.struct((-F.col("cosine")).alias("low"), "licence")).alias("b"))
    best = best.select("bag", F.col("b.licence").alias("licence"), (-F.col("b.low")).alias("cosine"))
    return texts.join(best, "bag").select(F.col("text").alias("bag"), "licence", "cosine")


def directory(path: Column) -> Column:
    """The directory of a path, ``""`` at the top."""
    return F.when(F.locate("/", path) > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def ancestors(directory_: Column) -> Column:
    """A directory and all above it, the nearest first and ``""`` last."""
    parts = F.split(directory_, "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(directory_ == "", F.array(F.lit(""))).otherwise(F.concat(above, F.array(F.lit(""))))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", least: float = LEAST_COSINE) -> DataFrame:
    """``files`` with licence, cosine and licence_from: ``own``, ``inherited`` or null.

    A null or empty text has no licence of its own; a null path is a file without a directory, which inherits nothing.
    Ties go to the first licence in order. Rows that agree in path and text get the same result and stay as they are.
    Files of one path with different texts keep their own licences; as licence files of a directory the nearest to a
    template counts.
    """
    path, text = F.col(path_col), F.col(text_col)
    is_licence = F.coalesce(F.regexp_extract(path, r"[^/]*$", 0).rlike(LICENCE_FILE), F.lit(False))
    held = F.when(is_licence & text.isNotNull(), F.array_append(segments(text), text)).otherwise(segments(text))
    own = files.select(path.alias("path"), is_licence.alias("is_licence"), F.xxhash64(text).alias("body"), F.explode(held).alias("text")).distinct()
    own = materialise(own, "licence-candidates")
    found = own.join(best_templates(own, least), own["text"] == F.col("bag"))
    per_file = found.groupBy("path", "body", "is_licence").agg(F.min(F.struct((-F.col("cosine")).alias("low"), "licence")).alias("b"))
    per_file = materialise(per_file.select("path", "body", "is_licence", F.col("b.licence").alias("licence"), (-F.col("b.low")).alias("cosine")), "licences")

    licensed = per_file.where("is_licence AND path IS NOT NULL").groupBy(directory(F.col("path")).alias("at")).agg(F.min(F.struct((-F.col("cosine")).alias("low"), "licence")).alias("b"))
    licensed = licensed.select("at", "b.licence")
    directories = files.where(path.isNotNull()).select(directory(path).alias("dir")).distinct()
    steps = directories.select("dir", F.posexplode(ancestors(F.col("dir"))).alias("up", "at"))
    nearest = steps.join(licensed, "at").groupBy("dir").agg(F.min(F.struct("up", "licence")).alias("b")).select(F.col("dir").alias("__dir"), F.col("b.licence").alias("__inherited"))

    rows = files.drop("licence", "cosine", "licence_from").withColumns({"__dir_of": directory(path), "__body": F.xxhash64(text)})
    mine = per_file.select(F.col("path").alias("__path"), F.col("body").alias("__b"), F.col("licence").alias("__own"), F.col("cosine").alias("__cosine"))
    rows = rows.join(mine, path.eqNullSafe(F.col("__path")) & (F.col("__body") == F.col("__b")), "left")
    rows = rows.join(nearest, F.col("__dir_of") == F.col("__dir"), "left")
    source = F.when(F.col("__own").isNotNull(), "own").when(F.col("__inherited").isNotNull(), "inherited")
    rows = rows.withColumns({"licence": F.coalesce("__own", "__inherited"), "cosine": F.col("__cosine"), "licence_from": source})
    return rows.drop("__dir_of", "__body", "__path", "__b", "__own", "__cosine", "__dir", "__inherited")
