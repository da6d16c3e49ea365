"""License scans by sparse TF-IDF cosine to templates, with inheritance by directory.

A file has units: its whole text, as a license file is one, and each line, as headers
are.  Units and templates are vectors over the words of the templates, weighted by
their rarity over all files; a word that no template has counts as the rarest word,
each occurrence by itself.  A file's license is that of the unit and template with
the greatest cosine, if it reaches THRESHOLD.  Files without one inherit from the
license file in the nearest directory above them (or in their own).

A template that names a version counts only where all its numbers stand in the unit, so
that one version is not taken for another.

Only units that can reach the threshold are compared, and this loses none: of each
template the weightiest words are taken until the others together have less than
THRESHOLD of its length; a unit without any of them has a smaller cosine (Cauchy and
Schwarz).  Those words are searched in every text.  Only texts that have one of
those words move, and the names of files.

Everything is column expressions and joins.  Templates are a parameter, at most
MOST_WORDS words in all; their words are what is broadcast.

Defined results: a null or empty text has no license of its own; repeated rows are
scanned once and reported each; equal cosines go to the first unit, then to the first
license by name, and of license files in one directory to the best, then to the first
path; a path without a directory has the directory ""; a null path has no ancestors;
an empty table of files gives an empty result, without templates nothing is found.
Only path and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estilens.llm.common import staged

THRESHOLD = 0.6
MOST_WORDS = 5_000

#: Fixed texts: how works commonly state their license.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
WORD = "[a-z0-9]+"
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying)[^/]*$"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _counts(text: str) -> dict[str, int]:
    import re

    found = re.findall(WORD, text.lower())
    return {word: found.count(word) for word in found}


def rarity(files: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """The weight of each word of the templates, from its frequency over all files;
    under "" the weight of words that occur nowhere."""
    present = F.array_intersect(words_of(F.coalesce("text", F.lit(""))), F.array(*map(F.lit, vocabulary)).cast("array<string>"))
    # One row per word and task before the shuffle; "" counts the files.
    counts = files.select(F.explode(F.concat(F.array(F.lit("")), present)).alias("word")).groupBy("word").count()
    df = {r["word"]: r["count"] for r in counts.collect()}  # as many rows as the templates have words
    n = df.get("", 0)
    return {word: math.log((1 + n) / (1 + df.get(word, 0))) + 1 for word in vocabulary} | {"": math.log(1 + n) + 1}


def needed_words(templates: Iterable[dict[str, int]], weight: dict[str, float], threshold: float) -> list[str]:
    """Words of which every unit that reaches the threshold has one at least."""
    out: set[str] = set()
    for counts in templates:
        squares = sorted(((tf * weight[word]) ** 2, word) for word, tf in counts.items())
        whole, rest = sum(s for s, _ in squares), 0.0
        for square, word in squares:
            rest += square
            if rest >= (threshold * (1 - 1e-9)) ** 2 * whole:
                out.add(word)
    return sorted(out)


def own_licenses(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files(path, text) -> key (see file_key), license, similarity and how (file or header)."""
    vectors = [_counts(text) for _, text in templates]
    vocabulary = sorted({word for counts in vectors for word in counts})
    if sum(map(len, vectors)) > MOST_WORDS:
        raise ValueError(f"templates have more than MOST_WORDS = {MOST_WORDS} words")
    weight = rarity(files, vocabulary)
    needed = F.array(*map(F.lit, needed_words(vectors, weight, threshold))).cast("array<string>")
    texts = files.select(file_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    # Only texts with a needed word move, once; everything below stays in the partition of the key.
    texts = texts.filter(F.arrays_overlap(words_of(F.col("text")), needed)).dropDuplicates(["key"])
    units = texts.select("key", F.posexplode(F.concat(F.array("text"), F.split("text", "\n", -1))).alias("unit", "line"))
    units = units.select("key", "unit", words_of(F.col("line")).alias("words")).filter(F.arrays_overlap("words", needed))
    counts = units.select("key", "unit", F.explode("words").alias("word")).groupBy("key", "unit", "word").agg(F.count(F.lit(1)).alias("tf"))
    # Each word's weight and its part in the unit vector of every template.
    sizes = [math.sqrt(sum((tf * weight[w]) ** 2 for w, tf in v.items())) for v in vectors]
    known = [
        F.struct(
            F.lit(w).alias("word"), F.lit(weight[w]).alias("idf"), F.array(*[F.lit(v.get(w, 0) * weight[w] / size) for v, size in zip(vectors, sizes)]).alias("parts"),
            F.array(*[F.lit(int(w.isdigit() and w in v)) for v in vectors]).alias("numbers"),
        )
        for w in vocabulary
    ]
    known = files.sparkSession.range(1).select(F.inline(F.array(*known))) if known else None
    if known is None:
        return texts.select("key", F.lit("").alias("license"), F.lit(0.0).alias("similarity"), F.lit("").alias("how")).limit(0)
    own = F.col("tf") * F.col("idf")
    rarest = F.col("tf") * F.lit(weight[""] ** 2)
    products = [F.sum(own * F.col("parts")[k]) for k in range(len(templates))]
    versions = [sum(w.isdigit() for w in v) for v in vectors]
    numbers = [F.sum(F.col("numbers")[k]) if n else F.lit(0).cast("bigint") for k, n in enumerate(versions)]
    scored = counts.join(F.broadcast(known), "word", "left").groupBy("key", "unit").agg(
        F.sqrt(F.sum(F.coalesce(own * own, rarest))).alias("length"), F.array(*products).alias("products"), F.array(*numbers).alias("numbers")
    )
    names = F.array(*[F.lit(name) for name, _ in templates])
    wanted = F.array(*[F.lit(n).cast("bigint") for n in versions])
    cosines = F.transform("products", lambda x, k: F.struct(
        F.when(F.get("numbers", k) == F.get(wanted, k), -F.round(x / F.col("length"), 6)).alias("s"), F.col("unit"), F.get(names, k).alias("license")))
    # A unit has a product with some template, since it has one of the needed words.
    best = scored.groupBy("key").agg(F.min(F.array_min(F.filter(cosines, lambda x: x["s"] <= -threshold))).alias("b")).filter("b IS NOT NULL")
    how = F.when(F.col("b.unit") == 0, "file").otherwise("header")
    return best.select("key", F.col("b.license").alias("license"), (-F.col("b.s")).alias("similarity"), how.alias("how"))


def file_key() -> Column:
    """A checksum of path and text: equal rows are one file."""
    return F.md5(F.concat_ws("\n", F.coalesce("path", F.lit("")), F.coalesce("text", F.lit(""))))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherited(paths: DataFrame, own: DataFrame) -> DataFrame:
    """paths(path), own(path, license, similarity) -> (directory, license, inherited_from)
    for each directory of paths with a license file above."""
    given = own.filter(F.col("path").rlike(LICENSE_FILE)).groupBy(directory(F.col("path")).alias("ancestor")).agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), "path", "license")).alias("g")
    )
    parts = F.split("directory", "/", -1)
    # One row per directory and ancestor: as deep as paths are, whatever the number of files.
    above = paths.select(directory(F.col("path")).alias("directory")).filter("directory IS NOT NULL").distinct().select(
        "directory", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("depth", "ancestor")
    )
    nearest = above.join(given, "ancestor").groupBy("directory").agg(F.max(F.struct("depth", "g")).alias("n"))
    return nearest.select("directory", F.col("n.g.license").alias("license"), F.col("n.g.path").alias("inherited_from"))


def license_scan(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files(path, text) -> path, license, similarity, how (file, header, inherited,
    none) and inherited_from, one row per row of files."""
    found = staged(own_licenses(files, templates, threshold), "licenses")
    names = staged(files.select("path", file_key().alias("key")), "license-paths")
    own = names.join(found, "key", "left")
    above = inherited(names.select("path"), own.filter("license IS NOT NULL").distinct())
    above = above.select(F.col("directory").alias("d"), F.col("license").alias("i_license"), "inherited_from")
    rows = own.join(above, directory(F.col("path")) == F.col("d"), "left")
    mine = F.col("license").isNotNull()
    return rows.select(
        "path", F.coalesce("license", "i_license").alias("license"), "similarity",
        F.when(mine, F.col("how")).when(F.col("i_license").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(~mine, F.col("inherited_from")).alias("inherited_from"),
    )


def as_repositories(docs: DataFrame) -> DataFrame:
    """Documents as files of repositories: a source is one, two digits of the id are
    directories, and each tenth document is the license file of a directory on its path."""
    n = F.coalesce("doc_id", F.lit(-1))
    parts = F.array(F.coalesce("source", F.lit("none")), (F.floor(n / 100) % 10).cast("string"), (F.floor(n / 1000) % 10).cast("string"))
    where = F.when(n % 10 == 0, F.slice(parts, F.lit(1), (F.floor(n / 10) % 3 + 1).cast("int"))).otherwise(parts)
    name = F.concat(F.when(n % 10 == 0, "LICENSE-").otherwise("file-"), n.cast("string"))
    return docs.select(F.array_join(F.concat(where, F.array(name)), "/").alias("path"), "text")


def scan_documents(docs: DataFrame) -> DataFrame:
    """The scan over documents as files; doc_id is read back from the path."""
    rows = license_scan(as_repositories(docs))
    number = F.regexp_extract("path", "-(-?[0-9]+)$", 1).cast("bigint")
    return rows.select(F.when(number >= 0, number).alias("doc_id"), *rows.columns)
