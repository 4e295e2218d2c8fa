"""Licence scan: sparse TF-IDF cosine of passages to licence templates, then inheritance from the nearest ancestor directory.

A passage is a sentence or line. Its terms are words without stop words; weights are term counts times inverse document frequencies, which are
counted over all files for the templates' terms, while every other term has the weight of one that no file holds. A file is
judged in its task, and only its licence leaves it: no term is ever shuffled. A file's own licence is the template of
the best passage at THRESHOLD or more. A licence file is one named like one, or one that is mostly such passages. A directory takes the best licence of its
licence files, and a file without its own takes that of the nearest directory above it: directories, not files, are joined with
their ancestors, so a directory with a third of all files costs one row.

Null or empty text has no licence of its own. A null or empty path stands in no directory; a path without a slash stands in the root, which relative and absolute paths share. Other columns may have any name. Ties go to the template's name in order. Rows that repeat an id are
files of their own. An empty table gives no rows."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, small_batches, table

THRESHOLD, FILE_SHARE = 0.6, 0.5
#: Words without weight.
STOP_WORDS = "a an and any are as at be by for from in into is it its not of on or that the this to under was which will with you your".split()
#: Notices by licence: the usual headers and openings of licence files.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENSE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"


def terms_of(text: str) -> list[str]:
    return [t for t in re.findall(TERM, text.lower()) if t not in STOP_WORDS]


def passages(text: str) -> list[list[str]]:
    """The terms of each passage that has any."""
    return [found for part in re.split(r"(?a:\n|(?<=[.!?])\s+)", text) if (found := terms_of(part))]


class Model:
    """Inverse document frequencies of the templates' terms, and the templates' weights, scaled to length one."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[str, int], total: int, threshold: float, file_share: float):
        self.threshold, self.file_share, self.rare = threshold, file_share, math.log(1 + total) + 1
        self.idf = {t: math.log((1 + total) / (1 + counts.get(t, 0))) + 1 for _, text in templates for t in terms_of(text)}
        self.templates = []
        for name, text in templates:
            weights = {t: n * self.idf[t] for t, n in Counter(terms_of(text)).items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            self.templates.append((name, {t: w / norm for t, w in weights.items()}))

    def best(self, passage: list[str]) -> tuple[float, str] | None:
        """The least of (-cosine, name) at the threshold or more."""
        known, norm, inner = {}, 0.0, 0.0
        for t, n in Counter(passage).items():
            w = n * self.idf.get(t, self.rare)
            norm += w * w
            if t in self.idf:
                known[t] = w
                inner += w * w
        # The terms outside all templates alone can keep the cosine below the threshold.
        if inner < (self.threshold - 1e-6) ** 2 * norm:
            return None
        scores = ((-round(sum(w * weights.get(t, 0.0) for t, w in known.items()) / math.sqrt(norm), 9), name) for name, weights in self.templates)
        return min((s for s in scores if -s[0] >= self.threshold), default=None)

    def judge(self, path: str, text: str) -> tuple[str | None, float | None, bool]:
        """The own licence of a file, its score, and whether it is a licence file."""
        top, words, license_words = None, 0, 0
        for passage in passages(text):
            words += len(passage)
            if found := self.best(passage):
                license_words += len(passage)
                top = min(top or found, found)
        if top is None:
            return None, None, False
        return top[1], -top[0], bool(re.search(LICENSE_NAME, path)) or license_words >= self.file_share * words


def term_counts(texts: DataFrame, vocabulary: set[str]) -> DataFrame:
    """(term, files): in how many rows of texts each term of the vocabulary occurs; each batch is counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            counts = Counter()
            for text in got.column(0):
                counts.update(vocabulary.intersection(re.findall(TERM, text.as_py().lower())))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "files"])

    return texts.mapInArrow(run, "term string, files long").groupBy("term").agg(F.sum("files").alias("files"))


def scan(files: DataFrame, id_col: str, path: Column, text_col: str, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """id, path, own_license, own_score, is_license_file, license and inherited_from (a directory) of each file. See the module."""
    spark = files.sparkSession
    small_batches(spark)
    named = files.select(F.col(id_col).alias("id"), F.coalesce(path, F.lit("")).alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    vocabulary = {t for _, text in templates for t in terms_of(text)}
    counts = {r["term"]: r["files"] for r in term_counts(named.select("text"), vocabulary).collect()}  # at most one row for each template term
    shared = spark.sparkContext.broadcast(Model(templates, counts, named.count(), threshold, file_share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            judged = [shared.value.judge(p.as_py(), t.as_py()) for p, t in zip(got.column(1), got.column(2), strict=True)]
            columns = [pa.array([j[k] for j in judged], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), *columns], names=["id", "path", "own_license", "own_score", "is_license_file"])

    schema = named.select("id", "path").schema.add("own_license", "string").add("own_score", "double").add("is_license_file", "boolean")
    own = materialize(named.mapInArrow(run, schema), "own")
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path") != "", "")
    given = own.filter("is_license_file").groupBy(folder.alias("above")).agg(F.min_by("own_license", F.struct(-F.col("own_score"), "own_license")).alias("given"))
    folders = own.select(folder.alias("folder")).filter("folder is not null").distinct()
    steps = F.split("folder", "/")
    ancestors = folders.select("folder", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))))).alias("above"))
    nearest = ancestors.join(given, "above").groupBy("folder").agg(F.max_by("given", F.length("above")).alias("given"), F.max_by("above", F.length("above")).alias("inherited_from"))
    nearest = materialize(nearest, "inherited")
    out = own.withColumn("folder", folder).join(nearest, "folder", "left")
    return out.select(
        "id", "path", "own_license", "own_score", "is_license_file",
        F.coalesce("own_license", "given").alias("license"), F.when(F.col("own_license").isNull(), F.col("inherited_from")).alias("inherited_from"),
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand in folders by source and language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    place = F.concat(F.lit("/"), F.coalesce("source", F.lit("_")), F.lit("/"), F.coalesce("lang", F.lit("_")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("_")), F.lit(".txt"))
    return scan(docs, "doc_id", place, "text").withColumnRenamed("id", "doc_id")
