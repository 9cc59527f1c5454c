"""Licence scan: a trained paragraph classifier confirmed by templates.

Every line with a word is a paragraph.  Its word 1- and 2-grams are hashed into
a sparse vector and scored by multinomial logistic regression over the licence
families and the class ``unknown``.  The model is trained in the session from

* the notices below, whole and with seeded gaps, alone and inside prose, and
* a bounded sample of the corpus' own paragraphs that share no word 3-gram with
  any notice, as class ``unknown``.

One fold of both is held back to fit a temperature that calibrates the class
probabilities.  A family predicted with probability ``LEAST`` or more is
*confirmed* when the paragraph holds at least ``MATCH`` of the word 3-grams of
one of the family's notices; otherwise it counts as unknown.

A notice may also be wrapped over lines.  Consecutive lines with a word (marks
of comments are no words) are one block; windows over its words, long enough to
hold any notice, are compared with the notices, and where ``MATCH`` of a notice
is found that no single line holds, the words from its first to its last common
3-gram are scored like a paragraph.  A block counts once per family found so.

DataFrame and SQL operations (and the DataFrame-based ml package) throughout.

Edge cases: null or empty texts have no paragraph and no family; paragraphs of
one or two words have no 3-gram and cannot be confirmed; rows with the same id
are one document (null is an id of its own); a very long paragraph is one
paragraph; ties between families go to the one that sorts first; an empty table
trains on the notices alone and gives no row; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import materialize

# Public licence notices by family.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "This work is dedicated to the public domain.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "reserved": [
        "All rights reserved.",
        "Copyright 2020 the authors. All rights reserved.",
        "No part of this publication may be reproduced without prior written permission of the publisher.",
    ],
}
UNKNOWN = "unknown"
BUCKETS = 1 << 14
VARIANTS = 20        # versions of a notice; one in five is held back
SAMPLE_DOCS = 1_500  # documents (about) whose paragraphs train the unknown class
SAMPLE_LINES = 4_000
LEAST, MATCH = 0.5, 0.6
COMMON = {"by", "under", "4", "0"}  # marks last, as most texts hold them
TEMPERATURES = [0.3 * 1.25 ** k for k in range(16)]


def families() -> list[str]:
    return sorted([*NOTICES, UNKNOWN])


def _cut(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def _marks() -> list[str]:
    """Words without which no text holds ``MATCH`` of any notice's 3-grams:
    long words of each notice, until the 3-grams without them are too few."""
    marks = set()
    for t in (_cut(n) for f in NOTICES for n in NOTICES[f]):
        every = {tuple(t[i:i + 3]) for i in range(len(t) - 2)}
        got = set()
        for w in sorted(set(t), key=lambda w: (w in COMMON, -len(w), w)):
            if sum(not got & set(g) for g in every) < MATCH * len(every):
                break
            got.add(w)
        marks |= got
    return sorted(marks)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(tok: Column, n: int) -> Column:
    """All runs of n words, as strings."""
    out = tok
    for k in range(1, n):
        rest = F.slice(tok, F.lit(k + 1), F.greatest(F.size(tok) - k, F.lit(0)))
        out = F.slice(F.zip_with(out, rest, lambda a, b: F.concat(a, F.lit(" "), b)), F.lit(1), F.greatest(F.size(tok) - k, F.lit(0)))
    return out


def notices(spark: SparkSession) -> DataFrame:
    """(family, notice, tok)"""
    rows = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(n).alias("notice")) for f in sorted(NOTICES) for n in NOTICES[f]])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.family", "r.notice", words(F.col("r.notice")).alias("tok"))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, tok) of every line with a word."""
    lines = docs.select(F.col(f"`{id_col}`").alias("id"), F.posexplode(F.split(F.col(f"`{text_col}`"), "\n")).alias("pos", "line"))
    return lines.select("id", "pos", words(F.col("line")).alias("tok")).where(F.size("tok") > 0)


def wrapped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, want, match, tok) of the notices that blocks of lines hold and
    none of their lines does: the notice's family, its share that was found and
    the words from its first to its last common 3-gram."""
    spark = docs.sparkSession
    longest = max(len(_cut(n)) for f in NOTICES for n in NOTICES[f])
    text = F.col(f"`{text_col}`")
    marks = F.array(*[F.lit(m) for m in _marks()])
    # most texts go here, before any word is cut
    low = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("t"), F.explode(F.array(F.lower(text))).alias("low"))
    low = low.where(F.exists(marks, lambda m: F.contains("low", m)))
    blocks = low.select("id", F.posexplode(F.split("t", r"\n(?:[^\p{L}\p{N}\n]*\n)+")).alias("pos", "block"))
    blocks = blocks.where(F.instr("block", "\n") > 0)
    blocks = blocks.where(F.arrays_overlap(words(F.col("block")), marks))
    cut = F.flatten(F.transform(F.split("block", "\n"), lambda x, i: F.transform(words(x), lambda w: F.struct(w.alias("w"), i.alias("i")))))
    # a generator's output is made once and then read by all expressions below
    rows = blocks.select("id", "pos", F.explode(F.array(cut)).alias("all")).where(F.size("all") > 2)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - longest, F.lit(1)), F.lit(longest))
    rows = rows.select("id", "pos", F.explode(F.transform(starts, lambda k: F.slice("all", k, 2 * longest))).alias("win"))
    rows = rows.select("id", "pos", "win", F.explode(F.array(grams(F.col("win.w"), 3))).alias("g"))
    known = notices(spark).select("family", F.array_distinct(grams(F.col("tok"), 3)).alias("want")).where(F.size("want") > 0)
    ours = sorted({" ".join(t[i:i + 3]) for t in (_cut(n) for f in NOTICES for n in NOTICES[f]) for i in range(len(t) - 2)})
    rows = rows.where(F.exists("g", lambda x: x.isin(ours))).crossJoin(F.broadcast(known))  # the notices above
    rows = rows.where(F.size(F.array_intersect("g", "want")) >= MATCH * F.size("want"))
    at = F.filter(F.transform("g", lambda x, p: F.when(F.array_contains("want", x), p)), lambda p: p.isNotNull())
    rows = rows.select("*", F.explode(F.array(at)).alias("at"))
    line = lambda p: F.get(F.col("win.i"), p)
    inside = F.filter("at", lambda p: line(p) == line(p + 2))
    held = lambda i: F.size(F.array_distinct(F.transform(F.filter(inside, lambda p: line(p) == i), lambda p: F.get("g", p))))
    alone = F.exists(F.array_distinct(F.transform(inside, line)), lambda i: held(i) >= MATCH * F.size("want"))
    first, last = F.array_min("at"), F.array_max("at")
    return rows.where(~alone).select("id", "pos", F.col("family").alias("want"),
                                     (F.size(F.array_intersect("g", "want")) / F.size("want")).alias("match"),
                                     F.slice(F.col("win.w"), first + 1, last - first + 3).alias("tok"))


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(family, tok, fold): fold 0 is held back for calibration."""
    spark = docs.sparkSession
    known = notices(spark)
    gap = lambda t, i: F.pmod(F.xxhash64("notice", "v", i, t), F.lit(100)) >= F.when(F.col("v") < 5, 0).otherwise(F.col("v"))
    varied = known.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1)))).select(
        "family", "v", F.filter("tok", gap).alias("tok"))
    n = docs.count()
    u = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = docs.where(u < min(1.0, SAMPLE_DOCS / max(1, n)))  # a bounded sample for training only
    lines = paragraphs(some, id_col, text_col).select("id", "pos", "tok")
    ours = [r[0] for r in known.select(F.explode(grams(F.col("tok"), 3))).distinct().collect()]  # of the notices above
    lines = lines.where(~F.arrays_overlap(grams(F.col("tok"), 3), F.array(*[F.lit(g) for g in sorted(ours)])))
    lines = lines.withColumn("k", F.xxhash64("id", "pos", "tok")).orderBy("k").limit(SAMPLE_LINES)
    prose = lines.select(F.lit(UNKNOWN).alias("family"), "tok", F.pmod(F.col("k"), F.lit(5)).alias("fold"), "k")
    # notices inside prose: each with a few sampled paragraphs around it
    around = prose.orderBy("k").limit(40).select(F.col("tok").alias("p"), F.pmod(F.col("k"), F.lit(8)).alias("g"), "fold")
    mixed = known.withColumn("g", F.pmod(F.xxhash64("notice"), F.lit(8))).join(around, "g").select(
        "family", F.concat("p", "tok").alias("tok"), "fold")
    alone = varied.select("family", "tok", F.pmod(F.col("v"), F.lit(5)).cast("long").alias("fold"))
    return alone.union(mixed).union(prose.select("family", "tok", "fold")).where(F.size("tok") > 0)


class Scanner:
    """The trained model with its calibrating temperature."""

    def __init__(self, model: LogisticRegressionModel, temperature: float):
        self.model, self.temperature = model, temperature

    @staticmethod
    def _featured(rows: DataFrame) -> DataFrame:
        tf = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="grams", outputCol="features")
        return tf.transform(rows.withColumn("grams", F.concat(F.col("tok"), grams(F.col("tok"), 2)))).drop("grams")

    @staticmethod
    def _chance(raw: Column, k: Column, t: float) -> Column:
        """Calibrated probability of class ``k`` (from 1) given stored scores."""
        e = F.aggregate(raw, F.lit(0.0), lambda a, x: a + F.exp((x - F.element_at(raw, k)) / t))
        return 1.0 / e

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``raw``, the class scores in the order of families(),
        and ``prediction``, the number of the best class from 0."""
        out = self.model.transform(self._featured(rows))
        return out.select(*rows.columns, vector_to_array("rawPrediction").alias("raw"), "prediction")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Scanner:
    rows = training_rows(docs, id_col, text_col)
    label = F.array_position(F.array(*[F.lit(f) for f in families()]), F.col("family")).cast("double") - 1
    rows = rows.withColumn("label", label).repartition(4).persist()  # a few thousand rows
    lr = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=40, standardization=False, probabilityCol="")
    scan = Scanner(lr.fit(Scanner._featured(rows.where("fold <> 0"))), 1.0)
    held = scan.scored(rows.where("fold = 0")).select("label", "raw").persist()
    own = (F.col("label") + 1).cast("int")
    loss = held.agg(*[F.avg(-F.log(F.greatest(Scanner._chance(F.col("raw"), own, t), F.lit(1e-12)))).alias(f"t{k}")
                      for k, t in enumerate(TEMPERATURES)]).first()
    held.unpersist()
    rows.unpersist()
    if loss[0] is not None:
        scan.temperature = TEMPERATURES[min(range(len(loss)), key=lambda k: loss[k])]
    return scan


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, family, prob, match, confirmed) of the paragraphs whose
    predicted family is a licence, and of the blocks of lines that hold a
    wrapped notice; ``pos`` is the number of the line or of the block."""
    unknown = families().index(UNKNOWN)
    found = scanner.scored(paragraphs(docs, id_col, text_col)).where(F.col("prediction") != unknown)
    # scores are written once: later expressions read them instead of scoring again
    found = materialize(found.select("id", "pos", "raw", F.col("prediction").cast("int").alias("k"),
                                     F.array_distinct(grams(F.col("tok"), 3)).alias("have")), "licences")
    names = F.array(*[F.lit(f) for f in families()])
    found = found.select("id", "pos", "have", F.element_at(names, F.col("k") + 1).alias("family"),
                         Scanner._chance(F.col("raw"), F.col("k") + 1, scanner.temperature).alias("prob"))
    found = found.where(F.col("prob") >= LEAST)
    known = notices(docs.sparkSession).select("family", F.array_distinct(grams(F.col("tok"), 3)).alias("want")).where(F.size("want") > 0)
    hit = found.join(F.broadcast(known), "family", "left")  # the notices above
    match = F.coalesce(F.size(F.array_intersect("have", "want")) / F.size("want"), F.lit(0.0))
    hit = hit.groupBy("id", "pos", "family", "prob").agg(F.max(match).alias("match"))
    # notices over several lines; few rows reach the model
    over = scanner.scored(materialize(wrapped(docs, id_col, text_col), "wrapped")).withColumn("k", F.col("prediction").cast("int") + 1)
    over = over.where(F.element_at(names, F.col("k")) == F.col("want")).select(
        "id", "pos", F.col("want").alias("family"), Scanner._chance(F.col("raw"), F.col("k"), scanner.temperature).alias("prob"), "match")
    over = over.where(F.col("prob") >= LEAST).groupBy("id", "pos", "family").agg(F.max("prob").alias("prob"), F.max("match").alias("match"))
    hit = hit.unionByName(over)
    return hit.withColumn("confirmed", F.col("match") >= MATCH)


def by_document(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document id: the confirmed families (sorted, comma-joined),
    how many paragraphs were predicted and confirmed, and the best score."""
    hits = scan(docs, scanner, id_col, text_col)
    per = hits.groupBy("id").agg(
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family"))))).alias("families"),
        F.sum(F.col("confirmed").cast("long")).alias("n_confirmed"), F.count(F.lit(1)).alias("n_predicted"),
        F.max(F.when(F.col("confirmed"), F.col("prob"))).alias("score"))
    ids = docs.select(F.col(f"`{id_col}`").alias("doc_id")).distinct()
    return ids.join(per, F.col("doc_id").eqNullSafe(F.col("id")), "left").select(
        "doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"),
        F.coalesce("n_predicted", F.lit(0)).alias("n_predicted"), F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"))
