"""Licence families of paragraphs by a trained classifier, confirmed against templates.

Texts are cut into lines, and long lines into stretches of PIECE words that overlap. Paragraphs of
several lines, that is lines up to one without words, that hold a licence word (CUES) also give
overlapping stretches of JOINED words across their lines, so that wrapped notices stand whole in
one of them. A piece is the set
of its words and neighbouring word pairs, hashed. A multinomial logistic regression, fitted on the
templates below in many damaged and surrounded forms, on notices of other licences and on a bounded
sample of ordinary pieces of the corpus, gives the chance of each licence family, of a licence
unknown to us, and of none.

Two further regressions on pieces held out from the first turn its odds into chances: that a piece
is a licence of any kind, and that its best family is right. For the first, whole licences are held
out, so it is calibrated on notices of which the classifier has never seen a word. A licence whose
family is not sure, or of whose templates a piece holds too few word pairs, is unknown
if it holds a licence word.

All of this is DataFrame expressions and Spark's own learners; nothing runs in Python workers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loggrove.llm.registry import query, table
from loggrove.scratch import written

# Short public licence notices by family, as they stand in files.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
    ),
    "proprietary": (
        "All rights reserved.",
        "This document is confidential and proprietary and may not be reproduced without written permission.",
    ),
}
# Short public notices of licences outside these families. Together they teach the unknown class.
UNKNOWN = {
    "eclipse": (
        "Licensed under the Eclipse Public License.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at the project's site.",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "artistic": (
        "This package is free software; you may redistribute it under the terms of the Artistic License 2.0.",
        "You are entitled to copy, modify and distribute verbatim copies of the standard version of this package.",
    ),
    "cddl": (
        "The contents of this file are subject to the terms of the Common Development and Distribution License.",
        "You may not use this file except in compliance with the license, a copy of which is included with the software.",
    ),
    "ofl": (
        "This font software is licensed under the SIL Open Font License, Version 1.1.",
        "This license is available with frequently asked questions and the fonts may be bundled, embedded and redistributed.",
    ),
    "isc": (
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appears in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "eupl": (
        "Licensed under the EUPL, Version 1.2 or later.",
        "You may not use this work except in compliance with the European Union Public Licence.",
    ),
    "odbl": (
        "This database is made available under the Open Database License.",
        "Any rights in individual contents of the database are licensed under the Database Contents License.",
    ),
    "wtfpl": (
        "You just do what you want to under the terms of this public license.",
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document.",
    ),
    "commercial": (
        "Use of this software requires a valid commercial license agreement with the vendor.",
        "The software may be used for evaluation only; redistribution is prohibited without a license.",
    ),
}
# Sentences that sound like licences and are none.
OTHERS = (
    "The driver had no valid license when the car was stopped.", "A fishing license costs twelve dollars a year.",
    "The version of the story that the public was told is wrong.", "Permission to land was refused by the tower.",
    "The general public reserved all seats in the software museum.", "The commons were open to the public for free.",
    "This vehicle needs a license plate in all states of the union.", "The poet took a certain license with the dates of the war.",
    "Her terms were clear, and the work was done under them without a word.", "He was granted leave to copy the old letters in the library.",
    "The restaurant lost its liquor license after a fight in the kitchen.", "All the rights and wrongs of the matter were discussed at length.",
    "They distributed free bread to anyone who stood in the line.", "No warranty of good weather was given for the long journey.",
    "The software on the old machine was written by a student.", "Without permission from his father he could not use the boat.",
)

FAMILIES = tuple(TEMPLATES)
OTHER_LICENCE = len(FAMILIES) + 1  # the label of the unknown class
ASIDE = 3  # every so many-th unknown licence is seen by the calibration alone
PIECE, OVERLAP = 80, 20  # words of a piece, and of those that the next one has too
JOINED, STEP = 40, 15  # words of a piece across lines, and from one such piece to the next: templates have 25 at most
PLACES = 1 << 15
ORDINARY = 4_000  # ordinary pieces that the classifier is fitted on at most
SAMPLED_DOCS = 2_000  # documents that these are taken from, about
FORMS = 24  # damaged and surrounded forms of each template
UNKNOWN_FROM = 0.9  # chance of a licence from which a piece counts as an unknown one: ordinary pieces are far more
CONFIRMED = 0.6  # share of a template's word pairs that a piece must hold
# What texts about licences hold.
CUES = ("licens", "licenc", "copyright", "rights reserved", "redistribut", "public domain", "creative commons", "permission", "spdx")


def word_list(text: Column) -> Column:
    """The words of a lower-cased text."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0))


def _speaks_of_licences(text: Column) -> Column:
    """Whether a lower-cased text holds one of CUES."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(cue)) for cue in CUES])


def pieces_of(text: Column) -> Column:
    """Word lists of a text's pieces, those of lines first; lines without words give none."""
    # Comment marks hold no words, so a line of them alone ends a paragraph and others' are not seen.
    lowered = F.lower(F.coalesce(text, F.lit("")))
    paragraphs = F.split(lowered, r"\n(?:[^\p{L}\p{N}\n]*\n)+")
    # All templates hold a licence word, so a paragraph without one has none of them across its lines.
    several = lambda t: _speaks_of_licences(t) & (F.size(F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[\p{L}\p{N}]"))) > 1)
    wrapped = F.transform(F.filter(paragraphs, several), word_list)
    joined = F.flatten(F.transform(wrapped, lambda w: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(w) - (JOINED - STEP) - 1, F.lit(0)), F.lit(STEP)), lambda i: F.slice(w, i + 1, JOINED))))
    lines = F.filter(F.transform(F.split(lowered, "\n"), word_list), lambda w: F.size(w) > 0)
    starts = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - OVERLAP - 1, F.lit(0)), F.lit(PIECE - OVERLAP))
    return F.concat(F.flatten(F.transform(lines, lambda w: F.when(F.size(w) <= PIECE, F.array(w)).otherwise(
        F.transform(starts(w), lambda i: F.slice(w, i + 1, PIECE))))), joined)


def word_pairs(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)),
                                                lambda a, b: F.concat_ws(" ", a, b))).otherwise(words)


def _hashed(frame: DataFrame) -> DataFrame:
    """``frame`` (with ``words``) and its ``features``."""
    return HashingTF(inputCol="terms", outputCol="features", numFeatures=PLACES, binary=True).transform(
        frame.withColumn("terms", F.concat("words", word_pairs(F.col("words"))))).drop("terms")


def _fixed(spark: SparkSession) -> DataFrame:
    """All fixed sentences: ``label`` (0 for no licence), ``number``, ``aside`` (for the calibration alone) and ``words``."""
    texts = [(i, False, t) for i, family in enumerate(FAMILIES, 1) for t in TEMPLATES[family]]
    texts += [(OTHER_LICENCE, i % ASIDE == ASIDE - 1, t) for i, notices in enumerate(UNKNOWN.values()) for t in notices]
    texts += [(0, False, t) for t in OTHERS]
    rows = F.array(*[F.struct(F.lit(float(i)).alias("label"), F.lit(n).alias("number"), F.lit(aside).alias("aside"), F.lit(t).alias("text"))
                     for n, (i, aside, t) in enumerate(texts)])
    return spark.range(1).select(F.inline(rows)).select("label", "number", "aside", word_list(F.lower("text")).alias("words"))


def _ordinary(docs: DataFrame) -> DataFrame:
    """At most ORDINARY numbered pieces without licence words, from documents chosen by hash."""
    total = docs.count()
    part = min(1.0, SAMPLED_DOCS / max(total, 1))
    chosen = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
    pieces = chosen.select(F.explode(pieces_of(F.col("text"))).alias("words")).where(~_speaks_of_licences(F.concat_ws(" ", "words")))
    taken = pieces.distinct().orderBy(F.xxhash64("words"), "words").limit(ORDINARY)
    return taken.select("words", (F.row_number().over(Window.orderBy(F.xxhash64("words"), "words")) - 1).alias("number"))


def training(docs: DataFrame) -> DataFrame:
    """``label`` (0 none, else the family's number), ``words`` and ``fold`` (0 for the calibration) of what is learned from."""
    ordinary = written(_ordinary(docs), "ordinary-pieces")
    own_fold = F.pmod(F.xxhash64("words"), F.lit(4))
    # Only pieces that are learned as ordinary too stand around licences; else their words would tell of licences.
    beside = written(ordinary.where(own_fold > 0).select(
        (F.row_number().over(Window.orderBy("number")) - 1).alias("beside"), F.slice("words", 1, 30).alias("around")), "beside-pieces")  # ORDINARY rows at most
    n = max(beside.count(), 1)
    forms = _fixed(docs.sparkSession).withColumn("form", F.explode(F.sequence(F.lit(0), F.lit(FORMS - 1))))
    # Every form but the first loses some words; every third has ordinary words around it. Of the licences that are
    # for the calibration alone these are left out: a line of its own is what tells that a licence is there.
    kept = F.filter("words", lambda w, i: (F.col("form") == 0) | (F.pmod(F.xxhash64(w, i, F.col("form"), F.col("number")), F.lit(100)) >= F.pmod(F.col("form"), F.lit(4)) * 6))
    fold = F.when(F.col("label") == OTHER_LICENCE, F.when(~F.col("aside"), 1).when(F.col("form") % 3 != 2, 0)).otherwise(F.pmod(F.xxhash64("number", "form"), F.lit(4)))
    forms = forms.select("label", "number", "form", kept.alias("words"), fold.alias("fold"), F.pmod(F.xxhash64("number", "form"), F.lit(n)).cast("int").alias("beside"))
    wrapped = F.when((F.col("form") % 3 == 2) & F.col("around").isNotNull(), F.concat(F.slice("around", 1, 15), "words", F.slice("around", 16, 15))).otherwise(F.col("words"))
    fixed = forms.join(F.broadcast(beside), "beside", "left").select("label", wrapped.alias("words"), "fold")
    plain = ordinary.select(F.lit(0.0).alias("label"), "words", own_fold.alias("fold"))
    return fixed.union(plain).where("size(words) > 0 AND fold IS NOT NULL")


def _judged(model: LogisticRegressionModel, hashed: DataFrame) -> DataFrame:
    """``hashed`` with the best family's number ``best``, its ``lead`` over none and unknown, and the ``odds`` of any licence; both as logarithms."""
    chances = model.transform(hashed).withColumn("_p", vector_to_array("probability")).drop("rawPrediction", "probability", "prediction", "features")
    families = F.slice("_p", 2, len(FAMILIES))
    top, none = F.array_max(families), F.get("_p", F.lit(0))
    log = lambda x: F.log(F.greatest(x, F.lit(1e-12)))
    return chances.withColumn("best", F.array_position(families, top).cast("int")).withColumn(
        "lead", log(top) - log(none + F.get("_p", F.lit(OTHER_LICENCE)))).withColumn("odds", log(1 - none) - log(none)).drop("_p")


def _longest(pair: str) -> str:
    return max(pair.split(" "), key=lambda word: (len(word), word))


def _telling_pairs(spark: SparkSession) -> list[str]:
    """Word pairs of which every piece that confirms a template holds one.

    Such a piece has CONFIRMED of the template's n word pairs, so it lacks fewer than any
    n - ceil(CONFIRMED * n) + 1 of them; taken are those with the longest words, which are rare.
    """
    templates = _fixed(spark).where((F.col("label") > 0) & (F.col("label") < OTHER_LICENCE)).select(F.array_distinct(word_pairs(F.col("words"))))
    found = set()
    for (pairs,) in templates.collect():  # the fixed sentences
        rarest = sorted(pairs, key=lambda pair: (-len(_longest(pair)), pair))
        needed = next(k for k in range(len(pairs) + 1) if k / len(pairs) >= CONFIRMED)
        found |= set(rarest[:len(pairs) - needed + 1])
    return sorted(found)


def _line(rows: DataFrame, feature: str, right: Column) -> tuple[float, float]:
    """Slope and offset that turn a feature into the chance that ``right`` holds."""
    marked = rows.select(feature, right.cast("double").alias("right"))
    if marked.select("right").distinct().count() < 2:
        return 1.0, 0.0
    line = LogisticRegression(featuresCol="x", labelCol="right", regParam=1e-3).fit(VectorAssembler(inputCols=[feature], outputCol="x").transform(marked))
    return float(line.coefficients[0]), float(line.intercept)


def _learned(rows: DataFrame) -> tuple[LogisticRegressionModel, tuple[float, float], tuple[float, float]]:
    """The classifier, and the calibrations of any licence and of the best family."""
    hashed = written(_hashed(rows), "licence-training")
    model = LogisticRegression(family="multinomial", maxIter=60, regParam=2e-4, elasticNetParam=0.0).fit(hashed.where("fold > 0").select("label", "features"))
    asked = written(_judged(model, hashed.where("fold = 0")).select("label", "best", "lead", "odds"), "licence-calibration")
    return model, _line(asked, "odds", F.col("label") > 0), _line(asked, "lead", F.col("best") == F.col("label"))


def judged_pieces(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Pieces that look like licences, and a row without piece for every document: the ``keep``
    columns, ``family`` (a name, 'unknown' or null), ``chance`` (of the family, or of any licence where that is unknown) and ``words``.

    Only pieces that hold a word of CUES or one of a template's ``_telling_pairs`` are judged: no other piece
    can be confirmed, and none without a word of CUES is unknown.

    Rows are not told apart but by ``keep``. Null, empty and wordless texts give the row without piece alone, and an
    empty table nothing. Texts of any length are cut in time in proportion to it, whether they have lines or not.
    """
    model, any_line, family_line = _learned(training(docs))
    pieces = docs.select(*keep, F.explode(F.concat(F.array(F.array().cast("array<string>")), pieces_of(F.col("text")))).alias("words"))
    # Most pieces end here, ahead of the hashing.
    telling = _telling_pairs(docs.sparkSession)
    possible = _speaks_of_licences(F.concat_ws(" ", "words")) | (
        F.arrays_overlap("words", F.lit(sorted({_longest(pair) for pair in telling}))) & F.arrays_overlap(word_pairs(F.col("words")), F.lit(telling)))
    pieces = pieces.where((F.size("words") == 0) | possible)
    chance = lambda feature, line: 1 / (1 + F.exp(-(line[0] * F.col(feature) + line[1])))
    seen = _judged(model, _hashed(pieces)).withColumn("licence", chance("odds", any_line)).withColumn("chance", chance("lead", family_line))
    likely = (F.size("words") > 0) & ((F.col("chance") >= 0.5) | (F.col("licence") >= UNKNOWN_FROM))
    found = seen.where((F.size("words") == 0) | likely).withColumn("_pairs", F.array_distinct(word_pairs(F.col("words"))))
    # As many rows as there are families.
    known = _fixed(docs.sparkSession).where((F.col("label") > 0) & (F.col("label") < OTHER_LICENCE)).select(
        F.col("label").cast("int").alias("_label"), F.array_distinct(word_pairs(F.col("words"))).alias("_template"))
    known = known.groupBy("_label").agg(F.collect_list("_template").alias("_templates"))
    compared = found.join(F.broadcast(known), F.col("best") == F.col("_label"), "left")
    shares = F.transform("_templates", lambda t: F.size(F.array_intersect("_pairs", t)) / F.size(t))
    sure = (F.col("chance") >= 0.5) & (F.array_max(shares) >= CONFIRMED)
    named = F.get(F.array(*[F.lit(f) for f in FAMILIES]), F.col("best") - 1)
    speaks = _speaks_of_licences(F.concat_ws(" ", "words"))  # pieces that don't are what ordinary ones are learned from
    family = F.when(F.size("words") == 0, F.lit(None)).when(sure, named).when(speaks & (F.col("licence") >= UNKNOWN_FROM), "unknown")
    return compared.select(*keep, family.alias("family"), F.when(sure, F.col("chance")).when(F.size("words") > 0, F.col("licence")).alias("chance"), "words").where(
        "family IS NOT NULL OR size(words) = 0")


def licence_scan(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id``, ``families`` (confirmed ones by name, comma-joined), ``n_confirmed`` and
    ``n_unknown`` (pieces, which overlap) and ``chance`` (the highest calibrated chance of a confirmed piece, or null).

    * Null, empty and wordless texts have no pieces and no licence. Whole texts are read, in pieces.
    * Repeated rows are judged each for itself; null ids stay null. An empty table gives none.
    * A corpus without ordinary pieces to learn from is judged by the templates alone.
    * Other columns are not read, whatever their names.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    pieces = judged_pieces(rows, ("_row", "doc_id"))
    known = F.col("family").isNotNull() & (F.col("family") != "unknown")
    return pieces.groupBy("_row", "doc_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(known, F.col("family")))), ",").alias("families"),
        F.count(F.when(known, F.lit(1))).alias("n_confirmed"), F.count(F.when(F.col("family") == "unknown", F.lit(1))).alias("n_unknown"),
        F.max(F.when(known, F.col("chance"))).alias("chance")).drop("_row")


@query()
def op6_licence_scan(spark, folder):
    return licence_scan(table(spark, folder, "documents"))
