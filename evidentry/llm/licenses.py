"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are runs of lines that were wrapped: a line goes on in the next one if it is long
enough to have been wrapped, does not end a sentence and is no SPDX tag; every other line is a
paragraph of its own. Features are word n-grams that hold at least one licence term; a sparse (L1) softmax regression maps them to licence families, to `unknown` (a
licence, but none of the families) or to `none`. It is trained on the notices below and on
variations of them made by rule; the probability from which a family is believed is
calibrated on variations that were kept out. A believed family must then share enough word
pairs with one of its notices, or the paragraph is `unknown` as well.

Training and scoring run in Spark's JVM; paragraphs without a licence term have no feature and
are never classified, which loses nothing, as their score is that of an empty vector: none.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN, NONE = "unknown", "none"
GRAMS = (1, 2, 3)
SPARSITY = 0.0002
SIMILARITY = 0.6         # share of the paragraph's or the notice's word pairs that must agree
VARIATIONS = 12          # of every notice

# Common short notices of licence families.
NOTICES: dict[str, tuple[str, ...]] = {
    "mit": ("Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT",
            "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
            "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License.", "Released under the Apache 2.0 license."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later",
            "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-2.0-or-later",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
            "Licensed under the GPL version 2.", "Released under the GNU GPL v3 license."),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only",
             "SPDX-License-Identifier: LGPL-3.0-or-later",
             "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License."),
    "agpl": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only",
             "Released under the terms of the GNU Affero General Public License."),
    "bsd": ("Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD license.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0",
            "Licensed under the Mozilla Public License, version 2.0."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "isc": ("Licensed under the ISC License.", "The ISC License applies to this text.", "SPDX-License-Identifier: ISC",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "bsl-1.0": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0",
                "Released under the Boost Software License 1.0."),
    "cc0": ("Released under the CC0 1.0 Universal Public Domain Dedication license.", "SPDX-License-Identifier: CC0-1.0"),
    "proprietary": ("All rights reserved.", "Copyright the authors. All rights reserved.",
                    "This document is proprietary and confidential; all rights reserved, no part may be copied without a license."),
}
# Licences of no family, and sentences that use licence terms but license nothing.
OTHERS = ("Licensed under the {} License.", "Released under the {} Public License, version {}.", "SPDX-License-Identifier: {}",
          "Distributed under the terms of the {} license agreement.", "This work is licensed under the {} licence.",
          "Use of this text is subject to the {} Open License.", "Distributed under the {} License, Version {}.",
          "The {} License applies to this text.", "Covered by the {} Software License.", "Available under the {} License {}.0.",
          "Licensed under the terms of the {} license.", "See the {} license for terms.")
OTHER_NAMES = ("Foobar", "Example", "Artistic", "Zlib", "Community", "Eclipse", "Beerware", "Academic", "Vendor", "Sample",
               "Wombat", "Northwind", "Garden", "Harbour", "Python", "Perl", "Openfont", "Unicode", "Lakeside", "Copper",
               "Meadow", "Falcon", "Granite", "Orchard", "Postgres", "Ruby", "Delta", "Summit", "Willow", "Ember")
NOT_LICENCES = ("She renewed her driver license at the office.", "The copyright debate went on for years.",
                "They license new doctors every spring.", "Seats are reserved for guests.", "A fishing licence costs ten euros.",
                "The apache helicopter landed.", "The warranty of the car ran out.", "Tables can be reserved by phone.",
                "The pub lost its license last year.", "Her driver license expired in May.",
                "He got his hunting license.", "You need a license to drive a truck.", "She got a new driver license.",
                "He wrote about copyright and the press.", "The license plates are made of metal.", "A new plate with the old license number.",
                "She renewed a hunting licence in autumn.", "The licensed plumber came late.", "The bar has no licence to sell wine.",
                "The warranty covers two years.", "He asked for permission to leave.", "The creative team met at noon.",
                "House of Commons members voted on it.", "A gnu crossed the river.")
TERMS = ("licen[sc]e[ds]?", "sublicense", "licensing", "copyright", "copyleft", "apache(?:-[0-9.]+)?", "gnu", "a?gpl(?:-[a-z0-9.-]+)?",
         "lgpl(?:-[a-z0-9.-]+)?", "bsd(?:-[a-z0-9-]+)?", "isc", "bsl(?:-[0-9.]+)?", "mozilla", "mpl(?:-[0-9.]+)?", "creative", "commons", "cc", "cc0(?:-[0-9.]+)?",
         "cc-by(?:-[a-z0-9.-]+)?", "spdx(?:-[a-z-]+)?", "reserved", "redistributions?", "redistribute", "proprietary", "warranty",
         "permission", "dedication")
TERM = "(?:" + "|".join(TERMS) + ")"
WORDS = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
WRAP_COLUMNS = 40        # shorter lines were not wrapped
MARGIN = r"[ \t#/*;>-]*"  # blanks and comment signs before a line's text
JOINT, NUMBER_END = "\x01", "\x02"
#: A numbered line that goes on in the next one, and the end of that line.
WRAPPED = (rf"(?md)^([0-9]+{NUMBER_END}(?!.*SPDX).{{{WRAP_COLUMNS - 1},}}[^\s.!?:])[ \t\r]*\n"
           rf"(?=[0-9]+{NUMBER_END}{MARGIN}[^\s#/*;>-])")


class Scanner(NamedTuple):
    vectorizer: CountVectorizerModel
    model: LogisticRegressionModel
    families: list[str]
    threshold: float


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORDS})"), F.lit(1))


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, in order: array of {paragraph: number of its first line from 1, line: its lines}."""
    plain = F.translate(text, JOINT + NUMBER_END, "  ")
    numbered = F.array_join(F.transform(F.split(plain, "\n"), lambda line, i: F.concat((i + 1).cast("string"), F.lit(NUMBER_END), line)), "\n")
    joined = F.split(F.regexp_replace(numbered, WRAPPED, "$1" + JOINT), "\n")
    return F.transform(joined, lambda p: F.struct(
        F.substring_index(p, NUMBER_END, 1).cast("long").alias("paragraph"),
        F.regexp_replace(F.regexp_replace(p, f"^[0-9]+{NUMBER_END}", ""), f"{JOINT}[0-9]+{NUMBER_END}", "\n").alias("line")))


def _grams(tokens: Column, n: int) -> Column:
    if n == 1:
        return tokens
    return F.when(F.size(tokens) >= n, F.transform(
        F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda k: F.array_join(F.slice(tokens, k, n), " "))).otherwise(F.array().cast("array<string>"))


def _features(tokens: Column) -> Column:
    every = F.concat(*[_grams(tokens, n) for n in GRAMS])
    return F.array_distinct(F.filter(every, lambda g: g.rlike(f"(?:^| ){TERM}(?: |$)")))


def examples() -> list[tuple[str, str, int]]:
    """(text, family, fold) made by rule from the notices; fold 1 is kept out for calibration."""
    out: list[tuple[str, str, int]] = []

    def vary(text: str, family: str) -> None:
        tokens = text.split()
        for k in range(VARIATIONS):
            seed = zlib.crc32(f"{text} {k}".encode())
            kept = [w for i, w in enumerate(tokens) if k == 0 or zlib.crc32(f"{seed} {i}".encode()) % 10 or len(tokens) < 5]
            before, after = (("", ""), ("Note: ", ""), ("", " See the file for details."), ("(c) 2024. ", ""))[k % 4]
            out.append((before + " ".join(kept) + after, family, int(k % 4 == 3)))

    for family, notices in NOTICES.items():
        for notice in notices:
            vary(notice, family)
    # names are kept out whole, so the bound is set by licences that were never seen
    for i, name in enumerate(OTHER_NAMES):
        for form in OTHERS:
            out.append((form.format(name, i % 3 + 1), UNKNOWN, int(i % 4 == 3)))
    for text in NOT_LICENCES:
        vary(text, NONE)
    out += [("", NONE, 0)] * 40
    return out


def train(spark: SparkSession) -> Scanner:
    """Fit the classifier and calibrate the probability from which a family is believed."""
    families = [*NOTICES, UNKNOWN, NONE]
    rows = spark.createDataFrame([(t, float(families.index(f)), fold) for t, f, fold in examples()], "text string, label double, fold int")
    rows = rows.select("label", "fold", _features(words(F.col("text"))).alias("grams"))
    # the vocabulary is that of the made examples, so its size does not depend on the corpus
    found = rows.where("fold = 0").select("label", F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n")).where(
        "n >= 2").orderBy("g").collect()
    vectorizer = CountVectorizerModel.from_vocabulary([r["g"] for r in found], inputCol="grams", outputCol="features").setBinary(True)
    data = vectorizer.transform(rows).cache()
    model = LogisticRegression(family="multinomial", regParam=SPARSITY, elasticNetParam=1.0, maxIter=60, standardization=False).fit(
        data.where("fold = 0"))
    scored = model.transform(data.where("fold = 1")).select(
        "label", F.array_max(F.slice(vector_to_array("probability"), 1, len(NOTICES))).alias("p"))
    # above the best-scored kept-out text that is of no family, within bounds
    worst = scored.where(F.col("label") >= len(NOTICES)).agg(F.max("p")).first()[0] or 0.0
    data.unpersist()
    return Scanner(vectorizer, model, families, min(0.9, max(0.5, worst)))


def _pairs(tokens: Column) -> Column:
    return F.array_distinct(F.when(F.size(tokens) > 1, _grams(tokens, 2)).otherwise(tokens))


def _similarity(family: Column, tokens: Column) -> Column:
    """Largest share of word pairs that the paragraph has in common with a notice of the family.

    The share is of the smaller of the two, so a notice within a longer paragraph and a part of
    a long notice both count; a part needs four pairs or more.
    """
    out = F.lit(0.0)
    for name, notices in NOTICES.items():
        best = F.lit(0.0)
        for notice in notices:
            w = re.findall(WORDS, notice.lower())
            wanted = list(dict.fromkeys(" ".join(w[i:i + 2]) for i in range(len(w) - 1)))
            shared = F.size(F.array_intersect(_pairs(tokens), F.array(*[F.lit(x) for x in wanted])))
            of = F.least(F.lit(len(wanted)), F.greatest(F.size(_pairs(tokens)), F.lit(min(4, len(wanted)))))
            best = F.greatest(best, shared / of)
        out = F.when(family == name, best).otherwise(out)
    return out


def scan(documents: DataFrame, scanner: Scanner, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per licence paragraph: id, paragraph (number of its first line from 1), family, probability, similarity, line.

    line has all lines of the paragraph; a paragraph that names several licences has the likeliest one.

    family is one of the notices' families or `unknown`; a family has a probability of the
    scanner's threshold or more and a similarity of `SIMILARITY` or more, everything else
    that is no `none` is `unknown`. Null and empty texts give no rows, repeated documents
    repeat theirs, and very long texts are read whole.
    """
    gate = f"(?i)(?<![a-z0-9.+-]){TERM}(?![a-z0-9])"
    rows = documents.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).where(F.col("text").rlike(gate))
    lines = rows.select("id", F.explode(F.filter(paragraphs(F.col("text")), lambda x: x["line"].rlike(gate))).alias("x")).select(
        "id", "x.paragraph", "x.line")
    lines = lines.withColumn("tokens", words(F.regexp_replace("line", f"-\n{MARGIN}", "-"))).withColumn("grams", _features(F.col("tokens"))).where(F.size("grams") > 0)
    scored = scanner.model.transform(scanner.vectorizer.transform(lines)).withColumn("p", vector_to_array("probability"))
    known = len(scanner.families) - 2
    best = F.array_max(F.slice("p", 1, known))
    family = F.element_at(F.array(*[F.lit(f) for f in scanner.families]), F.array_position(F.slice("p", 1, known), best).cast("int"))
    scored = scored.select("id", "paragraph", "line", "tokens", family.alias("guess"), best.alias("probability"),
                           (F.element_at("p", known + 2) < 0.5).alias("licence"))
    judged = scored.where("licence").withColumn("similarity", _similarity(F.col("guess"), F.col("tokens")))
    sure = (F.col("probability") >= scanner.threshold) & (F.col("similarity") >= SIMILARITY)
    return judged.select(F.col("id").alias(id), "paragraph", F.when(sure, F.col("guess")).otherwise(F.lit(UNKNOWN)).alias("family"),
                         "probability", "similarity", "line")
