r"""License scans by a trained paragraph classifier [native].

A paragraph (a line) falls into statements at the ends of its sentences, a long statement into windows of `WINDOW` words that overlap by
half; so a notice counts wherever it stands. A statement becomes sparse counts of its word 1- and 2-grams; a multinomial logistic
regression (Spark's own, in the JVM) gives probabilities of licence families and of an unknown class. It is trained on the statements
of the templates below, on parts of them, alone and among background words, and on background statements of the corpus itself: all
different statements that the model can be asked about (below) and that have no telling gram. The unknown class is calibrated on all of
these, each by a model that has learnt from the other half: a family must be likelier than the 99 % quantile of what they reach (0.5
at least, 0.9 at most). A
prediction counts only if the family's templates confirm it: at least half of the statement's word 3-grams must be telling 3-grams
of the family, or half of the telling 3-grams of one template must be in the statement. A 3-gram (a whole statement of one or two
words) is telling if it has a word of four letters or one of NAMES.

Texts are read once; what can be asked about is written, trained on and scored, without Python. A text, line or statement without any word of
`cover()` has no telling gram, so nothing could confirm it; it is left out before its words are counted, which changes no result.

Defined cases: null and empty texts have no paragraphs and give no rows; repeated rows give repeated rows; a null doc_id stays
null; other columns are not read; ties go to the family first in order; texts of any length are read to their end.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

# Usual statements of each family.
TEMPLATES = {
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "BSD License",
    ),
    "CC-BY": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", "This text is available under the Creative Commons Attribution-ShareAlike License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "Licensed under the GPL, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU General Public License",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "SPDX-License-Identifier: ISC", "ISC License"),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "SPDX-License-Identifier: MIT",
        "MIT License",
    ),
    "MPL": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License"),
    "public-domain": ("This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain.", "This work is in the public domain.", "SPDX-License-Identifier: Unlicense"),
}
# Statements near licences that name none.
NEAR_MISSES = (
    "The office will issue a new driving license to every person who asks for it in writing.",
    "Copyright by the author and the publisher of this book.",
    "Please ask for permission before you use the material in public.",
    "The terms of the contract are binding on both parties.",
    "This software is sold under a separate agreement with the vendor.",
    "The warranty covers parts and work for two years from the date of purchase.",
    "A fishing licence costs twenty pounds and runs for one season.",
    "Free software was given to all schools of the county.",
)
# Short words that name a licence.
NAMES = ("bsd", "cc", "gnu", "gpl", "isc", "mit", "mpl", "nc", "sa")
FAMILIES = tuple(sorted(TEMPLATES))
FEATURES, CONFIRM, WINDOW = 1 << 14, 0.5, 24
SENTENCE = r"(?<=[.!?;:])[\x20\x09-\x0D]+"
_WORD = r"[^\W_]+"


def grams(words: str, n: int) -> str:
    """SQL: the word n-grams of an array column."""
    return f"CASE WHEN size({words}) >= {n} THEN transform(sequence(0, size({words}) - {n}), i -> array_join(slice({words}, i + 1, {n}), ' ')) ELSE array() END"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def threes(words_: str) -> str:
    """SQL: the 3-grams of an array column; one or two words are one gram."""
    return f"CASE WHEN size({words_}) BETWEEN 1 AND 2 THEN array(array_join({words_}, ' ')) ELSE {grams(words_, 3)} END"


def telling(text: str) -> list[str]:
    """The telling 3-grams of a statement."""
    w = re.findall(_WORD, text.lower())
    found = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    return sorted({g for g in found if any(len(x) > 3 or x in NAMES for x in g.split())})


def parts_of(text: str) -> list[str]:
    """A template, and its sentences and halves where it has some."""
    sentences, w = re.split(SENTENCE, text), text.split()
    halves = [" ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :])] if len(w) > 14 else []
    return [text, *(sentences if len(sentences) > 1 else []), *halves]


def cover() -> tuple[tuple[str, ...], str]:
    """(words, pattern of short names): every telling gram of the templates has one of them."""
    open_, chosen = {g for texts in TEMPLATES.values() for t in texts for g in telling(t)}, []
    short = {g for g in open_ if not any(len(x) > 3 for x in g.split())}
    open_ -= short
    while open_:
        gain = Counter(x for g in open_ for x in set(g.split()) if len(x) > 3)
        chosen.append(max(gain, key=lambda x: (gain[x] * len(x), x)))
        open_ = {g for g in open_ if chosen[-1] not in g.split()}
    return tuple(chosen), f"(?:{'|'.join(sorted({x for g in short for x in g.split() if x in NAMES}))})(?![\\p{{L}}\\p{{N}}])"


def may_hold(text: Column) -> Column:
    """Whether a text has a word of cover(); null and false alike exclude a telling gram."""
    long, short = cover()
    return F.exists(F.array(F.lower(text)), lambda low: functools.reduce(lambda a, b: a | b, [low.contains(x) for x in long]) | low.rlike(short))


def _featured(rows: DataFrame) -> DataFrame:
    """(…, __w) with __features."""
    return HashingTF(inputCol="__g", outputCol="__features", numFeatures=FEATURES).transform(rows.withColumn("__g", F.concat("__w", F.expr(grams("__w", 2)))))


def _literal(spark: SparkSession, rows: list[tuple[str, float]]) -> DataFrame:
    """(id, __w, label)."""
    each = F.array(*[F.struct(F.lit(t).alias("statement"), F.lit(k).alias("label")) for t, k in rows])
    return spark.range(1).select(F.posexplode(each).alias("id", "row")).select("id", words(F.col("row.statement")).alias("__w"), "row.label")


def statements(docs: DataFrame, tested: bool = True) -> DataFrame:
    """docs(doc_id, text) to (doc_id, paragraph_no, statement_no, window_no, __w); tested: without those that have no telling gram."""

    def kept(rows: DataFrame, column: str) -> DataFrame:
        return rows.where(may_hold(F.col(column))) if tested else rows

    texts = kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "text")
    lines = kept(texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph_no", "line")), "line")
    said = kept(lines.select("doc_id", "paragraph_no", F.posexplode(F.split("line", SENTENCE)).alias("statement_no", "statement")), "statement")
    worded = said.select("doc_id", "paragraph_no", "statement_no", words(F.col("statement")).alias("__all")).where("size(__all) > 0")
    step = WINDOW // 2
    cuts = F.expr(f"transform(sequence(0, greatest(0, (size(__all) - 1) div {step} - 1)), i -> slice(__all, CAST(i * {step} + 1 AS INT), {WINDOW}))")
    return worded.select("doc_id", "paragraph_no", "statement_no", F.posexplode(cuts).alias("window_no", "__w"))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def background_of(said: DataFrame) -> DataFrame:
    """(h, __w): all different statements of statements() that have no telling gram."""
    every = _strings(sorted({g for texts in TEMPLATES.values() for t in texts for g in telling(t)}))
    plain = said.where(~F.arrays_overlap(F.expr(threes("__w")), every)).select("__w", F.xxhash64("__w").alias("h"))
    return cut(plain.distinct())


def _fitted(spark: SparkSession, background: DataFrame):
    """The model that the templates, the near misses and background(h, __w) give."""
    known = [(t, float(i)) for i, f in enumerate(FAMILIES) for whole in TEMPLATES[f] for t in parts_of(whole)]
    unknown = float(len(FAMILIES))
    given = known + [(t, unknown) for t in NEAR_MISSES]
    ours, pads = _literal(spark, given * 4), background.groupBy(F.pmod("h", F.lit(4 * len(given))).cast("int").alias("id")).agg(F.min("__w").alias("pad"))
    # of each statement two copies as it is, two with background words around it
    k = F.greatest(F.floor(F.col("id") / len(given)).cast("int") - 1, F.lit(0)) * 10
    around = F.concat(F.slice("pad", F.lit(1), k), F.col("__w"), F.slice("pad", k + 1, k))
    ours = ours.join(F.broadcast(pads), "id", "left").select(F.coalesce(around, F.col("__w")).alias("__w"), "label")  # at most 4 rows a statement above
    rows = ours.coalesce(1).unionByName(background.select("__w", F.lit(unknown).alias("label")))
    return LogisticRegression(featuresCol="__features", labelCol="label", maxIter=40, regParam=1e-4, family="multinomial").fit(_featured(cut(rows)))


def train(spark: SparkSession, background: DataFrame):
    """(model, threshold). The model learns from all of background(h, __w); the threshold is the 99 % quantile of what all of it reaches in
    models that have learnt from the other half."""
    best = F.array_max(F.slice(vector_to_array("probability"), 1, len(FAMILIES)))
    halves = [background.where(F.pmod("h", F.lit(2)) == i) for i in (0, 1)]
    reached = [_fitted(spark, halves[1 - i]).transform(_featured(halves[i])).select(F.round(best, 4).alias("p")) for i in (0, 1)]
    quantile = reached[0].unionByName(reached[1]).groupBy("p").agg(F.count(F.lit(1)).alias("n")).agg(F.percentile("p", F.lit(0.99), F.col("n"))).first()[0]
    return _fitted(spark, background), min(0.9, max(0.5, quantile or 0.0))


def scan(docs: DataFrame, tested: bool = True) -> DataFrame:
    """docs(doc_id, text) to licence statements: doc_id, paragraph_no, statement_no, window_no, family, probability, similarity."""
    said = cut(statements(docs))  # few of a corpus; training and scoring both read them
    model, threshold = train(docs.sparkSession, background_of(said))
    place = ["doc_id", "paragraph_no", "statement_no", "window_no"]
    scored = model.transform(_featured(said if tested else statements(docs, tested=False))).select(*place, "__w", vector_to_array("probability").alias("__p"))
    known = F.slice("__p", 1, len(FAMILIES))
    scored = scored.withColumn("probability", F.array_max(known)).withColumn("__at", F.array_position(known, F.array_max(known)).cast("int"))
    likely = scored.where((F.col("probability") >= threshold) & (F.col("probability") > F.element_at("__p", len(FAMILIES) + 1)))
    templates = F.element_at(F.array(*[F.array(*[_strings(telling(t)) for t in TEMPLATES[f]]) for f in FAMILIES]), F.col("__at"))
    mine = likely.withColumn("family", F.element_at(_strings(FAMILIES), F.col("__at"))).withColumn("__mine", F.array_distinct(F.expr(threes("__w")))).withColumn("__theirs", templates)
    by_statement = F.size(F.array_intersect("__mine", F.flatten("__theirs"))) / F.greatest(F.size("__mine"), F.lit(1))
    by_template = F.array_max(F.transform("__theirs", lambda t: F.size(F.array_intersect("__mine", t)) / F.size(t)))
    named = mine.withColumn("similarity", F.greatest(by_statement, by_template))
    return named.where(F.col("similarity") >= CONFIRM).select("doc_id", *[F.col(c).cast("long").alias(c) for c in place[1:]], "family", "probability", "similarity")


def op5_licence_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
