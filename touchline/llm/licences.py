"""Licence scans: a trained paragraph classifier whose predictions a comparison with templates confirms.

Every paragraph of every text is classified. Everything runs as DataFrame operations and MLlib
estimators in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

UNKNOWN = "unknown"

# Fixed values. Notices by which public licences are commonly stated.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GPL version 2.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "public-domain": (
        "Released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright 2020. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ),
}

# Fixed values. Sentences with the same words that state no licence.
OTHER_SENTENCES = (
    "He lost his driving licence after the accident last week.",
    "The teacher gave permission to leave the room early.",
    "The warranty on this washing machine ends next year.",
    "She asked whether the rights of the workers were reserved for later talks.",
    "The apache helicopter landed near the base.",
    "Students at MIT published the results in May.",
    "The library is open to the public and free of charge.",
    "The dog licence must be renewed every year at the office.",
    "A copy of the letter was sent to the general manager.",
    "The copyright debate went on in parliament for years.",
    "Please distribute the leaflets to any person who asks.",
    "The public domain of the village includes the meadow.",
    "Their license plate was found by the road.",
)

# Fixed values. Names by which notices refer to licences, and sentences that do so.
NAMES: dict[str, tuple[str, ...]] = {
    "mit": ("MIT License", "MIT licence terms"),
    "apache-2.0": ("Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0"),
    "gpl": ("GPLv3", "GPLv2 or later", "GPL-3.0", "GPL 2.0 or later", "GNU General Public License v3", "GNU GPL"),
    "lgpl": ("LGPLv2.1", "LGPLv2.1 or later", "LGPL-3.0", "GNU Lesser General Public License v3", "GNU LGPL"),
    "agpl": ("AGPLv3", "AGPL-3.0", "AGPLv3 or later", "GNU Affero General Public License v3", "GNU AGPL"),
    "bsd": ("BSD-3-Clause", "BSD-2-Clause", "BSD License", "New BSD License", "BSD 2-Clause License"),
    "mpl": ("MPL-2.0", "MPL 2.0", "Mozilla Public License 2.0", "MPL version 2.0"),
    "isc": ("ISC License", "ISC licence terms"),
    "cc-by": ("CC-BY-4.0", "CC BY 3.0", "Creative Commons Attribution 4.0"),
    "cc-by-sa": ("CC-BY-SA-4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0"),
    "cc-by-nc": ("CC-BY-NC-4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0"),
    "public-domain": ("CC0 1.0", "CC0-1.0", "the Unlicense"),
}
SENTENCES = ("{}", "Code: {}.", "License: {}.", "Released under the {}.", "Distributed under {}.", "Available under the terms of the {}.", "This file is licensed under {}.", "Use is subject to {}.")

#: What stands between words: a v before a number too, so that GPLv3, GPL v3 and GPL-3 are alike.
WORDS = r"[^\p{L}\p{N}.+]+(?:v(?=[0-9]))?|(?<=[a-z]{2})v?(?=[0-9])"
FEATURES = 1 << 13
#: Words of a window, and from one window to the next, in long paragraphs.
WINDOW, STEP = 40, 20
#: Variants in training of each notice and sentence, and of each name in a sentence.
VARIANTS, NAME_VARIANTS = 40, 4
#: Documents that give other windows, and windows, at most: half of them those likest to templates.
SAMPLE_DOCUMENTS, SAMPLE_WINDOWS = 500, 3000
#: Windows of the sample that share so much with a template may be notices, so they are not learned as others.
ALIKE = 0.3
#: Share of other windows (set aside in training) that may pass the threshold.
FALSE_ALARMS = 0.005
#: Share of word pairs that a confirmed paragraph and a template of its family have in common.
CONFIRMED = 0.6


def _words(text: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(text), r"\.(?=\s|$)", " ")
    return F.filter(F.split(cleaned, WORDS), lambda w: F.length(w) > 0)


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _pair_hashes(hashes: Column) -> Column:
    """Hashes of pairs of neighbouring words, in order, from those of the words."""
    return F.zip_with(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(0))), F.slice(hashes, F.lit(2), F.greatest(F.size(hashes) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _pairs(words: Column) -> Column:
    """Pairs of neighbouring words."""
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def _notices() -> list[tuple[str, str, int]]:
    """family, text, variants: the templates, and each name in each sentence."""
    named = [(f, sentence.format(n), NAME_VARIANTS) for f, names in NAMES.items() for n in names for sentence in SENTENCES]
    return [(f, t, VARIANTS) for f in sorted(TEMPLATES) for t in TEMPLATES[f]] + named


def _windows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, paragraph (its place among the text's paragraphs that hold a word), word (the window's
first), words, grams (hashes of its words and pairs): windows over the words of every paragraph, the lines up to an empty one."""
    parts = F.filter(F.split("text", r"(?:\r?\n[ \t]*){2,}"), lambda p: F.length(F.trim(p)) > 0)
    found = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(parts).alias("paragraph", "paragraph_text"))
    # exploded, so that the words are made once and not for each use of them
    words = found.select("doc_id", "text_hash", "paragraph", F.explode(F.array(_words(F.col("paragraph_text")))).alias("all_words")).filter(F.size("all_words") > 0)
    # each is hashed once a paragraph, though windows overlap, and numbers are passed on faster than texts
    words = words.select("*", F.explode(F.array(_hashes(F.col("all_words")))).alias("all_hashes"))
    words = words.select("*", F.explode(F.array(_pair_hashes(F.col("all_hashes")))).alias("all_pairs"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all_words") - (WINDOW - STEP)), F.lit(STEP))
    windows = words.select("doc_id", "text_hash", "paragraph", "all_words", "all_hashes", "all_pairs", F.explode(starts).alias("word"))
    grams = F.concat(F.slice("all_hashes", F.col("word"), F.lit(WINDOW)), F.slice("all_pairs", F.col("word"), F.lit(WINDOW - 1)))
    return windows.select("doc_id", "text_hash", "paragraph", "word", F.slice("all_words", F.col("word"), F.lit(WINDOW)).alias("words"), grams.alias("grams"))


def _similarity(pairs: Column, notices: Column) -> Column:
    """The largest share of word pairs, of the window or the notice if that is shorter, that one of the notices shares."""
    return F.array_max(F.transform(notices, lambda n: F.size(F.array_intersect(n, pairs)) / F.greatest(F.lit(1), F.least(F.size(n), F.size(pairs)))))


def _notice_pairs(spark: SparkSession) -> DataFrame:
    """family, notices: the word pairs of each notice. A fixed table of some hundred notices."""
    notices = spark.createDataFrame([(f, t) for f, t, _ in _notices()], "family string, notice string")
    return notices.select("family", _pairs(_words(F.col("notice"))).alias("notice")).groupBy("family").agg(F.collect_set("notice").alias("notices"))


def _others(docs: DataFrame) -> DataFrame:
    """words, drawn, n: numbered windows of docs that are like no notice, SAMPLE_WINDOWS at most; half of
    them drawn by hash from all windows of the sampled documents, half those likest to notices."""
    spark = docs.sparkSession
    hashed = docs.filter("text is not null").withColumn("h", F.xxhash64("doc_id", "text"))
    least = hashed.select("h").orderBy("h").limit(SAMPLE_DOCUMENTS)  # so many hashes at most, which may be broadcast
    drawn = _windows(hashed.join(F.broadcast(least.distinct()), "h", "left_semi"))
    # a fixed table of some hundred notices, as constants
    known = [n for r in _notice_pairs(spark).select("notices").collect() for n in r["notices"]]
    pairs = sorted({p for n in known for p in n})
    shared = F.size(F.filter(_pairs(F.col("words")), lambda p: p.isin(pairs)))
    drawn = materialize(drawn.select("words", shared.alias("shared")))
    # twice as many as wanted, of which those that are too like a notice go
    by_hash = drawn.orderBy(F.xxhash64("words"), "words").limit(SAMPLE_WINDOWS)
    likest = drawn.filter("shared > 0").orderBy(F.desc("shared"), F.xxhash64("words"), "words").limit(SAMPLE_WINDOWS)
    some = by_hash.withColumn("drawn", F.lit(True)).unionByName(likest.withColumn("drawn", F.lit(False)))
    notices = F.transform(F.split(F.lit("\n".join("|".join(n) for n in known)), "\n"), lambda n: F.split(n, r"\|"))
    # exploded, so that each is made once and not for each notice
    some = some.withColumn("pairs", F.explode(F.array(_pairs(F.col("words"))))).withColumn("notices", F.explode(F.array(notices)))
    some = materialize(some.withColumn("similarity", F.when(F.col("shared") > 0, _similarity(F.col("pairs"), F.col("notices"))).otherwise(0.0)).drop("pairs", "notices")).filter(F.col("similarity") < ALIKE)
    by_hash = some.filter("drawn").orderBy(F.xxhash64("words"), "words").limit(SAMPLE_WINDOWS // 2).select("words", "drawn")
    likest = some.filter("not drawn").orderBy(F.desc("similarity"), F.xxhash64("words"), "words").limit(SAMPLE_WINDOWS // 2).select("words", "drawn")
    return by_hash.unionByName(likest).withColumn("n", F.row_number().over(W.orderBy(F.xxhash64("words", "drawn"), "words")) - 1)


def _variants(known: DataFrame) -> DataFrame:
    """family, v, text, words: each text (with its number of variants) whole, and with words left out, cut
    or put before."""
    v = known.withColumn("words", _words(F.col("text"))).withColumn("few", F.size("words") < 6)
    v = materialize(v.withColumn("v", F.explode(F.sequence(F.lit(0), F.col("variants") - 1))))
    dropped = F.filter("words", lambda w, i: F.col("few") | (F.pmod(F.xxhash64(w, i, "v", "text"), F.lit(100)) >= F.col("v") % 4 * 8))
    v = materialize(v.withColumn("dropped", dropped))
    dropped = F.col("dropped")
    first = F.pmod(F.xxhash64("v", "text"), F.greatest(F.lit(1), F.size(dropped) - 12)).cast("int") + 1
    cut = F.when((F.col("v") % 3 == 1) & (F.size(dropped) > 16), F.slice(dropped, first, F.lit(30))).otherwise(dropped)
    before = F.array(*(F.lit(w) for w in "this file code project software the copyright 2019 2023 by authors a of".split()))
    lead = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.get(before, F.pmod(F.xxhash64("v", "text", k), F.size(before).cast("long")).cast("int")))
    made = F.when(F.col("v") == 0, F.col("words")).when(F.col("v") % 5 == 2, F.concat(lead, cut)).otherwise(cut)
    return materialize(v.select("family", "v", "text", made.alias("words"))).filter(F.size("words") > 0)


def _within_others(made: DataFrame, others: DataFrame, n: int) -> DataFrame:
    """made, every second variant amid the words of some other window (if there are any)."""
    at = F.when(F.col("v") % 2 == 1, F.pmod(F.xxhash64("text", "v"), F.lit(max(1, n))))
    around = made.withColumn("at", at).join(F.broadcast(others.select(F.col("n").cast("long").alias("at"), F.col("words").alias("others"))), "at", "left")
    around = materialize(around.withColumn("k", F.pmod(F.xxhash64("v", "text", F.lit(1)), F.greatest(F.lit(1), F.size("others"))).cast("int")))
    k = F.col("k")
    amid = F.concat(F.slice("others", F.lit(1), k), F.col("words"), F.slice("others", k + 1, F.lit(WINDOW)))
    first = F.greatest(F.lit(1), k - F.greatest(F.lit(0), (WINDOW - F.size("words")) / 2).cast("int"))
    return materialize(around.withColumn("words", F.when(F.col("others").isNull(), F.slice("words", 1, WINDOW)).otherwise(F.slice(amid, first, F.lit(WINDOW)))))


@dataclass
class LicenceModel:
    classifier: LogisticRegressionModel
    families: list[str]  #: by label; the last is UNKNOWN
    threshold: float


def _hashing() -> HashingTF:
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True)


def _best(predicted: DataFrame, families: list[str]) -> DataFrame:
    """label and probability of the likeliest family (UNKNOWN aside)."""
    p = F.slice(vector_to_array("probability"), 1, len(families) - 1)
    return predicted.withColumn("chances", p).withColumn("chance", F.array_max("chances")).withColumn("label", F.array_position("chances", F.col("chance")) - 1).drop("chances")


def fit_licences(docs: DataFrame) -> LicenceModel:
    """A classifier trained on variants of the notices, of other sentences, and on windows of docs
    (doc_id, text) that are like no notice, from at most SAMPLE_DOCUMENTS documents.

    Every second variant stands amid words of such a window. A fifth of the rows is set aside; the
    threshold on a family's probability lets FALSE_ALARMS of the windows drawn by hash among them pass,
    which are what is scanned later, and is 0.5 at least. Of repeated rows those with equal words share
    a place in the order. Null texts teach nothing; without any text the notices alone do.
    """
    spark = docs.sparkSession
    families = [*sorted(TEMPLATES), UNKNOWN]
    known = _notices() + [(UNKNOWN, t, VARIANTS) for t in OTHER_SENTENCES]
    others = materialize(_others(docs))
    made = _within_others(_variants(spark.createDataFrame(known, "family string, text string, variants int")), others, others.count())
    other = others.select(F.lit(UNKNOWN).alias("family"), F.col("n").alias("v"), "words", "drawn")
    label = F.array_position(F.array(*(F.lit(f) for f in families)), F.col("family")) - 1
    rows = made.select("family", "v", "words", F.lit(False).alias("drawn")).unionByName(other)
    rows = materialize(rows.select("v", "drawn", label.cast("double").alias("label"), _hashes(F.col("words")).alias("hashes")), 2)
    rows = rows.withColumn("grams", F.concat("hashes", _pair_hashes(F.col("hashes"))))
    rows = _hashing().transform(rows)
    regression = LogisticRegression(family="multinomial", regParam=2e-4, maxIter=60, standardization=False)
    model = regression.fit(rows.filter("v % 5 <> 4"))
    model.setRawPredictionCol("").setPredictionCol("")  # only probabilities are read
    aside = _best(model.transform(rows.filter("v % 5 = 4 and drawn")).drop("label"), families)
    passing = aside.agg(F.percentile("chance", 1 - FALSE_ALARMS)).first()[0]
    return LicenceModel(model, families, min(0.99, max(0.5, passing or 0.5)))


def scan_licences(docs: DataFrame, model: LicenceModel, unconfirmed: bool = False) -> DataFrame:
    """doc_id, text_hash, paragraph, family, probability, similarity, word, confirmed: the paragraphs of docs
    (doc_id, text) that state a licence, one row for each family found in a paragraph.

    Paragraphs are the lines of the whole text up to an empty one; all are read, in windows of WINDOW
    words. similarity is the share of word pairs, of the window or the notice if that is shorter, that
    the best notice of the family shares; it confirms from CONFIRMED. word is the first one of the
    likeliest window. Of predictions that no notice confirms, prose mostly, the rows are returned only if
    unconfirmed. Null and empty texts have no paragraphs; texts that share a doc_id have rows of their own
    (text_hash), repeated rows one.
    """
    windows = _windows(docs.select("doc_id", "text"))
    # features are binary, so what comes twice in a window counts once
    scored = _best(model.classifier.transform(_hashing().transform(windows)), model.families).filter(F.col("chance") >= model.threshold)
    family = F.element_at(F.array(*(F.lit(f) for f in model.families)), (F.col("label") + 1).cast("int"))
    scored = scored.select("doc_id", "text_hash", "paragraph", "word", _pairs(F.col("words")).alias("pairs"), family.alias("family"), "chance")
    compared = scored.join(F.broadcast(_notice_pairs(docs.sparkSession)), "family").withColumn("similarity", _similarity(F.col("pairs"), F.col("notices")))
    found = (
        compared.groupBy("doc_id", "text_hash", "paragraph", "family")
        .agg(F.max("chance").alias("probability"), F.max("similarity").alias("similarity"), F.max_by("word", F.struct("chance", -F.col("word"))).alias("word"))
        .withColumn("confirmed", F.col("similarity") >= CONFIRMED)
    )
    return found if unconfirmed else found.filter("confirmed")
