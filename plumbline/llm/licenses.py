"""License scan: a trained paragraph classifier, confirmed by template comparison.

Every paragraph is a sparse vector of hashed word 1- and 2-grams. A multinomial
logistic regression tells licence families, licence-like wording of no known
family and ordinary text apart. Its confidence is calibrated on templates that
the calibrated model wasn't fitted on: below the threshold a licence paragraph is
`unknown`. A family is reported only if the paragraph also shares enough of its
word 3-grams with one of the family's templates. DataFrame and SQL functions and
Spark ML's feature stages only.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import cut

FEATURES = 1 << 12
#: Ordinary paragraphs that the classifier is fitted on: the first so many by hash of their text.
ORDINARY_ROWS = 5000
#: Variants made of each template; every fifth is kept for calibration.
VARIANTS = 25
#: Of the variants of templates left out of the fit whose best family is wrong, the share that may reach the threshold.
WRONG = 0.25
#: Share of the held ordinary paragraphs that may be taken for licences.
ALARMS = 0.001
#: Least share of a paragraph's 3-grams that a template must have, or the reverse.
CONFIRM = 0.55
#: However sure the model is of ordinary paragraphs, `none` above this is never taken for a licence.
MOST_PLAIN = 0.5
ORDINARY, UNKNOWN = "none", "unknown"

# Usual wordings of licence notices, by family.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 2.1 or 3."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Licensed under the BSD 3-Clause License. Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License. Licensed under CC BY 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide. CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "MIT License"),
    ("MIT", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."),
    ("MIT", "Licensed under MIT, see LICENSE."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Apache License, Version 2.0, January 2004"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "GNU General Public License v3.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "GNU General Public License v2.0"),
    ("LGPL", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("AGPL-3.0", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("BSD", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC-BY-SA", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    ("CC0", "SPDX-License-Identifier: CC0-1.0"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("ISC", "Licensed under the ISC License."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying, use or distribution of this material is strictly prohibited."),
    ("unknown", "See LICENSE for details."),
    ("unknown", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("unknown", "The contents of this file are subject to the terms of the Common Development and Distribution License. You may not use this file except in compliance with the License."),
    ("unknown", "This font software is licensed under the SIL Open Font License, version 1.1."),
    ("unknown", "You may distribute this package under the terms of the Artistic License."),
    ("unknown", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions."),
    ("unknown", "Dieses Werk ist lizenziert unter einer freien Lizenz; alle Rechte vorbehalten."),
    ("unknown", "Ce logiciel est distribué sous licence libre; tous droits réservés."),
    ("unknown", "Este programa se distribuye bajo una licencia libre; todos los derechos reservados."),
    ("unknown", "Licensed under the terms set out in the enclosed license agreement."),
    ("unknown", "Use of this work is subject to a license; see the license file for its terms and conditions."),
    ("unknown", "This document may be copied and distributed under the conditions of its own public license."),
    ("unknown", "The licensee may use, copy and modify the material only as permitted by the license granted by the licensor."),
]


def _words(text) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _grams(words, n: int) -> Column:
    """Runs of n words of a word array, from n arrays shifted against each other: within a lambda over places, Spark would make the words anew for each."""
    many = F.greatest(F.size(words) - (n - 1), F.lit(0))
    out = F.slice(words, 1, many)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(words, k + 1, many), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def _compared(words) -> Column:
    """Distinct word 3-grams; of fewer words the whole."""
    return F.array_distinct(F.when(F.size(words) < 3, F.array(F.array_join(words, " "))).otherwise(_grams(words, 3)))


def _vectors(rows: DataFrame) -> DataFrame:
    """rows(words, ...) with features: hashed 1- and 2-grams, present or not."""
    pairs = F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    terms = rows.withColumn("terms", F.concat("words", F.filter(pairs, lambda p: p.isNotNull())))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="terms", outputCol="features").transform(terms).drop("terms")


def _unwrapped(text) -> Column:
    """text with the lines of a paragraph joined: a break behind a line of 40 characters or more that ends no sentence, before a line with anything in it."""
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+\n", "\n")
    return F.regexp_replace(lines, "\n(?<=[^\n]{39}[^\n.!?:;]\n)(?=[^\n])", " ")


def _worded(rows: DataFrame, *columns: str) -> DataFrame:
    """columns and words of rows(paragraph, ...) with a word. The words come out of a generator: as a projection Spark would make them anew wherever a condition names them."""
    return rows.select(*columns, F.explode(F.array(_words(F.col("paragraph")))).alias("words")).where(F.size("words") > 0)


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, key, words) of every paragraph with a word of docs(doc_id, text); key: hash of the text."""
    each = docs.select("doc_id", F.xxhash64("text").alias("key"), F.explode(F.split(_unwrapped(F.col("text")), "\n+")).alias("paragraph"))
    return _worded(each, "doc_id", "key")


def templates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(k, family, text) for k, (family, text) in enumerate(TEMPLATES)], "template int, family string, text string")
    return rows.select("template", "family", _words(F.col("text")).alias("words"))


def variants(spark: SparkSession) -> DataFrame:
    """(template, family, words) of VARIANTS forms of each template: some words left out, a copyright line before it, or half of it."""
    each = templates(spark).crossJoin(spark.range(VARIANTS).select(F.col("id").cast("int").alias("variant")))
    thinned = F.filter("words", lambda w, k: (F.col("variant") < 2) | (F.pmod(F.hash(F.col("template"), F.col("variant"), k), F.lit(12)) != 0))
    owner = F.array(F.lit("copyright"), F.concat(F.lit("20"), F.lpad((F.col("variant") % 25).cast("string"), 2, "0")), F.lit("the"), F.lit("authors"))
    half = F.greatest(F.lit(8), F.ceil(F.size("words") / 2)).cast("int")
    whole = F.when(F.col("variant") % 3 == 1, F.concat(owner, thinned)).otherwise(thinned)
    words = F.when(F.col("variant") % 5 == 2, F.slice(thinned, 1, half)).when((F.col("variant") % 5 == 3) & (F.size("words") > half), F.slice("words", -half, half)).otherwise(whole)
    return each.select("template", "family", words.alias("words")).where(F.size("words") > 0)


def ordinary(docs: DataFrame, rows: int = ORDINARY_ROWS) -> DataFrame:
    """(template, family, words): a bounded sample of distinct paragraphs, the first so many by hash of their words.

    Those with a word 3-gram of a template, or with two different licence words,
    are left out; one such word may stand in them. Template: null. Only hashes below a bound are sorted; it is
    raised as long as too few are.
    """
    known = sorted({" ".join(w[k : k + 3]) for _, text in TEMPLATES for w in [re.findall("[a-z0-9]+", text.lower())] for k in range(max(1, len(w) - 2))})
    each = docs.select(F.explode(F.split(_unwrapped(F.col("text")), "\n+")).alias("paragraph"))
    plain = _worded(each).withColumn("at", F.xxhash64("words"))
    many = docs.agg(F.sum(F.size(F.split("text", "[\r\n]+")))).first()[0] or 0
    share = 4.0 * rows / max(many, 1)
    while True:
        low = plain.where(F.col("at") < int(share * 2**64) - 2**63) if share < 1 else plain
        named = F.array_distinct(F.regexp_extract_all(F.array_join("words", " "), F.lit("(licen[sc]|copyright|rights|gnu|apache|warrant|redistribut)"), F.lit(1)))
        apart = low.where(F.size(named) < 2).where(~F.arrays_overlap(_compared(F.col("words")), F.array(*map(F.lit, known))))
        picked = cut(apart.dropDuplicates(["at"]).orderBy("at").limit(rows))
        if share >= 1 or picked.count() >= rows:
            break
        share *= 8
    return picked.select(F.lit(None).cast("int").alias("template"), F.lit(ORDINARY).alias("family"), "words", (F.pmod("at", F.lit(5)) == 4).alias("held"))


class Classifier:
    """A fitted model, its class names, the threshold on the probability of a family and the one that `none` stays below."""

    def __init__(self, model: LogisticRegressionModel, names: list[str], threshold: float, plain: float):
        self.model, self.names, self.threshold, self.plain = model, names, threshold, plain


def fit(docs: DataFrame, ordinary_rows: int = ORDINARY_ROWS) -> Classifier:
    """Fits on template variants and at most ordinary_rows paragraphs of docs.

    The thresholds come from a model that saw neither every third template (of
    families that have another) nor a fifth of the ordinary paragraphs.
    """
    spark = docs.sparkSession
    names = sorted({family for family, _ in TEMPLATES} | {ORDINARY})
    label = F.array_position(F.array(*map(F.lit, names)), F.col("family")).cast("double") - 1
    spare = [k for k, (family, _) in enumerate(TEMPLATES) if k % 3 == 2 and any(f == family and j % 3 != 2 for j, (f, _) in enumerate(TEMPLATES))]
    each = variants(spark).withColumn("held", F.col("template").isin(spare)).unionByName(ordinary(docs, ordinary_rows))
    rows = cut(_vectors(each).select("family", "held", "features", label.alias("label")).coalesce(2))
    train = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=30)
    trial = train.fit(rows.where("not held"))
    p = vector_to_array("probability")
    best = F.array_max(F.array(*[F.struct(p[k].alias("p"), F.lit(n).alias("family")) for k, n in enumerate(names) if n not in (ORDINARY, UNKNOWN)]))
    seen = trial.transform(rows.where("held and family != 'none'")).select("family", best.alias("best"))
    threshold = seen.where("best.family != family").agg(F.percentile("best.p", F.lit(1 - WRONG))).first()[0]
    none = trial.transform(rows.where("held and family = 'none'")).select(p[names.index(ORDINARY)].alias("p"))
    plain = none.agg(F.percentile("p", F.lit(ALARMS))).first()[0]
    return Classifier(train.fit(rows), names, float(threshold if threshold is not None else 0.5), min(MOST_PLAIN, float(plain if plain is not None else 0.5)))


def classify(rows: DataFrame, fitted: Classifier) -> DataFrame:
    """rows(words, ...) that read like a licence, with family, probability and overlap (share of 3-grams with the best template).

    family is `unknown` where the probability is below the calibrated threshold
    or no template of the family confirms it, however far its wording is from
    all templates. Only the probability of `none` says what reads like a licence.
    """
    spark = rows.sparkSession
    scored = fitted.model.transform(_vectors(rows)).withColumn("p", vector_to_array("probability"))
    none = fitted.names.index(ORDINARY)
    licence = scored.where(F.col("p")[none] < fitted.plain).drop("features", "rawPrediction", "probability")
    known = F.array(*[F.struct(F.col("p")[k].alias("p"), F.lit(n).alias("family")) for k, n in enumerate(fitted.names) if n not in (ORDINARY, UNKNOWN)])
    best = licence.withColumn("best", F.array_max(known)).drop("p", "prediction")
    known_grams = templates(spark).select("family", _compared(F.col("words")).alias("grams")).groupBy("family").agg(F.collect_list("grams").alias("templates"))
    met = best.join(F.broadcast(known_grams), best["best.family"] == known_grams["family"], "left")  # one row a family
    mine = _compared(F.col("words"))
    overlap = F.aggregate(
        F.coalesce("templates", F.array().cast("array<array<string>>")),
        F.lit(0.0),
        lambda a, t: F.greatest(a, F.size(F.array_intersect(t, mine)) / F.least(F.size(t), F.size(mine)).cast("double")),
    )
    judged = met.withColumn("overlap", overlap)
    sure = (F.col("best.p") >= fitted.threshold) & (F.col("overlap") >= CONFIRM)
    return judged.select(*[judged[c] for c in rows.columns], F.when(sure, F.col("best.family")).otherwise(UNKNOWN).alias("family"), F.col("best.p").alias("probability"), "overlap")


def scan(docs: DataFrame, ordinary_rows: int = ORDINARY_ROWS) -> DataFrame:
    """The licences named in every row of docs(doc_id, text).

    Columns: doc_id, n_paragraphs (those with an ASCII letter or digit; wrapped
    lines are joined first, see _unwrapped),
    n_licence (those that read like a licence), families (sorted distinct,
    `unknown` among them) and top_probability (null without one). Null and empty
    texts have none. Rows equal in doc_id and text have the same result, one row
    each; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = classify(paragraphs(rows), fit(rows, ordinary_rows)).select("doc_id", "key", "family", "probability")
    # the same text may stand in several rows of one doc_id; its paragraphs then count once for each of them
    held = found.groupBy(F.col("doc_id").alias("id"), "key").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("family")).alias("families"), F.max("probability").alias("top_probability"))
    own = rows.select("doc_id", F.xxhash64("text").alias("own"), F.size(F.filter(F.split(_unwrapped(F.col("text")), "\n+"), lambda p: p.rlike("[A-Za-z0-9]"))).alias("n_paragraphs"))
    counts = own.groupBy(F.col("doc_id"), F.col("own")).agg(F.count("*").alias("rows"), F.max("n_paragraphs").alias("n_paragraphs"))
    joined = counts.join(held, counts["doc_id"].eqNullSafe(held["id"]) & (counts["own"] == held["key"]), "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return joined.select(
        "doc_id",
        F.greatest(F.coalesce("n_paragraphs", F.lit(0)), F.lit(0)).cast("long").alias("n_paragraphs"),
        F.coalesce(F.floor(F.col("n") / F.col("rows")), F.lit(0)).cast("long").alias("n_licence"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"),
        "top_probability",
    )
