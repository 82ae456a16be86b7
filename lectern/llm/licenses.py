"""License scans by a trained paragraph classifier, in DataFrame functions only.

A paragraph is a sentence of a line.  Its words and word pairs feed a multinomial logistic regression over licence families and an
unknown class, trained on the templates below, on thinned copies of them, on wordings that name no licence, and on
sentences of the corpus.  Probabilities are calibrated by a temperature fitted on copies and sentences held out.  A prediction
stands only if the paragraph's word pairs also lie in the templates of the family predicted, so only paragraphs whose
pairs lie in the templates of all families are looked at; no sample of the corpus decides which those are.
"""

from __future__ import annotations

import json


from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import bounded_sample, checkpointed, hot_joined, read, text_key

UNKNOWN = "unknown"
#: Documents whose sentences serve as examples without a licence.
SAMPLE_DOCS = 300
#: At most so many of their distinct sentences are used.
SAMPLE_SENTENCES = 20_000
MIN_PROBABILITY = 0.6
MIN_CONTAINMENT = 0.6
# Names of the families and public wordings of their licences and notices.
_NAMES = {
    "mit": ["MIT License", "MIT licence", "The MIT License (MIT)", "Expat License"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license", "Apache 2.0"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License version 2", "GNU GPL v3", "GPL-3.0 license", "GPLv2"],
    "lgpl": ["GNU Lesser General Public License, version 3", "GNU LGPL v2.1", "LGPL-3.0 license"],
    "agpl": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0 license"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause license", "New BSD License"],
    "mpl": ["Mozilla Public License, Version 2.0", "MPL 2.0", "MPL-2.0 license"],
    "cc_by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"],
    "cc_by_sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc_by_nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "public_domain": ["CC0 1.0 Universal", "Unlicense", "public domain dedication CC0"],
}
_NOTICES = ["{}", "Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "Distributed under the terms of the {}.", "This software is available under the {}.", "See the {} for details."]
_TEXTS = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    ],
    "apache": [
        "You may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http www apache org licenses LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "See the License for the specific language governing permissions and limitations under the License",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
        "You should have received a copy of the GNU General Public License along with this program",
    ],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl": ["You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http mozilla org MPL 2.0"],
    "cc_by_sa": ["If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original"],
    "cc_by_nc": ["You may not use the material for commercial purposes"],
    "public_domain": ["This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
}
_NO_LICENCE = ["the license", "a driving license is required", "licensed under separate terms", "released under a new title", "this work is finished", "see the file for details", "license agreement between the parties", "all rights reserved", "copyright notice", "version 2.0 of the program", "version 3", "the general public was present", "permission is needed to enter", "available under the counter", "distributed under the name of the author", "the terms of the license", "a license fee is due", "commercial license only", "under the license", "4.0 international", "creative common sense", "the foundation published it", "software is provided by others", "licensed under the"]


def templates() -> list[tuple[str, str]]:
    """(family, text) of every template."""
    rows = [(f, n.format(name)) for f, names in _NAMES.items() for name in names for n in _NOTICES]
    return rows + [(f, t) for f, texts in _TEXTS.items() for t in texts]


def _rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(family, text) as a DataFrame of one literal."""
    held = F.lit(json.dumps([{"family": a, "text": b} for a, b in rows]))
    return spark.range(1).select(F.explode(F.from_json(held, "array<struct<family:string,text:string>>")).alias("x")).select("x.*")


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, with inner dots, pluses and hyphens kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*"), F.lit(0))


def grams(w: str) -> Column:
    """Words and word pairs of the token array ``w``, each once."""
    pairs = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(F.col(w), i + 1)))
    return F.array_distinct(F.concat(F.col(w), pairs))


def pairs(w: str) -> Column:
    """Word pairs of ``w``, or the word if there is but one."""
    # no lambda takes in ``w`` itself: where that is inlined, it would be computed again for each word
    n = F.greatest(F.size(w) - 1, F.lit(0))
    both = F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.when(F.size(w) < 2, F.col(w)).otherwise(F.array_distinct(both))


def sentences(text: Column) -> Column:
    """Sentences of the lines of a text; a sentence ends before white space that follows . ! or ? and precedes a capital or a digit."""
    return F.filter(F.split(text, r"\n|(?<=[.!?])[ \t\r]+(?=[\p{Lu}\p{N}])"), lambda s: F.length(F.trim(s)) > 0)


class Scanner:
    """Weights of the n-grams that tell families, the temperature and the templates' word pairs."""

    def __init__(self, vocabulary: list[str], classes: list[str], weights: list[list[float]], bias: list[float], temperature: float) -> None:
        self.vocabulary, self.classes, self.weights, self.bias, self.temperature = vocabulary, classes, weights, bias, temperature

    def table(self, spark: SparkSession) -> DataFrame:
        """(gram, w): the vocabulary with its weights by class; no more rows than the templates have n-grams."""
        held = F.lit(json.dumps([{"gram": g, "w": w} for g, w in zip(self.vocabulary, self.weights, strict=True)]))
        return checkpointed(spark.range(1).select(F.explode(F.from_json(held, "array<struct<gram:string,w:array<double>>>")).alias("x")).select("x.*"))

    def logits(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """``keys`` of ``rows`` (with token array w) and z, the logits by class divided by the temperature."""
        each = rows.select(*keys, F.explode(grams("w")).alias("gram")).join(F.broadcast(self.table(rows.sparkSession)), "gram")
        sums = [F.sum(F.get("w", i)).alias(f"z{i}") for i in range(len(self.classes))]
        total = rows.select(*keys).join(each.groupBy(*keys).agg(*sums), keys, "left")
        return total.select(*keys, F.array(*[(F.coalesce(f"z{i}", F.lit(0.0)) + b) / self.temperature for i, b in enumerate(self.bias)]).alias("z"))


def probabilities(z: str) -> Column:
    top = F.array_max(z)
    e = F.transform(z, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> Scanner:
    """Fits the classifier on the templates and on the sentences of SAMPLE_DOCS documents that name no licence."""
    spark = docs.sparkSession
    known = _rows(spark, templates()).withColumn("w", tokens(F.col("text")))
    ids = bounded_sample(docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id")).distinct(), "doc_id", SAMPLE_DOCS)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id", "left_semi").select(F.explode(sentences(F.col("text"))).alias("text"))
    plain = checkpointed(plain.where("not lower(text) rlike 'licen|copyright|gpl|creative commons'").distinct())
    plain = bounded_sample(plain, "text", SAMPLE_SENTENCES).withColumn("w", tokens(F.col("text")))
    # sentences that are mostly a template's wording are no examples of ordinary text
    stated = known.select(F.explode(pairs("w")).alias("g")).distinct().withColumn("hit", F.lit(1.0))
    plain = checkpointed(plain.where("size(w) > 0"))
    share = plain.select("text", F.explode(pairs("w")).alias("g")).join(stated, "g", "left").groupBy("text").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("share"))
    plain = checkpointed(plain.join(share.where("share < 0.3").select("text"), "text", "left_semi"))
    generic = _rows(spark, [(UNKNOWN, t) for t in _NO_LICENCE]).withColumn("w", tokens(F.col("text")))
    # the vocabulary is all the templates hold; names that ordinary sentences hold too don't mark a thinned copy
    own = known.select(F.explode(grams("w")).alias("gram")).distinct()
    common = plain.select(F.explode("w").alias("gram")).distinct()
    vocabulary = sorted(r.gram for r in own.collect())  # of the templates: bounded
    held = {r.gram for r in own.join(common, "gram", "left_anti").collect()}
    # Thinned copies: each word left out in turn, and the two halves; every fourth copy, and every fourth sentence of the corpus, is held out for calibration.
    words = known.union(generic).select("family", "text", "w")
    thin = words.select("family", "text", F.posexplode(F.transform("w", lambda _, i: F.concat(F.slice("w", F.lit(1), i), F.slice(F.col("w"), i + 2, F.size("w"))))).alias("k", "w")).where("size(w) > 2")
    named = F.arrays_overlap("w", F.array(*[F.lit(x) for x in sorted({t for names in _NAMES.values() for n in names for t in n.lower().replace("(", " ").replace(")", " ").replace(",", " ").split()} & held - {"license", "licence", "general", "public", "version"})]))
    thin = thin.where((F.col("family") == UNKNOWN) | named | (F.size("w") > 7))
    rows = words.select("family", "w", F.lit(0).alias("k")).union(thin.select("family", "w", (F.pmod(F.xxhash64("text", "k"), F.lit(4)) + 1).cast("int"))).union(plain.select(F.lit(UNKNOWN), "w", (F.pmod(F.xxhash64("text"), F.lit(4)) + 1).cast("int")))
    classes = sorted({*_NAMES, UNKNOWN})
    rows = checkpointed(rows.withColumn("label", F.array_position(F.array(*map(F.lit, classes)), F.col("family")).cast("double") - 1).withColumn("grams", grams("w")))
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", minTF=1.0)
    counter.setBinary(True)
    model = LogisticRegression(family="multinomial", regParam=0.0005, maxIter=60, standardization=False, elasticNetParam=0.0).fit(counter.transform(rows.where("k <> 1").select("grams", "label").coalesce(2)))
    matrix = model.coefficientMatrix.toArray()
    scanner = Scanner(vocabulary, classes, [[float(matrix[c, j]) for c in range(len(classes))] for j in range(len(vocabulary))], [float(b) for b in model.interceptVector], 1.0)
    # the temperature with the least log loss on the copies held out
    aside = rows.where("k = 1").select(F.xxhash64("grams", "family").alias("id"), "label", "w").dropDuplicates(["id"])
    z = scanner.logits(aside, ["id", "label"]).select("label", "z", F.explode(F.array(*[F.lit(t) for t in (0.5, 0.7, 0.85, 1.0, 1.25, 1.5, 2.0, 3.0)])).alias("t"))
    scaled = z.withColumn("z", F.transform("z", lambda x: x / F.col("t")))
    loss = scaled.groupBy("t").agg(F.avg(-F.log(F.greatest(F.get(probabilities("z"), F.col("label").cast("int")), F.lit(1e-12)))).alias("loss"))
    best = loss.orderBy("loss", "t").first()
    scanner.temperature = float(best.t) if best else 1.0
    return scanner


def licensed_paragraphs(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tkey, paragraph, family, probability, containment): every paragraph with MIN_CONTAINMENT of its word pairs in the templates, each distinct one of a document once.

    family is ``unknown`` unless the probability reaches MIN_PROBABILITY and the templates of the predicted family hold MIN_CONTAINMENT of the paragraph's word pairs.
    """
    spark = docs.sparkSession
    # words are taken within the generator: a filter on a column would take them again wherever it names it
    each = F.transform(sentences(F.col(text_col)), lambda s: F.struct(s.alias("paragraph"), tokens(s).alias("w")))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("tkey"), F.explode(each).alias("x"))
    rows = rows.select("doc_id", "tkey", "x.paragraph", "x.w").where(F.size("w") > 0)
    # membership in the fixed set of the templates' pairs, by a hash set; no family can hold more of them than all together
    stated = [r.g for r in _rows(spark, templates()).withColumn("w", tokens(F.col("text"))).select(F.explode(pairs("w")).alias("g")).distinct().collect()]
    # each distinct word that no template holds, but the last, starts a pair of its own that none holds, so whoever has more of them fails the test below
    vocabulary = sorted({word for g in stated for word in g.split(" ")})
    strange = F.size(F.array_distinct(F.filter("w", lambda x: ~x.isin(vocabulary))))
    rows = rows.where(strange <= (1 - MIN_CONTAINMENT) * (F.size("w") - 1) + 1.001)
    rows = rows.withColumn("own", pairs("w")).where(F.size(F.filter("own", lambda x: x.isin(stated))) / F.size("own") >= MIN_CONTAINMENT).drop("own")
    rows = checkpointed(rows.distinct().withColumn("pkey", F.xxhash64("paragraph")))
    # equal paragraphs are judged once
    texts = checkpointed(rows.groupBy("pkey", "paragraph").agg(F.first("w").alias("w"), F.count("*").alias("n")))
    p = scanner.logits(texts, ["pkey", "paragraph"]).withColumn("p", probabilities("z"))
    p = p.withColumn("probability", F.array_max("p")).withColumn("guess", F.get(F.array(*map(F.lit, scanner.classes)), (F.array_position("p", F.col("probability")) - 1).cast("int")))
    known = _rows(spark, templates()).withColumn("w", tokens(F.col("text"))).groupBy("family").agg(F.array_distinct(F.flatten(F.collect_list(pairs("w")))).alias("have"))
    judged = p.join(texts, ["pkey", "paragraph"]).join(F.broadcast(known), F.col("guess") == F.col("family"), "left")
    own = pairs("w")
    judged = judged.withColumn("containment", F.when(F.col("have").isNull(), 0.0).otherwise(F.size(F.array_intersect(own, "have")) / F.size(own)))
    sure = (F.col("guess") != UNKNOWN) & (F.col("probability") >= MIN_PROBABILITY) & (F.col("containment") >= MIN_CONTAINMENT)
    judged = judged.select("pkey", "paragraph", "n", F.when(sure, F.col("guess")).otherwise(UNKNOWN).alias("family"), "probability", "containment")
    # a notice that a third of all documents hold is joined where they are
    return hot_joined(rows.select("doc_id", "tkey", "pkey", "paragraph"), checkpointed(judged), ["pkey", "paragraph"], "n", rows.count()).drop("pkey", "n")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, n_license_paragraphs, probability): one row for every row of ``docs``.

    ``license`` is the family most paragraphs state (ties: the first by name), null if none does.  Null
    and empty texts have none; repeated rows get equal results.
    """
    found = licensed_paragraphs(docs, train(docs, text_col, id_col), id_col, text_col).where(F.col("family") != UNKNOWN)
    per = found.groupBy("doc_id", "tkey", "family").agg(F.count("*").alias("n"), F.max("probability").alias("p"))
    best = per.groupBy("doc_id", "tkey").agg(F.min_by("family", F.struct(-F.col("n"), F.col("family"))).alias("license"), F.sum("n").alias("n"), F.max("p").alias("p"))
    best = best.select(F.col("doc_id").alias("_d"), F.col("tkey").alias("_k"), "license", "n", "p")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("tkey"))
    out = rows.join(best, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tkey") == F.col("_k")), "left")
    return out.select("doc_id", "license", F.coalesce("n", F.lit(0)).cast("long").alias("n_license_paragraphs"), F.round("p", 6).alias("probability"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
