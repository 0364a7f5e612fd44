"""Licence scan: a trained classifier of paragraphs, confirmed by templates.

A multinomial logistic regression with an L1 penalty tells licence families and
an `unknown` class apart by word n-grams. It is trained on the templates below,
whole and in parts, and on a bounded sample of the table's own paragraphs as
`unknown`; n-grams that ordinary text has as well are no features. A temperature,
fitted on held-out rows, calibrates the chances. A paragraph (a line of a text)
is given to a family only when that is likelier than not, and the finding is
confirmed only when enough of its n-grams are those of one of the family's
templates. A paragraph with several notices has a row for each of the families.

DataFrame functions and the DataFrame-based regression only. The model is a small
constant; texts stay where they are, nothing is shuffled. A paragraph without any
feature scores as the bare intercepts do, which is `unknown`, so only paragraphs
with a word of some feature are scored.

Cases: null and empty texts have no paragraphs; repeated lines and equal rows are
reported each; rows without id are reported without; a table too empty for a
sample is judged by the templates alone; an empty table gives an empty result.
Only doc_id and text are read.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import hash_order, least_hashed

UNKNOWN = "unknown"
SAMPLE_DOCS = 600
SAMPLE_PARAGRAPHS = 4000
LONGEST_GRAM = 3
# An n-gram in more than this share of the sampled paragraphs is ordinary text.
ORDINARY = 0.002
PENALTY = 0.0005
STEPS = 80
LEAST_CHANCE = 0.5
LEAST_OVERLAP = 0.6
HELD_OUT = 4
# Families whose notices share their wording, and the n-grams that tell which is meant.
RELATED = {
    "gpl": ["gpl", "gnu general"], "lgpl": ["lgpl", "lesser general"], "agpl": ["agpl", "affero"],
    "cc-by": ["cc by", "commons attribution"], "cc-by-sa": ["by sa", "attribution sharealike", "share alike"],
    "cc-by-nc": ["by nc", "attribution noncommercial", "non commercial"],
}

# Notices and key passages of well-known licences, in their published wording.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "This project is licensed under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GPL v2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "reserved": [
        "Copyright 2020. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without "
        "the prior written permission of the publisher.",
        "All rights reserved. Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential.",
    ],
}


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def grams(found: Column, longest: int = LONGEST_GRAM) -> Column:
    """The distinct n-grams of a list of words, up to `longest` words."""


    def of_size(n: int) -> Column:
        starts = F.slice(found, 1, F.greatest(F.size(found) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda w, i: F.concat_ws(" ", w, *[F.get(found, i + k) for k in range(1, n)]))

    return F.array_distinct(F.concat(*map(of_size, range(1, longest + 1))))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, line, paragraph, found): the lines of all texts that have a word."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "paragraph"))
    return lines.withColumn("found", tokens(F.col("paragraph"))).where(F.size("found") > 0)


def parts(text: str) -> list[str]:
    """A template whole, without its end, and without its beginning."""
    words = text.split()
    cuts = [(0, len(words))]
    if len(words) > 12:
        third = len(words) // 3
        cuts += [(0, 2 * third), (third, len(words)), (0, third), (third, 2 * third), (2 * third, len(words))]
    return [" ".join(words[a:b]) for a, b in cuts]


class Model(NamedTuple):
    """Families (the last is unknown), n-grams with a weight for each, and the chances' temperature."""

    families: list[str]
    grams: list[str]
    weights: list[list[float]]
    intercepts: list[float]
    temperature: float
    keywords: list[str]
    templates: str


def training_rows(spark: SparkSession, docs: DataFrame, templates: str) -> DataFrame:
    """(family, paragraph, found): templates and their parts, and a bounded sample of the table as unknown."""
    labelled = [(f, p) for f, texts in TEMPLATES.items() for t in texts for p in parts(t)]
    known = spark.createDataFrame(labelled, "family string, paragraph string")
    chosen = least_hashed(docs.where("text is not null").select("doc_id", "text"), SAMPLE_DOCS, "doc_id")
    lines = paragraphs(chosen).orderBy(hash_order("paragraph"), "paragraph").limit(SAMPLE_PARAGRAPHS)
    ordinary = lines.where(overlap(grams(F.col("found")), templates) < LEAST_OVERLAP / 2)
    rows = known.withColumn("found", tokens(F.col("paragraph")))
    return rows.unionByName(ordinary.select(F.lit(UNKNOWN).alias("family"), "paragraph", "found"))


def template_grams(spark: SparkSession) -> str:
    """The n-grams of all templates, as JSON."""
    rows = [(f, t) for f, texts in TEMPLATES.items() for t in texts]
    found = spark.createDataFrame(rows, "family string, text string").select("family", grams(tokens(F.col("text"))).alias("g"))
    return json.dumps([{"family": r["family"], "g": r["g"]} for r in found.collect()])


def overlap(own: Column, templates: str, family: Column | None = None) -> Column:
    """The largest share that a paragraph's n-grams have in common with one template's, of the smaller of both."""
    table = F.from_json(F.lit(templates), "array<struct<family:string,g:array<string>>>")

    def largest(mine: Column) -> Column:
        of_family = table if family is None else F.filter(table, lambda t: t["family"] == family)
        shares = F.transform(
            of_family,
            lambda t: F.size(F.array_intersect(mine, t["g"])) / F.least(F.size(mine), F.size(t["g"])),
        )
        return F.coalesce(F.array_max(shares), F.lit(0.0))

    # bound once: the lambda above uses the paragraph's n-grams for every template
    return F.transform(F.array(own), largest)[0]


def train(spark: SparkSession, docs: DataFrame) -> Model:
    """Fit and calibrate. Everything collected is bounded by the templates and the sample."""
    templates = template_grams(spark)
    rows = training_rows(spark, docs, templates).withColumn("grams", grams(F.col("found"))).coalesce(1).cache()
    ordinary = rows.where(F.col("family") == UNKNOWN)
    n_ordinary = ordinary.count()
    counts = rows.select("family", F.explode("grams").alias("gram")).groupBy("gram").agg(
        F.sum(F.when(F.col("family") == UNKNOWN, 1).otherwise(0)).alias("ordinary"),
        F.sum(F.when(F.col("family") != UNKNOWN, 1).otherwise(0)).alias("licence"),
    )
    most = ORDINARY * max(n_ordinary, 1 / ORDINARY - 1)
    # numbers and very short words say too little alone
    telling = F.col("gram").rlike("[a-z]{4}|[a-z].* |.* .*[a-z]")
    features = counts.where((F.col("licence") > 0) & (F.col("ordinary") <= most) & telling)
    vocabulary = sorted(r["gram"] for r in features.collect())
    families = [*TEMPLATES, UNKNOWN]
    index = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", binary=True, minTF=1.0)
    # rows without a feature stand for all other text; licences weigh as much as they do
    weight = F.when(F.col("family") == UNKNOWN, 200.0 / max(1, n_ordinary)).otherwise(1.0)
    seen = vectors.transform(rows.withColumn("label", index).withColumn("weight", weight))
    nothing = vectors.transform(
        spark.createDataFrame([(UNKNOWN, "", [], [], float(len(families) - 1), 200.0)], seen.drop("features").schema)
    )
    seen = seen.unionByName(nothing).coalesce(1).cache()
    fold = F.pmod(hash_order("paragraph"), F.lit(HELD_OUT)) == 0
    regression = LogisticRegression(
        family="multinomial", elasticNetParam=1.0, regParam=PENALTY, maxIter=STEPS, weightCol="weight", standardization=False
    )
    # the calibration fit leaves the held-out rows out, the final one doesn't
    trial = regression.fit(seen.where(~fold | (F.col("family") == UNKNOWN)))
    held = trial.transform(seen.where(fold)).select("label", "weight", "rawPrediction").collect()
    temperature = fitted_temperature(held)
    fitted = regression.fit(seen)
    matrix, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    rows.unpersist()
    seen.unpersist()
    used = np.flatnonzero(np.abs(matrix).sum(axis=0) > 0)
    chosen = [vocabulary[k] for k in used]
    rare = {r["gram"]: r["ordinary"] for r in counts.where(~F.col("gram").contains(" ")).collect()}
    keywords = sorted({min(g.split(), key=lambda w: (rare.get(w, 0), -len(w), w)) for g in chosen})
    return Model(families, chosen, matrix[:, used].T.tolist(), intercepts.tolist(), temperature, keywords, templates)


def fitted_temperature(held: list) -> float:
    """What the logits are divided by so that held-out rows get the likeliest chances."""
    if not held:
        return 1.0
    logits = np.array([r["rawPrediction"].toArray() for r in held])
    label = np.array([int(r["label"]) for r in held])
    weight = np.array([r["weight"] for r in held])

    def loss(t: float) -> float:
        z = logits / t
        z -= z.max(axis=1, keepdims=True)
        return float((weight * (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), label])).sum())

    return float(min(np.geomspace(0.25, 4.0, 33), key=loss))


def bound(value: Column, use) -> Column:
    """What `use` makes of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def notices(found: Column, model: Model) -> Column:
    """(family, chance, overlap) of every family that a paragraph names, the likeliest first.

    The likeliest family counts by its calibrated chance. What its templates
    explain is taken away; the family for which most of the rest speaks is next,
    and so on until the rest speaks for none. Further families count by their
    calibrated odds against unknown alone, given the whole paragraph; they must be
    confirmed, and named if their notices share the wording of one found before.
    """
    weights = [{"g": g, "w": w} for g, w in zip(model.grams, model.weights, strict=True)]
    constant = F.from_json(F.lit(json.dumps(weights)), "array<struct<g:string,w:array<double>>>")
    names = F.from_json(F.lit(json.dumps(model.grams)), "array<string>")
    families = F.from_json(F.lit(json.dumps(model.families)), "array<string>")
    table = F.from_json(F.lit(model.templates), "array<struct<family:string,g:array<string>>>")
    results = "array<struct<family:string,chance:double,overlap:double>>"
    n_families = len(model.families) - 1

    def summed(own: Column, start: list[float]) -> Column:
        hits = F.array_intersect(own, names)
        rows = F.transform(hits, lambda g: F.get(constant, (F.array_position(names, g) - 1).cast("int"))["w"])
        return F.aggregate(rows, F.array(*map(F.lit, start)), lambda acc, w: F.zip_with(acc, w, lambda a, b: a + b))

    def place_of(values: Column, value: Column) -> Column:
        return (F.array_position(values, value) - 1).cast("int")

    def without(rest: Column, family: Column) -> Column:
        return F.array_except(rest, F.flatten(F.transform(F.filter(table, lambda t: t["family"] == family), lambda t: t["g"])))

    def may_follow(family: Column, rest: Column, before: Column) -> Column:
        allowed = ~F.array_contains(before, family)
        for name, telling in RELATED.items():
            kin = [k for k in RELATED if k != name and ("gpl" in k) == ("gpl" in name)]
            named = F.arrays_overlap(rest, F.array(*map(F.lit, telling)))
            allowed = allowed & ((family != name) | named | ~F.arrays_overlap(before, F.array(*map(F.lit, kin))))
        return allowed

    def state(rest: Column, out: Column, go: Column) -> Column:
        return F.struct(rest.alias("rest"), out.alias("out"), go.alias("go"))

    def row(family: Column, chance: Column, share: Column) -> Column:
        return F.struct(family.alias("family"), chance.alias("chance"), share.alias("overlap"))

    def of_grams(own: Column) -> Column:
        def share_of(family: Column) -> Column:
            return overlap(own, model.templates, family)

        def of_logits(z: Column) -> Column:
            def next_one(acc: Column, gains: Column) -> Column:
                def of_gain(gain: Column) -> Column:
                    def of_place(k: Column) -> Column:
                        family = F.get(families, k)
                        odds = 1 / (1 + F.exp((F.get(z, F.lit(n_families)) - F.get(z, k)) / F.lit(model.temperature)))
                        before = F.transform(acc["out"], lambda o: o["family"])

                        def of_share(share: Column) -> Column:
                            added = F.concat(acc["out"], F.array(row(family, odds, share)))
                            return F.when(share >= LEAST_OVERLAP, added).otherwise(acc["out"])

                        may = (odds >= LEAST_CHANCE) & may_follow(family, acc["rest"], before)
                        out = F.when(may, bound(share_of(family), of_share)).otherwise(acc["out"])
                        return state(without(acc["rest"], family), out, F.lit(True))

                    ended = state(acc["rest"], acc["out"], F.lit(False))
                    return F.when(gain > 0, bound(place_of(gains, gain), of_place)).otherwise(ended)

                return bound(F.array_max(gains), of_gain)

            def further(acc: Column, _: Column) -> Column:
                gains = F.slice(summed(acc["rest"], [0.0] * len(model.families)), 1, n_families)
                return F.when(acc["go"], bound(gains, lambda g: next_one(acc, g))).otherwise(acc)

            def begun(best: Column) -> Column:
                family = F.get(families, place_of(z, best))
                total = F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp((x - best) / F.lit(model.temperature)))
                likely = state(without(own, family), F.array(row(family, 1 / total, share_of(family))), F.lit(True))
                unsure = state(own, F.array().cast(results), F.lit(True))
                return F.when(1 / total >= LEAST_CHANCE, likely).otherwise(unsure)

            def of_best(best: Column) -> Column:
                rounds = F.sequence(F.lit(1), F.lit(n_families))
                every = F.aggregate(rounds, begun(best), further, lambda acc: acc["out"])
                return F.when(best > F.get(z, F.lit(n_families)), every).otherwise(F.array().cast(results))

            return bound(F.array_max(z), of_best)

        return bound(summed(own, model.intercepts), of_logits)

    return bound(grams(found), of_grams)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, line, family, chance, overlap, confirmed) of every family that a paragraph is likelier to name than not."""
    model = model or train(docs.sparkSession, docs)
    keywords = F.from_json(F.lit(json.dumps(model.keywords)), "array<string>")
    has_any = docs.select("doc_id", "text").where(F.arrays_overlap(F.split(F.lower("text"), "[^a-z0-9]+"), keywords))
    rows = paragraphs(has_any).where(F.arrays_overlap("found", keywords))
    # as a generator: else filters above would compute the logits many times over
    likely = rows.select("doc_id", "line", F.inline(notices(F.col("found"), model)))
    return likely.select("doc_id", "line", "family", "chance", "overlap", (F.col("overlap") >= LEAST_OVERLAP).alias("confirmed"))
