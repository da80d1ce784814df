"""Licence scans: a trained paragraph classifier with template comparison. Scoring is native.

A paragraph is a line of a text. One without any cue word (licence, copyright, warranty and the like)
is none: the classifier's classes all need such words. The others are scored by a softmax regression
over hashed word n-grams of one to three words, fitted to a bounded made-up sample: the templates cut,
blurred and put between other words, against ordinary sentences with cue words and lines of the
corpus. A prediction below the least probability is ``unknown``; that threshold is calibrated on held-out
examples so that at most ``FALSE_SHARE`` of those without a licence pass. A prediction counts as confirmed if
the paragraph has ``LEAST_OVERLAP`` of the word triples of a template of that family, or the template has
that share of the paragraph's; others count as unknown.

Null and empty texts have no paragraphs. Rows are handled one by one, so repeated rows, null ids,
empty tables and further columns need no care.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linecite.llm.common import hash_share

FEATURES = 2048
#: Lines of the corpus among the examples, at most about; made-up examples per class.
CORPUS_LINES = 300
EXAMPLES = 120
FALSE_SHARE = 0.01
LEAST_OVERLAP = 0.6
SEED = 23
NONE = "none"

# The usual short notices of each licence family.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the MIT License, see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation.",
        "Licensed under the GPL version 2 or later.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General "
        "Public License.",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced without prior written permission.",
        "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited.",
    ],
}
CUES = (
    r"(?i)licen[cs]|copyright|public domain|warrant|redistribut|permission is|rights reserved"
    r"|creative commons|\bcc[ -]?by|\bcc0|\bgpl|\bmit\b|proprietary|spdx|unauthorized copying"
)
_ORDINARY = [
    "the driver showed a license and the officer let the car pass",
    "she lost her fishing licence near the public park",
    "copyright disputes in the music business take years",
    "the warranty of the machine ended in spring",
    "a search warrant was issued by the court on monday",
    "permission is needed to enter the north gate",
    "the team has the license to broadcast all games of the season",
    "poetic license is what the writer asked for",
    "the product comes with a two year warranty on all parts",
    "students of mit built a bridge of paper",
    "pilots renew the licence after a test of their eyes",
    "the state will redistribute the funds among the schools",
]


def words_of(text: str) -> list[str]:
    return [w for w in re.sub("[^a-z0-9]+", " ", text.lower()).split(" ") if w]


def feature_ids(text: str) -> list[int]:
    """Hashed n-grams of one to three words, each once. The scan's expressions give the same."""
    words = words_of(text)
    grams = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    return sorted({xxhash.xxh64_intdigest(g, 42) % FEATURES for g in grams})


@dataclass(frozen=True)
class LicenseModel:
    families: list[str]
    #: One row per class, the first for none.
    weights: np.ndarray
    biases: np.ndarray
    least: float

    def probabilities(self, text: str) -> np.ndarray:
        ids = feature_ids(text)
        logits = self.biases + self.weights[:, ids].sum(axis=1) / max(1, len(ids)) ** 0.5
        odds = np.exp(logits - logits.max())
        return odds / odds.sum()


def examples(lines: list[str], per_class: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, int]]:
    """Made-up paragraphs with their class; ``lines`` of the corpus are none."""
    pick = random.Random(seed)
    plain = [w for line in _ORDINARY for w in line.split()]
    filler = plain + [w for line in lines for w in line.split()[:20]]

    def some(n: int) -> list[str]:
        return [pick.choice(filler) for _ in range(pick.randint(0, n))]

    out = []
    for label, family in enumerate(TEMPLATES, 1):
        for i in range(per_class):
            words = TEMPLATES[family][i % len(TEMPLATES[family])].split()
            if len(words) > 12 and pick.random() < 0.3:
                words = words[: pick.randint(9, len(words))]
            words = [w for w in words if pick.random() > 0.04]
            out.append((" ".join(some(8) + words + some(8)), label))
    for i in range(3 * per_class):
        words = pick.choice(_ORDINARY).split()
        pick.shuffle(words) if i % 3 == 0 else None
        out.append((" ".join(some(6) + words + some(6)), 0))
    return out + [(line, 0) for line in lines]


def fit(lines: list[str], rounds: int = 150, rate: float = 4.0) -> LicenseModel:
    """Softmax regression by gradient descent, threshold from every fourth example."""
    rows = examples(lines)
    x = np.zeros((len(rows), FEATURES), np.float32)
    for i, (text, _) in enumerate(rows):
        ids = feature_ids(text)
        x[i, ids] = 1 / max(1, len(ids)) ** 0.5
    y = np.array([label for _, label in rows])
    fitting = np.arange(len(rows)) % 4 != 3
    classes = len(TEMPLATES) + 1
    target = np.eye(classes, dtype=np.float32)[y[fitting]]
    weights, biases = np.zeros((classes, FEATURES), np.float32), np.zeros(classes, np.float32)
    own = x[fitting]
    for _ in range(rounds):
        logits = own @ weights.T + biases
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        error = odds / odds.sum(axis=1, keepdims=True) - target
        weights -= rate * (error.T @ own / len(own) + 1e-4 * weights)
        biases -= rate * error.mean(axis=0)
    model = LicenseModel([NONE, *TEMPLATES], weights.astype(float), biases.astype(float), 0.5)
    without = [model.probabilities(t)[1:].max() for (t, label), f in zip(rows, fitting) if not f and label == 0]
    least = float(np.quantile(without, 1 - FALSE_SHARE)) if without else 0.5
    return LicenseModel(model.families, model.weights, model.biases, min(0.95, max(0.5, least)))


def train(docs: DataFrame, lines: int = CORPUS_LINES) -> LicenseModel:
    """Fit to the templates and one line each of about ``lines`` sampled texts without a cue."""
    share = lines / max(1, docs.count())
    parts = F.split(F.col("text"), "\n")
    line = F.element_at(parts, (F.pmod(F.xxhash64("text"), F.size(parts)) + 1).cast("int"))
    rows = docs.where(hash_share(F.col("doc_id"), share, "license")).where("text is not null")
    found = rows.select(line.alias("line")).where(~F.col("line").rlike(CUES)).limit(2 * lines).collect()
    return fit(sorted(r["line"] for r in found))


# ---- scoring --------------------------------------------------------------------------------


def _numbers(values: np.ndarray) -> Column:
    """A constant array, spelled as text so that the plan holds one literal."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def _grams(words: Column, n: int) -> Column:
    count = F.size(words) - (n - 1)
    return F.when(
        count > 0,
        F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")),
    ).otherwise(F.array().cast("array<string>"))


def _softmax_best(line: Column, model: LicenseModel, weights: Column) -> Column:
    """``label, p, triples`` of a paragraph."""
    words = F.filter(F.split(F.regexp_replace(F.lower(line), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    parts = F.struct(words.alias("words"))
    with_grams = F.transform(
        F.array(parts),
        lambda s: F.struct(
            F.array_distinct(
                F.transform(
                    F.concat(*[_grams(s["words"], n) for n in (1, 2, 3)]),
                    lambda g: F.pmod(F.xxhash64(g), F.lit(FEATURES).cast("long")).cast("int"),
                )
            ).alias("ids"),
            F.array_distinct(_grams(s["words"], 3)).alias("triples"),
        ),
    )

    def scored(s: Column) -> Column:
        scale = F.sqrt(F.greatest(F.size(s["ids"]), F.lit(1)).cast("double"))

        def logit(label: int) -> Column:
            place = label * FEATURES + 1
            total = F.aggregate(s["ids"], F.lit(0.0), lambda a, i: a + F.element_at(weights, i + place))
            return F.lit(float(model.biases[label])) + total / scale

        logits = F.array(*[logit(label) for label in range(len(model.biases))])
        return F.struct(logits.alias("logits"), s["triples"].alias("triples"))

    def best(s: Column) -> Column:
        top = F.array_max(s["logits"])
        odds = F.aggregate(s["logits"], F.lit(0.0), lambda a, v: a + F.exp(v - top))
        return F.struct(
            (F.array_position(s["logits"], top).cast("int") - 1).alias("label"),
            (F.lit(1.0) / odds).alias("p"),
            s["triples"].alias("triples"),
        )

    return F.element_at(F.transform(F.transform(with_grams, scored), best), 1)


def _confirmed(family: str, triples: Column) -> Column:
    """Whether the paragraph and a template of the family share enough word triples."""
    tests = []
    for text in TEMPLATES[family]:
        words = words_of(text)
        own = sorted({" ".join(words[i : i + 3]) for i in range(len(words) - 2)})
        common = F.size(F.array_intersect(F.array(*[F.lit(t) for t in own]), triples))
        tests.append(common >= F.lit(LEAST_OVERLAP * len(own)))
        tests.append((common >= 3) & (common >= F.size(triples) * LEAST_OVERLAP))
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return result


def scan_licenses(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``n_cues, licenses, n_confirmed, n_unknown, score``.

    ``n_cues`` counts paragraphs with a cue, ``licenses`` lists the confirmed families in order, joined by
    commas, ``n_unknown`` counts paragraphs that look like a licence but are not confirmed, ``score`` is the
    largest probability of a confirmed paragraph, else 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    weights = _numbers(model.weights.ravel())
    cued = F.when(
        text.rlike(CUES), F.filter(F.split(text, "\n"), lambda line: line.rlike(CUES))
    ).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), cued.alias("lines"))
    rows = rows.select(
        "doc_id", "lines", F.transform("lines", lambda line: _softmax_best(line, model, weights)).alias("found")
    )

    def judged(f: Column) -> Column:
        family = F.lit(None).cast("string")
        for label, name in enumerate(model.families):
            if label:
                family = F.when((f["label"] == label) & _confirmed(name, f["triples"]), F.lit(name)).otherwise(family)
        return F.struct(
            family.alias("family"),
            f["p"].alias("p"),
            ((f["label"] > 0) & (f["p"] >= model.least)).alias("likely"),
        )

    rows = rows.select("doc_id", "lines", F.transform("found", judged).alias("found"))
    good = F.filter("found", lambda f: f["likely"] & f["family"].isNotNull())
    rows = rows.select("doc_id", "lines", "found", good.alias("good"))
    return rows.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_cues"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("good", lambda f: f["family"]))), ",").alias("licenses"),
        F.size("good").cast("long").alias("n_confirmed"),
        F.size(F.filter("found", lambda f: f["likely"] & f["family"].isNull())).cast("long").alias("n_unknown"),
        F.coalesce(F.array_max(F.transform("good", lambda f: f["p"])), F.lit(0.0)).alias("score"),
    )
