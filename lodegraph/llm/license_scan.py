"""Licence scan: a trained paragraph classifier whose predictions are confirmed against templates.

A paragraph is a line with a word, or a run of neighbouring lines that a notice is wrapped over.  It is described by the
word unigrams and bigrams in it.  A sparse multinomial logistic regression gives the probability of each licence
family and of none; it is fitted on the driver, on the templates below (with words left out at random), on fixed ordinary
sentences and on a bounded sample of the corpus's own lines.  Cutoffs are calibrated on sources that the
scoring fit has not seen, all copies and variants of a source being in one fold: that of a family on
held-out templates and ordinary lines, that of the class ``unknown`` on whole families left out of a fit, as
logistic calibration of the chance that a paragraph is a licence at all.  A paragraph is of a family if
that family's probability reaches the cutoff *and* enough of the paragraph's n-grams stand in one of the
family's templates; any other that reaches the second cutoff is ``unknown``.

Scanning uses DataFrame functions only.  A paragraph cannot reach a cutoff without one of
the model's *anchors*: the words outside the anchors have positive weights that, all of
them together, would not lift any family to it.  Lines without an anchor are
therefore passed over, exactly, before their n-grams are looked up, and end a run.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Public licence notices by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
}
#: Sentences that are no licence notices.
ORDINARY = [
    "The driver must carry a valid license at all times.", "Her license plate was lost on the road to the coast.",
    "This program is broadcast every Sunday at nine.", "He was granted permission to leave the city.",
    "The software was installed on all the machines.", "The terms of the treaty were published in the spring.",
    "A public meeting was held under the old bridge.", "The foundation supports free concerts for the general public.",
    "You may not enter this room without a ticket.", "Version two of the plan was released in May.",
    "The copy in the library is bound in red leather.", "The use of the source was permitted by the council.",
]
FAMILIES = tuple(sorted(TEMPLATES))
NONE = len(FAMILIES)
_SPLIT = "[^\\p{L}\\p{N}]+"


def grams_of(text: str) -> set[str]:
    """Lower-case unigrams and bigrams of runs of letters and digits."""
    words = "".join(c if c.isalpha() or c.isnumeric() else " " for c in text.lower()).split()
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}  # noqa: B905


@dataclass
class Classifier:
    """``weights[gram]``: one for each family and for none; a family needs ``cutoff``, a licence of any kind ``known``."""

    weights: dict[str, list[float]]
    bias: list[float]
    cutoff: float
    known: float
    anchors: list[str]


def _softmax(z: list[float]) -> list[float]:
    top = max(z)
    e = [math.exp(x - top) for x in z]
    total = sum(e)
    return [x / total for x in e]


@dataclass
class Source:
    """A text with its variants: they are learned from, or scored, together."""

    rows: list[set[str]]
    label: int


def sources_of(lines: list[str], rng: random.Random) -> list[Source]:
    """Templates, ordinary sentences and distinct lines of the corpus; a line most of which stands in a template is left out."""
    of_family = _grams_by_family()

    def variant(text: str) -> str:
        words = text.split()
        return " ".join(w for w in words if rng.random() > 0.08) or text

    out = [Source([grams_of(t)] * 3 + [grams_of(variant(t)) for _ in range(7)], k) for k, f in enumerate(FAMILIES) for t in TEMPLATES[f]]
    plain = [Source([grams_of(t)] * 3, NONE) for t in ORDINARY] + [Source([grams_of(t)], NONE) for t in dict.fromkeys(lines)]
    return out + [x for x in plain if x.rows[0] and max(len(x.rows[0] & own) for own in of_family) < 0.5 * len(x.rows[0])]


def _grams_by_family() -> list[set[str]]:
    return [set().union(*map(grams_of, TEMPLATES[f])) for f in FAMILIES]


def _probabilities(weights: dict[str, list[float]], bias: list[float], grams: set[str]) -> list[float]:
    z = list(bias)
    for g in grams:
        if g in weights:
            z = [a + b for a, b in zip(z, weights[g], strict=True)]
    return _softmax(z)


def fit(sources: list[Source], rng: random.Random, epochs: int, rate: float, sparsity: float) -> tuple[dict[str, list[float]], list[float]]:
    """Weights and biases by stochastic gradient steps with soft thresholding."""
    vocabulary = set().union(*[x.rows[0] for x in sources if x.label != NONE])
    # an n-gram of no template tells nothing and has no weight
    rows = [(g & vocabulary, x.label) for x in sources for g in x.rows]
    weights: dict[str, list[float]] = {}
    bias = [0.0] * (NONE + 1)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        rng.shuffle(rows)
        for grams, label in rows:
            p = _probabilities(weights, bias, grams)
            d = [step * ((k == label) - x) for k, x in enumerate(p)]
            bias = [a + b for a, b in zip(bias, d, strict=True)]
            for g in grams:
                w = weights.setdefault(g, [0.0] * (NONE + 1))
                for k, x in enumerate(d):
                    v = w[k] + x
                    w[k] = math.copysign(max(0.0, abs(v) - sparsity * step), v)
    return weights, bias


def train(lines: list[str], seed: int = 5, epochs: int = 25, rate: float = 0.3, sparsity: float = 2e-4, folds: int = 4) -> Classifier:
    """The classifier of all sources, with cutoffs from fits that had not seen what they score; ``lines`` are the corpus's sample."""
    rng = random.Random(seed)
    sources = sources_of(lines, rng)
    order = list(range(len(sources)))
    rng.shuffle(order)
    fold = {i: place % folds for place, i in enumerate(order)}
    of_family: list[float] = []  # of held-out templates: their own family's probability
    plain: list[float] = []  # of held-out ordinary lines: the probability of any licence
    for k in range(folds):
        model = fit([x for i, x in enumerate(sources) if fold[i] != k], rng, epochs // 2, rate, sparsity)
        for i, x in enumerate(sources):
            if fold[i] == k:
                p = [_probabilities(*model, g) for g in x.rows]
                if x.label == NONE:
                    plain.append(1 - p[0][NONE])
                else:
                    of_family += [q[x.label] for q in p]
    foreign: list[float] = []  # of families that the fit knew nothing of: the probability of any licence
    for k in range(NONE):
        model = fit([x for x in sources if x.label != k], rng, epochs // 2, rate, sparsity)
        foreign += [1 - _probabilities(*model, x.rows[0])[NONE] for x in sources if x.label == k]
    plain.sort()
    of_family.sort()
    high = plain[len(plain) * 99 // 100] if plain else 0.5
    cutoff = min(0.9, max(0.5, (of_family[len(of_family) // 20] + high) / 2))
    known = min(0.99, max(calibrated(foreign, plain), cutoff))
    weights, bias = fit(sources, rng, epochs, rate, sparsity)
    return Classifier(weights, bias, cutoff, known, _anchors(weights, bias, cutoff))


def calibrated(licences: list[float], others: list[float], least: float = 0.8) -> float:
    """The raw probability from which a paragraph is a licence with a chance of ``least``: Platt's logistic fit, both classes weighing the same."""
    if not licences or not others:
        return 0.5
    logit = lambda p: math.log(min(max(p, 1e-9), 1 - 1e-9) / (1 - min(max(p, 1e-9), 1 - 1e-9)))
    # Platt's targets: no certainty from few rows
    rows = [(logit(p), (len(licences) + 1) / (len(licences) + 2), 0.5 / len(licences)) for p in licences]
    rows += [(logit(p), 1 / (len(others) + 2), 0.5 / len(others)) for p in others]
    a, b = 1.0, 0.0
    for _ in range(500):
        ga = gb = 0.0
        for x, t, w in rows:
            d = w * (t - 1 / (1 + math.exp(-max(-40.0, min(40.0, a * x + b)))))
            ga, gb = ga + d * x, gb + d
        a, b = max(0.05, a + 0.2 * ga), b + 0.5 * gb
    x = (math.log(least / (1 - least)) - b) / a
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _anchors(weights: dict[str, list[float]], bias: list[float], cutoff: float) -> list[str]:
    """Words such that the n-grams without any of them cannot lift the families together to ``cutoff`` against none."""
    need = math.log(cutoff / (1 - cutoff)) - math.log(NONE)  # some family must lead none by this much
    gain = {g: [max(0.0, w[k] - w[NONE]) for k in range(NONE)] for g, w in weights.items()}
    anchors: list[str] = []
    left = dict(gain)
    while True:
        over = [sum(v[k] for v in left.values()) + bias[k] - bias[NONE] - need for k in range(NONE)]
        worst = max(range(NONE), key=over.__getitem__)
        if over[worst] < -1e-6 or not left:
            return sorted(anchors)
        share: dict[str, float] = {}
        for g, v in left.items():
            for word in set(g.split()):
                share[word] = share.get(word, 0.0) + v[worst]
        # short common words make poor anchors
        best = max(share, key=lambda w: share[w] * min(len(w), 8))
        anchors.append(best)
        left = {g: v for g, v in left.items() if best not in g.split()}


def sampled_lines(docs: DataFrame, rows: int) -> list[str]:
    """At most ``rows`` documents' first and last lines for the fit, by a hash of the id and text."""
    order = F.xxhash64(F.lit(17), "doc_id", "text")
    text = F.split(F.col("text"), "\n")
    chosen = docs.select(order.alias("h"), F.get(text, F.lit(0)).alias("a"), F.element_at(text, -1).alias("b"))
    return [x for r in C.smallest(chosen, F.col("h"), rows, docs.count(), ("a", "b")).collect() for x in (r["a"], r["b"]) if x]


def _classified(words: Column, model: Classifier) -> Column:
    """``(licence, p, share, family)`` of a paragraph's words: the chance of any licence, and the best family's chance and share of n-grams."""
    of_family = _grams_by_family()
    vocabulary = sorted(set().union(*of_family))
    known = F.array(*map(F.lit, vocabulary))
    weight = [F.array(*[F.lit(float(model.weights.get(g, [0.0] * (NONE + 1))[k])) for g in vocabulary]) for k in range(NONE + 1)]
    stands = [F.array(*[F.lit(float(g in own)) for g in vocabulary]) for own in of_family]
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    grams = F.array_distinct(F.concat(words, F.filter(pairs, lambda x: x.isNotNull())))

    def of(g: Column) -> Column:
        n = F.size(g)

        def rate(at: Column) -> Column:
            total = lambda table: F.aggregate(at, F.lit(0.0), lambda s, i: s + F.element_at(table, i))
            raised = F.array(*[F.exp(total(weight[k]) + F.lit(model.bias[k])) for k in range(NONE + 1)])

            def best(e: Column) -> Column:
                every = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
                options = F.array(*[F.struct((e[k] / every).alias("p"), (total(stands[k]) / n).alias("share"), F.lit(f).alias("family")) for k, f in enumerate(FAMILIES)])
                top = F.array_max(options)
                return C.let(top, lambda t: F.struct((1 - e[NONE] / every).alias("licence"), t["p"].alias("p"), t["share"].alias("share"), t["family"].alias("family")))

            return C.let(raised, best)

        return C.let(F.transform(F.array_intersect(g, known), lambda x: F.array_position(known, x).cast("int")), rate)

    return C.let(grams, of)


def _runs(lines: Column, anchors: Column) -> Column:
    """Runs of neighbouring lines with an anchor, each an array of the lines' words."""
    none = F.array().cast("array<array<string>>")
    start = F.struct(F.array().cast("array<array<array<string>>>").alias("done"), none.alias("open"))
    closed = lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])

    def step(s: Column, words: Column) -> Column:
        hit = F.struct(s["done"].alias("done"), F.concat(s["open"], F.array(words)).alias("open"))
        return F.when(F.arrays_overlap(words, anchors), hit).otherwise(F.struct(closed(s).alias("done"), none.alias("open")))

    return F.aggregate(lines, start, step, closed)


def scan(docs: DataFrame, model: Classifier | None = None, sample_rows: int = 300, confirm: float = 0.6) -> DataFrame:
    """``(doc_id, n_paragraphs, n_licence, n_unknown, families)`` of every row of ``docs``.

    ``n_paragraphs`` counts lines with a word.  ``n_licence`` paragraphs belong to the ``families`` (sorted, distinct),
    ``n_unknown`` are licence notices of no known family; a run of lines none of which is of a family by itself, but which are
    together, counts as one.  A null or empty text has no paragraph; every row is scanned by itself, repeated ones included; a null
    id stays null.  Of families with equal probability the one with the larger share of n-grams counts, then the last by name.  A
    very long text or line is scanned whole, within its row.  Other columns of ``docs`` are not read.  No row leaves its task.
    """
    model = model or train(sampled_lines(docs, sample_rows))
    text = F.coalesce(F.col("text"), F.lit(""))
    anchors = F.array(*map(F.lit, model.anchors)) if model.anchors else F.array().cast("array<string>")
    rows = docs.select("doc_id", F.filter(F.split(text, "\n"), lambda x: x.rlike(C.NO_WHITE)).alias("_lines"))
    words = F.transform("_lines", lambda x: F.array_remove(F.split(F.lower(x), _SPLIT), ""))
    rows = rows.select("doc_id", F.size("_lines").cast("long").alias("n_paragraphs"), _runs(words, anchors).alias("_runs"))
    sure = lambda x: (x["p"] >= model.cutoff) & (x["share"] >= confirm)

    def of_run(run: Column) -> Column:
        def together(lines: Column) -> Column:
            one = C.let(_classified(F.flatten(run), model), lambda m: F.when(sure(m), F.array(m)).otherwise(lines))
            return F.when((F.size(run) > 1) & ~F.exists(lines, sure), one).otherwise(lines)

        return C.let(F.transform(run, lambda w: _classified(w, model)), together)

    rows = rows.select("doc_id", "n_paragraphs", F.flatten(F.transform("_runs", of_run)).alias("_found"))
    families = F.array_sort(F.array_distinct(F.transform(F.filter("_found", sure), lambda x: x["family"])))
    count = lambda test: F.size(F.filter("_found", test)).cast("long")
    unknown = lambda x: ~sure(x) & (x["licence"] >= model.known)
    return rows.select("doc_id", "n_paragraphs", count(sure).alias("n_licence"), count(unknown).alias("n_unknown"), families.alias("families"))
