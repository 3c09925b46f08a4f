"""Operator 2, licence scans of paragraphs: n-gram logistic regression, then templates.

Paragraphs end at blank lines. In each, every stretch of words that begins with a 2-gram of a template and ends
with another that it has not had before, has ``CONFIRM`` of that template's 2-grams and at most ``2 * length + SLACK`` words (length: the template's)
is a window, over line breaks and wherever it stands. A window
is described by how often the word 1- and 2-grams of the licence templates occur in it. A logistic regression over these sparse counts gives a licence family or
the class unknown; its scores are calibrated by a temperature fitted on examples that
were not trained on: in each of ``TURNS`` turns other families are left out of training, and their
examples count as unknown ones. A family below ``LEAST_CHANCE`` counts as unknown. A prediction holds
only for windows of that family's templates; of windows that share words, the one with most of a template's
2-grams stays.

The examples are made here: templates with words dropped, changed and put around them, against
shuffled template words and at most ``2 * SAMPLE`` paragraphs of the corpus, drawn by a hash
and left out where a template would confirm them. The model is a few thousand numbers.

Edge cases: null and empty texts have no licence; licences are found in any paragraph, however
long the text; repeated rows are scanned each; rows with null ids too; an empty table
gives no rows; other columns pass through, unless they have a result's name.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import ALNUM, U64, VISIBLE, blocks, flat, lower, mix, widen, widened, word_hashes, words

SAMPLE = 2000
SAMPLE_BYTES = 2000
STEPS, RATE, DECAY = 200, 0.2, 1e-4
TURNS = 4
LEAST_CHANCE, CONFIRM, SLACK = 0.5, 0.6, 6
UNKNOWN = "unknown"

# Short notices by which the families are known.
TEMPLATES = {
    "agpl": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL-3.0."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Released under the Apache License 2.0."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.", "Licensed under the GPL-3.0."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the LGPL-2.1."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the MPL-2.0."],
    "public-domain": ["This work has been dedicated to the public domain.", "Released under CC0 1.0 Universal."],
    "reserved": ["All rights reserved.", "Copyright 2020. All rights reserved.", "No part of this publication may be reproduced without prior written permission of the publisher."],
}


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of 1-grams and of 2-grams (0 where a paragraph ends), paragraphs' offsets into words, texts' into paragraphs, words."""
    data, offsets = flat(texts)
    data = lower(data)
    starts, ends, at = words(data, offsets, ALNUM)
    one = word_hashes(data, starts, ends)
    # a line break with nothing but white space since the one before ends a blank line
    lines = np.flatnonzero(data == 10)
    seen = np.cumsum(VISIBLE[data], dtype=np.int64)[lines]
    blank = np.zeros(len(data), bool)
    blank[lines[1:][seen[1:] == seen[:-1]]] = True
    breaks = np.r_[0, np.cumsum(blank)]
    new = np.r_[True, breaks[starts[1:]] > breaks[starts[:-1]]] if len(starts) else np.zeros(0, bool)
    new[at[:-1][np.diff(at) > 0]] = True
    first = np.flatnonzero(new)
    two = np.zeros(len(one), U64)
    if len(one):
        two[:-1] = mix(one[:-1] * U64(3) + one[1:] * U64(5))
        two[np.r_[first[1:], len(one)] - 1] = 0
    return one, two, np.r_[first, len(one)], np.searchsorted(first, at), starts, ends


class Classifier:
    def __init__(self, negatives: list[str], seed: int = 7):
        rng = random.Random(seed)
        self.families = [UNKNOWN, *TEMPLATES]
        notices = [(f, t) for f, own in TEMPLATES.items() for t in own]
        one, two, at, _, _, _ = _grams(pa.array([t for _, t in notices]))
        self.vocabulary = np.unique(np.r_[one, two[two != 0]])
        self.templates: dict[str, list[set[int]]] = {f: [] for f in TEMPLATES}
        for (f, _), a, b in zip(notices, at, at[1:]):
            self.templates[f].append({int(x) for x in two[a : b - 1]})
        vocabulary = sorted({w for _, t in notices for w in t.split()})
        texts, label = [], []
        for f, t in notices:
            for _ in range(40):
                w = [x for x in t.split() if rng.random() > 0.06]
                w = [str(rng.randint(1, 2030)) if x.isdigit() and rng.random() < 0.3 else x for x in w]
                around = rng.sample(vocabulary, 2) + ["the", "project", "file", "Copyright", "2021", "by", "authors"]
                w = rng.choices(around, k=rng.choice([0, 0, 0, 1, 3])) + w + rng.choices(around, k=rng.choice([0, 0, 0, 1, 3]))
                texts.append(" ".join(w))
                label.append(self.families.index(f))
        for _ in range(600):
            texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(1, 20))))
            label.append(0)
        texts += [t for t in negatives if not self.confirmed_any(t)]
        label += [0] * (len(texts) - len(label))
        x, y = self._counts(texts), np.array(label)
        fold = np.arange(len(y)) % 5 == 0
        scores, truth = [], []
        for k in range(TURNS):
            away = (y > 0) & (y % TURNS == k)
            scores.append(x[fold] @ self._fitted(x[~fold & ~away], y[~fold & ~away]))
            truth.append(np.where(away, 0, y)[fold])
        score, own = np.concatenate(scores), np.concatenate(truth)
        self.loss = {t: -np.log(self._softmax(score / t)[np.arange(len(own)), own] + 1e-12).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
        self.temperature = min(self.loss, key=self.loss.get)
        self.weights = self._fitted(x[~fold], y[~fold])

    def confirmed_any(self, text: str) -> bool:
        _, two, _, _, _, _ = _grams(pa.array([text.replace("\n", " ")]))
        return any(self.confirms(f, two) for f in self.templates)

    def confirms(self, family: str, two: np.ndarray) -> float:
        """The largest share of a template's 2-grams that the paragraph has, or 0 under ``CONFIRM``."""
        own = set(two.tolist())
        best = max(len(own & t) / max(len(t), 1) for t in self.templates[family])
        return best if best >= CONFIRM else 0.0

    def known(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of grams that the templates have, and their numbers."""
        number = np.minimum(np.searchsorted(self.vocabulary, grams), len(self.vocabulary) - 1)
        place = np.flatnonzero(self.vocabulary[number] == grams)
        return place, number[place]

    def _counts(self, texts: list[str]) -> np.ndarray:
        one, two, at, _, _, _ = _grams(pa.array([t.replace("\n", " ") or "-" for t in texts]))
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        out = np.zeros((len(texts), len(self.vocabulary) + 1))
        for grams in (one, two):
            place, number = self.known(grams)
            np.add.at(out, (row[place], number), 1)
        out /= np.maximum(2 * np.diff(at) - 1, 1)[:, None] / 4
        out[:, -1] = 1
        return out

    def _windows(self, two: np.ndarray, row: np.ndarray) -> np.ndarray:
        """First word, word after the last, family, 2-grams of the template and the template's own, for each window."""
        places, _ = self.known(two)
        found = []
        for f, family in enumerate(self.families[1:], 1):
            for template in self.templates[family]:
                at = places[np.isin(two[places], np.array(list(template), U64))]
                least = max(int(np.ceil(CONFIRM * len(template) - 1e-9)), 1)
                reach = 2 * (len(template) + 1) + SLACK - 2
                if len(at) < least:
                    continue
                first, last = at[: len(at) - least + 1], at[least - 1 :]
                for i in np.flatnonzero((last - first <= reach) & (row[first] == row[last])).tolist():
                    own: set[int] = set()
                    for p in at[i : i + reach + 1].tolist():
                        if p - at[i] > reach or row[p] != row[at[i]]:
                            break
                        fresh = int(two[p]) not in own
                        own.add(int(two[p]))
                        if fresh and len(own) >= least:
                            found.append((at[i], p + 2, f, len(own), len(template)))
        return np.array(found, np.int64).reshape(-1, 5)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def _fitted(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Weights of a logistic regression, by Adam."""
        target = np.eye(len(self.families))[y]
        weights = np.zeros((x.shape[1], len(self.families)))
        m, v = np.zeros_like(weights), np.zeros_like(weights)
        for k in range(1, STEPS + 1):
            grad = x.T @ (target - self._softmax(x @ weights)) / len(y) - DECAY * weights
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            weights = weights + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        return weights

    def scan(self, texts: pa.Array) -> list[list[dict]]:
        """The confirmed licence paragraphs of each text."""
        one, two, at, _, starts, ends = _grams(texts)
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        if not len(one):
            return out
        windows = self._windows(two, np.repeat(np.arange(len(at) - 1), np.diff(at)))
        if not len(windows):
            return out
        a, b, family = windows[:, 0], windows[:, 1], windows[:, 2]
        scores = np.zeros((len(windows), len(self.families)))
        for grams, last in ((one, b), (two, b - 1)):
            place, number = self.known(grams)
            total = np.concatenate((np.zeros((1, len(self.families))), np.cumsum(self.weights[number], axis=0)))
            scores += total[np.searchsorted(place, last)] - total[np.searchsorted(place, a)]
        scores = scores * 4 / (2 * (b - a) - 1)[:, None] + self.weights[-1]
        chance = self._softmax(scores / self.temperature)
        chance = np.where(chance.argmax(1) == family, chance.max(1), 0.0)
        share = windows[:, 3] / windows[:, 4]
        offsets = flat(texts)[1]
        taken = np.zeros(len(one), bool)
        for k in np.lexsort((a, -chance, -share, -windows[:, 3])).tolist():
            if chance[k] < LEAST_CHANCE or taken[a[k] : b[k]].any():
                continue
            taken[a[k] : b[k]] = True
            i = int(np.searchsorted(offsets, starts[a[k]], "right")) - 1
            out[i].append({"start": int(starts[a[k]] - offsets[i]), "end": int(ends[b[k] - 1] - offsets[i]), "family": self.families[family[k]], "chance": float(chance[k]), "template_share": float(share[k])})
        for found in out:
            found.sort(key=lambda x: x["start"])
        return out


_KIND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("chance", pa.float64()), ("template_share", pa.float64())]))


def train(docs: DataFrame) -> Classifier:
    """A classifier whose unknown class has seen paragraphs of these documents."""
    small = docs.select("text").where((F.octet_length("text") <= 8 * SAMPLE_BYTES) & F.col("text").isNotNull())
    n = docs.count()
    chosen = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, SAMPLE / 4 / max(n, 1)) * (1 << 30))
    paragraphs = [p for r in small.where(chosen).collect() for p in r.text.split("\n") if 0 < len(p) <= SAMPLE_BYTES]
    # those of the least digests, so that the model doesn't follow the order in which rows arrive
    paragraphs.sort(key=lambda p: blake2b(p.encode(), digest_size=8).digest())
    return Classifier(paragraphs[: 2 * SAMPLE])


def _scan(batches: Iterator[pa.RecordBatch], model: Classifier) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches):
        yield widen(part, ["licenses"], [pa.array(model.scan(part.column("text")), _KIND)])


def scan_licenses(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` with licenses: span (byte offsets), family, calibrated chance and share of the best template for each licence paragraph."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = widened(docs.schema, "licenses array<struct<start:bigint,end:bigint,family:string,chance:double,template_share:double>>")
    return docs.mapInArrow(lambda batches: _scan(batches, shared.value), schema)


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_licenses(docs, train(docs))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"]))), ",")
    return found.select("doc_id", F.size("licenses").cast("bigint").alias("n_licenses"), families.alias("families"), F.coalesce(F.array_max(F.transform("licenses", lambda x: x["chance"])), F.lit(0.0)).alias("score"))
