"""Licence scans: a trained paragraph classifier whose predictions a template comparison confirms.

Paragraphs are lines, and where a template's word pairs are found across lines that no blank line parts,
the run of those lines; comment marks are no words. A multinomial logistic regression over hashed word
n-grams (1 to 3) tells the licence families, notices of other licences (``unknown``) and ordinary prose
(``none``) apart. It is trained on variants of the families' usual notices, on variants of some other
licences' notices, on templates whose telling words are replaced, and on paragraphs of a bounded sample of
documents. Temperature and the biases of
``unknown`` and ``none`` are then calibrated on further variants, on prose that was held out, and on
notices of licences that were not trained on. A predicted family counts only if one of its templates can be
aligned with the paragraph: most words in order, all words that tell it from similar templates of other
families, its version among them, and none of theirs between. Otherwise the class is unknown. The sentence
that opens both BSD licences is told by the clauses that follow it.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import ShingleHasher, mix, sample_keys, text_batches

# Families and phrases of their usual notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    "isc": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "lgpl-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "lgpl-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "agpl-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "bsd-2-clause": ("Licensed under the BSD 2-Clause License.",),
    "bsd-3-clause": ("Licensed under the BSD 3-Clause License.",),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "epl-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0."),
    "bsl-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0-1.0": ("Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "proprietary": ("All rights reserved.", "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher."),
}
# Notices of other licences, of which the first teach the unknown class and the second calibrate it.
OTHERS = (
    "Licensed under the Open Software License version 3.0.",
    "Licensed under the Academic Free License version 3.0.",
    "This package is licensed under the Artistic License 2.0.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License, Version 1.0. You may not use this file except in compliance with the License.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "This software is provided as is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Use of this source code is governed by a license that can be found in the LICENSE file.",
    "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "Permission to copy and use this software is granted to any person, provided that this notice appears in all copies.",
)
HELD_OUT = (
    "Licensed under the Microsoft Public License.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Distributed under the terms of the Python Software Foundation License, version 2.",
    "Permission to use, copy, modify and distribute this software and its documentation for any purpose is hereby granted without fee.",
    "Licensed under the Educational Community License, Version 2.0.",
    "This software is released under the PostgreSQL License.",
)
FAMILIES = tuple(TEMPLATES)
NONE, UNKNOWN, BSD = "none", "unknown", "bsd"
CLASSES = (*FAMILIES, UNKNOWN, NONE)
DIMS, ORDERS = 1 << 15, 3
#: A paragraph looks like a licence from this probability on; a template needs CONFIRMED of its words in order, and
#: is looked for across lines where ANCHORED of its word pairs are near each other. Templates whose words overlap by
#: ALIKE must be told apart by the words that only one of them has.
LOOKS, CONFIRMED, ANCHORED, ALIKE = 0.5, 0.8, 0.6, 0.5
#: Shares of prose and of other licences' notices among the paragraphs that probabilities are calibrated for.
PROSE, UNKNOWNS = 0.6, 0.1


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


class Template:
    """The words of a phrase, those that tell it from other families' similar phrases, and those of theirs that must not be among them."""

    def __init__(self, family: int, phrase: str):
        self.family, self.words = family, words_of(phrase)
        self.needed, self.barred = {w for w in self.words if any(c.isdigit() for c in w)}, set()
        mine = set(self.words)
        for other, phrases in TEMPLATES.items():
            for theirs in (set(words_of(p)) for p in phrases if other != FAMILIES[family]):
                if len(mine & theirs) >= ALIKE * len(mine | theirs):
                    self.needed |= mine - theirs
                    self.barred |= theirs - mine

    def share(self, words: list[str]) -> float:
        """The share of the template's words that an alignment finds in ``words``; 0 if it is told to be another's."""
        blocks = [b for b in SequenceMatcher(None, words, self.words, autojunk=False).get_matching_blocks() if b.size]
        if not blocks:
            return 0.0
        matched = {w for b in blocks for w in words[b.a : b.a + b.size]}
        at = {i for b in blocks for i in range(b.a, b.a + b.size)}
        between = {w for i, w in enumerate(words) if blocks[0].a <= i <= blocks[-1].a + blocks[-1].size and i not in at}
        return 0.0 if self.needed - matched or self.barred & between else sum(b.size for b in blocks) / len(self.words)


ALL = [Template(f, p) for f, phrases in enumerate(TEMPLATES.values()) for p in phrases]


class FeatureHasher(ShingleHasher):
    """Word hashes for features, by polynomials modulo 2^64: two words that collide share a feature, which is no more than any two of DIMS do."""

    RATIO = 0x9E3779B97F4A7C15

    def polynomials(self, byte: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        power = np.full(len(byte) + 1, self.RATIO, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(byte * power[:-1], dtype=np.uint64)))
        back = np.full(len(byte) + 1, pow(self.RATIO, -1, 1 << 64), np.uint64)
        back[0] = 1
        return (sums[end] - sums[start]) * np.cumprod(back, out=back)[start]


class Features:
    """Hashed word n-grams of paragraphs; words are runs of letters and digits, A-Z as a-z."""

    def __init__(self):
        self.hasher = FeatureHasher()
        self.hasher.blank = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

    def of(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each n-gram, its order, its paragraph, sorted by paragraph within an order; word counts)."""
        h, at = self.hasher.words(data, offs)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        out, orders, rows = [], [], []
        g = np.zeros(len(h), np.uint64)
        for n in range(1, ORDERS + 1):
            m = max(len(h) - n + 1, 0)
            g = mix(g[:m] * np.uint64(0x9E3779B97F4A7C15) + h[n - 1 :] + np.uint64(n))
            same = row[:m] == row[n - 1 :]
            out.append(g[same])
            orders.append(np.full(int(same.sum()), n))
            rows.append(row[:m][same])
        return np.concatenate(out), np.concatenate(orders), np.concatenate(rows), np.diff(at)

    def of_texts(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        offs = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        return self.of(np.frombuffer(b"".join(raw), np.uint8), offs)

    def pairs_of(self, text: str) -> np.ndarray:
        grams, order, _, _ = self.of_texts([text])
        return np.unique(grams[order == 2])

    def pairs(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word with the next one, across paragraphs too; each word's paragraph)."""
        h, at = self.hasher.words(data, offs)
        one = mix(h + np.uint64(1))
        return mix(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] + np.uint64(2)), np.repeat(np.arange(len(at) - 1), np.diff(at))


def bins(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(49)).astype(np.int64)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


class Classifier:
    """Weights (DIMS x CLASSES) and biases, the temperature and the shift of each class that calibrate them."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias, self.temperature, self.shift = weights, bias, 1.0, np.zeros(len(bias))
        features = Features()
        self.pairs = [features.pairs_of(" ".join(t.words)) for t in ALL]
        self.known = np.unique(np.concatenate(self.pairs))

    def logits(self, grams: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, self.weights.shape[1]))
        at = bins(grams)
        used = self.weights[at].any(1) if len(at) else np.zeros(0, bool)
        row, at = np.divmod(np.unique(row[used] * DIMS + at[used]), DIMS)  # present or not
        for c in range(out.shape[1]):
            out[:, c] = np.bincount(row, self.weights[at, c], minlength=n)
        return out + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return _softmax(logits / self.temperature + self.shift)

    def confirms(self, family: int, words: list[str]) -> bool:
        """Whether a template of the family can be aligned with ``words``, and no other family's longer one."""
        mine = [len(t.words) for t in ALL if t.family == family and t.share(words) >= CONFIRMED]
        return bool(mine) and not any(len(t.words) > max(mine) and t.share(words) >= CONFIRMED for t in ALL if t.family != family)

    def paragraphs(self, data: np.ndarray, offs: np.ndarray, features: Features) -> list[tuple[int, str, float]]:
        """(paragraph, family or unknown, probability) of those that look like a licence."""
        grams, _, row, words = features.of(data, offs)
        p = self.probabilities(self.logits(grams, row, len(words)))
        out = []
        for i in np.flatnonzero(1 - p[:, -1] >= LOOKS).tolist():
            family = int(p[i, :-2].argmax())
            sure = p[i, family] >= p[i, -2] and self.confirms(family, words_of(data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")))
            out.append((i, FAMILIES[family] if sure else UNKNOWN, float(p[i, family]) if sure else float(1 - p[i, -1])))
        return out

    def wrapped(self, data: np.ndarray, offs: np.ndarray, block: np.ndarray, features: Features) -> list[tuple[int, int, str, float]]:
        """(first line, last line, family, probability) of notices that go over several lines of a block (-1: of none)."""
        pairs, line = features.pairs(data, offs)
        if not len(pairs):
            return []
        which = np.searchsorted(self.known, pairs).clip(max=len(self.known) - 1)
        hit = np.flatnonzero((self.known[which] == pairs) & (block[line[:-1]] == block[line[1:]]) & (block[line[1:]] >= 0))
        which, own, seen = which[hit], block[line[hit]], {}
        for t in self.pairs:
            mine = np.flatnonzero(np.isin(which, np.searchsorted(self.known, t)))
            need = math.ceil(ANCHORED * len(t))
            distinct = np.unique(own[mine] * len(self.known) + which[mine]) // len(self.known)
            blocks, count = np.unique(distinct, return_counts=True)
            for b in blocks[count >= need].tolist():
                at = mine[slice(*np.searchsorted(own[mine], (b, b + 1)))]
                for lo, hi in _windows(hit[at].tolist(), which[at].tolist(), need, 2 * len(t) + 20):
                    first, last = int(line[lo]), int(line[hi + 1])
                    if last > first and (first, last) not in seen:
                        a, z = offs[first], offs[last + 1]
                        seen[first, last] = self.paragraphs(data[a:z], np.array([0, z - a]), features)
        return [(first, last, family, p) for (first, last), judged in seen.items() for _, family, p in judged if family != UNKNOWN]


def _windows(at: list[int], which: list[int], need: int, width: int) -> Iterator[tuple[int, int]]:
    """Disjoint (first, last) of ``at`` no further apart than ``width`` with ``need`` or more distinct ``which``: the fullest, then narrowest."""
    i = 0
    while i < len(at):
        best, lo, counts = None, i, {}
        for r in range(i, len(at)):
            if best and at[r] > at[best[2]] + width:
                break
            counts[which[r]] = counts.get(which[r], 0) + 1
            while at[r] - at[lo] > width or counts[which[lo]] > 1:
                counts[which[lo]] -= 1
                if not counts[which[lo]]:
                    del counts[which[lo]]
                lo += 1
            rank = (len(counts), at[lo] - at[r])
            if rank[0] >= need and (not best or rank > best[:2]):
                best = (*rank, lo, r)
        if not best:
            return
        yield at[best[2]], at[best[3]]
        i = best[3] + 1


def merged(lines: list[tuple[int, str, float]], wrapped: list[tuple[int, int, str, float]], block: np.ndarray) -> list[tuple[int, str, float]]:
    """Notices of single lines and wrapped ones: a wrapped notice takes in unknown lines within it and is one notice of its family; unknown lines that follow each other in a block are one."""
    taken: list[tuple[int, int, str]] = []
    for first, last, family, p in sorted(wrapped, key=lambda x: (x[0] - x[1], x[0])):
        lines = [x for x in lines if x[1] != UNKNOWN or not first <= x[0] <= last]
        known = any(f == family and first <= i <= last for i, f, _ in lines) or any(f == family and a <= last and first <= b for a, b, f in taken)
        taken.append((first, last, family))
        if not known:
            lines.append((first, family, p))
    out: list[tuple[int, str, float]] = []
    end = -1
    for i, family, p in sorted(lines):
        if family == UNKNOWN and out and out[-1][1] == UNKNOWN and i == end + 1 and block[i] == block[end]:
            out[-1] = (out[-1][0], UNKNOWN, max(out[-1][2], p))
        else:
            out.append((i, family, p))
        end = i
    return out


def which_bsd(following: bytes) -> str:
    """The family that the clauses after the opening sentence of a BSD notice name."""
    plain = re.sub(rb"[^a-z0-9]+", b" ", following.lower())
    if b"redistributions in binary form must reproduce" not in plain:
        return UNKNOWN
    return "bsd-3-clause" if b"endorse or promote products" in plain else "bsd-2-clause"


def variants(prose: list[str], seed: int, each: int = 30, others: tuple[str, ...] = ()) -> tuple[list[str], list[int]]:
    """Notices, those of ``others`` as unknown ones, with words dropped, recased or surrounded by words of ``prose``; class numbers."""
    pick = random.Random(seed)
    words = [w for line in prose[:500] for w in line.split()] or ["the"]
    texts, classes = [], []
    for c, phrases in enumerate([*TEMPLATES.values(), others]):
        for phrase in phrases:
            for i in range(each):
                own = phrase.split()
                if i % 3 == 1 and len(own) > 8:
                    own = [w for w in own if pick.random() > 0.08]
                if i % 3 == 2 and len(own) > 12:
                    lo = pick.randrange(len(own) // 3)
                    own = own[lo : lo + max(8, len(own) * 2 // 3)]
                around = [pick.choice(words) for _ in range(pick.choice((0, 0, 3, 10, 40)))]
                at = pick.randrange(len(around) + 1)
                text = " ".join(around[:at] + own + around[at:])
                texts.append(text.upper() if i % 10 == 9 else text)
                classes.append(c)
    return texts, classes


def strangers(prose: list[str], seed: int, each: int = 4) -> tuple[str, ...]:
    """Notices of no licence: the words that tell a template from others are replaced by words of ``prose`` and other numbers."""
    pick = random.Random(seed)
    names = [w for line in prose[:500] for w in words_of(line) if len(w) > 3] or ["name"]
    out = []
    for t in ALL:
        if t.needed:
            for _ in range(each):
                new = {w: str(pick.randint(4, 9)) if w.isdigit() else pick.choice(names) for w in sorted(t.needed)}
                out.append(" ".join(new.get(w, w) for w in t.words))
    return tuple(out)


def train(prose: list[str], steps: int = 120, rate: float = 0.5, ridge: float = 1e-5) -> Classifier:
    """Fits on variants of the templates, OTHERS and ``strangers`` and on half of ``prose``; calibrates on other variants, HELD_OUT, other strangers and the other half."""
    phrases = {p.lower() for ps in TEMPLATES.values() for p in ps}
    clean = [p for p in prose if not any(x in p.lower() for x in phrases)]
    half = (len(clean) + 1) // 2
    features, k = Features(), len(CLASSES)

    def data(lines, seed, others, each):
        texts, classes = variants(lines, seed, each, others)
        # Ordinary prose, and single words of the notices out of order: neither is a notice.
        pick = random.Random(seed + 1)
        loose = [" ".join(pick.sample(words, min(len(words), pick.randint(1, 4)))) for ps in [*TEMPLATES.values(), others] for p in ps for words in [p.split()] for _ in range(8)]
        texts, y = texts + lines + loose, np.array(classes + [k - 1] * (len(lines) + len(loose)))
        grams, _, row, _ = features.of_texts(texts)
        return grams, row, y, (1 / np.bincount(y, minlength=k).clip(1))[y]

    grams, row, y, share = data(clean[:half], 1, OTHERS + strangers(clean[:half], 3, 2), 16)
    known = np.zeros(DIMS, bool)  # n-grams of no notice say nothing
    known[bins(features.of_texts([p for ps in [*TEMPLATES.values(), OTHERS] for p in ps])[0])] = True
    at = bins(grams)
    keep = known[at]
    row, at = np.divmod(np.unique(row[keep] * DIMS + at[keep]), DIMS)
    used, at = np.unique(at, return_inverse=True)
    order = np.argsort(at, kind="stable")
    by_bin, start = row[order], np.searchsorted(at[order], np.arange(len(used)))
    first = np.searchsorted(row, np.arange(len(y)))
    some = np.flatnonzero(np.bincount(row, minlength=len(y)))
    weights, bias, target = np.zeros((len(used), k)), np.zeros(k), np.eye(k)[y]
    speed_w, speed_b = np.full((len(used), k), 1e-8), np.full(k, 1e-8)
    for _ in range(steps):  # AdaGrad on all rows
        z = np.zeros((len(y), k))
        z[some] = np.add.reduceat(weights[at], first[some])
        error = (_softmax(z + bias) - target) * share[:, None]
        slope = np.add.reduceat(error[by_bin], start) + ridge * weights
        speed_w += slope**2
        speed_b += error.sum(0) ** 2
        weights -= rate * slope / np.sqrt(speed_w)
        bias -= rate * error.sum(0) / np.sqrt(speed_b)
    model = Classifier(np.zeros((DIMS, k), np.float32), bias)
    model.weights[used] = weights
    grams, row, y, share = data(clean[half:] or clean, 2, HELD_OUT + strangers(clean[half:], 4, 1), 8)
    part = np.where(y == k - 1, PROSE, np.where(y == k - 2, UNKNOWNS, (1 - PROSE - UNKNOWNS) / len(FAMILIES)))
    model.temperature, model.shift = calibrate(model.logits(grams, row, len(y)), y, share * part)
    return model


def calibrate(z: np.ndarray, y: np.ndarray, share: np.ndarray, steps: int = 400) -> tuple[float, np.ndarray]:
    """The temperature, and the shifts of unknown and none, with the least log loss of softmax(z / temperature + shift) on classes ``y``."""
    log_t, shift, target = 0.0, np.zeros(z.shape[1]), np.eye(z.shape[1])[y]
    speed = np.full(3, 1e-8)
    for _ in range(steps):
        scaled = z / math.exp(log_t)
        error = (_softmax(scaled + shift) - target) * share[:, None]
        slope = np.array([-(error * scaled).sum(), error[:, -2].sum(), error[:, -1].sum()])
        speed += slope**2
        step = 0.1 * slope / np.sqrt(speed)
        log_t -= step[0]
        shift[-2:] -= step[1:]
    return math.exp(log_t), shift


def fit(docs: DataFrame, rows: int = 200, lines: int = 2000, chars: int = 2000) -> Classifier:
    """Trains with prose from ``rows`` documents taken by a hash of the doc_id: at most ``lines`` lines, of at most ``chars`` characters."""
    known = docs.where("text is not null and doc_id is not null").select(F.xxhash64(F.col("doc_id").cast("long")).alias("_h"), F.col("text").cast("string").alias("text"))
    keys = sample_keys(docs.where("doc_id is not null"), F.xxhash64(F.col("doc_id").cast("long")), rows)
    short = F.filter(F.split("text", "\n"), lambda x: (F.length(x) <= chars) & (F.trim(x) != ""))
    sample = known.join(F.broadcast(keys), "_h").select("_h", F.slice(short, 1, max(1, 4 * lines // rows)).alias("lines")).limit(2 * rows).collect()  # ``rows`` keys
    sample.sort(key=lambda r: (r["_h"], r.lines))
    return train([line for r in sample for line in r.lines][:lines])


SCANNED = "doc_id long, n_paragraphs long, families array<string>, scores array<double>, positions array<int>"


def _scan(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, features = model.value, Features()
        for batch in batches:
            for lo, hi, data, offs in features.hasher.chunks(batch.column(1)):
                breaks = np.flatnonzero(data == 10) + 1
                starts = np.union1d(offs[:-1], breaks)
                bounds = np.append(starts, len(data)) if len(starts) and starts[-1] < len(data) else starts if len(starts) else np.array([0])
                if bounds[-1] != len(data):
                    bounds = np.append(bounds, len(data))
                doc = np.searchsorted(offs, bounds[:-1], "right") - 1
                filled = np.array([data[a:b].size > 0 and bool((~features.hasher.blank[data[a:b]]).any()) for a, b in zip(bounds[:-1], bounds[1:])], bool)
                count = np.bincount(doc[filled], minlength=hi - lo)
                fresh = np.append(True, ~filled[:-1] | (doc[1:] != doc[:-1])) & filled if len(filled) else filled
                block = np.where(filled, np.cumsum(fresh) - 1, -1)
                found: list[list[tuple[int, str, float]]] = [[] for _ in range(hi - lo)]
                first = np.searchsorted(doc, np.arange(hi - lo))
                notices = merged(own.paragraphs(data, bounds, features), own.wrapped(data, bounds, block, features), block)
                bsd = [i for i, family, _ in notices if family == BSD]
                for i, family, score in notices:
                    if family == BSD:
                        end = min([bounds[x] for x in bsd if x > i] + [offs[doc[i] + 1]])
                        family = which_bsd(data[bounds[i] : end].tobytes())
                    found[doc[i]].append((i - int(first[doc[i]]), family, score))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(count, pa.int64()), pa.array([[f for _, f, _ in x] for x in found], pa.list_(pa.string())), pa.array([[s for _, _, s in x] for x in found], pa.list_(pa.float64())), pa.array([[p for p, _, _ in x] for x in found], pa.list_(pa.int32()))],
                    ["doc_id", "n_paragraphs", "families", "scores", "positions"],
                )

    return run


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, n_paragraphs and, for each paragraph that looks like a licence, its family, score and position.

    Whole texts are read. Null, empty and blank texts have no paragraphs; a null doc_id stays null;
    repeated rows are scanned each; other columns are left out; an empty table gives an empty result.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS x classes
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan(shared), SCANNED)


def licenses(docs: DataFrame) -> DataFrame:
    """One row per document: its licence (the surest confirmed family, else unknown, else none), all families and counts.

    Columns doc_id, n_paragraphs, license, score, families (sorted, comma-joined), n_notices and n_unknown.
    Null, empty and blank texts have no paragraphs and the licence ``none`` with score 0; of equally sure
    families the last by name counts; other cases as in ``scan``.
    """
    rows = scan(docs, fit(docs))
    named = F.filter(F.arrays_zip("scores", "families"), lambda x: x["families"] != UNKNOWN)
    best = F.array_max(named)
    other = F.when(F.size("families") > 0, UNKNOWN).otherwise(NONE)
    return rows.select(
        "doc_id", "n_paragraphs", F.coalesce(best["families"], other).alias("license"), F.coalesce(best["scores"], F.array_max("scores"), F.lit(0.0)).alias("score"),
        F.array_join(F.array_sort(F.array_distinct("families")), ",").alias("families"), F.size("families").cast("long").alias("n_notices"), F.size(F.filter("families", lambda f: f == UNKNOWN)).cast("long").alias("n_unknown"),
    )
