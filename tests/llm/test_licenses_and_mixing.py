import random
import re

import numpy as np
import pytest

from quarrystone.llm import licenses as L, mixing as M


@pytest.fixture(scope="module")
def prose(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()
    return [line for r in rows for line in r.text.split("\n") if line.strip()]


@pytest.fixture(scope="module")
def model(prose):
    return L.train(prose[:1500])


def found(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in L.scan(docs, model).collect()}


def named(family):
    return L.UNKNOWN if family == L.BSD else family  # its opening sentence alone names neither licence


def test_held_out_variants(spark, model, prose):
    texts, classes = L.variants(prose[1500:], seed=77, each=9)
    got = found(spark, model, texts)
    right = [named(L.FAMILIES[c]) in got[i].families for i, c in enumerate(classes)]
    wrong = [bool(set(got[i].families) - {L.FAMILIES[c], L.UNKNOWN}) for i, c in enumerate(classes)]
    assert np.mean(right) > 0.8 and np.mean(wrong) < 0.02


def test_probabilities_are_calibrated(model, prose):
    """On variants, prose and licences that neither training nor calibration saw."""
    others = ("Licensed under the Q Public License, version 1.0.", "Released under the terms of the Sleepycat License.", "You may use and redistribute this work under the terms of the Lucent Public License 1.02.")
    clean = [p for p in prose[1500:] if not any(x.lower() in p.lower() for ps in L.TEMPLATES.values() for x in ps)][:300]
    texts, classes = L.variants(prose[1500:], 78, 9, others)
    texts, classes = texts + clean, np.array(classes + [len(L.CLASSES) - 1] * len(clean))
    grams, _, row, words = L.Features().of_texts(texts)
    p = model.probabilities(model.logits(grams, row, len(words)))
    sure, right = p.max(1), p.argmax(1) == classes
    assert abs(sure.mean() - right.mean()) < 0.08 and right.mean() > 0.85
    unknown = np.flatnonzero(classes == len(L.FAMILIES))
    assert p[unknown, -2].mean() > 0.4


def test_prose_is_left_alone(spark, model, prose):
    phrases = [p.lower() for ps in L.TEMPLATES.values() for p in ps]
    clean = [p for p in prose[1500:] if not any(x in p.lower() for x in phrases)]
    got = found(spark, model, clean)
    assert np.mean([any(f != L.UNKNOWN for f in r.families) for r in got.values()]) < 0.002
    assert np.mean([bool(r.families) for r in got.values()]) < 0.02


def test_every_template_and_position(spark, model):
    cases = [(f, p) for f, ps in L.TEMPLATES.items() for p in ps]
    got = found(spark, model, [f"some words first\n\n{p}\nlast line" for _, p in cases])
    for i, (family, p) in enumerate(cases):
        assert named(family) in got[i].families, p
        assert got[i].n_paragraphs == 3 and got[i].positions[list(got[i].families).index(named(family))] == 2


def test_unlike_notices_are_unknown(spark, model):
    got = found(spark, model, ["Licensed under the Foo License, version 7 of the License, a Foo license", *L.HELD_OUT, *L.OTHERS])
    assert all(set(r.families) <= {L.UNKNOWN} for r in got.values())
    assert np.mean([list(got[i].families) == [L.UNKNOWN] for i in range(len(got))]) > 0.8


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""


@pytest.mark.parametrize("prefix", ["", "# ", " * "])
def test_wrapped_notices(spark, model, prefix):
    two = "1. Redistributions of source code must retain the above copyright notice.\n2. Redistributions in binary form must reproduce the above copyright\n   notice in the documentation."
    three = "3. Neither the name of the holder may be used to endorse or\n   promote products derived from this software."
    gpl2, lgpl2, lgpl3, agpl = GPL.replace("version 3", "version 2"), GPL.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"), GPL.replace("GNU General", "GNU Lesser General"), GPL.replace("GNU General", "GNU Affero General")
    cases = [(MIT, "mit"), (GPL, "gpl-3.0"), (gpl2, "gpl-2.0"), (lgpl2, "lgpl-2.1"), (lgpl3, "lgpl-3.0"), (agpl, "agpl-3.0"), (ISC, "isc"), (APACHE, "apache-2.0"), (BSD, L.UNKNOWN), (f"{BSD}\n\n{two}", "bsd-2-clause"), (f"{BSD}\n\n{two}\n{three}", "bsd-3-clause"), (GPL.replace("version 3", "version 4"), L.UNKNOWN)]
    got = found(spark, model, [f"some words first\n\n{prefix}" + b.replace("\n", "\n" + prefix) + "\n\nlast line" for b, _ in cases])
    for i, (body, family) in enumerate(cases):
        assert family in got[i].families and not set(got[i].families) - {family, L.UNKNOWN}, body
        assert got[i].positions[list(got[i].families).index(family)] == 2 and got[i].n_paragraphs == 2 + sum(bool(x) for x in body.split("\n"))
    assert all(len(got[i].families) == 1 for i in range(7))
    flat = found(spark, model, [b.replace("\n", " ") for b, _ in cases[:9]])
    assert [list(flat[i].families) for i in range(9)] == [[f] for _, f in cases[:9]]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
        row = out
    return row[-1]


def plain_families(model, text):
    """Families by judging every line and every run of up to eight lines of a block, with plain alignment."""
    out, features = set(), L.Features()
    for block in re.split(r"(?:\n[^A-Za-z0-9\n]*)+\n", text):
        lines = block.split("\n")
        for i in range(len(lines)):
            for j in range(i + 1, min(len(lines), i + 8) + 1):
                run = "\n".join(lines[i:j])
                words = L.words_of(run)
                grams, _, row, n = features.of_texts([run])
                p = model.probabilities(model.logits(grams, row, 1))[0]
                family = int(p[:-2].argmax())
                if 1 - p[-1] < L.LOOKS or p[family] < p[-2]:
                    continue
                for t in L.ALL:
                    if t.family == family and longest_common(words, t.words) >= L.CONFIRMED * len(t.words) and t.needed <= set(words) and not t.barred & set(words):
                        out.add(L.FAMILIES[family])
    return out


def test_equals_judging_every_run_of_lines(spark, model, prose):
    pick = random.Random(6)
    texts = []
    for i in range(60):
        lines = [" ".join(pick.choice(prose[1500:]).split()[:12]) for _ in range(pick.randint(1, 3))]
        notice = pick.choice([p for ps in L.TEMPLATES.values() for p in ps]).split()
        cut = sorted(pick.sample(range(1, len(notice)), min(len(notice) - 1, pick.choice((0, 1, 2, 3)))))
        wrapped = [" ".join(notice[a:b]) for a, b in zip([0, *cut], [*cut, len(notice)])]
        glue = pick.choice(("\n", "\n\n"))
        texts.append(glue.join(["\n".join(lines), "\n".join(pick.choice(("", "# ", " * ")) + x for x in wrapped), "the end of it"]))
    got = found(spark, model, texts)
    same = [set(got[i].families) - {L.UNKNOWN} == {f for f in plain_families(model, t) if f != L.BSD} for i, t in enumerate(texts)]
    assert np.mean(same) == 1.0, [(t, got[i].families, plain_families(model, t)) for i, t in enumerate(texts) if not same[i]][:2]


def test_paragraphs_and_documents_part_notices(spark, model):
    lines = MIT.split("\n")
    got = found(spark, model, [f"{lines[0]}\n\n{lines[1]}\n\n{lines[2]}", lines[0], "\n".join(lines[1:])])
    assert not any(set(r.families) - {L.UNKNOWN} for r in got.values())


def test_license_messy_rows(messy, no_docs):
    got = L.licenses(messy).collect()
    assert len(got) == messy.count()
    assert {r.doc_id for r in got if r.n_paragraphs == 0} == {2, 3, 4, None}
    assert L.licenses(no_docs).count() == 0


def rake(cells, targets, keep, rounds=200):
    """Iterative proportional fitting over a dict of cells, as the operator defines it."""
    weight = {c: 1.0 for c in cells}
    total = sum(cells.values())
    for _ in range(rounds):
        for d, goal in targets.items():
            have = {}
            for c, t in cells.items():
                have[c[d]] = have.get(c[d], 0) + t * weight[c]
            for c in cells:
                weight[c] *= goal.get(c[d], 0) * total / have[c[d]] if have[c[d]] else 0
        weight = {c: min(w, 1 / keep) for c, w in weight.items()}
    return weight


@pytest.mark.parametrize("local", [0, 1000])
def test_raking_equals_plain_fitting(spark, local):
    rng = random.Random(3)
    cells = {(f"s{a}", f"l{b}", f"t{c}"): rng.randint(50, 400) for a in range(4) for b in range(3) for c in range(2)}
    targets = ({f"s{a}": 0.25 for a in range(4)}, {"l0": 0.4, "l1": 0.3, "l2": 0.3}, {"t0": 0.6, "t1": 0.4})
    table = spark.createDataFrame([(*c, t) for c, t in cells.items()], "source string, lang string, topic string, tokens long")
    goals = {d: spark.createDataFrame(list(t.items()), "category string, share double") for d, t in zip(M.DIMENSIONS, targets)}
    want = rake(cells, dict(enumerate(targets)), 0.4)
    got = {(r.source, r.lang, r.topic): r.weight for r in M.rake(table, goals, 0.4, within=1e-7, rounds=60, local_cells=local).collect()}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-3 for c in want)
    for d, t in enumerate(targets):
        for k, share in t.items():
            assert abs(sum(cells[c] * got[c] for c in cells if c[d] == k) / sum(cells.values()) - share) < 1e-3


def test_slow_raking_goes_on_and_reports_its_gap(spark, caplog):
    table = spark.createDataFrame([("s0", "l0", "t", 100), ("s0", "l1", "t", 100), ("s1", "l1", "t", 100)], "source string, lang string, topic string, tokens long")
    goals = {d: spark.createDataFrame([(f"{d[0]}{i}", 0.5) for i in range(2)], "category string, share double") for d in ("source", "lang")}
    got = {(r.source, r.lang): r.weight for r in M.rake(table, goals, 0.2, within=0.002, rounds=1000).collect()}
    assert got["s0", "l1"] < 0.01 and not caplog.records  # no weight is trimmed; the gap falls ever more slowly
    M.rake(table, goals, 0.2, within=0.002, rounds=10).collect()
    assert "no rounds are left" in caplog.text


def test_sample_meets_the_targets(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, "tok " * rng.randint(20, 60), rng.choice(["en"] * 6 + ["de", "fr"]), rng.choice("aaab")) for i in range(6000)], "doc_id long, text string, lang string, source string")
    targets = {"lang": spark.createDataFrame([("en", 0.5), ("de", 0.25), ("fr", 0.25)], "category string, share double")}
    got = M.mix_documents(docs, targets=targets, keep=0.4).selectExpr("row.lang as lang", "row.source as source", "tokens", "probability", "sampled").toPandas()
    taken = got[got.sampled].groupby("lang").tokens.sum() / got[got.sampled].tokens.sum()
    assert abs(taken["en"] - 0.5) < 0.04 and abs(taken["de"] - 0.25) < 0.04
    assert abs(got[got.sampled].tokens.sum() / (got.tokens * got.probability).sum() - 1) < 0.05 and got.probability.between(0, 1).all()


def test_query_meets_its_targets(spark, sf_dir):
    """Shares of the expected sample against targets that are computed here, for every source, language and topic."""
    from quarrystone.llm.queries import op9_mixing

    got = op9_mixing(spark, sf_dir).toPandas()
    assert (got.gap < 1e-3).all() and got.probability.between(0, 1).all() and got.probability.max() > 0.99
    for name in ("source", "lang", "topic"):
        tokens = got.tokens.groupby(got[name].fillna("none")).sum()
        goal = tokens[tokens > 0] ** 0.7 / (tokens[tokens > 0] ** 0.7).sum()
        expected = (got.tokens * got.probability).groupby(got[name].fillna("none")).sum() / (got.tokens * got.probability).sum()
        assert all(abs(expected[c] / g - 1) < 1e-3 for c, g in goal.items())
    # The draw itself: as many tokens as expected, within four standard deviations.
    spread = (got.tokens**2 * got.probability * (1 - got.probability)).sum() ** 0.5
    assert abs(got.tokens[got.sampled].sum() - (got.tokens * got.probability).sum()) < 4 * spread


def test_targets_out_of_reach_are_trimmed_and_reported(spark):
    docs = spark.createDataFrame([(i, "word " * 10, "en" if i else "xx", "s") for i in range(400)], "doc_id long, text string, lang string, source string")
    targets = {"lang": spark.createDataFrame([("en", 0.5), ("xx", 0.5)], "category string, share double")}
    got = M.mix_documents(docs, targets=targets, least=0.2).collect()
    assert got[0].gap > 0.5 and all(r.probability <= 1 for r in got) and sum(r.tokens * r.probability for r in got) > 0.1 * 4000


def test_mixing_messy_rows(spark, messy, no_docs):
    topics = spark.createDataFrame([(1, "x"), (1, "a"), (None, "q"), (7, None)], "doc_id long, topic string")
    rows = M.mix_documents(messy, topics)
    got = rows.collect()
    assert len(got) == messy.count() and {r.topic for r in got if r.row.doc_id == 1} == {"a"}
    assert {r.tokens for r in got if r.row.doc_id in (2, 3, 4)} == {0}
    assert len({r.sampled for r in got if r.row.doc_id == 1}) == 1
    assert rows.select("row.*").columns == messy.columns
    assert M.mix_documents(no_docs).count() == 0
