import re

from pyspark.sql import functions as F

from cradlemart.llm.licenses import BASE, CC_BY, KEYWORDS, _resolved, detect, signature_rules, summarise

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    None, "", " ", "a", "MIT License", "the mit-license, see MIT LICENSE.", "Apache License 2.0 and Apache License",
    "GNU General Public License v3", "smit license", "mit licenses", "É mit  license É", "general public license " * 3,
    "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: MIT", "all rights reserved",
    "x " * 30_000 + "mit license" + " y" * 10, "license mit", "mit license apache license", "licensed under the mit",
]


def split(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def test_base_as_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, label string, s int")
    got = {r.id: r for r in summarise(detect(docs)).collect()}
    for i, t in enumerate(TEXTS):
        w, places, labels = split(t), [], set()
        for phrase, label in BASE:
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_rules_resolve(spark):
    assert len(signature_rules()) >= 200
    docs = spark.createDataFrame(
        [(1, "licensed under the Apache License, Version 2.0"), (2, "spdx-license-identifier: MIT"), (3, "free text")],
        "doc_id long, text string")
    found = {r.id: r for r in detect(docs).collect()}
    assert [(d.s, d.e, d.label) for d in found[1].detections] == [(0, 8, "apache-2.0")]
    assert [d.label for d in found[2].detections] == ["mit"]
    assert found[3].detections is None
    labels = {r.id: r.labels for r in summarise(detect(docs)).collect()}
    assert labels == {1: "apache,apache-2.0", 2: "mit", 3: ""}


def test_empty(spark):
    assert summarise(detect(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def spelled(pattern):
    """Every text that a rule's pattern stands for (rules have no open repetition)."""
    def of(nodes):
        out = [""]
        for op, value in nodes:
            name = str(op)
            if name == "LITERAL":
                some = [chr(value)]
            elif name == "IN":
                some = [chr(v) for _, v in value]
            elif name == "BRANCH":
                some = [x for part in value[1] for x in of(part)]
            elif name == "SUBPATTERN":
                some = of(value[3])
            elif name == "MAX_REPEAT":
                assert value[:2] == (0, 1)
                some = ["", *of(value[2])]
            else:
                assert name == "ASSERT"
                some = [""]
            out = [a + b for a in out for b in some]
        return out

    return of(re._parser.parse(pattern))


def test_gates_let_every_rule_pass(spark):
    texts = []
    for hints, pattern, label, _, _ in signature_rules():
        every = spelled(pattern)
        for text in every:
            raw = text.strip().replace(" ", "-\n").upper()
            assert (any(k in raw.lower() for k in KEYWORDS) or re.search(CC_BY, raw.lower())) and any(h in text for h in hints), (pattern, text)
        texts += [every[0], every[-1]] if label else []
    docs = spark.createDataFrame([(i, f"x{t.replace(' ', ' - ')} y") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.id: r for r in detect(docs).collect()}
    for i, text in enumerate(texts):
        assert got[i].detections, text


def test_license_texts_tags_and_denials(spark):
    cases = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\")": "mit",
        "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that": "bsd",
        "this is GPLv3 code": "gpl-3.0", "under an AGPLv3 licence": "agpl-3.0", "BSD-3-Clause": "bsd-3-clause",
        "Licensed under either of Apache License, Version 2.0 or MIT license at your option": "apache,apache-2.0,mit",
        "It is not licensed under the MIT License.": "mit",  # the base phrase stays
        "This is no longer released under the terms of the Eclipse Public License": "",
        "http://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa-4.0",
        "hereby I say that copyright and warranty are words": "",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    rows = {r.id: r for r in summarise(detect(docs)).collect()}
    assert {t: rows[i].labels for i, t in enumerate(cases)} == cases
    denied = rows[list(cases).index("It is not licensed under the MIT License.")]
    assert denied.score == 0.8 and rows[7].score == 0.0  # the score of the base phrase, no more


def test_overlaps_by_priority(spark):
    """b beats a, c beats b and leaves a alone: a stays."""
    def one(s, e, priority, label):
        return f"named_struct('s', {s}L, 'back', {-e}L, 'priority', {priority}, 'e', {e}L, 'label', '{label}', 'confidence', 0.5D)"

    def left(*found):
        column = F.expr("array(" + ", ".join(one(*x) for x in found) + ")")
        return [x.label for x in spark.range(1).select(_resolved(column).alias("r")).first().r]

    assert left((0, 4, 3, "a"), (3, 8, 2, "b"), (7, 9, 1, "c")) == ["a", "c"]
    assert left((0, 4, 3, "a"), (3, 8, 1, "b"), (7, 9, 2, "c")) == ["b"]
    assert left((0, 9, 9, "long"), (2, 4, 1, "within"), (9, 12, 5, "next")) == ["long", "next"]
    assert left((0, 3, 2, "weak"), (0, 3, 1, "strong")) == ["strong"]
