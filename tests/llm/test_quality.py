import random

import numpy as np

from cradlemart.llm.quality import accepted, score_quality


def rows(n=400):
    rnd = random.Random(3)
    out, labels = [], []
    for i in range(n):
        w = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(5, 80))]
        bad = i % 4 == 0
        if bad:
            w = [x.upper() + "!!" for x in w] if i % 8 else [x + "###" for x in w]
        out.append((i, " ".join(w), "s", 0.5))
        labels.append((i, int(not bad)))
    return out, labels


def test_held_out_accuracy(spark):
    docs, labels = rows()
    odd = [(9001, None, "s", 0.0), (9002, "", "s", 0.0), (9003, "é" * 100_000, "s", 0.0), (None, docs[1][1], "s", 0.0), (1, docs[0][1], "s", 0.0)]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, features string, score double")
    y = spark.createDataFrame([*labels, (9001, None), (None, 1), (1, 1)], "doc_id long, quality int")
    got = score_quality(d, y).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.id in truth and r.id != 1]
    assert len(held) > 50
    assert np.mean([(r.score >= 0.7) == bool(truth[r.id]) for r in held]) > 0.95
    kept = accepted(d, y)
    assert kept.columns == d.columns and 250 < kept.count() < 320


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    y = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in score_quality(d, y).collect()] == [1.0, 1.0]
    assert score_quality(d.limit(0), y).count() == 0


def test_labels_of_one_kind_are_the_score(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "x") for i in range(12)], "doc_id long, text string, score string")
    for kind in (0, 1):
        labels = spark.createDataFrame([(i, kind) for i in range(12)], "doc_id long, quality int")
        assert {r.score for r in score_quality(docs, labels).collect()} == {float(kind)}
        assert accepted(docs, labels).count() == 12 * kind
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {1.0}
