import math

import pytest
from pyspark.sql import functions as F

from cradlemart.llm.mixing import mix_sources


def rows():
    out = []
    for i in range(600):
        source = "hot" if i % 3 else f"s{i % 5}"
        out.append((i, "w " * (1 + i % 50), source, ["en", "fr", None][i % 7 % 3], f"t{i % 4}", "clash"))
    return out


def test_marginals_meet_targets(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, lang string, kind string, tokens string")
    targets = {"source": {"hot": 0.3, "s0": 0.5, "s1": 0.1, "s2": 0.1, "none": 3.0}, "language": {"en": 0.6, "fr": 0.3, None: 0.1}}
    got = mix_sources(docs, topic=F.col("kind"), targets=targets, power=1.0, keep=0.5, rounds=25).collect()
    assert len(got) == 600
    total = sum(r.tokens for r in got)
    share = {}
    for r in got:
        share[r.source] = share.get(r.source, 0) + r.tokens * r.multiplier / total
        share["lang", r.language] = share.get(("lang", r.language), 0) + r.tokens * r.multiplier / total
        assert r.copies in (math.floor(r.expected), math.floor(r.expected) + 1)
    assert share["hot"] == pytest.approx(0.3, abs=1e-3) and share["s0"] == pytest.approx(0.5, abs=1e-3)
    assert share["s3"] == 0 and share["lang", None] == pytest.approx(0.1, abs=1e-3)
    assert sum(r.tokens * r.copies for r in got) == pytest.approx(0.5 * total, rel=0.15)


def test_odd_input(spark):
    kind = "doc_id long, text string, source string, lang string"
    docs = spark.createDataFrame([(1, None, None, None), (1, "", "a", "b"), (None, "x y", "a", "b"), (2, "x", "a", None)], kind)
    assert sorted(r.tokens for r in mix_sources(docs, rounds=2).collect()) == [0, 0, 1, 2]
    assert mix_sources(docs.limit(0), rounds=2).count() == 0


def test_correlated_cells_with_default_rounds(spark):
    rows = []
    for s, lang in enumerate(["en", "fr", "de", "es"]):  # each source nearly in one language
        rows += [(1000 * s + i, "w " * 10, f"s{s}", lang if i % 5 else ["fr", "de", "es", "en"][s]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"source": {"s0": 0.4, "s1": 0.3, "s2": 0.2, "s3": 0.1}, "language": {"en": 0.38, "fr": 0.31, "de": 0.2, "es": 0.11}}
    got = mix_sources(docs, topic=F.lit("t"), targets=targets).groupBy("source").agg(F.sum(F.col("tokens") * F.col("multiplier")) / 16000)
    for source, share in got.collect():
        assert share == pytest.approx(targets["source"][source], abs=1e-5)
