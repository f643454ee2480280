import os
import re

import pytest

import corpus_pipeline
from cradlemart.llm.quality import score_quality

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def test_stages_as_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    scores = {r.id: r.score for r in score_quality(docs, labels).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    want = {i for i in text if scores[i] >= 0.7}
    best = {}
    for i in want:
        best[lower(text[i])] = max(i, best.get(lower(text[i]), i))
    after = {0: want, 1: set(best.values())}
    sets = {i: shingles(text[i]) for i in after[1]}
    group = {i: i for i in after[1]}
    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    after[2] = {i for i, g in group.items() if i == g}
    windows = set()
    for r in items:
        b = LETTERS.findall(lower(r.text))
        n = min(13, len(b))
        windows |= {tuple(b[s : s + n]) for s in range(len(b) - n + 1)} if n else set()
    after[3] = set()
    for i in after[2]:
        w, hit = LETTERS.findall(lower(text[i])), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
        if not (hit and 20 * len(hit) >= len(w)):
            after[3].add(i)
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        kept = corpus_pipeline.stored(stage(spark, kept, SF))
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.select("doc_id").collect()} == after[k], name
    last = corpus_pipeline.run(spark, SF)
    ids = [r.doc_id for r in last.collect()]
    assert set(ids) <= after[3] and len(ids) == len(set(ids)) > 0.6 * len(after[3])
    assert set(docs.columns) <= set(last.columns)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF))
    assert docs.count() == 0


def test_mix_tells_rows_of_one_id_apart_and_keeps_clashing_columns(spark):
    rows = [(1, "a | b", "en", "s", 5, "mine"), (1, "plain words without any mark", "en", "s", 28, "mine"), (2, "more words", "en", "s", 10, "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, topic string")
    out = corpus_pipeline.mix(spark, docs.unionByName(docs.where("doc_id = 2")), "")
    assert {"topic", "mix_topic", "tokens", "multiplier", "copies"} <= set(out.columns)
    got = {r.text: (r.topic, r.tokens) for r in out.collect()}
    assert got == {"a | b": ("mine", 3), "plain words without any mark": ("mine", 5), "more words": ("mine", 2)}
