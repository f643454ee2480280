import hashlib
from collections import defaultdict

from cradlemart.llm.exact_dedup import DedupIndex, deduplicate


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c.lower() if c.isascii() else c for c in t or "")].append(i)
    out = []
    for t, ids in groups.items():
        out += [(i, max(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out)


ROWS = [(i, t) for i, t in enumerate(["a", "A", "b", "", None, "É", "é", "x" * 200_000, "X" * 200_000, "c d"] * 3 + [f"t{i % 40}" for i in range(300)])]


def test_classes_as_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in ROWS], "doc_id long, text string, key string, n int")
    for bits, size in ((64, 100_000), (64, 3), (2, 1), (8, 2)):  # few bits: many different texts under one key
        got = DedupIndex(docs, key_bits=bits, bucket_keys=size).classes()
        assert sorted((r.id, r.keep_id, r.group_size, r.text_sha256) for r in got.collect()) == brute(ROWS)


def test_directory_splits_until_buckets_fit(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(500)], "doc_id long, text string")
    index = DedupIndex(docs, bucket_keys=20)
    sizes = index.buckets.collect()
    assert max(r["keys"] for r in sizes) <= 20 and sum(r["keys"] for r in sizes) == 500
    assert index.nodes().count() == 500


def test_deduplicate(spark):
    rows = [(1, "a"), (2, "A"), (2, "A"), (2, "b"), (None, "b"), (None, "q"), (3, "z")]
    docs = spark.createDataFrame([(i, t, "s", "u") for i, t in rows], "doc_id long, text string, id string, sha string")
    got = deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text.lower()) for r in got.collect()) == [(0, "q"), (2, "a"), (2, "b"), (3, "z")]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert DedupIndex(docs).classes().count() == 0
    assert deduplicate(docs).count() == 0
