import math
import random

import numpy as np
from pyspark.sql import functions as F

from cradlemart.llm import negatives
from cradlemart.llm.negatives import Search, build_block, mine_negatives, threshold_search

SCHEMA = "vec_id long, label int, embedding array<double>, id string, query int, score int"


def brute(rows, every):
    clean = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            clean[i, label, tuple(math.floor(256 * x) for x in v)] = None
    clean, out = sorted(clean), []
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=True))
    for a in clean:
        if a[0] % every:
            continue
        others = sorted(((-score(a, o), o[0], o) for o in clean if o != a and len(o[2]) == len(a[2])), key=lambda x: x[:2])
        positives = [x for x in others if x[2][1] == a[1]][:5]
        for p, pid, _ in positives:
            found = [x for x in others if x[2][1] != a[1] and 30 * -p <= 100 * -x[0] <= 90 * -p][:10]
            out += [(a[0], pid, r + 1, n, -p, -s) for r, (s, n, _) in enumerate(found)]
    return sorted(out)


def check(spark, rows, every, **options):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = mine_negatives(frame, F.col("id") % every == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, every)


def test_as_brute_force(spark):
    rnd = np.random.RandomState(5)
    centres = rnd.normal(size=(4, 8))
    rows = [(i, int(rnd.randint(4)), (centres[rnd.randint(4)] + 0.6 * rnd.normal(size=8)).round(2).tolist()) for i in range(400)]
    rows += [(1000 + i, i % 3, [0.5] * 8) for i in range(30)]  # ties
    rows += [(2000, None, [1.0] * 8), (2010, 1, None), (2020, 1, [math.nan] * 8), (2030, 1, [math.inf] + [0.0] * 7), (2040, 1, [None] * 8)]
    rows += [(3000, 1, []), (3001, 1, []), (3002, 2, []), (3010, 1, [1.0, 2.0]), (3011, 1, [1.0, 2.0]), (3012, 0, [1.0, 1.0])]
    rows += [(4000, 1, [0.0] * 8), (4010, 2, [-1.0] * 8), (None, 1, [1.0] * 8)]
    rows += [rows[0], rows[0], rows[10]]  # repeated rows count once
    check(spark, rows, 10)
    negatives.LEAST_ROWS, before = 32, negatives.LEAST_ROWS
    check(spark, rows, 10, block_rows=50)
    negatives.LEAST_ROWS = before


def test_large_components(spark):
    rnd = random.Random(1)
    rows = lambda scale: [(i, i % 2, [rnd.uniform(0.1, 1) * scale for _ in range(2)]) for i in range(40)]
    for scale in (1e5, 3e6):
        check(spark, rows(scale), 5)
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows(1e12)], SCHEMA)  # scores are held at the limit of 64 bits
    assert {r.positive_score for r in mine_negatives(frame, F.col("id") % 5 == 0, high=100).collect()} == {2**63 - 1}


def test_stops_before_the_end_of_the_lists():
    import pyarrow as pa

    n = 4_000
    values = [[n - i, 0] for i in range(n)]
    block = build_block(pa.table({"id": pa.array(range(n)), "label": pa.array([0] * n), "vec": pa.array(values, pa.list_(pa.int64()))}))
    search = Search(10)
    seen = threshold_search(block.lists[2], np.array([3, 0]), np.ones(n, bool), [search])
    assert search.rows.tolist() == list(range(10)) and seen < 100


def test_empty(spark):
    assert mine_negatives(spark.createDataFrame([], SCHEMA), F.col("id") % 10 == 0).count() == 0
    one = spark.createDataFrame([(100, 1, [1.0], "", 0, 0)], SCHEMA)
    assert mine_negatives(one, F.col("id") % 10 == 0).count() == 0
