import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from cradlemart.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k=10):
    counted = [(i, Counter(split(t))) for i, t in docs]
    number, total = sum(1 for _, c in counted if c), sum(c.total() for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in set(items):
        weights = {w: n * math.floor(1000 * math.log((2 * number + 2) / (2 * df[w] + 1))) for w, n in Counter(split(text)).items()}
        scored = []
        for i, c in counted:
            m = 100 - 75 + (75 * c.total() * number) // max(total, 1)
            score = sum(x * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w, x in weights.items() if c[w])
            if score > 0:
                scored.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, n string, tf int, h1 int")
    return d, spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, query int")


def test_as_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{int(rnd.paretovariate(0.6)) % 400}" for _ in range(800)] + ["Été", "中文", "a1"]
    text = lambda n: rnd.choice([" ", "-", "\n"]).join(rnd.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rnd.randint(0, 60))) for i in range(400)]
    docs += [(500 + i, "same Words here w1 w2") for i in range(40)]  # ties
    docs += [(600, None), (601, ""), (602, "..."), (603, text(40_000)), (7, "w1 w1 w3"), (7, "w1 w1 w3")]
    items = [(i, text(rnd.randint(1, 30))) for i in range(12)] + [(20, text(400)), (21, None), (22, "!?"), (23, "unknownword"), (24, "w1 w1 w1")]
    items += [items[0]]  # a repeated row counts once
    for block_rows in (16_384, 60):  # also in several blocks
        lexical.LEAST_ROWS, before = min(block_rows, 2048), lexical.LEAST_ROWS
        got = lexical.search(*frames(spark, docs, items), block_rows=block_rows).collect()
        lexical.LEAST_ROWS = before
        assert sorted(tuple(r) for r in got) == brute(docs, items)


def test_items_of_one_id_are_ranked_one_by_one(spark):
    docs, items = [(1, "a b"), (2, "b c c")], [(1, "a"), (1, "c")]
    assert sorted((r.rank, r.doc_id) for r in lexical.search(*frames(spark, docs, items)).collect()) == [(1, 1), (1, 2)]


def test_masks_are_left_out_once_the_rest_cannot_rank():
    rare, common = np.arange(12), np.arange(5_000)
    block = lexical.Block(
        pa.array(range(5_000)), np.array([1, 2]), np.array([0, 0]), np.array([0, 12, 5_012]), np.concatenate([rare, common]),
        np.full(5_012, 100), np.array([100, 100]),
    )
    docs, scores, evaluated = lexical.search_block(block, np.array([0, 1]), np.array([50, 1]), 10)
    assert docs.tolist() == list(range(10)) and scores.tolist() == [5_100] * 10 and evaluated == 12


def test_empty(spark):
    docs, items = frames(spark, [(1, "a b")], [(1, "a")])
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
