import random
import re

from cradlemart.llm.decontaminate import find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, width=13):
    out = []
    for i, text in docs:
        w, hit, named = split(text), set(), set()
        for item, t in items:
            b = split(t)
            n = min(width, len(b))
            for s in range(len(b) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[s : s + n]:
                        hit |= set(range(p, p + n))
                        named |= {str(item)} if item is not None else set()
        out.append((i or -1, len(w), len(hit), sorted(named)))
    return sorted(out)


def test_as_brute_force(spark):
    rnd = random.Random(4)
    vocabulary = ["a", "b", "c", "Été", "d9"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(1, text(20)), (2, text(5)), (3, "a"), (4, ""), (5, None), (6, "..."), (2, text(14)), (None, text(15)), (7, text(2))]
    docs = [(i, text(rnd.randint(0, 40))) for i in range(40)]
    docs += [(100 + k, f"zz {t} ZZ-{t}!") for k, (_, t) in enumerate(items)]
    docs += [(200, None), (201, ""), (None, items[0][1]), (1, "other"), (1, "other"), (202, "q " * 5000 + items[0][1].upper())]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, start int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for blocks in (200_000, 7):  # also in several blocks
        got = find_contamination(d, b, block_windows=blocks).collect()
        assert sorted((r.id or -1, r.n_words, r.n_hit, r["items"]) for r in got) == brute(docs, items)


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in find_contamination(d, b).collect()] == [(1, 2, 0, [])]
    assert find_contamination(d.limit(0), b).count() == 0
