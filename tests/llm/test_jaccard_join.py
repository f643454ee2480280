import random
import re

from cradlemart.llm.components import components
from cradlemart.llm.jaccard_join import light_boundary, similar_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    ids = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted((d if d is not None else -1, len(sets[i]), -1 if ids.get(find(i)) is None else ids[find(i)] if sets[i] else (d if d is not None else -1)) for i, (d, _) in enumerate(docs))


def corpus():
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = []
    for size in (5, 8, 9, 10, 12, 15, 20, 26, 40, 70, 150):
        for _ in range(3):
            base = [rnd.choice(vocabulary) for _ in range(size)]
            docs.append(" ".join(base))
            for _ in range(rnd.randint(2, 9)):  # chains of edits
                base = list(base)
                for _ in range(rnd.randint(0, 2)):
                    k = rnd.randrange(len(base))
                    kind = rnd.random()
                    if kind < 0.4:
                        base[k] = rnd.choice(vocabulary)
                    elif kind < 0.7:
                        base.append(rnd.choice(vocabulary))
                    elif len(base) > 3:
                        base.pop()
                docs.append(" ".join(base))
    passage = " ".join(rnd.choice(vocabulary) for _ in range(30))
    docs += [passage + " " + " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 8))) for _ in range(60)]
    docs += [None, "", "  ", "a", "A", "a b", "É b c", "é b c", docs[0], docs[0], docs[40].upper(), "q " * 30_000, "q " * 30_001]
    out = list(enumerate(docs, 100))
    rnd.shuffle(out)
    return [*out, (None, docs[3]), (100, docs[0]), (101, docs[90])]


def test_as_brute_force(spark):
    docs = corpus()
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, n int, node int").repartition(5)
    got = sorted((-1 if r.id is None else r.id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in similar_documents(d).collect())
    assert got == brute(docs)


def test_boundary_follows_cost():
    assert light_boundary({}, 85) == 0
    assert light_boundary({7: 1000}, 85) >= 7
    assert light_boundary({20: 1000}, 85) < 20


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(80)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.label for r in got.collect()} == {n: find(n) for n in parent}


def test_empty(spark):
    assert similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
