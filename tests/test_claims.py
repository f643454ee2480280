"""Names asked for in commit order, against a plain replay."""

import random

import pytest

from cradlemart.operators import claims as cl
from cradlemart.operators import quality
from cradlemart.operators.graph import components

CLAIM = "seq long, actor string, names array<string>"


def replay(claims, held):
    holds, won = {}, []
    for name, actor in held:
        holds.setdefault(actor, set()).add(name)
    for seq, actor, names in sorted(claims):
        names = {n for n in names if n is not None}
        if any(names & mine for other, mine in holds.items() if other != actor):
            continue
        won.append(seq)
        if names:
            holds[actor] = names
    return won


def decided(spark, claims, held, **options):
    c = spark.createDataFrame(claims, CLAIM)
    h = spark.createDataFrame(held, "name string, actor string")
    return sorted(r.seq for r in cl.granted(c, h, **options).collect())


@pytest.mark.parametrize("seed", range(4))
def test_same_as_one_after_the_other(spark, seed):
    rnd = random.Random(seed)
    name = lambda: rnd.choice([f"n{int(rnd.paretovariate(0.7)) % 60}", f"n{rnd.randrange(60)}"])
    held = [(name(), f"a{rnd.randrange(80)}") for _ in range(40)]
    held = list({actor: (n, actor) for n, actor in held}.values())
    claims = [(i, f"a{rnd.randrange(50)}", [name() for _ in range(rnd.choice((1, 1, 1, 2, 0)))]) for i in range(300)]
    claims += [(400, "a1", [None]), (401, "a2", ["n1", "n1"])]
    want = replay(claims, held)
    rnd.shuffle(claims)
    assert decided(spark, claims, held) == want


def test_a_huge_component_is_cut_along_seq(spark):
    rnd = random.Random(9)
    held = [(f"n{i}", f"a{i}") for i in range(12)]
    claims = [(i, f"a{rnd.randrange(15)}", [f"n{rnd.randrange(15)}"]) for i in range(80)]
    assert decided(spark, claims, held, fold_rows=60) == replay(claims, held)


def test_names_pass_from_hand_to_hand(spark):
    accounts = spark.createDataFrame([(1, "z1"), (2, "y"), (3, "x")], "account_id long, account_name string")
    asked = [(1, 1, "z2"), (2, 1, "z4"), (3, 3, "z2"), (4, 2, "z1"), (5, 1, "y"), (6, 2, "x"), (7, 3, "z4"), (8, 2, None), (9, 2, "x")]
    changes = spark.createDataFrame(asked, "seq long, account_id long, account_name string")
    got = {r.seq: dict(r.errors) for r in quality.validate_profile_changes(changes, accounts).collect()}
    assert got == {n: {} for n in range(1, 10)}
    late = spark.createDataFrame([(1, 2, "z1"), (2, 1, "z2"), (3, 2, "z1")], changes.schema)
    got = {r.seq: dict(r.errors) for r in quality.validate_profile_changes(late, accounts).collect()}
    assert got == {1: {"username": "taken"}, 2: {}, 3: {}}


def test_a_long_chain_takes_a_handful_of_jobs(spark):
    n = 100_000
    forms = spark.range(n).selectExpr("id AS seq", "concat('u', id div 2) AS u", "concat('e', (id + 1) div 2) AS e")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    won = quality.first_come(forms, ["u", "e"])
    assert won.where("seq % 2 = 1").isEmpty() and won.count() == n // 2
    assert len(tracker.getJobIdsForGroup("chain")) < 80
    spark.sparkContext.setJobGroup("", "")


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(10**6), rnd.randrange(10**6)) for _ in range(300)]
    edges += [(a + 1, b) for a, b in edges[:150]] + [(10**7 + i, 10**7 + i + 1) for i in range(60)]
    above = {x: x for e in edges for x in e}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in edges:
        above[root(a)] = root(b)
    frame = spark.createDataFrame(edges, "a long, b long")
    for limit in (2_000_000, 40):
        got = {r.node: r.root for r in components(frame, limit).collect()}
        assert set(got) == set(above)
        assert len(set(got.values())) == len({root(x) for x in above})
        assert all(got[a] == got[b] for a, b in edges)
