import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cradlemart.operators import ledger, ordered

CAP = 99_999_999
EVENTS = "account_id string, seq long, kind string, amount long"


def replay(rows, opening=None):
    balance, out = dict(opening or {}), {}
    for account, seq, kind, amount in sorted(rows, key=lambda r: r[1]):
        b = balance.get(account, 0)
        if kind == "grant":
            b = CAP if b + amount >= CAP + 1 else b + amount
        else:
            b = {"reset": 0, "credit": b + amount, "debit": b - amount}[kind]
        balance[account] = out[account, seq] = b
    return out, balance


def random_rows(n, seed):
    rnd = random.Random(seed)
    rows = []
    for seq in range(n):
        account = "hot" if rnd.random() < 0.4 else f"a{rnd.randrange(30)}"
        kind = rnd.choices(["grant", "reset", "credit", "debit"], [5, 1, 3, 3])[0]
        amount = rnd.choice([0, 5, CAP, CAP + 1, 10**12, 10**15]) if rnd.random() < 0.1 else rnd.randrange(60_000_000)
        rows.append((account, seq, kind, min(amount, 10**8) if kind != "grant" else amount))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("share,min_rows", [(1e-3, 10**9), (1e-3, 0), (0.05, 0), (0.3, 10)])
def test_equals_replay_however_it_is_cut(spark, share, min_rows):
    rows = random_rows(4000, 7)
    opening = {"hot": 5_000_000, "a1": -3, "quiet": 12}
    events = spark.createDataFrame(rows, EVENTS)
    want, last = replay(rows, opening)
    got = ledger.points_ledger(
        events, spark.createDataFrame(list(opening.items()), "account_id string, points long"), share, min_rows
    )
    assert {(r.account_id, r.seq): r.balance for r in got.where("seq IS NOT NULL").collect()} == want
    assert {r.account_id: r.points for r in ledger.last_balance(got).collect()} == last


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.sampled_from("xy"), st.sampled_from(["grant", "reset", "credit", "debit"]),
            st.integers(0, CAP + 2),
        ),
        min_size=1, max_size=25,
    )
)
def test_equals_replay_on_any_log(spark, events):
    rows = [(a, i, k, n) for i, (a, k, n) in enumerate(events)]
    got = ledger.points_ledger(spark.createDataFrame(rows, EVENTS), share=0.2, min_rows=0)
    assert {(r.account_id, r.seq): r.balance for r in got.collect()} == replay(rows)[0]


def test_cap_edges(spark):
    rows = [
        ("a", 1, "grant", CAP), ("a", 2, "grant", 1), ("a", 3, "credit", 10), ("a", 4, "grant", 1), ("a", 5, "reset", 0),
        ("a", 6, "debit", 7), ("a", 7, "grant", 9), ("a", 8, "grant", 10**13),
    ]
    got = ledger.points_ledger(spark.createDataFrame(rows, EVENTS)).orderBy("seq").collect()
    assert [r.balance for r in got] == [CAP, CAP, CAP + 10, CAP, 0, -7, 2, CAP]


def test_commands(spark):
    texts = [
        "pointGet5", "pointGet5\n", "pointGet１２", "pointGet٣٤", "pointReset", "pointreset", "xpointGet5", "pointGet",
        "pointGet" + "9" * 60, "pointGet-5", "baby",
    ]
    df = spark.createDataFrame([(i, "a", t) for i, t in enumerate(texts)], "seq long, account_id string, search_box string")
    got = {r.seq: (r.kind, r.amount) for r in ledger.points_commands(df).collect()}
    assert got == {0: ("grant", 5), 2: ("grant", 12), 3: ("grant", 34), 4: ("reset", 0), 8: ("grant", None)}


def test_balance_of_accounts_without_events(spark):
    accounts = spark.createDataFrame([("a",), ("b",)], "account_id string")
    led = ledger.points_ledger(spark.createDataFrame([("a", 1, "credit", 4)], EVENTS))
    assert {r.account_id: r.points for r in ledger.points_balance(accounts, led).collect()} == {"a": 4, "b": 0}


@pytest.mark.parametrize("keys", [["account_id"], []])
def test_running_number(spark, keys):
    df = spark.createDataFrame(random_rows(3000, 5), EVENTS).withColumnRenamed("seq", "s")
    got = ordered.running_number(df, keys, "s", share=0.01, min_rows=0).orderBy("s").collect()
    seen = {}
    for r in got:
        key = r.account_id if keys else ""
        seen[key] = seen.get(key, 0) + 1
        assert r.n == seen[key]


def test_running_number_with_null_and_equal_order_values(spark):
    df = spark.createDataFrame([("k", None, i) for i in range(5)] + [("k", 7, i) for i in range(20)], "k string, o long, t long")
    for keys in (["k"], []):
        got = ordered.running_number(df, keys, "o", ["t"], share=0.1, min_rows=0).collect()
        assert [(r.o, r.t) for r in sorted(got, key=lambda r: r.n)] == [(None, i) for i in range(5)] + [(7, i) for i in range(20)]


def test_hot_key_is_cut_into_even_blocks(spark):
    df = spark.range(100_000).selectExpr("if(id % 3 = 0, 0, id) AS k", "id AS o")
    every, large = ordered.with_blocks(df, ["k"], "o", share=0.01, min_rows=0)
    sizes = every.where("k = 0").groupBy("_block").count().collect()
    assert len(sizes) >= 33 and max(r["count"] for r in sizes) <= 1100
    assert large.count() == 33_334 and every.count() == 100_000


def test_block_with_a_third_of_the_rows_is_cut_again(spark):
    """One order value far away from all others would leave everything in one block."""
    df = spark.range(60_000).selectExpr("if(id = 7, bigint(1e15), id) AS o", "'k' AS k")
    every, _ = ordered.with_blocks(df, ["k"], "o", share=0.01, min_rows=0)
    assert max(r["count"] for r in every.groupBy("_block").count().collect()) <= 700
    for keys in (["k"], []):
        got = ordered.running_number(df, keys, "o", share=0.01, min_rows=0).orderBy("o").select("n").collect()
        assert [r.n for r in got] == list(range(1, 60_001))


@pytest.mark.parametrize("order,ties", [
    ("CASE id WHEN 7 THEN -bigint(1e15) WHEN 8 THEN bigint(1e15) ELSE id % 100 END", ["t"]),  # two far outliers
    ("timestamp_seconds(if(id < 40000, 1000, id))", ["t"]),  # many rows of one moment
    ("if(id < 30000, NULL, string(id))", ["t"]),  # many nulls, and texts as order values
])
def test_blocks_do_not_depend_on_the_order_values(spark, order, ties):
    df = spark.range(60_000).selectExpr(f"{order} AS o", "hash(id) AS t", "'k' || (id div 100000) AS k")
    want = [tuple(r) for r in df.orderBy("o", "t").select("o", "t").collect()]
    for keys in (["k"], []):
        every, large = ordered._blocks(df, keys, "o", ties, 0.0, 600, even=not keys)
        assert large.count() == 60_000
        assert max(r["count"] for r in every.groupBy("_block").count().collect()) <= 1200
        got = ordered.running_number(df, keys, "o", ties, min_rows=600).orderBy("n").collect()
        assert [(r.o, r.t) for r in got] == want and [r.n for r in got] == list(range(1, 60_001))


def test_two_levels_of_cuts(spark):
    """More places than one array of the first level holds."""
    df = spark.range(50_000).selectExpr("if(id % 50 = 0, 'cold' || id, 'hot') AS k", "pmod(hash(id), 1000) AS o", "id AS t")
    every, large = ordered.with_blocks(df, ["k"], "o", min_rows=100, ties=["t"])
    sizes = every.groupBy("k", "_block").count().collect()
    assert len(sizes) > 1000 + 5000 and max(r["count"] for r in sizes) <= 200
    assert large.where("k <> 'hot'").count() == 0
    got = ordered.running_number(df, ["k"], "o", ["t"], min_rows=100).where("k = 'hot'").orderBy("n").collect()
    assert [(r.o, r.t) for r in got] == sorted((r.o, r.t) for r in got) and [r.n for r in got] == list(range(1, 49_001))


def test_large_grants_and_debits_are_exact(spark):
    rows = [("a", 1, "debit", 5 * 10**12), ("a", 2, "grant", 2 * 10**12), ("b", 1, "debit", 9 * 10**18), ("b", 2, "debit", 9 * 10**18),
            ("b", 3, "credit", 9 * 10**18), ("c", 1, "debit", 7), ("c", 2, "grant", None)]
    got = {(r.account_id, r.seq): r.balance for r in ledger.points_ledger(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {("a", 1): -5 * 10**12, ("a", 2): -3 * 10**12, ("b", 1): -9 * 10**18, ("b", 2): -18 * 10**18,
                   ("b", 3): -9 * 10**18, ("c", 1): -7, ("c", 2): CAP}
    deltas = ledger.point_deltas(spark.createDataFrame([("b", 1, "credit", 9 * 10**18), ("b", 2, "credit", 9 * 10**18)], EVENTS))
    assert [int(r.delta) for r in deltas.collect()] == [18 * 10**18]
