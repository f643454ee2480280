"""Each stream, fed in several micro-batches, against its batch twin."""

import random

import pytest
from pyspark.sql import functions as F

from cradlemart.operators import ledger, quality, settlement, social
from cradlemart.schemas import FEEDS, LISTED, PAY_CARD, PAY_POINTS
from cradlemart.sources.changes import put_changes, read_state, runs, superseded
from cradlemart.sources.tables import append, committed_versions, publish, read_feed, read_snapshot
from cradlemart.streaming import jobs

from .test_quality import COLUMNS, GOOD


def feed(spark, folder, df, parts):
    """Write a feed as files in seq order and read it one file per micro-batch."""
    rows = df.orderBy("seq").collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(folder)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return read_feed(spark, folder, schema, max_files=1)


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def test_points(spark, tmp_path):
    rnd = random.Random(4)
    log = spark.createDataFrame(
        [(f"a{rnd.randrange(6)}", i, rnd.choice(["grant", "reset", "credit", "debit"]), rnd.randrange(70_000_000)) for i in range(400)],
        FEEDS["ledger_event"],
    )
    path = jobs.live_points(feed(spark, str(tmp_path / "in"), log, 4), str(tmp_path / "out"))
    got = jobs.read_points(spark, path, "string")
    assert rows(got) == rows(ledger.last_balance(ledger.points_ledger(log)))


def test_listing_state(spark, tmp_path):
    rnd = random.Random(5)
    log = spark.createDataFrame(
        [(i, rnd.choice(["sale", "rental"]), str(rnd.randrange(40)), rnd.choice(["listed", "sold", "deleted"])) for i in range(200)],
        FEEDS["listing_event"],
    )
    path = jobs.live_listing_state(feed(spark, str(tmp_path / "in"), log, 3), str(tmp_path / "out"))
    got = jobs.read_listings(spark, path, "string")
    assert rows(got) == rows(settlement.listing_state(log))


@pytest.mark.parametrize("mode", ["as_is", "first_wins"])
def test_settlement(spark, tmp_path, mode):
    rnd = random.Random(6)
    listings = spark.createDataFrame(
        [(c, str(i), f"s{i % 3}", LISTED, int(i == 2)) for c in ("sale", "rental") for i in range(8)],
        "channel string, listing_id string, seller_id string, status string, deleted int",
    )
    buys = spark.createDataFrame(
        [
            (
                i, rnd.choice(["sale", "rental"]), str(rnd.randrange(9)), f"b{rnd.randrange(4)}",
                rnd.choice([PAY_CARD, PAY_POINTS]), str(rnd.randrange(300, 900)), str(rnd.randrange(1000)),
            )
            for i in range(90)
        ],
        FEEDS["purchase"],
    )
    stream = feed(spark, str(tmp_path / "in"), buys, 3)
    paths = jobs.live_settlement(stream, listings, str(tmp_path / "out"), mode)
    ids = spark.createDataFrame([], "channel string, transaction_id string")
    want = settlement.settle(buys, listings, ids, mode)
    for name, path in paths.items():
        got = spark.read.parquet(path).drop("batch")
        if name == "listing_updates":
            got = got.distinct()
        assert rows(got) == rows(getattr(want, name)), name


def test_follow(spark, tmp_path):
    rnd = random.Random(7)
    log = spark.createDataFrame(
        [(i, f"u{rnd.randrange(4)}", f"u{rnd.randrange(4)}", rnd.choice(["follow", "unfollow"])) for i in range(150)],
        "seq long, followed_id string, follower_id string, action string",
    )
    path = jobs.live_follow(feed(spark, str(tmp_path / "in"), log, 3), str(tmp_path / "out"))
    got = jobs.read_follows(spark, path, "string")
    assert rows(got.drop("follow_id")) == rows(social.follow_now(log))
    ids, there, last = {}, set(), 0
    for r in log.orderBy("seq").collect():
        edge = (r.followed_id, r.follower_id)
        if r.action == "unfollow":
            there.discard(edge)
        elif edge not in there:
            there.add(edge)
            last += 1
            ids[edge] = f"{last:05}"
    assert {(r.followed_id, r.follower_id): r.follow_id for r in got.collect()} == {e: ids[e] for e in there}


def test_registration(spark, tmp_path):
    rnd = random.Random(8)
    forms = [{**GOOD, "seq": i, "username": f"u{rnd.randrange(12)}", "email": f"e{rnd.randrange(12)}"} for i in range(40)]
    df = spark.createDataFrame([tuple(f[c] for c in COLUMNS) for f in forms], FEEDS["registration"])
    resent = df.unionByName(df.where("seq % 10 = 3"))  # the same form sent twice
    timed = resent.withColumn("sent_at", F.timestamp_seconds(F.col("seq") + 1704067200))
    accounts = spark.createDataFrame([("u0", "e0")], "account_name string, email string")
    path = jobs.live_registration(feed(spark, str(tmp_path / "in"), timed, 2), accounts, str(tmp_path / "out"))
    want = {r.seq: r.errors for r in quality.validate_registrations(df, accounts).collect()}
    got = spark.read.parquet(path).collect()
    assert len(got) == 40 and {r.seq: r.errors for r in got} == want


def test_window_counts_drop_late_rows(spark, tmp_path):
    times = ["00:10", "00:50", "01:10", "05:30", "05:10", "05:20", "00:20", "05:40"]
    df = spark.createDataFrame(
        [(i, f"2024-01-01 {t}:00", "dm") for i, t in enumerate(times)], "seq long, t string, kind string"
    ).withColumn("t", F.col("t").cast("timestamp"))
    stream = feed(spark, str(tmp_path / "in"), df, 4)
    path, late = jobs.live_window_counts(stream, "t", "kind", str(tmp_path / "out"), late="1 hour")
    assert {(r.window_start.hour, r.n) for r in jobs.read_counts(spark, path).collect()} == {(0, 2), (1, 1), (5, 4)}
    assert [r.seq for r in spark.read.parquet(late).collect()] == [6]


def test_batch_run_again_leaves_the_same_result(spark, tmp_path):
    folder = str(tmp_path / "t")
    df = spark.range(3)
    append(df, folder, 0)
    append(df, folder, 0)
    append(df, folder, 1)
    assert spark.read.parquet(folder).count() == 6
    append(df, str(tmp_path / "plain"))
    append(df, str(tmp_path / "plain"))
    assert spark.read.parquet(str(tmp_path / "plain")).count() == 6
    snap = str(tmp_path / "s")
    assert read_snapshot(spark, snap, "id bigint").count() == 0
    publish(df, snap, 0)
    publish(df.limit(1), snap, 1)
    publish(spark.range(5), snap, 10)
    assert read_snapshot(spark, snap, "id bigint").count() == 5
    assert read_snapshot(spark, snap, "id bigint", before=10).count() == 1
    assert committed_versions(spark, snap) == [0, 1, 10]
    (tmp_path / "s" / "version=10" / "_SUCCESS").unlink()
    assert read_snapshot(spark, snap, "id bigint").count() == 1


def test_late_forms_are_handled(spark, tmp_path):
    forms = [{**GOOD, "seq": i, "username": f"u{i}", "email": f"e{i}"} for i in (20, 21, 5)]
    df = spark.createDataFrame([tuple(f[c] for c in COLUMNS) for f in forms], FEEDS["registration"]).coalesce(1)
    accounts = spark.createDataFrame([("u0", "e0")], "account_name string, email string")
    path = jobs.live_registration(feed(spark, str(tmp_path / "in"), df, 3), lambda: accounts, str(tmp_path / "out"))
    assert {r.seq for r in spark.read.parquet(path).collect()} == {20, 21, 5}


def test_streams_start_from_stored_state(spark, tmp_path):
    events = spark.createDataFrame([("a", i, "credit", 1) for i in range(6)], "account_id string, seq long, kind string, amount long")
    opening = spark.createDataFrame([("a", 100), ("b", 7)], "account_id string, points long")
    path = jobs.live_points(feed(spark, str(tmp_path / "in"), events, 3), str(tmp_path / "out"), opening)
    got = jobs.read_points(spark, path, "string")
    assert {r.account_id: int(r.points) for r in got.collect()} == {"a": 106, "b": 7}
    log = spark.createDataFrame([(1, "x", "y", "unfollow"), (2, "p", "q", "follow"), (3, "p", "r", "follow")],
                                "seq long, followed_id string, follower_id string, action string")
    stored_edges = spark.createDataFrame([("x", "y", "00007"), ("x", "z", "00009")], "followed_id string, follower_id string, follow_id string")
    path = jobs.live_follow(feed(spark, str(tmp_path / "in2"), log, 3), str(tmp_path / "out2"), stored_edges)
    got = {(r.followed_id, r.follower_id, r.follow_id) for r in jobs.read_follows(spark, path, "string").collect()}
    assert got == {("x", "z", "00009"), ("p", "q", "00010"), ("p", "r", "00011")}


def test_points_go_on_after_a_restart(spark, tmp_path):
    """The stream ends, gets more events and starts again on its checkpoint; a busy account is cut into blocks."""
    rnd = random.Random(14)
    log = [(f"a{min(rnd.randrange(12), 4)}", i, rnd.choice(["grant", "reset", "credit", "debit"]), rnd.randrange(70_000_000)) for i in range(300)]
    df = spark.createDataFrame(log, FEEDS["ledger_event"])
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    path = jobs.live_points(feed(spark, source, df.where("seq < 200"), 2), out)
    path = jobs.live_points(feed(spark, source, df.where("seq >= 200"), 2), out)
    assert rows(jobs.read_points(spark, path, "string")) == rows(ledger.last_balance(ledger.points_ledger(df)))
    touched = {r.n for r in spark.read.parquet(f"{out}/effects").where("batch >= 0").groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert max(touched) <= 5  # one row per account a batch


def test_net_effects_compose(spark):
    rnd = random.Random(15)
    log = [(f"a{rnd.randrange(3)}", i, rnd.choice(["grant", "grant", "credit", "debit", "reset"][: rnd.choice((4, 5))]), rnd.randrange(60_000_000)) for i in range(200)]
    df = spark.createDataFrame(log, FEEDS["ledger_event"])
    opening = spark.createDataFrame([("a0", 90_000_000), ("a1", 5)], "account_id string, points long")
    want = {r.account_id: int(r.points) for r in ledger.last_balance(ledger.points_ledger(df, opening)).collect()}
    for min_rows in (2_000_000, 20):
        for r in ledger.net_effects(df, min_rows=min_rows).collect():
            b = {"a0": 90_000_000, "a1": 5}.get(r.account_id, 0)
            cut = 0 if r.peak is None else max(0, b + int(r.peak) - 99_999_999)
            assert (int(r.set_to) if r.set_to is not None else b + int(r.delta) - cut) == want[r.account_id]


def test_changes_are_written_once_and_merged_by_levels(spark, tmp_path):
    path, ddl = str(tmp_path / "state"), "k string, v bigint"
    now = {}
    for batch in range(11):
        change = {f"k{(batch * 3 + i) % 10}": (batch, i == 2) for i in range(3)}
        frame = spark.createDataFrame([(k, v, gone) for k, (v, gone) in change.items()], ddl + ", gone boolean").coalesce(1)
        for _ in range(2 if batch in (3, 8) else 1):  # a batch that runs again
            put_changes(frame, path, ddl, ["k"], batch, fanout=3)
        before = dict(now)
        now = {k: v for k, v in {**now, **{k: None if gone else v for k, (v, gone) in change.items()}}.items() if v is not None}
        assert {r.k: r.v for r in read_state(spark, path, ddl, ["k"], batch, fanout=3).collect()} == before
        assert {r.k: r.v for r in read_state(spark, path, ddl, ["k"], fanout=3).collect()} == now
    assert [first for first, _ in runs(spark, path, fanout=3)] == [0, 9, 10]
    only = spark.createDataFrame([("k1",), ("k7",)], "k string")
    assert {r.k for r in read_state(spark, path, ddl, ["k"], only=only, fanout=3).collect()} == {"k1", "k7"} & set(now)
    assert len(superseded(spark, path, fanout=3)) == 12


def test_few_changes_of_a_large_state_write_few_rows(spark, tmp_path):
    path, ddl = str(tmp_path / "state"), "k bigint, v bigint"
    put_changes(spark.range(200_000).selectExpr("id AS k", "0L AS v"), path, ddl, ["k"], 0)
    put_changes(spark.range(0, 200_000, 200).selectExpr("id AS k", "1L AS v"), path, ddl, ["k"], 1)
    assert spark.read.parquet(f"{path}/level=0/version=1").count() == 1_000
    state = read_state(spark, path, ddl, ["k"])
    assert state.count() == 200_000 and state.agg(F.sum("v")).first()[0] == 1_000


def test_a_part_of_a_table_is_one_batch_however_many_files_it_has(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs.StreamedViews, "FILE_ROWS", 5, raising=False)
    keys = [*range(60), 75, 149]  # parts of 50, 11 and 1 rows
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").repartition(8).write.parquet(str(tmp_path / "customer.parquet"))
    views, seen = jobs.StreamedViews(spark, str(tmp_path)), {}
    for name, stream in (("steps", views.table("customer")), ("mixed", views.mixed("customer"))):
        seen[name] = []
        jobs.start(stream, lambda rows, n, name=name: seen[name].append(sorted(r.c_custkey for r in rows.collect())), str(tmp_path / name))
    assert seen["steps"] == [[*range(50)], [*range(50, 60), 75], [149]]
    assert seen["mixed"] == [[k for k in keys if k % 3 == part] for part in range(3)]
