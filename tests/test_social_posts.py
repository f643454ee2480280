import random

import pytest

from cradlemart.operators import posts, social
from cradlemart.sources.tables import load_tables, marketplace

from . import shop


@pytest.fixture(scope="module")
def m(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shop"))
    shop.write(spark, folder)
    return marketplace(load_tables(spark, folder))


def test_follow_graph(m):
    counts = {r.account_id: (r.n_following, r.n_followers) for r in social.follow_counts(m["follow"]).collect()}
    assert counts == {"00001": (2, 1), "00002": (1, 1), "00099": (0, 1)}
    assert {(r.follower_id, r.followed_name) for r in social.following(m["follow"], m["account"]).collect()} == {
        ("00001", "beni"), ("00002", "aki"),
    }
    assert {(r.followed_name, r.follower_name) for r in social.followers(m["follow"], m["account"]).collect()} == {
        ("beni", "aki"), ("aki", "beni"),
    }


def test_follow_flag_and_add(spark, m):
    pairs = spark.createDataFrame([("00001", "00001"), ("00001", "00002"), ("00003", "00002")], "viewer_id string, account_id string")
    got = {(r.viewer_id, r.account_id): r.followed for r in social.follow_flag(pairs, m["follow"]).collect()}
    assert got == {("00001", "00002"): True, ("00003", "00002"): False}
    wanted = spark.createDataFrame(
        [(1, "00002", "00001"), (2, "00003", "00001"), (3, "00003", "00001")], "seq long, followed_id string, follower_id string"
    )
    assert [(r.seq, r.followed_id) for r in social.follow_add(wanted, m["follow"]).collect()] == [(2, "00003")]
    assert social.follow_remove(m["follow"], wanted).count() == 2


def test_follow_log_equals_replay(spark):
    rnd = random.Random(11)
    log = [(i, f"u{rnd.randrange(4)}", f"u{rnd.randrange(4)}", rnd.choice(["follow", "unfollow"])) for i in range(300)]
    edges = set()
    for _, followed, follower, action in log:
        (edges.add if action == "follow" else edges.discard)((followed, follower))
    df = spark.createDataFrame(log, "seq long, followed_id string, follower_id string, action string")
    assert {tuple(r) for r in social.follow_now(df).collect()} == edges


def test_profile(m):
    rows = {r.account_id: r for r in social.account_profile(m["account"], m["address"]).collect()}
    assert rows["00001"].prefecture == "東京都" and rows["00002"].prefecture is None and len(rows) == 3


def test_dm_thread(m):
    rows = social.dm_threads(m["dm"], m["account"]).collect()
    thread = sorted((r for r in rows if r.high_id == "00002"), key=lambda r: r.position)
    assert [(r.position, r.dm_id, r.receiver_name) for r in thread] == [(1, "00001", "aki"), (2, "00002", "beni")]
    assert thread[0].sent_at_text == "2024年05月01日 12:00:00"
    sides = {(r.viewer_id, r.dm_id): r.side for r in social.dm_sides(social.dm_threads(m["dm"], m["account"])).collect()}
    assert sides == {
        ("00001", "00001"): "other", ("00002", "00001"): "self", ("00001", "00002"): "self", ("00002", "00002"): "other",
        ("00001", "00004"): "self",
    }


def test_dm_busy_thread_is_numbered_across_blocks(spark, m):
    dm = spark.range(3000).selectExpr(
        "id AS dm_id", "if(id % 3 = 0, 'x', 'y') AS receiver_id", "if(id % 3 = 0, 'y', 'x') AS sender_id", "'' AS content",
        "'' AS media", "timestamp_seconds(1700000000 + id div 2) AS sent_at", "int(id % 10 = 9) AS deleted",
    )
    rows = social.dm_threads(dm, m["account"], share=0.05, min_rows=0).collect()
    rows.sort(key=lambda r: r.dm_id)
    assert [r.position for r in rows] == list(range(1, 2701))


def test_posts(m):
    feed = {r.post_id: r for r in posts.post_feed(m["post"], m["account"]).collect()}
    assert feed["00002"].account_name is None and len(feed) == 3
    assert [r.post_id for r in posts.post_feed(m["post"], m["account"], only_live=True).collect()] == ["00001"]
    rows = {r.post_id: r for r in posts.post_detail(m["post"], m["account"], m["post_content"], m["post_media"]).collect()}
    assert rows["00001"].texts == ["同じ\n文", ""] and rows["00001"].content_ids == ["00001", "00002", "00003", "00004"]
    assert rows["00001"].media == ["m/1.jpg", "m/2.jpg"] and rows["00002"].texts is None
    html = {r.content_id: r.html for r in posts.post_html(m["post_content"]).collect()}
    assert html["00001"] == "同じ<br>文"
