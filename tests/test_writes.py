import pytest
from pyspark.sql import functions as F

from cradlemart.operators import writes
from cradlemart.schemas import FEEDS, LISTED
from cradlemart.sources.tables import load_tables, marketplace

from . import shop

def at():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


@pytest.fixture(scope="module")
def m(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shop"))
    shop.write(spark, folder)
    return marketplace(load_tables(spark, folder))


def test_ids_pass_99999_and_start_at_one(spark):
    new = spark.range(5).selectExpr("10 - id AS seq")
    old = spark.createDataFrame([("99997",), ("00005",), ("junk",)], "new_id string")
    got = {r.seq: r.new_id for r in writes.assign_ids(new, old, "new_id", "seq").collect()}
    assert got == {6: "99998", 7: "99999", 8: "100000", 9: "100001", 10: "100002"}
    more = spark.createDataFrame([("99999",), ("100000",)], "new_id string")
    assert min(r.new_id for r in writes.assign_ids(new, more, "new_id", "seq").collect()) == "100001"
    first = writes.assign_ids(new, old.limit(0), "new_id", "seq").collect()
    assert sorted(r.new_id for r in first) == ["00001", "00002", "00003", "00004", "00005"]


def test_ids_are_dense_over_uneven_order_values(spark):
    new = spark.range(5000).selectExpr("if(id < 2000, id, id * id * 1000) AS seq")
    got = writes.assign_ids(new, spark.createDataFrame([], "k string"), "k", "seq").orderBy("seq").collect()
    assert [int(r.k) for r in got] == list(range(1, 5001))


def form(seq, channel, uploads):
    return (seq, channel, "00001", "name", "未使用に近い", "d", "¥ 1,234", "00002", "着払い(購入者負担)", "3～4日で発送", "1～2週", uploads)


def test_list_items(spark, m):
    forms = spark.createDataFrame(
        [
            form(3, "sale", ["a.png", "", "c.png", "d.png"]), form(1, "sale", ["x.png", "", "", ""]),
            form(2, "rental", ["r.png", "s.png", "", ""]),
        ],
        FEEDS["listing_form"],
    )
    out = writes.list_items(forms, m["listing"], m["category_status"], m["photo"], at())
    listings = {(r.channel, r.listing_id): r for r in out.listings.collect()}
    assert set(listings) == {("sale", "00006"), ("sale", "00007"), ("rental", "00002")}
    assert listings["sale", "00006"].rental_period is None and listings["rental", "00002"].rental_period == "1～2週"
    assert str(listings["sale", "00007"].price) == "1234.00" and listings["sale", "00007"].status == LISTED
    assert {(r.channel, r.status_id, r.listing_id) for r in out.category_status.collect()} == {
        ("sale", "00006", "00006"), ("sale", "00007", "00007"), ("rental", "00002", "00002"),
    }
    assert {(r.channel, r.photo_id, r.listing_id, r.path[-2:]) for r in out.photos.collect()} == {
        ("sale", "00007", "00006", "_1"), ("sale", "00008", "00007", "_1"), ("sale", "00009", "00007", "_3"),
        ("sale", "00010", "00007", "_4"), ("rental", "00002", "00002", "_1"), ("rental", "00003", "00002", "_2"),
    }


def test_publish_posts(spark, m):
    forms = spark.createDataFrame(
        [(8, "00001", "t2", ["a", "", "", "a"], ["", "p.png", "", "q.png"]), (5, "00002", "t1", ["x"], ["z.jpg", "", "", ""])],
        FEEDS["post_form"],
    )
    out = writes.publish_posts(forms, m["post"], m["post_content"], m["post_media"], at())
    assert {(r.post_id, r.title) for r in out.posts.collect()} == {("00004", "t1"), ("00005", "t2")}
    texts = {r.content_id: (r.post_id, r.text) for r in out.contents.collect()}
    assert texts == {
        "00005": ("00004", "x"), "00006": ("00004", None), "00007": ("00004", None), "00008": ("00004", None),
        "00009": ("00005", "a"), "00010": ("00005", ""), "00011": ("00005", ""), "00012": ("00005", "a"),
    }
    media = {r.media_id: (r.content_id, r.path.split("_")[-1]) for r in out.media.collect()}
    assert media == {"00003": ("00005", "z.jpg"), "00004": ("00010", "p.png"), "00005": ("00012", "q.png")}


def test_comments_and_messages(spark, m):
    forms = spark.createDataFrame(
        [(1, "sale", "00001", "00001", "hi"), (2, "rental", "00001", "00001", "ho")],
        "seq long, channel string, listing_id string, author_id string, content string",
    )
    got = {(r.channel, r.comment_id, r.deleted) for r in writes.add_comments(forms, m["comment"]).collect()}
    assert got == {("sale", "00004", 0), ("rental", "00002", 0)}
    dm = spark.createDataFrame([(1, "00001", "00002", "x")], "seq long, receiver_id string, sender_id string, content string")
    assert writes.send_dms(dm, m["dm"], at()).first().dm_id == "00005"


def test_updates(spark, m):
    changes = spark.createDataFrame(
        [(1, "00001", "old", "1", 0, "9", "p", "c", "n", "b"), (2, "00001", "new", None, 2, "8", "p2", "c", "n", None)],
        "seq long, account_id string, account_name string, phone string, children int, postal_code string, "
        "prefecture string, city_ward string, address_number string, building string",
    )
    accounts, addresses = writes.update_profiles(m["account"], m["address"], changes)
    rows = {r.account_id: r for r in accounts.collect()}
    assert (rows["00001"].account_name, rows["00001"].phone, rows["00001"].children) == ("new", None, 2)
    assert rows["00002"].account_name == "beni" and rows["00001"].points == 50
    assert addresses.first().postal_code == "8" and addresses.first().building is None


def test_edits_and_photos(spark, m):
    changes = spark.createDataFrame(
        [(1, c, "00001", "n", "k", "d", "5", "a", "b", "00004", "半年以上") for c in ("sale", "rental")],
        "seq long, channel string, listing_id string, name string, condition string, description string, price string, "
        "shipping_payer string, shipping_estimate string, category_id string, rental_period string",
    ).withColumn("price", F.col("price").cast("decimal(12,2)"))
    for channel, category in (("sale", "00001"), ("rental", "00004")):
        listings, bridge = writes.edit_listings(m["listing"], m["category_status"], changes, channel)
        row = listings.where(f"channel = '{channel}' AND listing_id = '00001'").first()
        assert row.name == "n" and row.category_id == category
        assert bridge.where(f"channel = '{channel}' AND listing_id = '00001'").first().category_id == "00004"
        assert listings.where("name = 'n'").count() == 1
    uploads = spark.createDataFrame(
        [(1, "sale", "00001", "u1"), (2, "sale", "00001", "u2")], "seq long, channel string, listing_id string, path string"
    )
    photos = writes.replace_photos(m["photo"], uploads).where("channel = 'sale' AND listing_id = '00001'").collect()
    assert [r.path for r in photos] == ["u2"] * 4
    icons = spark.createDataFrame([(1, "00002", "i")], "seq long, account_id string, icon string")
    assert writes.replace_icons(m["account"], icons).where("icon = 'i'").first().account_id == "00002"


def test_category_drift(m):
    assert {r.listing_id for r in writes.category_drift(m["listing"], m["category_status"]).collect()} == {
        "00002", "00003", "00004", "00005",
    }
