import random

import pytest
from pyspark.sql import functions as F

from cradlemart.operators import catalog
from cradlemart.sources.tables import for_listing, load_tables, marketplace

from . import shop


@pytest.fixture(scope="module")
def m(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shop"))
    shop.write(spark, folder)
    return marketplace(load_tables(spark, folder))


def by_id(df, channel="sale"):
    return {r.listing_id: r for r in df.where(F.col("channel") == channel).collect()}


def test_browse_and_visible(m):
    grid = catalog.browse(m["listing"], m["photo"])
    rows = by_id(grid)
    assert rows["00001"].cover == "p/b.jpg" and rows["00003"].price == 300 and rows["00004"].cover is None
    shown = by_id(catalog.visible(grid))
    assert set(shown) == {"00001", "00002"}
    assert (shown["00001"].sold_out, shown["00002"].sold_out) == (False, True)
    assert by_id(catalog.visible(grid), "rental")["00001"].sold_out


def test_facets(m):
    tags = {}
    for r in catalog.facet_index(m["listing"]).collect():
        tags.setdefault((r.channel, r.listing_id), set()).add(r.tag)
    assert tags["sale", "00001"] == {"子供服", "新品/未使用", "0～1000円", "1000～2000円"}
    assert tags["sale", "00002"] == {"ベビー＆マタニティ", "目立った汚れなし", "3000～5000円"}
    assert tags["sale", "00003"] == {"傷/汚れあり", "0～1000円"}
    assert tags["sale", "00004"] == {"ベビー用品", "全体的に状態が悪い", "5000円以上"}
    assert tags["sale", "00005"] == {"未使用に近い", "0～1000円"}
    assert tags["rental", "00001"] == {"育児用品", "目立った傷や汚れなし", "1000～2000円", "2000～3000円"}
    counts = catalog.facet_counts(m["listing"]).collect()
    assert sum(r.n for r in counts) == sum(len(t) for t in tags.values())


def test_keyword(m):
    def hits(*terms, **options):
        return {(r.term, r.listing_id) for r in catalog.keyword_search(m["listing"], list(terms), **options).collect()}

    assert hits("%", "_") == {("%", "00001"), ("_", "00002")}
    assert hits("bib_set", wildcards=True) == {("bib_set", "00002"), ("bib_set", "00005")}
    assert len(catalog.keyword_search(m["listing"], ["%"], wildcards=True).collect()) == 6
    assert hits("CRIB") == set()


def test_keyword_table_equals_brute_force(spark):
    rnd = random.Random(3)
    names = ["".join(rnd.choice("ab c") for _ in range(rnd.randrange(0, 12))) for _ in range(200)]
    words = ["".join(rnd.choice("ab c") for _ in range(rnd.randrange(0, 5))) for _ in range(60)]
    listings = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "listing_id long, name string")
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    got = {(r.term, r.listing_id) for r in catalog.keyword_search(listings, terms).collect()}
    assert got == {(w, i) for w in set(words) for i, n in enumerate(names) if w in n and w} | {
        ("", i) for i, n in enumerate(names) if "" in words
    }


def test_item_detail(m):
    rows = by_id(catalog.item_detail(m["listing"], m["photo"], m["category"]))
    assert rows["00001"].photos == ["p/b.jpg", "p/a.jpg", "p/a,comma.jpg", " "]
    assert rows["00004"].photos == [] and rows["00003"].category_id is None and rows["00001"].category_name == "子供服"


def test_long_photo_list_goes_on_in_pages(spark):
    photos = spark.range(2500).selectExpr(
        "'sale' AS channel", "if(id < 2400, 'hot', string(id)) AS listing_id", "string(id) AS photo_id",
        "format_string('%05d', id) AS path",
    )
    for min_rows in (0, 10**9):
        rows = catalog.photo_lists(photos, share=0.1, min_rows=min_rows).where("listing_id = 'hot'").collect()
        rows.sort(key=lambda r: r.first_no)
        assert max(len(r.photos) for r in rows) <= 1000
        assert [p for r in rows for p in r.photos] == [f"{i:05d}" for i in range(2400)]
        assert [r.first_no for r in rows] == [1 + sum(len(x.photos) for x in rows[:i]) for i in range(len(rows))]


def test_photo_slots(m):
    rows = by_id(catalog.photo_slots(m["listing"], m["photo"]))
    assert [rows["00001"][f"photo{i}"] for i in range(1, 5)] == ["p/b.jpg", "p/a.jpg", "p/a,comma.jpg", " "]
    assert rows["00001"].photo_count == 3
    assert [rows["00002"][f"photo{i}"] for i in range(1, 5)] == ["p/c.jpg", None, None, None]
    assert [rows["00005"][f"photo{i}"] for i in range(1, 5)] == ["", "", "", ""] and rows["00005"].photo_count == 0


def test_photo_slots_pass_on_four_photos_a_task(spark):
    photos = spark.range(3000, numPartitions=6).selectExpr(
        "'sale' AS channel", "if(id % 3 = 0, id, 0) AS listing_id", "id AS photo_id", "if(id % 7 = 0, ' ', concat('p', id)) AS path"
    )
    listings = spark.createDataFrame([("sale", 0), ("sale", 3)], "channel string, listing_id long")
    slots = catalog.photo_slots(listings, photos)
    got = {r.listing_id: tuple(r[f"photo{i}"] for i in range(1, 5)) + (r.photo_count,) for r in slots.collect()}
    assert got == {0: (" ", "p1", "p2", "p4", 1714), 3: ("p3", None, None, None, 1)}
    plan = slots._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_page_size_is_a_parameter(spark, m):
    photos = spark.range(10).selectExpr("'sale' AS channel", "'00001' AS listing_id", "string(id) AS photo_id", "string(id) AS path")
    rows = catalog.item_detail(m["listing"].where("channel = 'sale' AND listing_id = '00001'"), photos, m["category"], page_rows=4)
    assert sorted((r.first_no, len(r.photos)) for r in rows.collect()) == [(1, 4), (5, 4), (9, 2)]


def test_comments_seller_storefront(m):
    rows = {r.comment_id: r for r in catalog.comments(m["comment"], m["account"]).where("channel = 'sale'").collect()}
    assert rows["00001"].author_name == "beni" and rows["00002"].author_name is None and len(rows) == 3
    assert catalog.comments(m["comment"], m["account"], only_live=True).count() == 3
    assert {(r.channel, r.comment_count) for r in catalog.comment_counts(m["comment"]).collect()} == {("sale", 3), ("rental", 1)}
    assert by_id(catalog.seller(m["listing"], m["account"]))["00003"].seller_name == "beni"
    front = catalog.storefront(m["listing"], m["photo"]).collect()
    assert {r.channel for r in front} == {"sale"} and len(front) == 5


def test_viewer_action(spark, m):
    pairs = [
        ("00001", "sale", "00001"), ("00001", "sale", "00002"), ("00003", "rental", "00001"),
        ("00002", "rental", "00001"), ("00003", "sale", "00001"), ("00003", "sale", "77777"),
    ]
    df = spark.createDataFrame(pairs, "viewer_id string, channel string, listing_id string")
    got = {(r.viewer_id, r.channel, r.listing_id): r.action for r in catalog.viewer_action(df, m["listing"]).collect()}
    assert got == {
        pairs[0]: "owner", pairs[1]: "owner_sold", pairs[2]: "owner", pairs[3]: "sold", pairs[4]: "buy",
    }


def test_key_reaches_every_scan(m):
    """One listing reads one table of each twin pair, with the key pushed down and only its columns."""
    own = for_listing(m, "sale", "00001")
    one = catalog.visible(catalog.browse(own["listing"], own["photo"]))
    plan = one._jdf.queryExecution().executedPlan()
    scans = [line for line in plan.toString().splitlines() if "FileScan" in line]
    assert len(scans) == 2
    assert all("(saleId#" in line and "= 00001)" in line for line in scans)
    assert not any("productDescription" in line for line in scans)
    assert [r.listing_id for r in one.collect()] == ["00001"]
    page = catalog.item_detail(own["listing"], own["photo"], own["category"]).collect()
    assert [(r.listing_id, len(r.photos)) for r in page] == [("00001", 4)]


def test_facets_do_not_shuffle(m):
    plan = catalog.facet_index(m["listing"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_pages_do_not_depend_on_the_cut(spark):
    from cradlemart.operators.ordered import paged_lists

    df = spark.range(50).selectExpr("'k' AS k", "id AS o", "string(id) AS v").union(
        spark.range(500).selectExpr("string(id) AS k", "id AS o", "'x' AS v"))
    found = [
        sorted((r.k, r.first_no, tuple(r.vs)) for r in paged_lists(df, ["k"], "o", {"vs": "v"}, page_rows=10, **cut).collect())
        for cut in ({}, {"share": 0.01, "min_rows": 0}, {"share": 0.0, "min_rows": 7})
    ]
    assert found[0] == found[1] == found[2]
    assert [(n, len(v)) for k, n, v in found[0] if k == "k"] == [(1, 10), (11, 10), (21, 10), (31, 10), (41, 10)]


def test_backslash_in_a_wildcard_term(spark):
    rows = spark.createDataFrame([("a\\b",), ("ab",), ("100%",), ("c\\",)], "name string")
    def names(*terms):
        return sorted((r.term, r.name) for r in catalog.keyword_search(rows, list(terms), wildcards=True).collect())

    assert names("a\\b") == [("a\\b", "a\\b")]
    assert names("0\\%", "c\\") == [("0\\%", "100%"), ("c\\", "c\\")]


def test_term_table_joins_by_distinct_name(spark):
    rows = spark.createDataFrame([(1, "red ring"), (2, "red ring"), (3, None), (4, "")], "listing_id long, name string")
    terms = spark.createDataFrame([("r",), ("ring",), ("zzz",), (None,), ("ring",)], "term string")
    got = sorted((r.term, r.listing_id) for r in catalog.keyword_search(rows, terms).collect())
    assert got == [("r", 1), ("r", 2), ("ring", 1), ("ring", 2)]
