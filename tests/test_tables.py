"""The way back to the stored tables, commits of several tables, narrowing by key."""

from cradlemart.operators import writes
from cradlemart.schemas import TABLES
from cradlemart.sources.tables import append, commit, committed, for_key, load_tables, marketplace, superseded, unmarketplace

from . import shop


def test_round_trip_through_the_stored_tables(spark, tmp_path):
    shop.write(spark, str(tmp_path))
    tables = load_tables(spark, str(tmp_path))
    views = marketplace(tables)
    back = unmarketplace(views)
    assert set(back) == set(TABLES)
    for name, rows in back.items():
        assert rows.columns == tables[name].columns
        kept = [c for c in rows.columns if c != "password"]
        assert sorted(map(str, rows.select(kept).collect())) == sorted(map(str, tables[name].select(kept).collect()))


def test_new_comments_can_be_stored(spark, tmp_path):
    folder = str(tmp_path)
    shop.write(spark, folder)
    views = marketplace(load_tables(spark, folder))
    listing = views["listing"].where("channel = 'sale'").first()
    forms = spark.createDataFrame([(1, "sale", listing.listing_id, listing.seller_id, "new")],
                                  "seq long, channel string, listing_id string, author_id string, content string")
    before = views["comment"].count()
    for name, rows in unmarketplace({"comment": writes.add_comments(forms, views["comment"])}).items():
        append(rows, f"{folder}/{name}")
    again = marketplace(load_tables(spark, folder))["comment"]
    assert again.count() == before + 1 and again.where("content = 'new'").count() == 1


def test_commit_switches_all_tables_at_once(spark, tmp_path):
    root = str(tmp_path / "store")
    assert committed(spark, root) == {}
    commit(spark, root, {"a": spark.range(3), "b": spark.range(4)}, 1)
    commit(spark, root, {"a": spark.range(5)}, 2)
    spark.range(9).write.parquet(f"{root}/b/3-unfinished")  # a commit that never came to its manifest row
    assert {name: rows.count() for name, rows in committed(spark, root).items()} == {"a": 5, "b": 4}
    assert [r["name"] for r in superseded(spark, root).collect()] == ["a"]
    commit(spark, root, {"a": spark.range(6)}, 2)
    assert committed(spark, root)["a"].count() == 6


def test_key_reaches_every_view(spark):
    views = {"x": spark.range(5).withColumnRenamed("id", "post_id"), "y": spark.range(5)}
    one = for_key(views, post_id=3)
    assert one["x"].count() == 1 and one["y"].count() == 5
