"""Listings: the browse grid, keyword and facet search, item pages, storefronts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import same_id, whole_yen
from ..schemas import CATEGORIES, CONDITION_TAGS, PRICE_ABOVE, PRICE_BANDS, SOLD, TAG_ONLY_IN
from .ordered import MIN_ROWS, PAGE_ROWS, SHARE, paged_lists

# The id comes first: sorts compare their first key fast, and a channel alone hardly tells rows apart.
LISTING = ["listing_id", "channel"]


def cover_photos(photos: DataFrame) -> DataFrame:
    """The cover of a listing: its lexicographically largest photo path."""
    return photos.groupBy(*LISTING).agg(F.max("path").alias("cover"))


def browse(listings: DataFrame, photos: DataFrame, *more: str) -> DataFrame:
    """The grid: every listing with its cover, whole-yen price, status and deletion flag (and ``more`` columns)."""
    return listings.join(cover_photos(photos), LISTING, "left").select(
        *LISTING, "cover", whole_yen(F.col("price")).alias("price"), "name", "status", "deleted", *more
    )


def visible(grid: DataFrame) -> DataFrame:
    """What the grid page shows: listings with a photo that are not deleted, with the sold-out badge."""
    shown = (F.coalesce("cover", F.lit("")) != "") & (F.col("deleted") == 0)
    return grid.where(shown).withColumn("sold_out", F.coalesce(F.col("status") == SOLD, F.lit(False)))


def keyword_search(listings: DataFrame, terms: list[str] | DataFrame, wildcards: bool = False) -> DataFrame:
    """Listings whose name contains a term, one row per (term, listing), case-sensitive.

    A list of terms is tested in one pass over the listings. A DataFrame with a ``term`` column may
    be of any size: the distinct names' substrings of the term lengths are matched by an equi-join,
    so the work is names x lengths and not names x terms, and the hits are joined back by name.
    ``wildcards`` lets ``%`` and ``_`` in a listed term match as in LIKE; a backslash before anything
    else stands for itself.
    """
    if isinstance(terms, DataFrame):
        if wildcards:
            raise ValueError("wildcards need the terms as a list")
        wanted = terms.select("term").where(F.col("term").isNotNull()).distinct()
        lengths = wanted.agg(F.collect_set(F.length("term")).alias("_lengths")).scalar()
        names = listings.select("name").where(F.col("name").isNotNull()).distinct()
        sized = names.withColumn("_len", F.explode(lengths)).where(F.col("_len") <= F.length("name"))
        pieces = sized.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("name") - F.col("_len") + 1))).select(
            "name", F.col("name").substr(F.col("_at"), F.col("_len")).alias("term")
        )
        hits = pieces.join(wanted, "term", "left_semi").distinct()
        return listings.join(hits, "name").select("term", *listings.columns)

    def hit(term: str) -> Column:
        return F.col("name").like(f"%{_like(term)}%") if wildcards else F.col("name").contains(term)

    found = _one_row_each(listings, "term", [F.when(hit(term), F.lit(term)) for term in terms])
    return found.select("term", *listings.columns)


def _like(term: str) -> str:
    """A term as LIKE reads it, with backslashes that escape nothing doubled."""
    return re.sub(r"\\([%_\\])?", lambda m: m[0] if m[1] else "\\\\", term)


def _one_row_each(df: DataFrame, name: str, values: list[Column]) -> DataFrame:
    """One row per value that is not null; stays within generated code, unlike array filters."""
    return df.withColumn(name, F.explode(F.array(*values))).where(F.col(name).isNotNull())


def _case(rows: list[tuple[Column, str]]) -> Column:
    """The label of the first test that holds."""
    return F.coalesce(*[F.when(test, F.lit(label)) for test, label in rows])


def category_tags() -> list[Column]:
    return [_case([(same_id(F.col("category_id"), int(key)), name) for key, name in CATEGORIES.items()])]


def condition_tags() -> list[Column]:
    def test(label: str, stored: str) -> Column:
        same = F.col("condition") == stored
        return same & (F.col("channel") == TAG_ONLY_IN[label]) if label in TAG_ONLY_IN else same

    return [_case([(test(label, stored), label) for label, stored in CONDITION_TAGS.items()])]


def price_tags() -> list[Column]:
    """Bands share their ends, so a price may have two tags."""
    price = F.col("price")
    bands = [F.when(price.between(lo, hi), F.lit(label)) for label, (lo, hi) in PRICE_BANDS.items()]
    return [*bands, F.when(price > PRICE_ABOVE[1], F.lit(PRICE_ABOVE[0]))]


def facet(listings: DataFrame, tags: list[Column]) -> DataFrame:
    """One row per (listing, tag) for some of the tags."""
    return _one_row_each(listings, "tag", tags)


def facet_index(listings: DataFrame) -> DataFrame:
    """Every (listing, tag) pair of the 15 tags in one pass, without a join or a shuffle."""
    return facet(listings, [*category_tags(), *condition_tags(), *price_tags()])


def facet_counts(listings: DataFrame) -> DataFrame:
    """Listings per channel and tag."""
    return facet_index(listings).groupBy("channel", "tag").agg(F.count(F.lit(1)).alias("n"))


def photo_lists(photos: DataFrame, share: float = SHARE, min_rows: int = MIN_ROWS, page_rows: int = PAGE_ROWS) -> DataFrame:
    """All photo paths of a listing in photo order, at most ``page_rows`` to a row."""
    ordered = photos.withColumn("_order", F.col("photo_id").try_cast("bigint"))
    return paged_lists(ordered, LISTING, "_order", {"photos": "path"}, ["path"], page_rows, share, min_rows)


def item_detail(listings: DataFrame, photos: DataFrame, categories: DataFrame, **skew: float) -> DataFrame:
    """The item page: the listing, its category from the dimension and its photo list.

    A listing with more than ``page_rows`` photos (1,000 by default) goes on in further rows (``first_no`` > 1).
    """
    dimension = categories.select("category_id", "category_name", F.col("category_id").alias("known_category_id"))
    return (
        listings.join(dimension, "category_id", "left")
        .join(photo_lists(photos, **skew), LISTING, "left")
        .select(
            *LISTING, "seller_id", "name", "condition", "description", whole_yen(F.col("price")).alias("price"),
            "shipping_payer", "shipping_estimate", "rental_period", "status", "deleted",
            F.col("known_category_id").alias("category_id"), "category_name",
            F.coalesce("first_no", F.lit(1)).alias("first_no"),
            F.coalesce("photos", F.array().cast("array<string>")).alias("photos"),
        )
    )


def photo_slots(listings: DataFrame, photos: DataFrame) -> DataFrame:
    """The edit form's four photo slots and the count of photos that are not blank.

    Without any photo the slots are empty texts; with some, the unused ones are null. Every task
    passes on at most its first four photos of a listing, so a listing's many photos never meet.
    """
    place = Window.partitionBy(*LISTING).orderBy("_order", "path")
    first = (
        photos.select(*LISTING, "path", F.col("photo_id").try_cast("bigint").alias("_order"))
        .withColumn("_no", F.row_number().over(place)).where(F.col("_no") <= 4)
        .groupBy(*LISTING)
        .agg(*[F.max(F.when(F.col("_no") == i, F.col("path"))).alias(f"photo{i}") for i in range(1, 5)])
    )
    counts = photos.groupBy(*LISTING).agg(F.count(F.when(F.trim("path") != "", 1)).alias("photo_count"))
    none = F.col("photo_count").isNull()
    return listings.join(counts, LISTING, "left").join(first, LISTING, "left").select(
        *LISTING,
        *[F.when(none, "").otherwise(F.col(f"photo{i}")).alias(f"photo{i}") for i in range(1, 5)],
        F.coalesce("photo_count", F.lit(0)).alias("photo_count"),
    )


def comments(comment: DataFrame, accounts: DataFrame, only_live: bool = False) -> DataFrame:
    """Comments with their author's name and icon; deleted ones stay in unless ``only_live``."""
    rows = comment.where(F.col("deleted") == 0) if only_live else comment
    author = accounts.select(F.col("account_id").alias("author_id"), F.col("account_name").alias("author_name"), "icon")
    return rows.join(author, "author_id", "left").select(
        *LISTING, "comment_id", "author_id", "content", "deleted", "author_name", "icon"
    )


def comment_counts(comment: DataFrame) -> DataFrame:
    return comment.groupBy(*LISTING).agg(F.count(F.lit(1)).alias("comment_count"))


def seller(listings: DataFrame, accounts: DataFrame) -> DataFrame:
    """The seller's id, name and icon of every listing."""
    who = accounts.select(F.col("account_id").alias("seller_id"), F.col("account_name").alias("seller_name"), "icon")
    return listings.select(*LISTING, "seller_id").join(who, "seller_id").select(*LISTING, "seller_id", "seller_name", "icon")


def storefront(listings: DataFrame, photos: DataFrame, channels: tuple[str, ...] = ("sale",)) -> DataFrame:
    """The listings on each account's profile page; the site shows sales only."""
    shown = F.col("channel").isin(*channels)
    return browse(listings.where(shown), photos.where(shown), "seller_id")


def viewer_action(pairs: DataFrame, listings: DataFrame) -> DataFrame:
    """What a viewer may do with a listing (viewer_id, channel, listing_id -> action).

    Only sales tell an owner that the item is sold; an owner of a rental always gets ``owner``.
    """
    state = listings.select(*LISTING, "seller_id", "status")
    owner, sold = F.col("viewer_id") == F.col("seller_id"), F.col("status") == SOLD
    action = (
        F.when(owner & sold & (F.col("channel") == "sale"), "owner_sold")
        .when(owner, "owner")
        .when(sold, "sold")
        .otherwise("buy")
    )
    return pairs.join(state, LISTING).select("viewer_id", *LISTING, action.alias("action"))
