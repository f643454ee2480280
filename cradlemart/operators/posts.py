"""The parenting diary: feed and post pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import line_breaks
from .ordered import MIN_ROWS, PAGE_ROWS, SHARE, paged_lists


def _live(posts: DataFrame, only_live: bool) -> DataFrame:
    return posts.where((F.col("deleted") == 0) & (F.col("visibility") == 0)) if only_live else posts


def _with_author(posts: DataFrame, accounts: DataFrame) -> DataFrame:
    return posts.join(accounts.select("account_id", "account_name"), "account_id", "left")


def post_feed(posts: DataFrame, accounts: DataFrame, only_live: bool = False) -> DataFrame:
    """All posts with author and title. Hidden and deleted ones stay in unless ``only_live``."""
    return _with_author(_live(posts, only_live), accounts).select("post_id", "account_id", "account_name", "title")


def post_detail(
    posts: DataFrame,
    accounts: DataFrame,
    contents: DataFrame,
    media: DataFrame,
    only_live: bool = False,
    share: float = SHARE,
    min_rows: int = MIN_ROWS,
    page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """The post page: distinct content ids, texts, media ids and media of each post, in content order.

    Equal texts of one post show once. Lists longer than ``page_rows`` (1,000 by default) go on
    in rows with ``first_no`` > 1.
    """
    def parts(rows: DataFrame, **values: str) -> DataFrame:
        place = F.col("content_id").try_cast("bigint").alias("_order")
        each = [F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")) for kind, c in values.items()]
        return rows.select("post_id", place, F.inline(F.array(*each))).where(F.col("value").isNotNull())

    texts = parts(contents, content_id="content_id", text="text")
    files = parts(media.join(contents.select("content_id", "post_id"), "content_id"), media_id="media_id", media="path")
    distinct = texts.unionByName(files).groupBy("post_id", "kind", "value").agg(F.min("_order").alias("_order"))
    lists = paged_lists(distinct, ["post_id", "kind"], "_order", {"items": "value"}, ["value"], page_rows, share, min_rows)
    pages = lists.groupBy("post_id", "first_no").agg(
        *[
            F.first(F.when(F.col("kind") == kind, F.col("items")), ignorenulls=True).alias(name)
            for kind, name in (("content_id", "content_ids"), ("text", "texts"), ("media_id", "media_ids"), ("media", "media"))
        ]
    )
    return _with_author(_live(posts, only_live), accounts).join(pages, "post_id", "left").select(
        "post_id", "account_id", "account_name", "title", "posted_at", "visibility", "deleted",
        F.coalesce("first_no", F.lit(1)).alias("first_no"), "content_ids", "texts", "media_ids", "media",
    )


def post_html(contents: DataFrame) -> DataFrame:
    """Post texts with line breaks as the page prints them."""
    return contents.select("content_id", "post_id", line_breaks(F.col("text")).alias("html"))
