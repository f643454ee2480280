"""Accounts, the follow graph and direct messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import japanese_time
from .ordered import BLOCK, MIN_ROWS, SHARE, carry, running_number, with_blocks

EDGE = ["followed_id", "follower_id"]


def account_profile(accounts: DataFrame, addresses: DataFrame) -> DataFrame:
    """Each account with its postal address."""
    return accounts.join(addresses, "account_id", "left")


def follow_now(log: DataFrame) -> DataFrame:
    """The follow graph after a log of follow and unfollow actions (followed_id, follower_id, seq, action)."""
    last = log.groupBy(*EDGE).agg(F.max_by("action", "seq").alias("action"))
    return last.where(F.col("action") == "follow").select(*EDGE)


def follow_starts(log: DataFrame, present: DataFrame, busy: bool = True) -> DataFrame:
    """The follow actions that make an edge: those that do not find it there already.

    ``present`` are the edges before the log. An edge whose log is very long is cut into blocks;
    each block gets the action before its first.
    """
    every, large = with_blocks(log.select(*EDGE, "seq", "action"), EDGE, "seq", busy=busy)
    ends = large.groupBy(*EDGE, BLOCK).agg(F.max_by("action", "seq").alias("_end"))
    earlier = ends.select(*EDGE, BLOCK, F.lag("_end").over(Window.partitionBy(*EDGE).orderBy(BLOCK)).alias("_earlier"))
    before = F.lag("action").over(Window.partitionBy(*EDGE, BLOCK).orderBy("seq"))
    marked = carry(every.withColumn("_before", before), earlier, EDGE)
    marked = marked.join(present.select(*EDGE, F.lit("follow").alias("_present")), EDGE, "left")
    absent = F.coalesce("_before", "_earlier", "_present", F.lit("unfollow")) != "follow"
    return marked.where((F.col("action") == "follow") & absent).select(*EDGE, "seq")


def follow_add(requests: DataFrame, follows: DataFrame) -> DataFrame:
    """New edges of a batch, each once with its first request; edges that exist already are left out."""
    first = requests.groupBy(*EDGE).agg(F.min("seq").alias("seq"))
    return first.join(follows.select(*EDGE), EDGE, "left_anti")


def follow_remove(follows: DataFrame, requests: DataFrame) -> DataFrame:
    """The graph without the edges a batch removes."""
    return follows.join(requests.select(*EDGE), EDGE, "left_anti")


def follow_counts(follows: DataFrame) -> DataFrame:
    """Accounts followed by and following each account that takes part in the graph."""
    followers = follows.groupBy(F.col("followed_id").alias("account_id")).agg(F.count(F.lit(1)).alias("n_followers"))
    following = follows.groupBy(F.col("follower_id").alias("account_id")).agg(F.count(F.lit(1)).alias("n_following"))
    return followers.join(following, "account_id", "full").select(
        "account_id",
        F.coalesce("n_following", F.lit(0)).alias("n_following"),
        F.coalesce("n_followers", F.lit(0)).alias("n_followers"),
    )


def following(follows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Whom each account follows, with names."""
    named = accounts.select(F.col("account_id").alias("followed_id"), F.col("account_name").alias("followed_name"))
    return follows.select(*EDGE).join(named, "followed_id").select("follower_id", "followed_id", "followed_name")


def followers(follows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Who follows each account, with both names; edges to unknown accounts drop out."""
    return following(follows, accounts).join(
        accounts.select(F.col("account_id").alias("follower_id"), F.col("account_name").alias("follower_name")),
        "follower_id",
    )


def follow_flag(candidates: DataFrame, follows: DataFrame) -> DataFrame:
    """For (viewer_id, account_id) pairs other than the viewer: does the viewer follow the account?"""
    edges = follows.select(
        F.col("followed_id").alias("account_id"), F.col("follower_id").alias("viewer_id"), F.lit(True).alias("followed")
    ).distinct()
    return (
        candidates.where(F.col("viewer_id") != F.col("account_id"))
        .join(edges, ["viewer_id", "account_id"], "left")
        .select("viewer_id", "account_id", F.coalesce("followed", F.lit(False)).alias("followed"))
    )


def dm_threads(
    messages: DataFrame, accounts: DataFrame, share: float = SHARE, min_rows: int = MIN_ROWS
) -> DataFrame:
    """Every live message with its pair of accounts and its place in their thread (by time, then id)."""
    pairs = messages.where(F.col("deleted") == 0).select(
        F.least("sender_id", "receiver_id").alias("low_id"),
        F.greatest("sender_id", "receiver_id").alias("high_id"),
        "dm_id", "sender_id", "receiver_id", "content", "media", "sent_at",
    )
    placed = running_number(pairs, ["low_id", "high_id"], "sent_at", ["dm_id"], "position", share=share, min_rows=min_rows)
    named = accounts.select(F.col("account_id").alias("receiver_id"), F.col("account_name").alias("receiver_name"))
    return placed.join(named, "receiver_id", "left").select(
        "low_id", "high_id", "position", "dm_id", "sender_id", "receiver_id", "receiver_name", "content", "media",
        japanese_time(F.col("sent_at")).alias("sent_at_text"),
    )


def dm_sides(threads: DataFrame) -> DataFrame:
    """The thread as each of its two accounts sees it: ``self`` for own messages, else ``other``."""
    viewers = F.array_distinct(F.array("low_id", "high_id"))
    return (
        threads.withColumn("viewer_id", F.explode(viewers))
        .withColumn("partner_id", F.when(F.col("viewer_id") == F.col("low_id"), F.col("high_id")).otherwise(F.col("low_id")))
        .withColumn("side", F.when(F.col("sender_id") == F.col("viewer_id"), "self").otherwise("other"))
        .select("viewer_id", "partner_id", "position", "side", "dm_id", "content", "sent_at_text")
    )
