"""Purchases: accept or reject, move points, mark listings sold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_digits
from ..schemas import LISTED, PAY_POINTS, SOLD
from ..session import stored
from .catalog import LISTING

LARGEST_PRICE = 9_999_999_999  # what a listing's decimal(12,2) can hold
from .writes import assign_ids


@dataclass
class Settlement:
    transactions: DataFrame
    events: DataFrame
    listing_updates: DataFrame
    rejects: DataFrame


def check_purchases(purchases: DataFrame, listings: DataFrame, mode: str = "as_is") -> DataFrame:
    """Each purchase with its seller, numbers and ``reason`` (null when it is accepted).

    Claimed points and price are taken from the form, as the site does. ``as_is`` lets sold or
    deleted listings be bought again; ``first_wins`` accepts the first purchase of a live listing.
    """
    if mode not in ("as_is", "first_wins"):
        raise ValueError(f"unknown mode {mode!r}")
    by_points = F.col("payMethod") == PAY_POINTS
    read = purchases.withColumn("price", ascii_digits(F.col("sellingPrice")).try_cast("bigint")).withColumn(
        "claimed", ascii_digits(F.col("point")).try_cast("bigint")
    )
    read = read.withColumn(
        "_form_reason",
        F.when(
            F.col("price").isNull() | (F.col("price") > LARGEST_PRICE) | (by_points & F.col("claimed").isNull()), "bad_number"
        ).when(
            by_points & (F.col("claimed") < F.col("price")), "not_enough_points"
        ),
    )
    state = listings.select(*LISTING, "seller_id", "status", "deleted", F.lit(True).alias("_known"))
    reason = F.when(F.col("_known").isNull(), "missing_listing").otherwise(F.col("_form_reason"))
    if mode == "first_wins":
        # The winner is found per listing before the join, so a listing that everybody wants to buy
        # is reduced on the map side and the join itself stays free to split it.
        good = read.where(F.col("_form_reason").isNull())
        state = state.join(good.groupBy(*LISTING).agg(F.min("seq").alias("_first")), LISTING, "left")
        gone = (F.col("status") == SOLD) | (F.col("deleted") != 0) | (F.col("seq") != F.col("_first"))
        reason = F.coalesce(reason, F.when(gone, "already_gone"))
    checked = read.join(state, LISTING, "left").withColumn("reason", reason)
    return checked.select(
        "seq", *LISTING, F.col("account_id").alias("buyer_id"), "seller_id", F.col("payMethod").alias("payment_method"),
        "price", "claimed", "reason",
    )


def settle(
    purchases: DataFrame, listings: DataFrame, transactions: DataFrame, mode: str = "as_is"
) -> Settlement:
    """Turn purchases into new transaction rows, ledger events, listing updates and rejects.

    The seller is always credited; the buyer is debited when paying with points. The checked
    purchases are written once, as all four outputs and the numbering read them.
    """
    return split_settlement(stored(check_purchases(purchases, listings, mode)), transactions)


def split_settlement(checked: DataFrame, transactions: DataFrame) -> Settlement:
    """The four outputs of a checked batch, which should be a stored or persisted one."""
    accepted = checked.where(F.col("reason").isNull())
    credit = F.struct(F.col("seller_id").alias("account_id"), F.lit("credit").alias("kind"))
    debit = F.when(
        F.col("payment_method") == PAY_POINTS, F.struct(F.col("buyer_id").alias("account_id"), F.lit("debit").alias("kind"))
    )
    numbered = assign_ids(accepted, transactions, "transaction_id", "seq", per_channel=True)
    return Settlement(
        transactions=numbered.select(
            "channel", "transaction_id", "listing_id", "buyer_id", "payment_method", F.lit(0).alias("status")
        ),
        events=accepted.select("seq", F.col("price").alias("amount"), F.explode(F.array(credit, debit)).alias("e"))
        .where(F.col("e").isNotNull())
        .select("e.account_id", "seq", "e.kind", "amount"),
        listing_updates=accepted.select(*LISTING).distinct().withColumn("status", F.lit(SOLD)),
        rejects=checked.where(F.col("reason").isNotNull()).select(
            "seq", *LISTING, "buyer_id", "payment_method", "price", "claimed", "reason"
        ),
    )


def listing_state(events: DataFrame) -> DataFrame:
    """Status and deletion flag of each listing from its log (channel, listing_id, kind).

    Both only ever move one way, so the order of the log does not matter.
    """
    was = lambda kind: F.max(F.when(F.col("kind") == kind, 1).otherwise(0))
    return (
        events.groupBy(*LISTING)
        .agg(was("sold").alias("_sold"), was("deleted").alias("deleted"))
        .select(*LISTING, F.when(F.col("_sold") == 1, SOLD).otherwise(LISTED).alias("status"), "deleted")
    )


def sales_report(transactions: DataFrame, listings: DataFrame) -> DataFrame:
    """Number and value of purchases per channel and payment method, at the listed price."""
    return (
        transactions.join(listings.select(*LISTING, "price"), LISTING)
        .groupBy("channel", "payment_method")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("price").cast("bigint")).cast("bigint").alias("total"))
    )
