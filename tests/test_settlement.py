import pytest

from cradlemart.operators import ledger, settlement
from cradlemart.schemas import FEEDS, LISTED, PAY_CARD, PAY_POINTS, SOLD

LISTINGS = "channel string, listing_id string, seller_id string, status string, deleted int"
TRANSACTIONS = "channel string, transaction_id string"


@pytest.fixture(scope="module")
def shop(spark):
    listings = spark.createDataFrame(
        [("sale", "1", "s", LISTED, 0), ("sale", "2", "s", SOLD, 0), ("sale", "3", "t", LISTED, 1), ("rental", "1", "t", LISTED, 0)],
        LISTINGS,
    )
    purchases = spark.createDataFrame(
        [
            (1, "sale", "1", "b", PAY_CARD, "500", "0"),
            (2, "sale", "1", "c", PAY_POINTS, "500", "500"),
            (3, "sale", "1", "c", PAY_POINTS, "500", "499"),
            (4, "sale", "9", "c", PAY_CARD, "500", "0"),
            (5, "sale", "2", "s", PAY_POINTS, "70", "100"),
            (6, "sale", "3", "b", PAY_CARD, "30", None),
            (7, "rental", "1", "b", PAY_POINTS, "30", "x"),
            (8, "rental", "1", "b", PAY_CARD, "40", "x"),
        ],
        FEEDS["purchase"],
    )
    return purchases, listings, spark.createDataFrame([("sale", "99999")], TRANSACTIONS)


def test_default_mode(shop):
    out = settlement.settle(*shop)
    assert {(r.channel, r.transaction_id, r.listing_id, r.buyer_id) for r in out.transactions.collect()} == {
        ("sale", "100000", "1", "b"), ("sale", "100001", "1", "c"), ("sale", "100002", "2", "s"),
        ("sale", "100003", "3", "b"), ("rental", "00001", "1", "b"),
    }
    assert {(r.seq, r.reason) for r in out.rejects.collect()} == {
        (3, "not_enough_points"), (4, "missing_listing"), (7, "bad_number"),
    }
    deltas = {r.account_id: r.delta for r in ledger.point_deltas(out.events).collect()}
    assert deltas == {"s": 500 + 500 + 70 - 70, "c": -500, "t": 30 + 40}
    assert out.listing_updates.count() == 4
    balances = ledger.last_balance(ledger.points_ledger(out.events))
    assert {r.account_id: r.points for r in balances.collect()} == deltas


def test_first_wins(shop):
    out = settlement.settle(*shop, mode="first_wins")
    assert {(r.channel, r.listing_id, r.buyer_id) for r in out.transactions.collect()} == {
        ("sale", "1", "b"), ("rental", "1", "b"),
    }
    assert {r.seq for r in out.rejects.where("reason = 'already_gone'").collect()} == {2, 5, 6}
    with pytest.raises(ValueError):
        settlement.settle(*shop, mode="other")


def test_listing_state(spark):
    log = spark.createDataFrame(
        [(1, "sale", "1", "listed"), (2, "sale", "1", "sold"), (3, "sale", "2", "deleted"), (4, "rental", "1", "listed")],
        FEEDS["listing_event"],
    )
    got = {(r.channel, r.listing_id): (r.status, r.deleted) for r in settlement.listing_state(log).collect()}
    assert got == {("sale", "1"): (SOLD, 0), ("sale", "2"): (LISTED, 1), ("rental", "1"): (LISTED, 0)}
