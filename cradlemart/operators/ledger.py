"""Points: commands typed into the search box, the capped running balance, balances per account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_digits
from ..schemas import CAP
from .ordered import BLOCK, MIN_ROWS, SHARE, carry, with_blocks

MONEY = "decimal(38,0)"
# Debits are 64-bit numbers, so with fewer than 10^9 of them no balance is low enough to keep a grant
# of this size below the cap: such a grant always leaves exactly the cap, and sums stay within 38 digits.
SURE = 10**28


def points_commands(searches: DataFrame) -> DataFrame:
    """Search texts (seq, account_id, search_box) to grant and reset events.

    Amounts have up to 38 digits; a longer number is null, which the ledger reads as beyond the cap.
    """
    digits = F.regexp_extract("search_box", r"(?U)\ApointGet(\d+)\z", 1)
    is_reset = F.col("search_box") == "pointReset"
    is_grant = digits != ""
    return searches.where(is_reset | is_grant).select(
        "account_id",
        "seq",
        F.when(is_reset, "reset").otherwise("grant").alias("kind"),
        F.when(is_reset, F.lit(0).cast(MONEY)).otherwise(ascii_digits(digits).try_cast(MONEY)).alias("amount"),
    )


EVENT_ORDER = ["seq", "kind"]  # one settlement may credit and debit an account under the same seq


def _newest(value: str | Column) -> Column:
    """The value at the last event; the opening row (no seq) comes first."""
    return F.max_by(value, F.struct(F.coalesce("seq", F.lit(-(2**63))), "kind"))


def _steps(events: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """Sums along ``order`` within ``part``, restarted at every row with a ``set_to`` value.

    ``delta`` is what the row adds; ``peak`` is set where the balance is cut to the cap and holds
    what was added up to that cut. Adds ``sets`` (restarts so far), ``cum`` (sum since the restart)
    and ``top`` (highest sum at a cut since the restart).
    """
    w = f"OVER (PARTITION BY {', '.join(part)} ORDER BY {', '.join(order)} ROWS UNBOUNDED PRECEDING)"
    return (
        events.selectExpr("*", f"count(set_to) {w} AS sets", f"CAST(sum(delta) {w} AS {MONEY}) AS _sum")
        .selectExpr(
            "*",
            f"CAST(_sum - coalesce(last(if(set_to IS NULL, NULL, _sum - set_to), true) {w}, 0BD) AS {MONEY}) AS cum",
        )
        # The largest (sets, sum) pair so far belongs to the newest stretch that has a cut.
        .selectExpr("*", f"max(if(peak IS NULL, NULL, struct(sets, CAST(cum - delta + peak AS {MONEY}) AS sum))) {w} AS _best")
        .selectExpr("*", "if(_best.sets = sets, _best.sum, NULL) AS top")
        .drop("_sum", "_best")
    )


def _balance(opening: str) -> str:
    """SQL for the running balance: the sum less whatever the cap has cut off so far."""
    start = f"if(sets = 0, {opening}, 0BD)"
    return f"CAST({start} + cum - coalesce(greatest(0BD, {start} + top - {CAP}BD), 0BD) AS {MONEY})"


def _known(events: DataFrame) -> DataFrame:
    return events.select("account_id", "seq", "kind", F.col("amount").cast(MONEY).alias("amount")).where(
        F.col("kind").isin("grant", "reset", "credit", "debit")
    )


def _moves(known: DataFrame) -> DataFrame:
    """Events with what they do to a balance: ``set_to``, ``delta`` and ``peak``."""
    return (
        known.selectExpr(
            "*",
            f"""CAST(CASE WHEN kind = 'reset' THEN 0 WHEN kind = 'grant' AND (amount IS NULL OR amount >= {SURE}BD)
                THEN {CAP} END AS {MONEY}) AS set_to""",
        )
        .selectExpr("*", "coalesce(set_to, if(kind = 'debit', -amount, amount)) AS delta")
        .selectExpr("*", "if(kind = 'grant' AND set_to IS NULL, delta, NULL) AS peak")
    )


def _as_event(*keys: str) -> list[str]:
    """What a stretch of events does as a whole, in the shape of one event."""
    return [
        *keys, f"if(sets > 0, {_balance('0BD')}, NULL) AS set_to", f"if(sets > 0, {_balance('0BD')}, cum) AS delta",
        "if(sets = 0, top, NULL) AS peak",
    ]


def net_effects(events: DataFrame, share: float = SHARE, min_rows: int = MIN_ROWS, busy: bool = True) -> DataFrame:
    """What a batch of events does to each account (account_id, set_to, delta, peak), in one row.

    A balance b becomes ``set_to`` where that is given, else b + ``delta`` less what b + ``peak``
    is above the cap. Busy accounts are summed up block by block.
    """
    every, _ = with_blocks(_moves(_known(events)), ["account_id"], "seq", share, min_rows, busy, ties=["kind"])
    end = F.struct("sets", "cum", "top")
    blocks = _steps(every, ["account_id", BLOCK], EVENT_ORDER).groupBy("account_id", BLOCK).agg(_newest(end).alias("end"))
    whole = _steps(blocks.select("account_id", BLOCK, "end.*").selectExpr(*_as_event("account_id", BLOCK)), ["account_id"], [BLOCK])
    last = whole.groupBy("account_id").agg(F.max_by(end, BLOCK).alias("end"))
    return last.select("account_id", "end.*").selectExpr(*_as_event("account_id"))


def points_ledger(
    events: DataFrame, opening: DataFrame | None = None, share: float = SHARE, min_rows: int = MIN_ROWS
) -> DataFrame:
    """Balance after every event (account_id, seq, kind, amount), applied in ``seq`` order.

    An account has at most one event per (seq, kind). grant n adds n and stops at the cap (null: beyond the cap); reset sets 0; credit and debit are not limited.
    Amounts and balances are decimal(38,0).
    ``opening`` (account_id, points) gives balances before the first event; its rows carry no seq.
    """
    known = _known(events)
    if opening is not None:
        known = known.unionByName(
            opening.select(
                "account_id",
                F.lit(None).cast("bigint").alias("seq"),
                F.lit("credit").alias("kind"),
                F.col("points").cast(MONEY).alias("amount"),
            )
        )
    moves = _moves(known)
    every, large = with_blocks(moves, ["account_id"], "seq", share, min_rows, ties=["kind"])
    local = _steps(every, ["account_id", BLOCK], EVENT_ORDER)

    # One row per block of a large account, in the shape of an event: what the block does as a whole.
    ends = (
        _steps(large, ["account_id", BLOCK], EVENT_ORDER)
        .groupBy("account_id", BLOCK)
        .agg(_newest(F.struct("sets", "cum", "top")).alias("end"))
        .select("account_id", BLOCK, "end.*")
    )
    as_events = ends.selectExpr(*_as_event("account_id", BLOCK))
    opened = (
        _steps(as_events, ["account_id"], [BLOCK])
        .selectExpr("account_id", BLOCK, f"{_balance('0BD')} AS _close")
        .selectExpr("account_id", BLOCK, f"lag(_close) OVER (PARTITION BY account_id ORDER BY {BLOCK}) AS _open")
    )
    return carry(local, opened, ["account_id"]).selectExpr(
        "account_id", "seq", "kind", "amount", f"{_balance('coalesce(_open, 0BD)')} AS balance"
    )


def last_balance(ledger: DataFrame) -> DataFrame:
    """The newest balance of each account that has a ledger row."""
    return ledger.groupBy("account_id").agg(_newest("balance").alias("points"))


def points_balance(accounts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Current points of every account as decimal(38,0), 0 where the ledger has none."""
    return (
        accounts.select("account_id")
        .join(last_balance(ledger), "account_id", "left")
        .select("account_id", F.coalesce("points", F.lit(0)).cast(MONEY).alias("points"))
    )


def point_deltas(events: DataFrame) -> DataFrame:
    """Sum of credits and debits per account for one batch, as decimal(38,0)."""
    amount = F.col("amount").cast("decimal(28,0)")  # sums have ten digits more
    signed = F.when(F.col("kind") == "debit", -amount).otherwise(amount)
    return (
        events.where(F.col("kind").isin("credit", "debit"))
        .groupBy("account_id")
        .agg(F.sum(signed).cast(MONEY).alias("delta"))
    )
