"""Ordered work per key that stays spread out when one key holds a large part of all rows.

A plain window sends a whole key to one task. Here a key with many more than ``min_rows`` rows (and
``share`` of all rows, if a share is given) is cut into blocks along its order; the window runs per
(key, block) and a table with one row per block carries the result of the earlier blocks on.

Blocks are cut at drawn rows, so their sizes depend on how many rows there are and not on how the
order values are spread: far outliers, steep gaps and millions of rows with one order value do no
harm as long as ties tell the rows apart. About ``SPLITS`` rows are drawn for each ``min_rows``, by a
hash of key and place, so every reading of the same rows draws the same ones and no data goes through
the driver. The places of a key are held in sorted arrays on two levels and looked up by halving; both
levels have about as many places as the square root of those drawn, so a key of 10^12 rows has arrays
of some 3,000 places. Spark's own size estimate decides whether these tables are broadcast.

Rows that agree in key, order and ties stay in one block. Nulls come first. For one group
of all rows pass no keys: over a key column that is a literal Spark has nothing to join by but nested loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARE = 0.0
MIN_ROWS = 2_000_000  # rows a key or block may have uncut; blocks do not grow with the data
PAGE_ROWS = 1_000  # values in one row of a list
BLOCK = "_block"
PARTS = 1 << 32  # more than the parts a block can be cut into
SPLITS = 16  # rows drawn per limit: a block above the limit has a chance of e^-16, one above twice of e^-32
LARGE = 8  # drawn rows from which a key is cut; one of twice the limit has fewer with a chance of 10^-7
DRAWS = 2**53


def _at(order: str, ties: list[str | Column]) -> Column:
    """The place of a row in its key, as a struct that compares like the window's order."""
    values = [F.col(f"`{v}`") if isinstance(v, str) else v for v in (order, *ties)]
    return F.struct(*[value.alias(f"_{i}") for i, value in enumerate(values)])


def _limit(df: DataFrame, share: float, min_rows: int) -> Column:
    """The largest number of rows a key or block may have uncut."""
    least = float(max(min_rows, 1))
    if not share:
        return F.lit(least)
    return df.agg(F.expr(f"greatest(count(1) * double({share}), double({least}))").alias("_limit")).scalar()


def _beside(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the further columns of a table that has one row per key, or one row in all without keys."""
    added = [c for c in small.columns if c not in keys]
    columns = [F.col(f"`{c}`") for c in df.columns]
    if not keys:
        return df.select(*columns, *[small.select(c).scalar().alias(c) for c in added])
    named = small.selectExpr(*[f"`{k}` AS `_hot_{k}`" for k in keys], *added)
    match = F.expr(" AND ".join(f"`{k}` <=> `_hot_{k}`" for k in keys))
    return df.join(named, match, "left").select(*columns, *added)


def _part(df: DataFrame, cuts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add ``name``: 1 + how many cuts of its group a row at ``_at`` has reached; 0 where there are no cuts.

    Always a left join: an inner one may be built from ``df`` and then holds the arrays of all its rows at once.
    """
    step = "p + shiftleft(1, i)"
    reached = f"""if(size(_cuts) > 0, aggregate(sequence(length(bin(size(_cuts))) - 1, 0, -1), 0, (p, i) ->
        if({step} <= size(_cuts) AND try_element_at(_cuts, {step}) <= _at, {step}, p), p -> 1 + p), 0)"""
    return _beside(df, cuts, keys).withColumn(name, F.expr(f"bigint({reached})")).drop("_cuts")


def _cuts(df: DataFrame, keys: list[str], at: Column, limit: Column) -> tuple[DataFrame, DataFrame]:
    """Sorted places to cut at: per large key, and per large key and part of the first cut."""
    rate = F.least(F.lit(1.0), F.lit(float(SPLITS)) / limit)
    draw = F.pmod(F.xxhash64(*keys, at), F.lit(DRAWS)) / F.lit(float(DRAWS))
    rows = df.select(*keys, at.alias("_at"), draw.alias("_draw")).where(F.col("_draw") < rate).distinct()
    known = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_drawn")).where(F.col("_drawn") >= LARGE)
    drawn = _beside(rows, known, keys).where(F.col("_drawn").isNotNull())
    places = F.sort_array(F.collect_set("_at")).alias("_cuts")
    few = F.col("_draw") * F.sqrt("_drawn") < rate
    first = drawn.where(few).groupBy(*keys).agg(places)
    second = _part(drawn, first, keys, "_first").groupBy(*keys, "_first").agg(places)
    return first, second


def _blocks(
    df: DataFrame, keys: list[str], order: str, ties: list[str | Column], share: float, min_rows: int, even: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``_block``, and only its rows in cut groups.

    ``even`` cuts the whole table along ``order`` whatever the size of its keys.
    """
    by, at = [] if even else keys, _at(order, ties)
    first, second = _cuts(df, by, at, _limit(df, share, min_rows))

    once = _part(df.withColumn("_at", at), first, by, "_first")
    twice = _part(once, second, [*by, "_first"], "_second")
    every = twice.selectExpr(*[f"`{c}`" for c in df.columns], f"_first * {PARTS} + _second AS {BLOCK}")
    return every, every if even else every.where(F.col(BLOCK) > 0)


def with_blocks(
    df: DataFrame, keys: list[str], order: str, share: float = SHARE, min_rows: int = MIN_ROWS, busy: bool = True,
    ties: list[str | Column] = (),
) -> tuple[DataFrame, DataFrame]:
    """All rows with ``_block`` (0 for ordinary keys, rising along ``order`` for large ones), and the
    rows of large keys alone for making the per-block table. A caller that has counted no more than
    ``min_rows`` rows in all may say that no key is ``busy``."""
    if not busy:
        whole = df.withColumn(BLOCK, F.lit(0).cast("bigint"))
        return whole, whole.where(F.lit(False))
    return _blocks(df, keys, order, ties, share, min_rows)


def carry(df: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Join the per-block table back to the rows of its block."""
    return _beside(df, summary, [*keys, BLOCK])


def _carried(large: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Totals of the earlier blocks of a key, one row per block, as ``_before_<name>``."""
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return (
        large.groupBy(*keys, BLOCK)
        .agg(*[F.sum(value).alias(f"_in_{name}") for name, value in sums.items()])
        .select(*keys, BLOCK, *[F.sum(f"_in_{name}").over(before).alias(f"_before_{name}") for name in sums])
    )


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, Column],
    ties: list[str | Column] = (),
    share: float = SHARE,
    min_rows: int = MIN_ROWS,
    cut_all: bool = False,
) -> DataFrame:
    """Running totals per key by (order, ties), the current row included.

    Without keys the totals run over the whole table, which is then always cut into blocks.
    ``cut_all`` does the same for keys of few values that each hold much of the table. The input is
    read several times, all but once for its key and order columns only, so it should be a stored one.
    """
    every, large = _blocks(df, keys, order, ties, share, min_rows, even=cut_all or not keys)
    # Few-valued keys come after the block, which tells rows apart faster when sorting.
    groups = [BLOCK, *keys] if cut_all else [*keys, BLOCK]
    along = Window.partitionBy(*groups).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    local = every.select("*", *[F.sum(value).over(along).alias(name) for name, value in sums.items()])
    return carry(local, _carried(large, keys, sums), keys).selectExpr(
        *[f"`{c}`" for c in df.columns], *[f"bigint({name} + coalesce(_before_{name}, 0)) AS {name}" for name in sums]
    )


def running_number(
    df: DataFrame, keys: list[str], order: str, ties: list[str | Column] = (), name: str = "n", **options: object
) -> DataFrame:
    """``row_number`` per key (or over the whole table) by (order, ties), starting at 1."""
    return running_sums(df, keys, order, {name: F.lit(1)}, ties, **options)


def paged_lists(
    df: DataFrame,
    keys: list[str],
    order: str,
    lists: dict[str, str],
    ties: list[str | Column] = (),
    page_rows: int = PAGE_ROWS,
    share: float = SHARE,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Group concatenation with bounded rows: ordered arrays of at most ``page_rows`` values.

    A key with up to ``page_rows`` rows gives one row with ``first_no`` = 1; a longer one goes on
    in further rows. ``lists`` maps output names to columns; nulls are skipped as in GROUP_CONCAT.
    """
    every, large = with_blocks(df, keys, order, share, min_rows, ties=ties)
    place = F.row_number().over(Window.partitionBy(*keys, BLOCK).orderBy(order, *ties))
    placed = carry(every.withColumn("_no", place), _carried(large, keys, {"rows": F.lit(1)}), keys)
    # Pages are cut by the number within the whole key, so they do not depend on the blocks.
    pages = placed.withColumn("_no", F.expr("bigint(_no + coalesce(_before_rows, 0))")).withColumn(
        "_page", F.expr(f"(_no - 1) div {page_rows}")
    )
    arrays = pages.groupBy(*keys, "_page").agg(
        F.expr("min(_no)").alias("first_no"),
        *[
            F.expr(f"sort_array(collect_list(if(`{c}` IS NULL, NULL, struct(_no, `{c}` AS v)))).v").alias(out)
            for out, c in lists.items()
        ],
    )
    return arrays.select(*keys, "first_no", *lists)
