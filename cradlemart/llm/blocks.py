"""A stated query set against all rows, in blocks.

Rows are dealt over blocks of bounded size and every query visits every block. Both travel through
one shuffle by block and are sorted so that a block's rows come before the queries; a task thus holds
one block at a time and streams the queries past it, however many they are. A lost task is run again
from the shuffle files. Nothing goes through the driver but the number of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number_of_blocks(rows: int, block_rows: int, least_rows: int, tasks: int) -> int:
    """Blocks of at most about ``block_rows`` rows; as many as there are tasks while rows last."""
    return max(1, -(-rows // block_rows), min(tasks, rows // least_rows))


def in_blocks(
    data: DataFrame, place: Column, queries: DataFrame, blocks: int, build: Callable[[pa.Table], object],
    answer: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str,
) -> DataFrame:
    """``answer(build(rows of a block), queries)`` for every block; rows are ordered by ``id``.

    ``place`` is a number of 64 bits that spreads the rows. The columns of both sides go by name; a
    side that lacks a column has nulls there.
    """
    dealt = data.withColumns({"_block": F.pmod(place, F.lit(blocks)).cast("int"), "_asks": F.lit(0)})
    asked = queries.withColumns({"_block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "_asks": F.lit(1)})
    both = dealt.unionByName(asked, allowMissingColumns=True).repartition(blocks, "_block")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, built = None, [], None
        for batch in batches:
            here, asks = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("_block", "_asks"))
            edges = np.flatnonzero((np.diff(here) != 0) | (np.diff(asks) != 0)) + 1
            for low, high in zip([0, *edges], [*edges, len(here)], strict=True):
                if low == high:
                    continue
                if here[low] != block:
                    block, parts, built = here[low], [], None
                piece = batch.slice(low, high - low)
                if not asks[low]:
                    parts.append(piece)
                elif parts:
                    built = build(pa.Table.from_batches(parts)) if built is None else built
                    yield from answer(built, piece)

    return both.sortWithinPartitions("_block", "_asks", "id").mapInArrow(rows, schema)


def best(found: DataFrame, query: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each query with their ``rank``; each task cuts its own rows first."""
    from pyspark.sql.window import Window

    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)
