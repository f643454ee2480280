"""Hard negatives by Fagin's threshold algorithm, a block of rows at a time.

Components become integers (floor of 256 x), so a score, the inner product with the anchor, is exact.
In a block every dimension has a list of the rows sorted by their component. An anchor reads each
list from the end that its sign favours, a few ranks at a time in all lists at once (sorted access);
rows seen for the first time are scored in full (random access). No row that is still unseen can
score more than the threshold, the inner product of the anchor with the components last read. A
window of scores is finished as soon as the threshold falls strictly below its k-th score (equal
scores must still be seen, since smaller ids come first) or below its lower limit.

The first pass finds each anchor's positives, the second one the negatives in all the windows of an
anchor at once. Each block gives at most k rows a window; the best k of all blocks are the result.
Blocks hold at most about ``BLOCK_ROWS`` rows and see the anchors as a stream, see ``blocks``.

Rules for odd input: rows with a null id, label or vector, or with a null or non-finite component take
no part. Rows that agree in id, label and vector count once; other rows that share an id are all rows of
their own. Vectors of different lengths have no score with each other; empty vectors score 0. Ties go
to the smaller id (rows that share an id: in no stated order). A component beyond 64 bits is held at the
64-bit limit, and so is a score. Tables without anchors, positives or negatives give no rows. Other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import best, in_blocks, number_of_blocks
from .common import only, stored

ANCHOR_EVERY = 100
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # a negative's score in hundredths of its positive's
SCALE = 256
BLOCK_ROWS, LEAST_ROWS = 32_768, 2_048
FIRST_DEPTH = 16  # ranks read before the first look at the threshold; doubled each time
LIMIT = 2**63 - 1


def usable(rows: DataFrame) -> DataFrame:
    """(id, label, vec) of the rows that take part, with integer components, each once."""
    number = lambda x: x.cast("double")
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) != float("inf")))
    return (
        rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & sound)
        .select("id", "label", F.transform("vec", lambda x: F.floor(number(x) * F.lit(float(SCALE)))).alias("vec"))
        .distinct()
    )


class Lists(NamedTuple):
    """The rows of a block that have vectors of one length, and their rank lists."""

    rows: np.ndarray  # numbers of the rows in the block
    values: np.ndarray  # rows x dimensions, in a type that holds every score exactly
    order: np.ndarray  # dimensions x rows: row numbers by rising component
    largest: int


class Block(NamedTuple):
    ids: pa.Array
    labels: np.ndarray
    lists: dict[int, Lists]


def _exact_type(largest: int, other: int, width: int) -> type:
    """The fastest type in which an inner product of such components is exact."""
    bound = largest * other * max(width, 1)
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object


def _largest(values: np.ndarray) -> int:
    return max(abs(int(values.max())), abs(int(values.min())), 1) if values.size else 1


def build_block(table: pa.Table) -> Block:
    vectors = table["vec"].combine_chunks()
    bounds, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
    sizes, lists = np.diff(bounds), {}
    for width in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == width)
        values = flat[(bounds[rows][:, None] + np.arange(width)).ravel()].reshape(len(rows), width)
        order = np.argsort(values, axis=0, kind="stable").astype(np.int32).T.copy()
        largest = _largest(values)
        lists[width] = Lists(rows, values.astype(_exact_type(largest, largest, width)), order, largest)
    return Block(table["id"].combine_chunks(), table["label"].to_numpy(), lists)


class Search:
    """The best ``k`` rows seen so far in one window of scores [low, high]."""

    def __init__(self, k: int, low: int = -LIMIT - 1, high: int = LIMIT):
        self.k, self.low, self.high = k, low, high
        self.rows, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, rows: np.ndarray, scores: np.ndarray) -> None:
        fits = (scores >= self.low) & (scores <= self.high)
        if len(self.rows) == self.k:
            fits &= scores >= self.scores[-1]
        if not fits.any():
            return
        rows, scores = np.concatenate([self.rows, rows[fits]]), np.concatenate([self.scores, scores[fits]])
        order = np.lexsort((rows, ~scores))[: self.k]  # rows of a block are numbered by rising id
        self.rows, self.scores = rows[order], scores[order]

    def finished(self, threshold: int) -> bool:
        return threshold < self.low or (len(self.rows) == self.k and threshold < self.scores[-1])


def _held(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit numbers; beyond that they are held at the limits."""
    if scores.dtype == object:
        return np.array([max(-LIMIT - 1, min(LIMIT, x)) for x in scores], np.int64)
    return scores.astype(np.int64)


def threshold_search(lists: Lists, anchor: np.ndarray, allowed: np.ndarray, searches: list[Search]) -> int:
    """Fill the searches with the best of the allowed rows; returns how many rows were seen."""
    n, width = lists.values.shape
    kind = _exact_type(lists.largest, _largest(anchor), width)
    weights = anchor.astype(kind)
    values = lists.values.astype(kind, copy=False)
    up, down = np.flatnonzero(anchor < 0), np.flatnonzero(anchor > 0)
    signed = np.concatenate([up, down])
    seen, depth, step, still = np.zeros(n, bool), 0, FIRST_DEPTH, searches
    while still and depth < n:
        until = min(n, depth + step) if len(signed) else n
        new = np.full(n, len(signed) == 0)  # an anchor of zeros has no list to read: all rows score 0
        new[lists.order[up, depth:until]] = True
        new[lists.order[down, n - until : n - depth]] = True
        new &= ~seen
        seen |= new
        rows = np.flatnonzero(new & allowed)
        if len(rows):
            scores = _held(values[rows] @ weights)
            for search in still:
                search.offer(rows, scores)
        depth, step = until, 2 * step
        last = lists.values[np.concatenate([lists.order[up, until - 1], lists.order[down, n - until]]), signed]
        threshold = sum(int(x) * int(w) for x, w in zip(last, anchor[signed], strict=True))
        still = [s for s in still if not s.finished(threshold)]
    return int(seen.sum())


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _asked(block: Block, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, Lists]]:
    """Number, label, vector of each query that the block has rows for, with the lists to search."""
    vectors = _column(batch, "vec")
    for i, label in enumerate(_column(batch, "label").to_pylist()):
        anchor = vectors[i].values.to_numpy(zero_copy_only=False)
        if len(anchor) in block.lists:
            yield i, label, anchor, block.lists[len(anchor)]


def _is(block: Block, lists: Lists, own: object, label: int, anchor: np.ndarray) -> np.ndarray:
    """Which rows are the anchor itself."""
    same = pc.equal(block.ids, own).to_numpy(zero_copy_only=False)[lists.rows] & (block.labels[lists.rows] == label)
    at = np.flatnonzero(same)
    same[at] = (lists.values[at] == anchor).all(axis=1)
    return same


def _find_positives(k: int):
    def answer(block: Block, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        asked, found, scores = [], [], []
        ids = _column(batch, "id")
        for i, label, anchor, lists in _asked(block, batch):
            search = Search(k)
            others = (block.labels[lists.rows] == label) & ~_is(block, lists, ids[i], label, anchor)
            threshold_search(lists, anchor, others, [search])
            asked += [i] * len(search.rows)
            found.append(lists.rows[search.rows])
            scores.append(search.scores)
        at = pa.array(asked, pa.int64())
        columns = [ids.take(at), _column(batch, "query").take(at), *_joined(block, found, scores)]
        yield pa.RecordBatch.from_arrays(columns, ["anchor_id", "query", "id", "score"])

    return answer


def _find_negatives(k: int, low: int, high: int):
    def answer(block: Block, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        asked, places, found, scores = [], [], [], []
        positives = _column(batch, "positives")
        bounds, points = positives.offsets.to_numpy(), positives.values.field("score").to_pylist()
        for i, label, anchor, lists in _asked(block, batch):
            # low * p <= 100 * n <= high * p, in whole numbers
            searches = {at: Search(k, -(-low * points[at] // 100), high * points[at] // 100) for at in range(bounds[i], bounds[i + 1])}
            searches = {at: s for at, s in searches.items() if s.low <= s.high}
            threshold_search(lists, anchor, block.labels[lists.rows] != label, list(searches.values()))
            for at, search in searches.items():
                asked += [i] * len(search.rows)
                places += [at] * len(search.rows)
                found.append(lists.rows[search.rows])
                scores.append(search.scores)
        at, places = pa.array(asked, pa.int64()), pa.array(places, pa.int64())
        windows = [positives.values.field(name).take(places) for name in ("place", "id", "score")]
        columns = [_column(batch, "id").take(at), _column(batch, "query").take(at), *windows, *_joined(block, found, scores)]
        names = ["anchor_id", "query", "place", "positive_id", "positive_score", "id", "score"]
        yield pa.RecordBatch.from_arrays(columns, names)

    return answer


def _joined(block: Block, found: list[np.ndarray], scores: list[np.ndarray]) -> list[pa.Array]:
    """Ids and scores of the rows found."""
    none = [np.zeros(0, np.int64)]
    return [block.ids.take(pa.array(np.concatenate(none + found))), pa.array(np.concatenate(none + scores))]


def mine_negatives(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``is_anchor`` tells anchors by ``id``."""
    data = stored(usable(only(rows, id=id_col, label=label_col, vec=vector_col)))
    blocks = number_of_blocks(data.count(), block_rows, LEAST_ROWS, data.sparkSession.sparkContext.defaultParallelism)
    place, kind = F.xxhash64("id", "label", "vec"), data.schema["id"].dataType.simpleString()
    anchors = data.where(is_anchor).withColumn("query", F.xxhash64("label", "vec"))  # tells rows of one id apart

    order = [F.col("score").desc(), F.col("id")]
    near = in_blocks(
        data, place, anchors, blocks, build_block, _find_positives(positives),
        f"anchor_id {kind}, query bigint, id {kind}, score bigint",
    )
    windows = best(near, ["anchor_id", "query"], order, positives).groupBy("anchor_id", "query").agg(
        F.collect_list(F.struct(F.col("rank").alias("place"), "id", "score")).alias("positives")
    )
    asked = anchors.join(windows.withColumnRenamed("anchor_id", "id"), ["id", "query"])
    far = in_blocks(
        data, place, stored(asked), blocks, build_block, _find_negatives(negatives, low, high),
        f"anchor_id {kind}, query bigint, place int, positive_id {kind}, positive_score bigint, id {kind}, score bigint",
    )
    return best(far, ["anchor_id", "query", "place"], order, negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
