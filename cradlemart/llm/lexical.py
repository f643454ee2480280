"""Ranked lexical search by presence-mask grouping.

Terms are named by two 64-bit hashes. A first pass over the documents counts them (documents, terms)
and the document frequency of the terms that occur in items. A second pass deals the documents'
counts of these terms over blocks of bounded size, and every item visits every block (see ``blocks``).
In a block a term has the list of its documents, and its largest frequency factor there. For an item
the lists set one bit per term in the documents' masks; documents are grouped by mask, and a mask
cannot score more than the sum of its terms' largest contributions. Masks are evaluated by
descending maximum, a growing number of documents at a time, until the k-th score lies above every
maximum that is left (at an equal maximum a smaller id could still come first). Each block gives at
most k documents an item; the best k of all blocks are the result.

All scores are 64-bit integers. A filter of fixed size over the items' terms keeps most other terms
from being sent; it may let some pass and never decides. Texts and counts are read whole.

Rules for odd input: null texts and texts without terms are no documents for the counts and match
nothing; items without terms give no rows. Very long texts are hashed a slice of bounded size at a
time, a longer text as a whole. Rows that share an id are documents of their own. Ties go to the
smaller id, null ids first. Items that repeat id and text count once; different texts under one id
are ranked one by one. Other columns are not looked at. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import best, in_blocks, number_of_blocks
from .common import only, stored
from .tokens import BASE, BASE_INVERSE, LETTERS, Words, _power, mix, words

BEST = 10
FILTER_BITS = 20
BLOCK_ROWS, LEAST_ROWS = 16_384, 2_048
TERM = ["h1", "h2"]
# Fixed values of the ranking: a term's weight and a document's length factor.
WEIGHT, FREQUENCY, PERCENT, LENGTH_PERCENT, LENGTH_FACTOR = 1000, 1_000_000_000, 100, 75, 8
LIMIT = 2**63

_CODES = np.random.RandomState(20251103).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64)


def second_hash(w: Words) -> np.ndarray:
    """A hash of each word that is independent of the first."""
    n = len(w.data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[w.data] * _power(BASE, n), out=sums[1:])
    return mix((sums[w.end] - sums[w.start]) * _power(BASE_INVERSE, n + 1)[w.start]) if n else np.zeros(0, np.uint64)


class Counts(NamedTuple):
    """Terms of some texts: text i has n[i] of them; one entry for each different one."""

    first: int
    n: np.ndarray
    owner: np.ndarray
    h1: np.ndarray
    h2: np.ndarray
    tf: np.ndarray


def term_counts(column: pa.Array, passes: np.ndarray | None = None) -> Iterator[Counts]:
    """Counts of the texts of a batch, a slice at a time; only of terms that pass the filter."""
    for w in words(column, LETTERS):
        n = np.diff(w.offsets)
        owner, h1, h2 = np.repeat(np.arange(len(n)), n), w.hash, second_hash(w)
        if passes is not None:
            may = _may_pass(h1, passes)
            owner, h1, h2 = owner[may], h1[may], h2[may]
        order = np.lexsort((h2, h1, owner))
        owner, h1, h2 = owner[order], h1[order], h2[order]
        edge = np.ones(len(h1), bool)
        edge[1:] = (owner[1:] != owner[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        at = np.flatnonzero(edge)
        tf = np.diff(np.append(at, len(h1)))
        yield Counts(w.first, n, owner[at], h1[at].view(np.int64), h2[at].view(np.int64), tf)


def _may_pass(h1: np.ndarray, passes: np.ndarray) -> np.ndarray:
    cell = h1 >> np.uint64(64 - FILTER_BITS)
    return (passes[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1) == 1


def item_terms(items: DataFrame) -> DataFrame:
    """(query, item_id, h1, h2, times): one row per different term of an item; query tells items of one id apart."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in term_counts(batch.column(2)):
                at = pa.array(c.owner + c.first)
                named = [batch.column(0).take(at), batch.column(1).take(at)]
                counted = [pa.array(x.astype(np.int64)) for x in (c.h1, c.h2, c.tf)]
                yield pa.RecordBatch.from_arrays([*named, *counted], ["query", "item_id", *TERM, "times"])

    kind = items.schema["id"].dataType.simpleString()
    named = items.select(F.xxhash64("text").alias("query"), "id", "text").distinct()
    return named.mapInArrow(rows, f"query bigint, item_id {kind}, h1 bigint, h2 bigint, times bigint")


def term_filter(terms: DataFrame) -> np.ndarray:
    """The items' terms as 2^FILTER_BITS bits, of fixed size whatever the number of items."""
    cell = F.shiftrightunsigned("h1", 64 - FILTER_BITS)
    bit = F.expr(f"shiftleft(1L, int(shiftrightunsigned(h1, {64 - FILTER_BITS}) & 63))")
    packed = terms.groupBy(F.shiftrightunsigned(cell, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for word, bits in packed.collect():  # at most 2^(FILTER_BITS - 6) rows
        out[word] = bits
    return out.view(np.uint64)


def corpus_counts(docs: DataFrame, passes: np.ndarray) -> DataFrame:
    """(h1, h2, df) of the terms that pass the filter; the row without a term has the documents and all terms."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in term_counts(batch.column(1), passes):
                order = np.lexsort((c.h2, c.h1))
                h1, h2 = c.h1[order], c.h2[order]
                at = np.flatnonzero(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))[: len(h1)])
                df = np.diff(np.append(at, len(h1)))
                blank = pa.array([None], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(h1[at]), blank]), pa.concat_arrays([pa.array(h2[at]), blank]),
                        pa.array(np.append(df, (c.n > 0).sum())), pa.array(np.append(np.zeros(len(df), np.int64), c.n.sum())),
                    ],
                    [*TERM, "df", "terms"],
                )

    partial = docs.mapInArrow(rows, "h1 bigint, h2 bigint, df bigint, terms bigint")
    return partial.groupBy(*TERM).agg(F.sum("df").alias("df"), F.sum("terms").alias("terms"))


def document_counts(docs: DataFrame, passes: np.ndarray) -> DataFrame:
    """(id, n, h1, h2, tf) of the documents with terms that pass; the last three are arrays."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in term_counts(batch.column(1), passes):
                which, size = np.unique(c.owner, return_counts=True)
                bounds = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (c.h1, c.h2, c.tf.astype(np.int32))]
                named = [batch.column(0).take(pa.array(which + c.first)), pa.array(c.n[which].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*named, *lists], ["id", "n", *TERM, "tf"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(rows, f"id {kind}, n bigint, h1 array<bigint>, h2 array<bigint>, tf array<int>")


class Block(NamedTuple):
    """Documents of a block, numbered by rising id, and the postings of their terms."""

    ids: pa.Array
    h1: np.ndarray  # the terms, in order
    h2: np.ndarray
    bounds: np.ndarray  # postings bounds of the terms
    docs: np.ndarray
    factor: np.ndarray  # frequency factor of each posting
    largest: np.ndarray  # of each term


def build_block(documents: int, terms: int):
    def length_factor(n: np.ndarray) -> np.ndarray:
        if int(n.max()) * LENGTH_PERCENT * documents >= LIMIT:
            n = n.astype(object)
        return (PERCENT - LENGTH_PERCENT + (LENGTH_PERCENT * n * documents) // terms).astype(np.int64)

    def build(table: pa.Table) -> Block:
        lists = [table[c].combine_chunks() for c in (*TERM, "tf")]
        doc = np.repeat(np.arange(table.num_rows), np.diff(lists[0].offsets.to_numpy()))
        h1, h2, tf = (x.flatten().to_numpy() for x in lists)
        order = np.lexsort((doc, h2, h1))
        h1, h2, doc, tf = h1[order], h2[order], doc[order], tf[order].astype(np.int64)
        at = np.flatnonzero(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        m = length_factor(table["n"].to_numpy())
        factor = (FREQUENCY * tf) // (WEIGHT * tf + LENGTH_FACTOR * m[doc])
        return Block(
            table["id"].combine_chunks(), h1[at], h2[at], np.append(at, len(h1)), doc, factor, np.maximum.reduceat(factor, at)
        )

    return build


def _places(block: Block, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Number of each term in the block, -1 where the block does not have it."""
    out = np.full(len(h1), -1)
    low, high = np.searchsorted(block.h1, h1, "left"), np.searchsorted(block.h1, h1, "right")
    for i in np.flatnonzero(high > low):
        at = low[i] + np.searchsorted(block.h2[low[i] : high[i]], h2[i])
        if at < high[i] and block.h2[at] == h2[i]:
            out[i] = at
    return out


def _grouped(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct masks and the number of each document's mask."""
    if masks.shape[1] == 1:
        distinct, group = np.unique(masks[:, 0], return_inverse=True)
        return distinct[:, None], group
    distinct, group = np.unique(masks, axis=0, return_inverse=True)
    return distinct, group.ravel()


def search_block(block: Block, places: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The best ``k`` documents of the block, their scores, and how many documents were evaluated."""
    none = np.zeros(0, np.int64)
    have = (places >= 0) & (weights > 0)
    places, weights = places[have], weights[have]
    if not len(places):
        return none, none, 0
    postings = [slice(block.bounds[p], block.bounds[p + 1]) for p in places]
    masks = np.zeros((len(block.ids), -(-len(places) // 64)), np.uint64)
    for j, mine in enumerate(postings):
        masks[block.docs[mine], j // 64] |= np.uint64(1) << np.uint64(j % 64)
    docs = np.flatnonzero(masks.any(axis=1))
    distinct, group = _grouped(masks[docs])
    most = np.zeros(len(distinct), np.int64)
    for j, (weight, largest) in enumerate(zip(weights, block.largest[places], strict=True)):
        most += ((distinct[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64) * (weight * largest)
    # Documents in the order of their masks' maxima; all documents of a mask follow each other.
    order = np.lexsort((docs, group, -most[group]))
    docs, bound = docs[order], most[group][order]
    best_docs, best_scores, done, look = none, none, 0, k  # documents before the next look at the k-th score
    while done < len(docs) and (len(best_docs) < k or bound[done] >= best_scores[-1]):
        until = np.searchsorted(-bound, -bound[min(done + look, len(docs)) - 1], "right")  # whole masks
        chosen = np.sort(docs[done:until])
        scores = np.zeros(len(chosen), np.int64)
        for weight, mine in zip(weights, postings, strict=True):
            at = np.searchsorted(block.docs[mine], chosen)
            at[at == mine.stop - mine.start] = 0
            there = block.docs[mine][at] == chosen
            scores += np.where(there, weight * block.factor[mine][at], 0)
        chosen, scores = np.concatenate([best_docs, chosen]), np.concatenate([best_scores, scores])
        top = np.lexsort((chosen, -scores))[:k]
        top = top[scores[top] > 0]
        best_docs, best_scores = chosen[top], scores[top]
        done, look = until, 2 * look
    return best_docs, best_scores, done


def _answer(k: int):
    def answer(block: Block, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns = {name: batch.column(batch.schema.get_field_index(name)) for name in ("query", "item_id", *TERM, "weights")}
        asked, found, scores = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(batch.num_rows):
            h1, h2, weights = (columns[c][i].values.to_numpy() for c in (*TERM, "weights"))
            docs, points, _ = search_block(block, _places(block, h1, h2), weights, k)
            asked += [i] * len(docs)
            found.append(docs)
            scores.append(points)
        at = pa.array(asked, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                columns["query"].take(at), columns["item_id"].take(at), block.ids.take(pa.array(np.concatenate(found))),
                pa.array(np.concatenate(scores)),
            ],
            ["query", "item_id", "doc_id", "score"],
        )

    return answer


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", k: int = BEST, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of each item."""
    docs = only(docs, id=id_col, text=text_col)
    terms = stored(item_terms(only(items, id=item_col, text=item_text_col)))
    passes = term_filter(terms)
    counts = stored(corpus_counts(docs, passes))
    total = counts.where("h1 IS NULL").first()
    documents, all_terms = (total["df"], total["terms"]) if total else (0, 0)
    # floor(1000 ln((2 N + 2) / (2 df + 1))); a term in no document weighs nothing here.
    weight = F.floor(F.lit(float(WEIGHT)) * F.log((2 * F.lit(documents) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weighed = terms.join(counts.where("h1 IS NOT NULL"), TERM).select(
        "query", "item_id", F.struct(*TERM, (F.col("times") * weight).alias("weight")).alias("term")
    )
    asked = weighed.groupBy("query", "item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    asked = stored(asked.select(
        "query", "item_id", F.col("terms.h1").alias("h1"), F.col("terms.h2").alias("h2"), F.col("terms.weight").alias("weights")
    ))
    blocks = number_of_blocks(documents, block_rows, LEAST_ROWS, docs.sparkSession.sparkContext.defaultParallelism)
    found = in_blocks(
        document_counts(docs, passes), F.xxhash64("id", F.monotonically_increasing_id()), asked, blocks,
        build_block(documents, max(all_terms, 1)), _answer(k),
        f"query bigint, item_id {terms.schema['item_id'].dataType.simpleString()}, "
        f"doc_id {docs.schema['id'].dataType.simpleString()}, score bigint",
    )
    return best(found, ["query", "item_id"], [F.col("score").desc(), F.col("doc_id")], k).select("item_id", "rank", "doc_id", "score")
