"""Similarity self-join on n-gram sets by a size-aware heavy-light scheme.

A document's set holds the hashes of its distinct word shingles. Equal sets become one node.
Two sets of sizes a and b link when they share at least o(a, b) shingles, which follows from the
Jaccard threshold.

* Small sets (light) enumerate subsets of fixed size: for every partner size the subsets of o(a, b)
  shingles. Two sets link exactly when they emit the same subset for their pair of sizes, so these
  links need no verification.
* Large sets (heavy) scan inverted lists, kept only for the rarest shingles of each set (as many as
  a linked pair must share one of). Rarity comes from counts over all documents, held in a fixed
  number of cells; any order gives right results, a good one gives short lists.
* The boundary is the size for which the expected cost over the histogram of sizes is lowest.

Lists are not expanded to all pairs. First every member of a list is compared with the list's
pivot, the member with the fewest rarer shingles, and components are formed. Then only members of
different components that still share a list are compared, unless the number of shingles that
either can still share from there on rules a link out. Comparisons are made on the texts, exactly. So no link between different
components is lost, and members of one component need no further comparison.

Sets and lists are named by 64-bit hashes. Rules for odd input: null and wordless texts have the
empty set and link with nothing, their component is their own id; rows that repeat an id or text
give a row each and take part once; null ids never name a component unless all its ids are null.
Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import only, stored
from .components import components
from .tokens import SHINGLE_FACTORS, SPACED, Words, mix, words

WIDTH = 4
PERCENT = 85
CELL_BITS = 20  # cells of the rarity counts: 2^20 counts, 4 MB, for any size of input
STRIP = 16
FILTER_BITS = 22  # bits of the pre-filter on the nodes whose texts are compared
LARGEST_LIGHT = 24
LIST_COST = 6  # handling a list entry (shuffled, joined, perhaps compared) against emitting a subset


def overlap(a: int, b: int, percent: int) -> int:
    """Common elements that sets of these sizes need."""
    return -(-percent * (a + b) // (100 + percent))


def partner_sizes(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def subset_count(n: int, limit: int, percent: int) -> int:
    return sum(comb(n, overlap(n, m, percent)) for m in partner_sizes(n, percent) if m <= limit)


def light_boundary(sizes: dict[int, int], percent: int) -> int:
    """The largest size to treat by subsets: lowest cost of subsets below and list entries above."""

    def cost(limit: int) -> float:
        light = sum(c * subset_count(n, limit, percent) for n, c in sizes.items() if n <= limit)
        least = -(-percent * (limit + 1) // 100)
        heavy = sum(c * prefix_size(n, percent) * LIST_COST for n, c in sizes.items() if n >= least)
        return light + heavy

    return min(range(LARGEST_LIGHT + 1), key=lambda x: (cost(x), x))


def _sets(w: Words, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of every text of a chunk."""
    hashes, _ = w.shingles(width)
    for i in range(len(w.bounds) - 1):
        low, high = int(w.offsets[i]), int(w.offsets[i + 1])
        if high - low >= width:
            yield w.first + i, np.unique(hashes[low : high - width + 1])
        elif high > low:  # too few words: the whole sequence is one shingle
            short = (w.hash[low:high] * SHINGLE_FACTORS[: high - low]).sum(dtype=np.uint64)
            yield w.first + i, mix(np.array([short + np.uint64(high - low)], np.uint64))
        else:
            yield w.first + i, np.zeros(0, np.uint64)


def _node(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "big", signed=True)


def _rows(docs: DataFrame, width: int) -> DataFrame:
    """(id, node, n) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes = [], []
            for w in words(batch.column(1), SPACED):
                for _, values in _sets(w, width):
                    nodes.append(_node(values))
                    sizes.append(len(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64())], names=["id", "node", "n"]
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(rows, f"id {kind}, node bigint, n bigint")


def _cell_counts(docs: DataFrame, width: int) -> np.ndarray:
    """How many shingles of documents fall in each cell; the only thing brought to the driver, of fixed size."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for w in words(batch.column(1), SPACED):
                found = [v for _, v in _sets(w, width)]
                cells = (np.concatenate(found) >> np.uint64(64 - CELL_BITS)).astype(np.int64)
                total += np.bincount(cells, minlength=1 << CELL_BITS)
        strips = total.reshape(-1, STRIP)
        used = np.flatnonzero(strips.any(axis=1))
        columns = [pa.array(used.astype(np.int32)), *(pa.array(strips[used, i]) for i in range(STRIP))]
        yield pa.RecordBatch.from_arrays(columns, names=["strip", *names])

    names = [f"n{i}" for i in range(STRIP)]  # neighbouring cells travel in one row
    partial = docs.mapInArrow(rows, "strip int, " + ", ".join(f"{n} bigint" for n in names))
    counts = partial.groupBy("strip").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros(((1 << CELL_BITS) // STRIP, STRIP), np.uint32)
    for i, n in enumerate(names):
        out[counts["strip"].to_numpy(), i] = np.minimum(counts[n].to_numpy(), 2**32 - 1)
    return out.ravel()


def _light_keys(values: np.ndarray, limit: int, percent: int) -> Iterator[tuple[np.uint64, int]]:
    """Key of every subset to emit, with the smaller size of its pair of sizes."""
    n = len(values)
    for m in partner_sizes(n, percent):
        if m > limit:
            continue
        size = overlap(n, m, percent)
        if size > n:
            continue
        tag = np.uint64((min(n, m) << 32) | max(n, m))
        index = np.array(list(combinations(range(n), size)), np.int64)
        keys = mix((mix(values[index] + tag) * np.uint64(0x9E3779B97F4A7C15)).sum(axis=1, dtype=np.uint64) ^ mix(np.array([tag]))[0])
        for key in keys:
            yield key, min(n, m)


def _entries(docs: DataFrame, counts: np.ndarray, limit: int, width: int, percent: int) -> DataFrame:
    """Entries of the lists: (token, node, n, pos). Subset keys have pos = -(smaller size of the pair)."""
    least_heavy = -(-percent * (limit + 1) // 100)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies are sent once by each task
        for batch in batches:
            tokens, nodes, sizes, places = [], [], [], []
            for w in words(batch.column(1), SPACED):
                for _, values in _sets(w, width):
                    n, node = len(values), _node(values)
                    if not n or node in seen:
                        continue
                    seen.add(node)
                    if n <= limit:
                        for key, low in _light_keys(values, limit, percent):
                            tokens.append(np.array([key], np.uint64))
                            nodes.append(node)
                            sizes.append((n, 1))
                            places.append(np.array([-low], np.int32))
                    if n >= least_heavy:
                        k = prefix_size(n, percent)
                        rank = counts[(values >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                        tokens.append(values[np.lexsort((values, rank))[:k]])
                        nodes.append(node)
                        sizes.append((n, k))
                        places.append(np.arange(k, dtype=np.int32))
            repeats = np.array([k for _, k in sizes], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(0, np.uint64), *tokens]).view(np.int64)),
                    pa.array(np.repeat(np.array(nodes, np.int64), repeats)),
                    pa.array(np.repeat(np.array([n for n, _ in sizes], np.int32), repeats)),
                    pa.array(np.concatenate([np.zeros(0, np.int32), *places])),
                ],
                names=["token", "node", "n", "pos"],
            )

    return docs.select("id", "text").mapInArrow(rows, "token bigint, node bigint, n int, pos int")


def _need(a: str, b: str, percent: int) -> str:
    """SQL: the overlap that two sets need."""
    return f"ceil({percent}D * ({a}.n + {b}.n) / {100 + percent} - 1e-9)"


def _sizes_fit(a: str, b: str, percent: int) -> str:
    return f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n)"


def _may_link(a: str, b: str, percent: int) -> str:
    """SQL: sizes and the place of one common shingle in both allow a link."""
    after = f"least({a}.n - {a}.pos, {b}.n - {b}.pos)"
    return f"{_sizes_fit(a, b, percent)} AND least({a}.pos, {b}.pos) + {after} >= {_need(a, b, percent)}"


def _texts(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, text) of the given nodes. A bit per hash of a node, of fixed size, spares shuffling most others."""
    bits = nodes.select(F.shiftrightunsigned("node", 64 - FILTER_BITS).cast("int").alias("bit")).distinct().toArrow()
    wanted = np.zeros(1 << FILTER_BITS, bool)
    wanted[bits["bit"].to_numpy()] = True
    wanted = np.packbits(wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(wanted)
        seen: set[int] = set()
        for batch in batches:
            at, found = [], []
            for w in words(batch.column(1), SPACED):
                for row, values in _sets(w, width):
                    node = _node(values)
                    if node not in seen and keep[(node % 2**64) >> (64 - FILTER_BITS)]:
                        seen.add(node)
                        at.append(row)
                        found.append(node)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int64()), batch.column(1).take(pa.array(at, pa.int64()))], names=["node", "text"]
            )

    some = docs.select("id", "text").mapInArrow(rows, "node bigint, text string")
    return some.groupBy("node").agg(F.first("text").alias("text")).join(nodes, "node", "left_semi")


def _linked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link, by comparison of their shingles."""
    first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: list[list[np.ndarray]] = [[], []]
            for side in (0, 1):
                for w in words(batch.column(2 + side), SPACED):
                    sets[side] += [v for _, v in _sets(w, width)]
            same = []
            for x, y in zip(*sets, strict=True):
                common = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                same.append(100 * common >= percent * (len(x) + len(y) - common))
            mask = pa.array(same, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return both.mapInArrow(rows, "a bigint, b bigint")


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links)."""
    docs = only(docs, id=id_col, text=text_col)
    rows = stored(_rows(docs, width))
    nodes = stored(
        rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.min("id").alias("least_id"))
    )
    by_size = nodes.where(F.col("n") <= 2 * LARGEST_LIGHT).groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    limit = light_boundary({r.n: r.c for r in by_size.collect()}, percent)  # at most 48 rows
    counts = _cell_counts(docs, width)
    entries = _entries(docs, counts, limit, width, percent)
    # Place and size in one number: the aggregate is what is shuffled most. A list whose entries all
    # come from copies of one set in several tasks stays in, and gives no pair.
    placed = F.shiftleft(F.col("pos").cast("bigint"), 32) + F.col("n")
    pivots = (
        entries.groupBy("token")
        .agg(F.count(F.lit(1)).alias("entries"), F.min(F.struct(placed.alias("at"), "node")).alias("p"))
        .where("entries > 1")
        .selectExpr("token", "named_struct('pos', int(shiftright(p.at, 32)), 'n', int(p.at & 4294967295), 'node', p.node) AS p")
    )
    lists = stored(entries.join(pivots, "token"))
    star = lists.where("node <> p.node")
    subset_links = star.where("pos < 0 AND p.n = -pos").select(F.col("p.node").alias("a"), F.col("node").alias("b"))
    heavy = lists.where("pos >= 0")
    pairs = (
        star.where("pos >= 0").select("p", F.struct("n", "pos").alias("x"), "node")
        .where(_may_link("p", "x", percent))
        .select(F.col("p.node").alias("a"), F.col("node").alias("b")).distinct()
    )
    texts = stored(_texts(docs, heavy.select("node").distinct(), width))
    links = stored(_linked(pairs, texts, width, percent).unionByName(subset_links).distinct())
    labels = components(links)

    def labelled(found: DataFrame) -> DataFrame:
        return found.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    # What a set can still share from a list's shingle on: its shingles beyond the prefix and those of
    # its prefix, from there on, that stand in a list at all. A linked pair meets this bound at the first
    # shingle that both share, so it is enough to make pairs where the bound holds.
    onward = Window.partitionBy("node").orderBy(F.desc("pos"))
    members = heavy.select("token", "node", "n", "pos", (F.col("node") == F.col("p.node")).alias("is_pivot")).distinct()
    members = members.withColumn("rest", F.expr(f"ceil({percent}D * n / 100 - 1e-9) - 1") + F.row_number().over(onward))
    named = stored(labelled(members.drop("pos")))
    open_lists = named.groupBy("token").agg(
        F.min("label").alias("low"), F.max("label").alias("high"),
        F.max(F.when(F.col("is_pivot"), F.col("label"))).alias("main"),
    ).where("low <> high").select("token", "main")
    open_rows = named.join(open_lists, "token").select("token", "node", "n", "rest", "label", "main")
    left, right = open_rows.where("label <> main").alias("x"), open_rows.alias("y")
    shared = left.join(
        right,
        F.expr(
            f"x.token = y.token AND x.label <> y.label AND {_sizes_fit('x', 'y', percent)} "
            f"AND least(x.rest, y.rest) >= {_need('x', 'y', percent)}"
        ),
    )
    rest = shared.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    more = _linked(rest, texts, width, percent)
    labels = components(links.unionByName(more))
    joined = labels.join(nodes, "node").groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_node = labels.join(joined, "label").select("node", "component_id")
    named_nodes = nodes.join(of_node, "node", "left").select(
        "node", F.coalesce("component_id", "least_id").alias("component_id")
    )
    return rows.join(named_nodes, "node", "left").select(
        "id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
