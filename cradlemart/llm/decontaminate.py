"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``width`` consecutive words (a shorter item is one
window). A window is a set of ``shingle``-word runs and must be contained in a document whole, so the
necessary prefix of its rarity order is one shingle: the one that is rarest over all documents. Only
these shingles are joined with the documents. Each match gives one place where the window could
start; it must lie within the document (positional and length bound), and the words there must be
those of the window (exact check, on the words themselves).

The scan tasks need the benchmark's shingles at hand. They are held in blocks of at most
``block_windows`` windows; every block is one pass over the documents, so no size of the benchmark
makes what a task holds grow.

Rules for odd input: a null or wordless text has no words and is never hit; null or wordless items
have no windows; items that share an id count as one, items without id hit but are not counted. Each
input row gets one result row; rows are told apart by id and text. Empty tables give no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import only, stored
from .tokens import LETTERS, Words, words

WIDTH = 13
SHINGLE = 3
BLOCK_WINDOWS = 200_000
RATIO = 20  # contaminated: hits are at least one word in this many


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def benchmark_windows(items: DataFrame, width: int, shingle: int) -> DataFrame:
    """Distinct (item, window words, number of words, shingles with their offsets)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1), LETTERS):
                out: dict[str, list] = {"number": [], "window": [], "n": [], "shingles": []}
                by_size = {}
                for i, (low, high) in enumerate(zip(w.offsets[:-1], w.offsets[1:], strict=True)):
                    n = min(int(high - low), width)
                    size = min(n, shingle)
                    if size and size not in by_size:
                        by_size[size] = w.shingles(size)[0].view(np.int64)
                    for at in range(low, high - n + 1) if n else ():
                        out["number"].append(w.first + i)
                        out["window"].append(w.text_of(at, n))
                        out["n"].append(n)
                        out["shingles"].append(by_size[size][at : at + n - size + 1].tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(out["number"], pa.int64())), pa.array(out["window"], pa.binary()),
                        pa.array(out["n"], pa.int32()), pa.array(out["shingles"], pa.list_(pa.int64())),
                    ],
                    names=["item", "window", "n", "shingles"],
                )

    kind = items.schema["item"].dataType.simpleString()
    return items.mapInArrow(rows, f"item {kind}, window binary, n int, shingles array<bigint>").distinct()


def _document_frequencies(docs: DataFrame, wanted: np.ndarray, sizes: list[int]) -> DataFrame:
    """In how many documents each wanted shingle stands."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1), LETTERS):
                found = [np.zeros(0, np.uint64)]
                owner = np.repeat(np.arange(len(w.offsets) - 1), np.diff(w.offsets))
                for size in sizes:
                    hashes, whole = w.shingles(size)
                    at = np.flatnonzero(whole & _is_in(hashes, wanted))
                    pairs = np.unique(np.stack([owner[at].astype(np.uint64), hashes[at]]), axis=1)
                    found.append(pairs[1])
                hashes, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(hashes), pa.array(counts)], names=["token", "df"])

    return docs.mapInArrow(rows, "token bigint, df bigint").groupBy("token").agg(F.sum("df").alias("df"))


def _is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    low_bits = np.zeros(1 << 16, bool)  # most values fail this look-up and need no search
    low_bits[(ordered & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = low_bits[(values & np.uint64(0xFFFF)).astype(np.int64)]
    at = np.flatnonzero(out)
    place = np.searchsorted(ordered, values[at])
    place[place == len(ordered)] = 0
    out[at] = ordered[place] == values[at]
    return out


def _hits(docs: DataFrame, block: dict, sizes: list[int], key_kind: str) -> DataFrame:
    """(id, words, window number, start) of every window of the block that a document contains."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1), LETTERS):
                yield _hits_of(w, batch.column(0), block, sizes)

    return docs.mapInArrow(rows, f"id {key_kind}, text_key bigint, window_no bigint, start bigint")


def _hits_of(w: Words, ids: pa.Array, block: dict, sizes: list[int]) -> pa.RecordBatch:
    doc_rows, keys, numbers, starts = [], [], [], []
    known: dict[int, int] = {}
    for size in sizes:
        hashes, whole = w.shingles(size)
        order, windows = block[size]
        at = np.flatnonzero(whole & _is_in(hashes, order))
        doc = np.searchsorted(w.offsets, at, "right") - 1
        for position, owner in zip(at.tolist(), doc.tolist(), strict=True):
            low, high = int(w.offsets[owner]), int(w.offsets[owner + 1])
            for number, offset, n, text in windows[int(hashes[position])]:
                start = position - offset
                if start >= low and start + n <= high and w.text_of(start, n) == text:
                    doc_rows.append(w.first + owner)
                    if owner not in known:
                        known[owner] = _text_key(w, owner)
                    keys.append(known[owner])
                    numbers.append(number)
                    starts.append(start - low)
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(doc_rows, pa.int64())), pa.array(keys, pa.int64()), pa.array(numbers, pa.int64()),
            pa.array(starts, pa.int64()),
        ],
        names=["id", "text_key", "window_no", "start"],
    )


def _text_key(w: Words, owner: int) -> int:
    text = w.data[w.bounds[owner] : w.bounds[owner + 1]]
    return int.from_bytes(hashlib.blake2b(text.tobytes(), digest_size=8).digest(), "big", signed=True)


def word_counts(docs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys = [np.zeros(0, np.int64)], []
            for w in words(batch.column(1), LETTERS):
                counts.append(np.diff(w.offsets))
                keys += [_text_key(w, i) for i in range(len(w.bounds) - 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.int64()), pa.array(np.concatenate(counts).astype(np.int64))],
                names=["id", "text_key", "n_words"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(rows, f"id {kind}, text_key bigint, n_words bigint")


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", width: int = WIDTH, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """One row per document row: id, n_words, n_hit (words inside occurrences of windows), items (sorted ids)."""
    docs = only(docs, id=id_col, text=text_col)
    items = only(items, item=item_col, text=item_text_col)
    kind = docs.schema["id"].dataType.simpleString()
    owned = stored(benchmark_windows(items, width, shingle))
    # Windows are numbered by content; ids of items are joined back at the end.
    numbers = Window.partitionBy("part").orderBy("window")
    distinct = owned.groupBy("window").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    distinct = stored(
        distinct.withColumn("part", F.pmod(F.xxhash64("window"), F.lit(1024)))
        .withColumn("window_no", F.col("part") * F.lit(1 << 40) + F.row_number().over(numbers))
    )
    total = distinct.count()
    blocks = max(1, -(-total // block_windows))
    found = None
    for b in range(blocks):
        mine = distinct.where(F.pmod(F.xxhash64("window_no"), F.lit(blocks)) == b)
        hits = _block_hits(docs, mine, width, shingle, kind)
        found = hits if found is None else found.unionByName(hits)
    found = stored(found)
    spans = found.join(distinct.select("window_no", "n"), "window_no").select(
        "id", "text_key", "start", (F.col("start") + F.col("n")).alias("stop")
    ).distinct()
    hit = (
        spans.groupBy("id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
        .withColumn("n_hit", F.expr(
            "aggregate(spans, struct(0L AS n, 0L AS upto), (a, s) -> struct("
            "a.n + greatest(s.stop - greatest(s.start, a.upto), 0L) AS n, greatest(a.upto, s.stop) AS upto), a -> a.n)"
        ))
        .select("id", "text_key", "n_hit")
    )
    of_item = owned.join(distinct.select("window", "window_no"), "window").select("window_no", "item").distinct()
    named = found.select("id", "text_key", "window_no").distinct().join(of_item, "window_no")
    named = named.groupBy("id", "text_key").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    counted = word_counts(docs).alias("d")

    def same(other: str) -> Column:
        return F.expr(f"d.text_key = {other}.text_key AND d.id <=> {other}.id")

    joined = counted.join(hit.alias("h"), same("h"), "left").join(named.alias("i"), same("i"), "left")
    return joined.select(
        F.col("d.id").alias("id"), F.col("d.n_words").alias("n_words"),
        F.coalesce("h.n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("i.items", F.array().cast("array<string>")).alias("items"),
    )


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * RATIO >= F.col("n_words"))


def _block_hits(docs: DataFrame, windows: DataFrame, width: int, shingle: int, kind: str) -> DataFrame:
    rows = windows.select("window_no", "window", "n", "shingles").toLocalIterator()  # at most block_windows rows
    rows = [(r.window_no, bytes(r.window), r.n, np.array(r.shingles, np.int64).view(np.uint64)) for r in rows]
    sizes = sorted({min(n, shingle) for _, _, n, _ in rows})
    wanted = np.unique(np.concatenate([np.zeros(0, np.uint64), *(s for _, _, _, s in rows)]))
    counts = {t % 2**64: n for t, n in _document_frequencies(docs, wanted, sizes).toLocalIterator()}
    block: dict[int, tuple] = {size: (None, {}) for size in sizes}
    for number, text, n, shingles in rows:
        rarity = [(counts.get(int(s), 0), int(s)) for s in shingles]
        df, token = min(rarity)
        if df:  # a window whose rarest shingle is in no document is in none
            offset = rarity.index((df, token))
            block[min(n, shingle)][1].setdefault(token, []).append((number, offset, n, text))
    block = {size: (np.array(sorted(found), np.uint64), found) for size, (_, found) in block.items()}
    return _hits(docs, block, sizes, kind)
