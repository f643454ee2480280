"""Line dedup by levelled sorted runs of line hashes.

A line's key is the line without white space at both ends and with A-Z lower-cased. ``LineRuns`` holds
what is known of the keys as runs: files of (128-bit key hash, number of documents, largest document
id), sorted by hash. Documents come in batches. The keys of a batch are combined on the map side,
merge-anti-joined with the runs, which takes away the keys that the runs have already settled (found
in ``least`` documents, the largest id among them), and the rest becomes a run of level 0. When a
level has ``fanout`` runs they are compacted into one run of the next level, so there are
``fanout`` runs a level and few levels. Lines that stand everywhere are settled after a few batches
and never enter a run again.

A key that stands in at least ``least`` documents loses its lines in all of them but the one with
the largest id. Only the hashes of the lines are shuffled; a document's text meets the hashes that it
has to lose, which are joined with a key's documents through ``SALTS`` parts each, so a line in a
third of all documents is no hot group.

Rules for odd input: null and empty texts have one empty line. A line may be as long as its text;
texts are split in slices of bounded size. Rows that share an id are one document, each row with its
own result (a document belongs to one batch). Ties do not occur: the largest id holds its key as often as it has it. Null ids
together are one document that comes before all others. A document that repeats a key loses or keeps all
its lines of that key. Columns other than id and text are not looked at. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, shared_folder, stored
from .tokens import chunks, text_buffers

LEAST_DOCUMENTS = 3
LEAST_LENGTH = 20  # code points of a key
BATCHES = 6
FANOUT = 3
SALTS = 16
SPACES = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
KEY_DDL = "h1 bigint, h2 bigint"


def _slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The texts of a batch, about a megabyte at a time; null is the empty text."""
    _, bounds = text_buffers(column)
    whole = pc.fill_null(column.cast(pa.large_string()), "")
    for first, last in chunks(bounds):
        yield first, whole.slice(first, last - first)


def _keys(texts: pa.Array, least_length: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text; then for the lines with a long enough key their number and hash."""
    lines = pc.split_pattern(texts, "\n")
    keys = pc.ascii_lower(pc.utf8_trim(lines.flatten(), characters=SPACES))
    at = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), least_length).to_numpy(zero_copy_only=False))
    digests = b"".join(blake2b(k, digest_size=16).digest() for k in keys.take(pa.array(at)).cast(pa.large_binary()).to_pylist())
    pairs = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return lines, at, pairs[:, 0], pairs[:, 1]


def line_keys(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(id, h1, h2): the distinct long keys of each row of (id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _slices(batch.column(1)):
                lines, at, h1, h2 = _keys(texts, least_length)
                owner = pc.list_parent_indices(lines).to_numpy()[at]
                seen = np.unique(np.stack([owner.astype(np.int64), h1, h2], axis=1), axis=0)
                ids = batch.column(0).take(pa.array(seen[:, 0] + first))
                yield pa.RecordBatch.from_arrays([ids, pa.array(seen[:, 1]), pa.array(seen[:, 2])], ["id", *KEY])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(rows, f"id {kind}, {KEY_DDL}")


class LineRuns:
    """Levels of sorted runs in the shared folder."""

    def __init__(self, least: int = LEAST_DOCUMENTS, fanout: int = FANOUT):
        self.least, self.fanout = least, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def settled(self, run: DataFrame) -> DataFrame:
        return run.where(F.col("documents") >= self.least).select(*KEY, F.col("last").alias("_last"))

    def add(self, entries: DataFrame) -> DataFrame:
        """Take the keys (id, h1, h2) of a batch of new documents; returns the run made from them."""
        own = entries.groupBy(*KEY).agg(F.count(F.lit(1)).alias("documents"), F.max("id").alias("last"))
        for run in self.runs():
            known = self.settled(run).hint("merge")
            later = known["_last"].eqNullSafe(own["last"]) | own["last"].isNull() | (known["_last"] > own["last"])
            own = own.join(known, [own[k] == known[k] for k in KEY] + [later], "left_anti")
        return self._put(own, 0)

    def _put(self, rows: DataFrame, level: int) -> DataFrame:
        """Write a run at a level; a full level is compacted into one run of the next."""
        run = stored(rows.sortWithinPartitions(*KEY))
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(self._merged(full), level + 1)
        return run

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        every = runs[0]
        for run in runs[1:]:
            every = every.unionByName(run)
        return every.groupBy(*KEY).agg(F.sum("documents").alias("documents"), F.max("last").alias("last"))

    def frequent(self) -> DataFrame:
        """(h1, h2, keep_id) of the keys in at least ``least`` documents."""
        found = self._merged(self.runs()).where(F.col("documents") >= self.least)
        return found.select(*KEY, F.col("last").alias("keep_id"))


def _one_per_document(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """The entries with those of rows that share an id reduced to one for each key."""
    repeated = ids.groupBy("id").count().where("count > 1").select(F.col("id").alias("_id"))
    same = F.col("id").eqNullSafe(F.col("_id"))
    return entries.join(repeated, same, "left_anti").unionByName(entries.join(repeated, same, "left_semi").distinct())


def _in_batches(entries: DataFrame, batches: int) -> DataFrame:
    """The entries, written with one folder for each batch of documents."""
    path = shared_folder(entries.sparkSession)
    dealt = entries.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int"))
    dealt.write.partitionBy("batch").parquet(path)
    return entries.sparkSession.read.schema(dealt.schema).parquet(path)


def _losses(entries: DataFrame, frequent: DataFrame) -> DataFrame:
    """(id, lost): the hashes of the keys that a document has to lose."""
    keys = frequent.select(*(F.col(k).alias(f"_{k}") for k in KEY), "keep_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_part"))
    match = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("_salt") == F.col("_part"))
    lost = entries.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(keys, match)
    lost = lost.where(~F.col("id").eqNullSafe(F.col("keep_id")))
    return lost.groupBy(F.col("id").alias("_id")).agg(F.collect_set(F.struct(*KEY)).alias("lost"))


def _without_lost(docs: DataFrame, least_length: int) -> DataFrame:
    """(id, n_lines, n_dropped, kept_text) from (id, text, lost)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _slices(batch.column(1)):
                n = pc.add(pc.count_substring(texts, "\n"), 1).to_numpy().astype(np.int64)
                dropped, kept = np.zeros(len(texts), np.int64), texts
                lost = batch.column(2).slice(first, len(texts))
                which = np.flatnonzero(lost.is_valid().to_numpy(zero_copy_only=False))
                if len(which):
                    lines, at, h1, h2 = _keys(texts.take(pa.array(which)), least_length)
                    bounds = lines.offsets.to_numpy()
                    flat, stays = lines.flatten(), np.ones(bounds[-1], bool)
                    places = np.searchsorted(at, bounds)
                    every = kept.to_pylist()
                    for i, gone in enumerate(lost.take(pa.array(which))):
                        gone = {(x["h1"], x["h2"]) for x in gone.as_py()}
                        low, high = places[i], places[i + 1]
                        out = [p for p, a, b in zip(at[low:high], h1[low:high].tolist(), h2[low:high].tolist(), strict=True) if (a, b) in gone]
                        stays[out] = False
                        mine = slice(bounds[i], bounds[i + 1])
                        dropped[which[i]] = len(out)
                        every[which[i]] = "\n".join(flat[mine].filter(pa.array(stays[mine])).to_pylist())
                    kept = pa.array(every, pa.large_string())
                columns = [batch.column(0).slice(first, len(texts)), pa.array(n), pa.array(dropped), kept.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_lines", "n_dropped", "kept_text"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(rows, f"id {kind}, n_lines bigint, n_dropped bigint, kept_text string")


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_DOCUMENTS,
    least_length: int = LEAST_LENGTH, batches: int = BATCHES, fanout: int = FANOUT,
) -> DataFrame:
    """One row per document: id, n_lines (before), n_dropped, kept_text."""
    docs = only(docs, id=id_col, text=text_col)
    entries = _in_batches(_one_per_document(line_keys(docs, least_length), docs.select("id")), batches)
    index = LineRuns(least, fanout)
    for number in range(batches):
        index.add(entries.where(F.col("batch") == number).drop("batch"))
    losses = _losses(entries, stored(index.frequent()))
    held = docs.join(losses, docs["id"].eqNullSafe(losses["_id"]), "left").select("id", "text", "lost")
    return _without_lost(held, least_length)
