"""Exact duplicates by an extendible-hash index on shared files.

A text's key is the leading 64 bits of the SHA-256 of its normalised bytes (A-Z lower-cased). The
index has a directory of 2^g entries, each naming a bucket by its own depth and leading key bits; a
bucket that holds more keys than it may is split by one more bit, and the directory doubles when a
bucket gets deeper than it. Texts that share a key are compared byte by byte; texts that differ under one key follow each other in that key's chain. Copies
are collapsed by each scan task before anything is shuffled, so a text with a third of all rows
costs one row per task. The index files are written by owner tasks, each with a range of buckets.

Rules for odd input: a null text counts as the empty text. A null id is smaller than every id. Rows
that repeat id and text are all kept by ``classes`` (nothing tells them apart) and reduced to one by
``deduplicate``. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, only, shared_folder, stored

KEY_BITS = 64
BUCKET_KEYS = 100_000


def _keyed(docs: DataFrame, key_bits: int, with_text: bool) -> DataFrame:
    """Id, key and digest of every row, with the normalised bytes if asked for."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            normal = pc.ascii_lower(pc.fill_null(batch.column(1), "")).cast(pa.binary())
            digests = [hashlib.sha256(x.as_buffer()).digest() for x in normal]
            keys = [int.from_bytes(d[:8], "big") >> (64 - key_bits) << (64 - key_bits) for d in digests]
            columns = {
                "id": batch.column(0),
                "key": pa.array([k - 2**64 if k >= 2**63 else k for k in keys], pa.int64()),
                "sha": pa.array([d.hex() for d in digests], pa.string()),
            }
            yield pa.RecordBatch.from_pydict(columns | ({"bytes": normal} if with_text else {}))

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(rows, f"id {kind}, key bigint, sha string" + ", bytes binary" * with_text)


def directory(slots: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Buckets (depth, prefix, keys) of an extendible-hash directory over distinct keys.

    Starts at the depth that fits evenly spread keys; each round splits the overfull buckets by one
    more bit. A bucket is final once its keys fit or all 64 bits are used. Driver work is one job a
    round; keys are hashes, so one or two rounds follow the first.
    """
    total, depth = slots.count(), 0
    while depth < 32 and total > bucket_keys << depth:
        depth += 1
    done, open_slots = None, slots.select("key")
    while True:
        prefix = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("bigint")
        counted = stored(open_slots.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("keys")))
        full = (F.col("keys") > bucket_keys) & F.lit(depth < 64)
        final = counted.where(~full).select(F.lit(depth).alias("depth"), "prefix", "keys")
        done = final if done is None else done.unionByName(final)
        if counted.where(full).isEmpty():
            return done
        open_slots = open_slots.join(
            counted.where(full).select(F.col("prefix").alias("p")), prefix == F.col("p"), "left_semi"
        )
        depth += 1


def directory_entries(buckets: DataFrame, depth: int) -> DataFrame:
    """The 2^depth directory entries (entry, bucket_depth, bucket_prefix)."""
    spread = F.expr(f"sequence(shiftleft(prefix, {depth} - depth), shiftleft(prefix + 1, {depth} - depth) - 1)")
    return buckets.select(
        F.explode(spread).alias("entry"), F.col("depth").alias("bucket_depth"), F.col("prefix").alias("bucket_prefix")
    )


class DedupIndex:
    """Rows by key, the directory, and one node per distinct text in buckets, all in shared files."""

    def __init__(
        self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = KEY_BITS,
        bucket_keys: int = BUCKET_KEYS,
    ):
        docs = only(docs, id=id_col, text=text_col)
        self.entries = stored(_keyed(docs, key_bits, with_text=False))
        # Equal bytes meet in one group; each scan task sends a text once, however often it has it.
        texts = _keyed(docs, key_bits, with_text=True).groupBy("key", "sha", "bytes").agg(
            F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        )
        self.texts = stored(texts.select("key", "sha", "keep_id", "group_size"))
        self.buckets = directory(self.texts.select("key").distinct(), bucket_keys)
        self.path = self._write()

    def _write(self) -> str:
        """The index files: one node per distinct text, written by owner tasks, each with a range of buckets."""
        path = shared_folder(self.entries.sparkSession)
        self.buckets.write.parquet(f"{path}/directory")
        buckets = self.entries.sparkSession.read.parquet(f"{path}/directory")
        depth = buckets.agg(F.max("depth")).first()[0] or 0
        order = Window.partitionBy("key").orderBy("sha")
        entry = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("bigint")
        (
            self.texts.withColumn("chain", F.row_number().over(order))
            .withColumn("entry", entry)
            .join(directory_entries(buckets, depth), "entry")
            .select("bucket_depth", "bucket_prefix", "key", "chain", "sha", "keep_id", "group_size")
            .repartitionByRange("bucket_prefix", "key")
            .sortWithinPartitions("key", "chain")
            .write.parquet(f"{path}/nodes")
        )
        return path

    def nodes(self) -> DataFrame:
        return self.entries.sparkSession.read.parquet(f"{self.path}/nodes")

    def classes(self) -> DataFrame:
        """One row per input row: id, keep_id, group_size, text_sha256, looked up in the index."""
        nodes = self.nodes().select("key", "sha", "keep_id", "group_size")
        return self.entries.join(nodes, ["key", "sha"]).select(
            "id", "keep_id", "group_size", F.col("sha").alias("text_sha256")
        )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row, that of the largest id, for each normalised text; all columns kept."""
    index = DedupIndex(docs, id_col, text_col)
    kept = index.classes().where(F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "text_sha256").distinct()
    gone = index.classes().where(~F.col("id").eqNullSafe(F.col("keep_id"))).select("id").distinct()
    repeated = index.entries.groupBy("id").count().where("count > 1").select("id")
    dropped = gone.unionByName(repeated).distinct()
    key = docs[f"`{id_col}`"]
    unique = docs.join(dropped, key.eqNullSafe(dropped["id"]), "left_anti")
    # Ids that stand on several rows, or on both kept and dropped texts, are settled row by row.
    unclear = docs.join(repeated, key.eqNullSafe(repeated["id"]), "left_semi")
    digest = F.sha2(F.encode(ascii_lower(docs[f"`{text_col}`"]), "utf-8"), 256)
    settled = unclear.join(
        kept.select(F.col("id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha")),
        F.col(f"`{id_col}`").eqNullSafe(F.col("_kept_id")) & (digest == F.col("_kept_sha")), "inner",
    ).dropDuplicates(["_kept_id", "_kept_sha"]).drop("_kept_id", "_kept_sha")
    return unique.unionByName(settled)
