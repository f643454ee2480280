"""Who gets a name when many ask, decided in commit order.

A claim (seq, actor, names) asks for all its names at once. It is granted when nobody else holds one
of them at that moment; the actor then gives up every name held before. A claim that is not granted
changes nothing. That is what a site does that looks a name up and then writes it, one form
after the other.

Most claims need no order. A name held by an actor who claims nothing is never given up, so others
who ask for it are refused. The first to ask for a free name gets it, and if that actor asks for
nothing later, all others are refused. Two passes of this leave few claims, however many ask for
one name. Of these, claims that share no name with another actor are granted. The rest falls into
connected components of actors and names that do not touch each other: each is replayed in order by
one task. A component of more than ``fold_rows`` rows is cut along ``seq`` instead, and the parts
are decided one after another, each from the names held after the one before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .graph import components

FOLD_ROWS = 1_000_000


def _asks(claims: DataFrame) -> DataFrame:
    return claims.select("seq", "actor", F.explode("names").alias("name"))


def _without(claims: DataFrame, refused: DataFrame) -> DataFrame:
    return claims.join(refused.select("seq").distinct(), "seq", "left_anti")


def _refused_for_good(claims: DataFrame, held: DataFrame | None) -> DataFrame:
    """Claims that lose a name to a claim that surely gets it and is its actor's last one."""
    asks = _asks(claims)
    first = asks.groupBy("name").agg(F.min("seq").alias("first"), F.min_by("actor", "seq").alias("owner"))
    free = first
    if held is not None:
        holders = held.groupBy("name").agg(F.min("actor").alias("low"), F.max("actor").alias("high"))
        free = first.join(holders, "name", "left").where("low IS NULL OR (low = owner AND high = owner)")
    wins = free.groupBy(F.col("first").alias("seq")).agg(F.count("name").alias("won"))
    last = claims.groupBy("actor").agg(F.max("seq").alias("seq"), F.max_by(F.size("names"), "seq").alias("wanted"))
    final = wins.join(last, "seq").where("won = wanted").select(F.col("seq").alias("first"))
    taken = free.join(final, "first").select("name", "owner")
    return asks.join(taken, "name").where("actor <> owner")


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (root, seq, actor, names) by component, holdings (without seq) first, claims in order."""
    here, holders, holds = None, {}, {}
    for batch in batches:
        won = []
        for root, seq, actor, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if root != here:
                here, holders, holds = root, {}, {}
            if seq is not None:
                if any(holders.get(name, set()) - {actor} for name in names):
                    continue
                won.append(seq)
                for name in holds.pop(actor, ()):
                    holders[name].discard(actor)
            for name in names:
                holders.setdefault(name, set()).add(actor)
                holds.setdefault(actor, set()).add(name)
        yield pa.RecordBatch.from_arrays([pa.array(won, pa.int64())], ["seq"])


def after(held: DataFrame, granted: DataFrame) -> DataFrame:
    """Who holds what (name, actor) once the granted claims (seq, actor, names) are written."""
    last = granted.groupBy("actor").agg(F.max_by("names", "seq").alias("names"))
    return held.join(last, "actor", "left_anti").select("name", "actor").unionByName(
        last.select(F.explode("names").alias("name"), "actor")
    )


def _piecewise(claims: DataFrame, held: DataFrame, rows: int, fold_rows: int) -> DataFrame:
    """Decide claims of one huge component in parts along ``seq``."""
    parts = 2 * -(-rows // fold_rows)
    cuts = claims.stat.approxQuantile("seq", [i / parts for i in range(1, parts)], 1 / (4 * parts))
    part = sum((F.col("seq") > cut).cast("int") for cut in sorted(set(cuts)))
    dealt, out = stored(claims.withColumn("part", part)), None
    for number in range(len(set(cuts)) + 1):
        mine = dealt.where(F.col("part") == number).drop("part")
        won = stored(mine.join(granted(mine, held, fold_rows), "seq", "left_semi"))
        held = stored(after(held, won))
        out = won.select("seq") if out is None else out.unionByName(won.select("seq"))
    return out


def granted(claims: DataFrame, held: DataFrame | None = None, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """(seq) of the granted ones among ``claims`` (seq bigint, actor, names array); ``held`` is (name, actor).

    Actors are strings and ``seq`` is unique. A claim without names is granted and gives nothing up.
    """
    claims = stored(claims.select("seq", "actor", F.array_distinct(F.array_compact("names")).alias("names")))
    none, left = claims.where(F.size("names") == 0).select("seq"), claims.where(F.size("names") > 0)
    moving = None
    if held is not None:
        movers = left.select("actor").distinct()
        fixed = held.join(movers, "actor", "left_anti").select("name").distinct()
        moving = stored(held.join(movers, "actor", "left_semi").select("name", "actor").distinct())
        left = _without(left, _asks(left).join(fixed, "name", "left_semi"))
    left = stored(_without(left, _refused_for_good(left, moving)))

    touched = _asks(left).select("name", "actor", F.lit(1).alias("asked"))
    if moving is not None:
        touched = touched.unionByName(moving.withColumn("asked", F.lit(0)))
    shared = touched.groupBy("name").agg(F.min("actor").alias("low"), F.max("actor").alias("high"), F.max("asked").alias("asked"))
    shared = shared.where("low <> high AND asked = 1").select("name")
    edges = stored(touched.join(shared, "name", "left_semi").select("name", "actor").distinct())
    if edges.isEmpty():
        return none.unionByName(left.select("seq"))
    plain = left.join(edges.select("actor").distinct(), "actor", "left_anti").select("seq")

    node = F.xxhash64(F.lit("actor"), "actor")
    roots = components(edges.select(node.alias("a"), F.xxhash64(F.lit("name"), "name").alias("b")))
    rows = left.select("seq", "actor", "names")
    if moving is not None:
        # A holding that nobody else asks for hinders nobody, and giving it up helps nobody.
        kept = moving.join(edges.select("name").distinct(), "name", "left_semi")
        rows = rows.unionByName(kept.select(F.lit(None).cast("bigint").alias("seq"), "actor", F.array("name").alias("names")))
    rows = stored(rows.withColumn("node", node).join(roots, "node").select("root", "seq", "actor", "names"))
    sizes = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > fold_rows)
    huge = {r["root"]: r["n"] for r in sizes.toLocalIterator()}  # no more than rows / fold_rows of them
    is_huge = F.col("root").isin(*huge) if huge else F.lit(False)
    small = rows.where(~is_huge).repartition("root").sortWithinPartitions("root", "seq")
    out = none.unionByName(plain).unionByName(small.mapInArrow(_replay, "seq bigint"))
    if huge:
        large = rows.where(is_huge)
        kept = large.where("seq IS NULL").select(F.explode("names").alias("name"), "actor")
        out = out.unionByName(_piecewise(large.where("seq IS NOT NULL").drop("root"), kept, sum(huge.values()), fold_rows))
    return out
