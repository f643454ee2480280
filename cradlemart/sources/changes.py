"""Keyed state of a stream, kept as runs of changes.

A batch writes only its own changed rows, as run ``level=0/version=<batch>``. Whenever ``FANOUT``
runs of a level are there they are merged into one of the next level, so a row is written again
once a level and a reader finds at most ``FANOUT`` - 1 runs a level. Which runs make up the state
follows from the batch number alone: a batch that runs again after a failure reads the state
before it and writes the same runs. A run counts once its _SUCCESS file is there.

A row with ``gone`` set removes its key. With ``sums`` the named columns are added up over the runs
instead of being replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import committed_versions

FANOUT = 8
GONE = "gone"


def _folder(path: str, level: int, version: int) -> str:
    return f"{path}/level={level}/version={version}"


def runs(spark: SparkSession, path: str, before: int | None = None, fanout: int = FANOUT) -> list[tuple[int, str]]:
    """(first batch, folder) of the runs that hold the state before a batch, or the newest state."""
    found, level = [], 0
    while versions := committed_versions(spark, f"{path}/level={level}"):
        found += [(v + 1 - fanout**level, v, _folder(path, level, v)) for v in versions if before is None or v < before]
        level += 1
    out, covered = [], -1
    for first, last, folder in sorted(found, key=lambda run: (run[0], -run[1])):
        if first > covered:
            out.append((first, folder))
            covered = last
    return out


def _together(spark: SparkSession, parts: list[tuple[int, str]], ddl: str, keys: list[str], sums: list[str], only: DataFrame | None) -> DataFrame:
    """The newest row (or the sums) of each key in the given runs."""
    rows = spark.createDataFrame([], f"{ddl}, {GONE} boolean, _run bigint")
    for first, folder in parts:
        rows = rows.unionByName(spark.read.schema(f"{ddl}, {GONE} boolean").parquet(folder).withColumn("_run", F.lit(first).cast("bigint")))
    if only is not None:
        rows = rows.join(only.select(*keys).distinct(), keys, "left_semi")
    if sums:
        return rows.groupBy(*keys).agg(*[F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in sums], F.lit(False).alias(GONE))
    values = [c for c in rows.columns if c not in (*keys, "_run")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_run").alias("_v"))
    return last.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


def read_state(
    spark: SparkSession, path: str, ddl: str, keys: list[str], before: int | None = None, only: DataFrame | None = None,
    sums: list[str] = (), fanout: int = FANOUT,
) -> DataFrame:
    """One row per key (columns as in ``ddl``); ``only`` narrows the state to the keys of a batch."""
    found = _together(spark, runs(spark, path, before, fanout), ddl, keys, list(sums), only)
    return found.where(~F.col(GONE)).drop(GONE)


def put_changes(
    changes: DataFrame, path: str, ddl: str, keys: list[str], batch_id: int, sums: list[str] = (), fanout: int = FANOUT
) -> None:
    """Write the changed rows of a batch (at most one a key) and merge the levels that are full."""
    spark = changes.sparkSession
    if GONE not in changes.columns:
        changes = changes.withColumn(GONE, F.lit(False))
    names = [c for c in spark.createDataFrame([], ddl).columns]
    changes.select(*names, GONE).write.mode("overwrite").parquet(_folder(path, 0, batch_id))
    level = 1
    while (batch_id + 1) % fanout**level == 0:
        width = fanout ** (level - 1)
        parts = [(v + 1 - width, _folder(path, level - 1, v)) for v in range(batch_id - (fanout - 1) * width, batch_id + 1, width)]
        merged = _together(spark, parts, ddl, keys, list(sums), None)
        if batch_id + 1 == fanout**level:
            merged = merged.where(~F.col(GONE))  # nothing earlier that it could remove
        merged.write.mode("overwrite").parquet(_folder(path, level, batch_id))
        level += 1


def superseded(spark: SparkSession, path: str, fanout: int = FANOUT) -> list[str]:
    """Folders of runs that no reader of the newest state needs; a running batch may still read them."""
    used = {folder for _, folder in runs(spark, path, fanout=fanout)}
    out, level = [], 0
    while versions := committed_versions(spark, f"{path}/level={level}"):
        out += [f for f in (_folder(path, level, v) for v in versions) if f not in used]
        level += 1
    return out
