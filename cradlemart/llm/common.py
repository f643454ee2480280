"""Helpers of the text operators: the shared folder, stored tables, narrow inputs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="cradlemart-text-")
        spark.sparkContext.setCheckpointDir(root)
    return os.path.join(root, f"text-{uuid.uuid4().hex}")


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns under fixed names, so that other columns can never clash."""
    return df.select(*(df[f"`{old}`"].alias(new) for new, old in columns.items()))


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z only; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
