"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key in a join even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The JVM never compiles methods above 8,000 bytes of code; long rule lists get there.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Without call sites in error messages a plan is built in about half the time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "cradlemart", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's settings; on a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """A new folder for one run under the shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may go without that setting; it gets a temporary folder.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="cradlemart-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return os.path.join(root, f"cradlemart-{uuid.uuid4().hex}")


def stored(df: DataFrame) -> DataFrame:
    """Write rows to the shared folder and read them back.

    Used where several passes follow: each then reads only its columns, and a lost executor costs
    no more than reading them again.
    """
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
