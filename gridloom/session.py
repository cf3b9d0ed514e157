"""Session helpers shared by the operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Temporary folder of this process, by master.
_own: dict[str, str] = {}
ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where the driver found it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def small_batches(spark: SparkSession, rows: int = 1000, mb: int = 32) -> None:
    """Bound an Arrow batch by rows and bytes, so that a worker's memory does not follow the length of texts.

    Plans read these two settings when they run, later than the call that builds them: they stay set in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which driver and executors share; below a temporary one on a local master only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and spark.sparkContext.master in _own:
        at = _own[spark.sparkContext.master]
    if not at:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"master {master}: spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = _own[master] = "file://" + own
    return f"{at.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends there, and what several plans read is made once."""
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
