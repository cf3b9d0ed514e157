"""Helpers that the operators share: narrow projections, Arrow maps and tables in the shared folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable, small_batches  # noqa: F401

#: The only separators of words in these operators: space, tab, newline, vertical tab, form feed, carriage return.
WORD_BREAKS = " \t\n\x0b\f\r"
WORD_BREAK_CLASS = r"[ \t\n\x0B\f\r]"


#: Temporary folder of this process, by master.
_own: dict[str, str] = {}


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, by their own names; whatever other columns there are cannot clash with results."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a worker-side set-up: ``make`` runs once a task and returns the function for a batch."""

    importable(spark_of(df))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for b in batches:
            if b.num_rows:
                yield step(b)

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a temporary one only on a local master."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"master {master}: spark.checkpoint.dir must name a folder that driver and executors share")
    if master not in _own:
        _own[master] = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, _own[master], ignore_errors=True)
    return "file://" + _own[master]


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends there, and a lost executor costs no recomputation."""
    spark = spark_of(df)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for t in tables:
        jvm, path = t.sparkSession._jvm, t._stored_at
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def words_of(text: Column) -> Column:
    """Words of a text as an array: runs of characters outside WORD_BREAKS."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK_CLASS + "+"), lambda w: w != "")


def int_lists(bufs: list[bytes]) -> pa.Array:
    """list<int32> from each row's raw int32 bytes."""
    import numpy as np

    offsets = np.zeros(len(bufs) + 1, np.int64)
    np.cumsum([len(b) // 4 for b in bufs], out=offsets[1:])
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(bufs))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
