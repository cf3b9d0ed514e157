"""Chunking as a stream: it is stateless by document, so that each micro-batch is a batch query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunk import MAX_CHARS, STRATEGIES
from ..operators.extract import extract


def page_stream(spark: SparkSession, path: str, schema: str = "doc_id long, html string", files_per_batch: int = 64) -> DataFrame:
    """New Parquet files of pages as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def chunk_stream(pages: DataFrame, out: str, checkpoint: str, strategy: str = "stc", max_chars: int = MAX_CHARS) -> StreamingQuery:
    """Append the chunks of new pages to Parquet at ``out``; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, no: int) -> None:
        e = extract(batch).persist()
        STRATEGIES[strategy](e, max_chars).withColumn("batch", F.lit(no)).write.mode("overwrite").parquet(f"{out}/batch={no}")
        e.unpersist()

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def extract_stream(pages: DataFrame) -> DataFrame:
    """The extraction itself as a streaming DataFrame."""
    return extract(pages)


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type in tumbling windows of event time, late rows up to a watermark."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
