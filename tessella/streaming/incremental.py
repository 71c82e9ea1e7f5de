"""Extension: files that arrive are indexed as they come. A stream of folder listings, one indexing run a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.plans.pipeline import Corpus


def watch_folder(spark: SparkSession, folder: str, corpus: Corpus, checkpoint: str) -> StreamingQuery:
    """Indexes the folder whenever new files appear. The micro-batch only says that something came; indexing compares digests, so a batch that runs twice does no harm."""
    arrivals = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder).select("path")

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            corpus.index_folder(folder)

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events (ts, event_type) counted by window and type, with a watermark for late ones; for streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
