"""Work through what is new, once, resumably.

Instead of a loop over rows whose result is null, a file stream remembers in
its checkpoint which files it has seen; ``availableNow`` takes all there are
and stops. A batch that ran twice after a failure is written once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def process_new(
    spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], key: str, files_per_batch: int = 100
) -> None:
    """Transform all Parquet files of ``source`` that earlier calls haven't seen, appending to ``sink``.

    Each micro-batch goes to a folder of its own number, replaced if the batch
    runs again, so a failure between write and commit leaves nothing twice.
    ``key`` rows that repeat within a batch are written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch.dropDuplicates([key])).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_processed(spark: SparkSession, sink: str) -> DataFrame:
    """What all calls have written."""
    return spark.read.parquet(sink).drop("batch")


def unprocessed(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The same without a stream: rows whose key the results lack."""
    return source.join(done.select(key).distinct(), key, "left_anti")


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events of each type in each window of event time; works on streams and tables."""
    out = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = out.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
