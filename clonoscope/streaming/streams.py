"""Structured Streaming: files of sequence tables as they arrive, and event counts in windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.readers import Options, chain


def airr_stream(spark: SparkSession, folder: str, columns: list[str], o: Options, out: str, checkpoint: str) -> StreamingQuery:
    """New files of a folder go through the import chain, batch by batch, into a Parquet table; a batch that is run again is written
    again under its own number, so a restart makes no double rows."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    stream = spark.readStream.schema(schema).options(sep=o.separator, header=str(o.header).lower(), pathGlobFilter="*.{tsv,csv,txt}").csv(folder)

    def write(batch: DataFrame, number: int) -> None:
        chain(batch, o).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): tumbling windows over `ts`; on a stream, with a watermark for late rows."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")
