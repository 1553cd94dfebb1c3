"""Tick stream to tumbling bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from sigmatide.session import is_folder
from sigmatide.sources.bars import sequence_key


def read_stream(spark: SparkSession, folder: str, schema: StructType,
                file_name: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, at most ``files_per_trigger`` in a micro-batch.

    Without that bound a backlog is one micro-batch.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_name)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.parquet(folder)


def table_stream(spark: SparkSession, folder: str, name: str, schema: StructType,
                 files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table of a folder as a stream, be it one file or a folder of files.

    ``schema`` may name some of the columns only; others are not read.
    """
    if is_folder(spark, f"{folder}/{name}"):
        return read_stream(spark, f"{folder}/{name}", schema, files_per_trigger=files_per_trigger)
    return read_stream(spark, folder, schema, name, files_per_trigger)


def stream_bars(ticks: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Bars per ticker and window; a window is emitted once the watermark has passed it.

    ``ticks``: event_id, ticker, ts, price. Open and close are the first and last tick by
    (ts, event_id); later ticks than the watermark are dropped. The same code runs on a
    batch, where it gives every window.
    """
    key = sequence_key(F.unix_micros("ts"), F.col("event_id"), 19)
    return (
        ticks.filter(F.col("price") > 0)
        .withWatermark("ts", delay)
        .groupBy("ticker", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("price", key).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", key).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .select("ticker", F.col("w.start").alias("dt"), "open", "high", "low", "close", "volume")
    )


def append_to_parquet(stream: DataFrame, folder: str) -> StreamingQuery:
    """Append a stream to a table folder, process what is available, and stop.

    The checkpoint lives next to the table, so a rerun continues where the last one ended.
    """
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{folder}_checkpoint")
        .trigger(availableNow=True)
        .start(folder)
    )
