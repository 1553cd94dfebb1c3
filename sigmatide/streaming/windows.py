"""Session and sliding windows over the tick stream.

Both run on a stream, where a window is emitted once the watermark has passed its end and later ticks are
dropped, and on a batch, where they give every window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmatide.sources.bars import sequence_key


def _tick_aggregates() -> list[Column]:
    """Open and close are the first and last tick by (ts, event_id)."""
    key = sequence_key(F.unix_micros("ts"), F.col("event_id"), 19)
    return [F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", key).alias("close"), F.count(F.lit(1)).alias("n")]


def stream_sessions(ticks: DataFrame, gap: str = "20 minutes", delay: str = "1 hour") -> DataFrame:
    """Bars of ticks without a pause longer than ``gap``: ticker, start, last, open, high, low, close, n.

    ``ticks``: event_id, ticker, ts, price; prices of 0 or less, and rows without ticker or time, are no ticks. The
    state is one partial aggregate per open session; a tick between two of them merges them.
    """
    return (
        ticks.filter(F.col("price") > 0).filter("ticker is not null")
        .withWatermark("ts", delay)
        .groupBy("ticker", F.session_window("ts", gap).alias("w"))
        .agg(*_tick_aggregates(), F.max("ts").alias("last"))
        .select("ticker", F.col("w.start").alias("start"), "last", "open", "high", "low", "close", "n")
    )


def stream_sliding(ticks: DataFrame, width: str = "1 hour", slide: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """Bars over windows of ``width`` that start every ``slide``: ticker, dt, open, high, low, close, n.

    A tick is aggregated once, in the pane of one slide; only finished panes, a row each, go to the width / slide windows
    they belong to. A ticker's panes are few, so a hot ticker is one row per task and pane.
    """
    panes = (
        ticks.filter(F.col("price") > 0).filter("ticker is not null")
        .withWatermark("ts", delay)
        .groupBy("ticker", F.window("ts", slide).alias("pane"))
        .agg(*_tick_aggregates())
        .select("ticker", F.window_time("pane").alias("at"), "open", "high", "low", "close", "n")
    )
    return (
        panes.groupBy("ticker", F.window("at", width, slide).alias("w"))
        .agg(F.min_by("open", "at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
             F.max_by("close", "at").alias("close"), F.sum("n").alias("n"))
        .select("ticker", F.col("w.start").alias("dt"), "open", "high", "low", "close", "n")
    )
