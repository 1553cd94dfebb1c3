"""Ticks that follow news: a join of two streams bounded in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmatide.operators.time_joins import time_block


def stream_reactions(news: DataFrame, ticks: DataFrame, within_seconds: int = 300, delay: str = "1 hour") -> DataFrame:
    """Pairs of a news item and a tick of its ticker at most ``within_seconds`` after it: ticker, doc_id,
    published, event_id, ts, price.

    ``news``: ticker, doc_id, published; ``ticks``: event_id, ticker, ts, price. Rows without ticker or time match
    nothing. Each side has its own watermark; a row leaves the state once the watermarks of both sides rule out a
    partner. The join's key holds a block of time besides the ticker, so a hot ticker's state lies in many
    partitions: a tick is in one block, a news item in its own and the next. The same code runs on batches.
    """
    blocks = time_block(F.col("published"), within_seconds)
    told = (
        news.select(F.col("ticker").alias("news_ticker"), "doc_id", "published")
        .withWatermark("published", delay)
        .withColumn("news_block", F.explode(F.array(blocks, blocks + 1)))
    )
    seen = (
        ticks.filter(F.col("price") > 0).select("event_id", "ticker", "ts", "price")
        .withWatermark("ts", delay).withColumn("block", time_block(F.col("ts"), within_seconds))
    )
    condition = ("news_ticker = ticker AND news_block = block AND ts >= published "
                 f"AND ts <= published + INTERVAL {within_seconds} SECONDS")
    return told.join(seen, F.expr(condition)).select("ticker", "doc_id", "published", "event_id", "ts", "price")
