"""News feeds: flat and nested item forms to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM_TYPE = (
    "struct<content: struct<title: string, clickThroughUrl: struct<url: string>, "
    "provider: struct<displayName: string>, pubDate: string>, "
    "title: string, link: string, publisher: string, providerPublishTime: bigint>"
)


def news_items(feeds: DataFrame, per_ticker: int = 3) -> DataFrame:
    """(ticker, news ARRAY) to (ticker, ord, item), the first ``per_ticker`` of each list."""
    return feeds.select(
        "ticker", F.posexplode(F.slice("news", 1, per_ticker)).alias("ord", "item"))


def news_tickers(items: DataFrame, universe: DataFrame, tickers: int = 15) -> DataFrame:
    """Items of the first ``tickers`` of a universe, with the ticker's place ``pos``.

    The optimizer knows the size of the cut list and broadcasts it if it is small: items are then
    cut before any shuffle of their texts.
    """
    place = universe.select("ticker", "pos").orderBy("pos", "ticker").limit(tickers)
    return items.join(place, "ticker")


def first_items(items: DataFrame, per_ticker: int = 3) -> DataFrame:
    """The first ``per_ticker`` items per ticker by ``ord``, without building any list.

    The rank filter becomes a group limit before the shuffle, so a ticker with most of the
    items sends at most ``per_ticker`` rows from each map task.
    """
    order = Window.partitionBy("ticker").orderBy("ord")
    return (
        items.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= per_ticker)
        .drop("_rank")
    )


def item_time(item: Column) -> Column:
    """ISO text or epoch seconds as zone-free UTC time; missing time is the epoch."""
    instant = F.coalesce(
        F.try_to_timestamp(item["content"]["pubDate"]),
        F.timestamp_seconds(item["providerPublishTime"]),
        F.timestamp_seconds(F.lit(0)),
    )
    return F.convert_timezone(None, F.lit("UTC"), instant)


def news_flatten(items: DataFrame) -> DataFrame:
    """(ticker, pos, ord, item) to title, link, publisher and time; nested wins over flat."""
    item, content = F.col("item"), F.col("item.content")
    return items.select(
        "ticker", "pos", "ord",
        F.coalesce(content["title"], item["title"], F.lit("No title")).alias("title"),
        F.coalesce(content["clickThroughUrl"]["url"], item["link"], F.lit("#")).alias("link"),
        F.coalesce(content["provider"]["displayName"], item["publisher"], F.lit("Unknown"))
        .alias("publisher"),
        item_time(item).alias("time"),
    )
