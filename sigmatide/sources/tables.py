"""The library's inputs read from a folder of Parquet tables.

Maps order lines, parts, events and documents to prints, bars, ticks, ticker facts and
news, so that every operator runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmatide.functions.columns import TRADING_DAYS
from sigmatide.session import shared_folder
from sigmatide.sources.bars import (
    bars_daily,
    last_bars,
    scan_bars,
    sequence_key,
    stored_period,
    write_bars,
)
from sigmatide.sources.dimensions import INFO_NUMBERS
from sigmatide.sources.news import ITEM_TYPE, news_tickers

PRINT_ORDER = ["seq"]
VOLUME_SCALE = 1e5
NEWS_SINCE = 707_356_800  # 1992-06-01
TICKS_SINCE = 1_704_067_200  # 2024-01-01
TICK_TICKERS = ["click", "error", "purchase", "signup", "view"]


# Stored bars by session, folder and state of the source files.
_STORED: dict[tuple, str] = {}


class Tables:
    """Derived inputs of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def brands(self) -> DataFrame:
        """One row per part: key, ticker and brand number ``b``."""
        return self.table("part").select(
            "p_partkey",
            F.upper(F.trim("p_brand")).alias("ticker"),
            F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int").alias("b"),
        )

    def prints(self) -> DataFrame:
        """Priced order lines: ticker, dt, price, qty and ``seq``, their order.

        ``seq`` sorts by order, line, price in cents and quantity, since order and line alone
        repeat.
        """
        lines = self.table("lineitem")
        b, price = F.col("b"), F.col("l_extendedprice")
        day = F.datediff("dt", F.lit("1995-01-01").cast("date"))
        drift = F.exp(F.lit(6e-4) * (b % 5 - 2) * day)
        spread = 1 + (price - 55000) / 5e6 * (1 + F.expr("b div 5"))
        line = (F.col("l_linenumber").cast("bigint") * 10 ** 15
                + F.round(price * 100).cast("bigint") * 10 ** 4
                + F.col("l_quantity").cast("bigint"))
        # The join follows the real sizes: broadcast if part is small, else a shuffle join
        # whose hot part keys are split at run time.
        return (
            lines.withColumn("dt", F.col("l_shipdate").cast("date"))
            .join(self.brands(), F.col("l_partkey") == F.col("p_partkey"))
            .select("ticker", "dt", (F.lit(100.0) * drift * spread).alias("price"),
                    F.col("l_quantity").alias("qty"),
                    sequence_key(F.col("l_orderkey"), line, 18).alias("seq"))
        )

    def _source_state(self) -> tuple:
        """A digest of paths, sizes and times of the files that bars are built from; contents are not read, and the
        driver gets one row per table, however many files there are."""
        state = []
        for name in ("lineitem", "part"):
            listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(
                f"{self.folder}/{name}.parquet")
            file = F.xxhash64("path", "length", "modificationTime")
            state.append(tuple(listed.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(file),
                                          F.sum(file.cast("decimal(38,0)"))).first()))
        return tuple(state)

    def stored_bars(self) -> DataFrame:
        """All bars as a table of its own, by month, built once per session and state of the sources.

        The source's time column can't be compared in its row groups, so a period read from
        it would read all prints; the stored table has a DATE column and monthly partitions.
        """
        key = (self.spark.sparkContext.applicationId, self.folder, self._source_state())
        if key not in _STORED:
            folder = shared_folder(self.spark, "bars-by-month")
            write_bars(self._built_bars(), folder)
            _STORED[key] = folder
        return self.spark.read.parquet(_STORED[key])

    def _built_bars(self) -> DataFrame:
        return scan_bars(bars_daily(self.prints(), PRINT_ORDER, VOLUME_SCALE), one_per_day=False)

    def bars(self, period: str | None = None) -> DataFrame:
        """Daily bars of all tickers, optionally of a calendar period only."""
        if period is None:
            return self._built_bars()
        return stored_period(self.stored_bars(), period)

    def universe(self) -> DataFrame:
        """All brands as one universe, in brand order."""
        return self.brands().select(F.lit("brands").alias("name"), "ticker",
                                    F.col("b").alias("pos")).distinct()

    def universes(self) -> DataFrame:
        """Besides all brands, those of an even number as a second list."""
        even = self.universe().filter(F.col("pos") % 2 == 0).withColumn("name", F.lit("even"))
        return self.universe().unionByName(even)

    def ticker_info(self) -> DataFrame:
        """Facts per brand; the 52-week levels come from its last 252 bars."""
        year = last_bars(self.stored_bars(), TRADING_DAYS).groupBy("ticker").agg(
            F.max("high").alias("top"), F.min("low").alias("bottom"))
        b = F.col("b")

        def unless(n: int, value: Column) -> Column:
            return F.when(b % n != 0, value)

        facts = self.table("part").select(
            F.trim("p_brand").alias("short_name"),
            F.upper(F.trim("p_brand")).alias("ticker"),
            F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int").alias("b")).distinct()
        return facts.join(year, "ticker", "left").select(
            "ticker", "short_name",
            unless(11, F.col("top")).alias("week52_high"),
            unless(11, F.col("bottom")).alias("week52_low"),
            unless(7, F.lit(2.5) * b).alias("trailing_pe"),
            (F.pow(F.lit(10.0), (5 + b % 9).cast("double")) * 1.5).alias("market_cap"),
            ((b - 8) / 50).alias("revenue_growth"),
            ((b - 4) / 60).alias("profit_margin"),
            unless(6, b % 6 / 100).alias("dividend_yield"),
        )

    def ticks(self, events: DataFrame | None = None) -> DataFrame:
        """Events as priced ticks; ``events`` may be a stream of the same table."""
        events = self.table("events") if events is None else events
        return events.select(
            "event_id", F.col("event_type").alias("ticker"),
            F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
        ).filter(F.col("price") > 0)

    def tick_facts(self) -> DataFrame:
        """Facts of the tick tickers: none are known; price levels come from the stream itself."""
        return self.spark.createDataFrame(
            [], "ticker string, short_name string, " + ", ".join(f"{c} double" for c in INFO_NUMBERS))

    def news(self) -> DataFrame:
        """Documents as news items in both forms; every third one is flat."""
        flat = F.col("doc_id") % 3 == 0
        doc = F.col("doc_id")
        seconds = F.lit(TICKS_SINCE) + doc * 60  # 2024-01-01 plus doc_id minutes
        utc = F.convert_timezone(None, F.lit("UTC"), F.timestamp_seconds(seconds))
        iso = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        link = F.concat(F.lit("https://news.example/"), doc)
        content = F.when(~flat, F.struct(
            F.col("text").alias("title"),
            F.struct(link.alias("url")).alias("clickThroughUrl"),
            F.struct(F.col("source").alias("displayName")).alias("provider"),
            iso.alias("pubDate")))
        item = F.struct(
            content.alias("content"),
            F.when(flat, F.col("text")).alias("title"),
            F.when(flat, link).alias("link"),
            F.when(flat, F.col("source")).alias("publisher"),
            F.when(flat, seconds).alias("providerPublishTime"),
        ).cast(ITEM_TYPE)
        return self.table("documents").select(
            F.concat(F.lit("BRAND#"), doc % 25 + 1).alias("ticker"),
            doc.alias("ord"), item.alias("item"))

    def tick_news(self, documents: DataFrame | None = None) -> DataFrame:
        """Documents as news of the tick tickers, one a minute from the first tick's day; they may be a stream."""
        documents = self.table("documents") if documents is None else documents
        ticker = F.get(F.array(*map(F.lit, TICK_TICKERS)), F.pmod("doc_id", F.lit(len(TICK_TICKERS))).cast("int"))
        return documents.select(ticker.alias("ticker"), "doc_id",
                                F.timestamp_seconds(F.lit(TICKS_SINCE) + F.col("doc_id") * 60).alias("published"))

    def dated_news(self) -> DataFrame:
        """Documents as news (ticker, doc_id, published) spread over the years of the bars."""
        minutes = F.pmod(F.col("doc_id") * 7919, F.lit(3_000_000))
        return self.table("documents").select(
            F.concat(F.lit("BRAND#"), F.col("doc_id") % 25 + 1).alias("ticker"), "doc_id",
            F.timestamp_seconds(F.lit(NEWS_SINCE) + minutes * 60).alias("published"))

    def feed(self, tickers: int = 15) -> DataFrame:
        """News items of the first tickers of the universe, with their place."""
        return news_tickers(self.news(), self.universe(), tickers)
