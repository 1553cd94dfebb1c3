"""Market movers and the news feed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmatide.functions.columns import first_match
from sigmatide.sources.bars import last_bars
from sigmatide.sources.dimensions import universe_position, with_ticker_info

BOARD_ROWS = 10
LOOK_BACK = 5
NEWS_KEPT, NEWS_SHOWN = 50, 30

# A title containing one of these substrings is in the category; first wins.
NEWS_KEYWORDS = {
    "earnings": ["earnings", "revenue", "profit", "quarter", "eps"],
    "mergers": ["merger", "acquire", "acquisition", "deal", "buyout"],
    "fda": ["fda", "approval", "government", "regulatory", "sec", "congress"],
    "upgrades": ["upgrade", "downgrade", "target", "rating", "analyst"],
}


def recent_days(bars: DataFrame, days: int = LOOK_BACK) -> DataFrame:
    """Bars of the table's last ``days`` days with bars; the first of them is a bare subquery."""
    dates = bars.select("dt").distinct().orderBy(F.desc("dt")).limit(days)
    return bars.filter(F.col("dt") >= dates.agg(F.min("dt")).scalar())


def bars_before(bars: DataFrame, days: int) -> DataFrame:
    """The bars as they were ``days`` days with bars ago."""
    dates = bars.select("dt").distinct().orderBy(F.desc("dt")).limit(days + 1)
    return bars.filter(F.col("dt") <= dates.agg(F.min("dt")).scalar())


def board_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """board, ticker, change (entered, left, stayed), rank_now, rank_before, newcomer: two states of the boards.

    Entries are compared as multisets, null tickers being equal: of three equal entries of which two were there
    before, one has entered and two have stayed. ``newcomer`` marks tickers that were on no board before. Ranks are the best of
    equal entries. Boards are short, and all joins are on (board, ticker).
    """
    key = ["board", "ticker"]
    states = now.select(*key), before.select(*key)
    moves = [(states[0].exceptAll(states[1]), "entered"), (states[1].exceptAll(states[0]), "left"),
             (states[0].intersectAll(states[1]), "stayed")]
    found = None
    for rows, name in moves:
        rows = rows.withColumn("change", F.lit(name))
        found = rows if found is None else found.unionByName(rows)
    for df, name in ((now, "rank_now"), (before, "rank_before")):
        ranks = df.groupBy(F.col("board").alias("_board"), F.col("ticker").alias("_ticker")).agg(F.min("rank").alias(name))
        same = F.col("board").eqNullSafe(F.col("_board")) & F.col("ticker").eqNullSafe(F.col("_ticker"))
        found = found.join(ranks, same, "left").drop("_board", "_ticker")
    known = before.select(F.col("ticker").alias("_ticker")).distinct()
    fresh = states[0].select("ticker").distinct().join(
        known, F.col("ticker").eqNullSafe(F.col("_ticker")), "left_anti").select(F.col("ticker").alias("_new"))
    return found.join(fresh.withColumn("_is_new", F.lit(True)), F.col("ticker").eqNullSafe(F.col("_new")), "left").select(
        *key, "change", "rank_now", "rank_before", F.coalesce("_is_new", F.lit(False)).alias("newcomer"))


def mover_metrics(bars: DataFrame, info: DataFrame) -> DataFrame:
    """Change of the last two closes, last volume and 52-week position per ticker.

    Missing facts count as 0, and so does the distance from a missing level. Cut the bars with
    recent_days first, so that a ticker that no longer trades leaves the boards.
    """
    newest = last_bars(bars, 2)
    pair = newest.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("close", "dt").alias("price"),
        F.min_by("close", "dt").alias("previous"),
        F.max_by("volume", "dt").alias("volume"),
    ).filter("n = 2")
    return mover_columns(with_ticker_info(pair, info))


def mover_columns(pairs: DataFrame) -> DataFrame:
    """(ticker, price, previous, volume, facts) to the columns of the boards."""
    price, before = F.col("price"), F.col("previous")

    def distance(level: str) -> Column:
        return F.coalesce(F.try_divide(price - F.col(level), F.col(level)) * 100, F.lit(0.0))

    return pairs.select(
        "ticker", "price", ((price - before) / before * 100).alias("change"), "volume",
        F.coalesce("week52_high", F.lit(0.0)).alias("high_52w"),
        F.coalesce("week52_low", F.lit(0.0)).alias("low_52w"),
        distance("week52_high").alias("pct_from_high"),
        distance("week52_low").alias("pct_from_low"),
        (F.coalesce("dividend_yield", F.lit(0.0)) * 100).alias("div_yield"),
    )


def movers_top(metrics: DataFrame, universe: DataFrame | None = None,
               rows: int = BOARD_ROWS) -> DataFrame:
    """Six boards of the first ``rows`` tickers; ties keep the universe order.

    Each ticker is ranked on six keys (largest key first); the rank filter is applied as a
    group limit before the six-way shuffle.
    """
    keys = {
        "most_active": F.col("volume"),
        "gainers": F.col("change"),
        "losers": -F.col("change"),
        "high_52w": F.col("pct_from_high"),
        "low_52w": -F.col("pct_from_low"),
        "dividends": F.col("div_yield"),
    }
    boards = F.array(*[F.struct(F.lit(b).alias("board"), k.alias("sort_key"))
                       for b, k in keys.items()])
    best = Window.partitionBy("board").orderBy(
        F.desc_nulls_last("sort_key"), F.asc_nulls_last("pos"), "ticker")
    return (
        universe_position(metrics, universe)
        .select("*", F.inline(boards))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= rows)
        .drop("pos", "sort_key")
    )


def news_category(news: DataFrame, text: str = "title") -> DataFrame:
    """Add ``category``: the first keyword group with a substring of the lower-case text.

    The text is lowered once, in its own projection, and searched whole for each keyword.
    """
    def any_of(words: list[str]) -> Column:
        return reduce(Column.__or__, [F.col("_lower").contains(w) for w in words])

    groups = [(any_of(words), name) for name, words in NEWS_KEYWORDS.items()]
    return (
        news.withColumn("_lower", F.lower(text))
        .withColumn("category", first_match(*groups, otherwise="general"))
        .drop("_lower")
    )


def news_latest(news: DataFrame, rows: int = NEWS_KEPT) -> DataFrame:
    """The newest ``rows`` items with their category; equal times keep the feed's order."""
    return news_category(news.orderBy(F.desc("time"), "pos", "ord").limit(rows))


def news_by_category(latest: DataFrame, category: str | None = None,
                     rows: int = NEWS_SHOWN) -> DataFrame:
    """The newest ``rows`` of the kept items in a category (all without one)."""
    chosen = latest if category is None else latest.filter(F.col("category") == category)
    return chosen.orderBy(F.desc("time"), "pos", "ord").limit(rows)
