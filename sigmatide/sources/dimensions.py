"""Small reference tables: ticker universes, ticker facts, portfolio definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The ticker lists of the investment, movers, buy-list and news features.
INVESTMENT_TICKERS = [
    "AAPL", "MSFT", "GOOGL", "AMZN", "META", "NVDA", "TSLA", "AMD", "CRM", "ADBE", "NOW", "SNOW", "PLTR",
    "UBER", "ABNB", "AVGO", "QCOM", "MU", "MRVL", "AMAT", "JPM", "GS", "V", "MA", "BLK", "JNJ", "UNH",
    "LLY", "ABBV", "MRK", "PFE", "WMT", "COST", "HD", "NKE", "SBUX", "MCD", "XOM", "CVX", "NEE", "CAT",
    "BA", "HON", "GE", "RTX", "NFLX", "DIS", "SPY", "QQQ", "VTI", "VOO", "COIN", "MARA", "ENPH", "SEDG",
    "RIVN", "LCID", "CRWD", "ZS", "NET", "DDOG", "MDB", "ARM", "SMCI", "IONQ",
]
MOVERS_TICKERS = [
    "AAPL", "MSFT", "GOOGL", "AMZN", "TSLA", "NVDA", "META", "AMD", "NFLX", "DIS", "BA", "JPM", "GS", "V",
    "MA", "PFE", "JNJ", "MRK", "UNH", "XOM", "CVX", "WMT", "HD", "CRM", "ORCL", "INTC", "CSCO", "VZ", "T",
    "KO", "PEP",
]
BUY_LIST_TICKERS = [
    *MOVERS_TICKERS, "COST", "NKE", "SBUX", "PYPL", "SQ", "UBER", "LYFT", "SNAP", "PINS",
]
NEWS_TICKERS = [
    "AAPL", "MSFT", "GOOGL", "AMZN", "TSLA", "NVDA", "META", "AMD", "NFLX", "DIS", "BA", "JPM", "GS", "V",
    "MA", "PFE", "JNJ", "MRK", "UNH", "XOM", "CVX",
]

NAMED_UNIVERSES = {
    "investment": INVESTMENT_TICKERS,
    "movers": MOVERS_TICKERS,
    "buy_list": BUY_LIST_TICKERS,
    "news": NEWS_TICKERS,
}

# Name, target multiple, target return, annual return, picks, description.
PORTFOLIOS = [
    ("conservative", "Conservative Growth", 1.4, 0.40, 0.183, 6,
     "Lower risk, steady growth with established companies"),
    ("moderate", "Balanced Growth", 1.7, 0.70, 0.304, 8, "Mix of growth and stability"),
    ("aggressive", "Aggressive Growth", 2.0, 1.00, 0.414, 10,
     "Higher risk, maximum growth potential"),
]
# Weight of the k-th pick; a portfolio without a list is weighted equally.
PORTFOLIO_WEIGHTS = {
    "moderate": [0.20, 0.18, 0.15, 0.12, 0.10, 0.10, 0.08, 0.07],
    "aggressive": [0.25, 0.20, 0.15, 0.12, 0.08, 0.07, 0.05, 0.04, 0.02, 0.02],
}

INFO_NUMBERS = ["week52_high", "week52_low", "trailing_pe", "market_cap", "revenue_growth",
                "profit_margin", "dividend_yield"]


def universes(spark: SparkSession) -> DataFrame:
    """(name, ticker, pos) of the fixed ticker lists."""
    rows = [(name, t, i + 1) for name, ts in NAMED_UNIVERSES.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "name string, ticker string, pos int")


def read_universe(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(name, ticker, pos) of a text file with one ticker a line, in the order of the file, upper case.

    For long lists, such as that of a screener over hundreds of tickers, which are data and no part of the
    library. Blank lines and what follows a # are left out; a ticker that repeats keeps its first place.
    """
    ticker = F.upper(F.trim(F.regexp_replace("value", "#.*", "")))
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    listed = lines.select("line", ticker.alias("ticker")).filter("ticker <> ''")
    first = listed.groupBy("ticker").agg(F.min("line").alias("line"))
    place = F.row_number().over(Window.orderBy("line"))  # one row per ticker of one list
    return first.select(F.lit(name).alias("name"), "ticker", place.alias("pos"))


def universe_filter(df: DataFrame, universe: DataFrame, name: str | None = None) -> DataFrame:
    """Rows whose ticker is in a (name, ticker, pos) list.

    No broadcast hint: the optimizer broadcasts the list only if its size allows it.
    """
    if name is not None:
        universe = universe.filter(F.col("name") == name)
    wanted = universe.select(F.upper(F.trim("ticker")).alias("ticker"))
    return df.withColumn("ticker", F.upper(F.trim("ticker"))).join(wanted, "ticker", "left_semi")


def universe_position(df: DataFrame, universe: DataFrame | None) -> DataFrame:
    """Add ``pos``, the place in the universe list, the tie-break of ranked boards.

    Tickers outside the list, or all without a list, get NULL; ranks then tie-break by ticker.
    """
    if universe is None:
        return df.withColumn("pos", F.lit(None).cast("int"))
    place = universe.groupBy("ticker").agg(F.min("pos").alias("pos"))
    return df.join(place, "ticker", "left")


def with_ticker_info(df: DataFrame, info: DataFrame) -> DataFrame:
    """Left join of the nullable facts, as they are."""
    return df.join(info.select("ticker", "short_name", *INFO_NUMBERS), "ticker", "left")


def scan_ticker_info(tickers: DataFrame, info: DataFrame) -> DataFrame:
    """Facts per ticker with defaults: numbers 0, name = ticker."""
    return with_ticker_info(tickers.select("ticker"), info).select(
        "ticker",
        F.coalesce("short_name", "ticker").alias("short_name"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in INFO_NUMBERS],
    )


def portfolio_definitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        PORTFOLIOS,
        "portfolio string, name string, target_multiple double, target_return double, "
        "annual_return double, n_picks int, description string",
    )
