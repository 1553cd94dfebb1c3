"""Buy/sell analysis of three months of raw bars, and the buy list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmatide.functions.columns import (
    ANNUAL,
    first_match,
    number_text,
    points,
    ratio_change,
    whole,
)
from sigmatide.operators.estimators import with_returns
from sigmatide.sources.bars import min_history
from sigmatide.sources.dimensions import universe_position, with_ticker_info

MIN_BARS = 20
START_SCORE = 50
MAX_BUY_REASONS, MAX_SELL_REASONS = 6, 4
BUY_LIST_SCORE, BUY_LIST_ROWS, BUY_LIST_SHOWN = 50, 20, 15
PRICE_BANDS = {"all": (0.0, None), "0-10": (0.0, 10.0), "10-100": (10.0, 100.0),
               "100-500": (100.0, 500.0), "500-1000": (500.0, None)}


def insufficient(bars: DataFrame) -> DataFrame:
    """ticker, n_bars and reason of the tickers with too few bars for the analysis."""
    counted = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_bars"))
    return counted.filter(F.col("n_bars") < MIN_BARS).withColumn(
        "reason", F.format_string(f"insufficient data: %d of {MIN_BARS} bars", "n_bars"))


def rsi() -> Column:
    """Aggregate: mean gain against mean loss over the whole window."""
    r = F.col("returns")
    gain = F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0))
    loss = F.coalesce(F.abs(F.avg(F.when(r < 0, r))), F.lit(0.001))
    return 100 - 100 / (1 + gain / loss)


def analyzer_metrics(bars: DataFrame) -> DataFrame:
    """Changes, volatility and volume surge in percent, moving averages and RSI per ticker."""
    rows = with_returns(min_history(bars, MIN_BARS)).withColumn(
        "age", F.count(F.lit(1)).over(whole()) - F.col("rn") + 1)

    def close_at(age: int) -> Column:
        return F.max(F.when(F.col("age") == age, F.col("close")))

    def tail_mean(column: str, size: int) -> Column:
        return F.avg(F.when(F.col("age") <= size, F.col(column)))

    per_ticker = rows.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_bars"),
        close_at(1).alias("price"), close_at(5).alias("close_5"), close_at(20).alias("close_20"),
        F.max(F.when(F.col("rn") == 1, F.col("close"))).alias("close_first"),
        (F.stddev_samp("returns") * ANNUAL * 100).alias("volatility"),
        tail_mean("volume", 5).alias("volume_5"), tail_mean("volume", 20).alias("volume_20"),
        tail_mean("close", 20).alias("ma_20"), tail_mean("close", 50).alias("mean_50"),
        rsi().alias("rsi"),
    )
    price = F.col("price")
    return (
        per_ticker.withColumns({
            "ret_5d": ratio_change(price, F.col("close_5")) * 100,
            "ret_20d": ratio_change(price, F.col("close_20")) * 100,
            "ret_60d": ratio_change(price, F.col("close_first")) * 100,
            "volume_surge": F.when(F.col("volume_20") > 0,
                                   (F.col("volume_5") / F.col("volume_20") - 1) * 100)
            .otherwise(0.0),
            "ma_50": F.when(F.col("n_bars") >= 50, F.col("mean_50")).otherwise(F.col("ma_20")),
        })
        .withColumns({"above_ma_20": price > F.col("ma_20"), "above_ma_50": price > F.col("ma_50")})
        .select("ticker", "price", "ret_5d", "ret_20d", "ret_60d", "volatility", "volume_surge",
                "ma_20", "ma_50", "above_ma_20", "above_ma_50", "rsi")
    )


def rsi_mean(bars: DataFrame) -> DataFrame:
    return with_returns(bars).groupBy("ticker").agg(rsi().alias("rsi"))


def week52_position(metrics: DataFrame, info: DataFrame) -> DataFrame:
    """Add facts and percent distance from the 52-week high and low.

    A missing high or low is taken as the price itself, so the distance is 0.
    """
    price = F.col("price")

    def distance(level: str) -> Column:
        ref = F.coalesce(level, price)
        return F.coalesce(F.try_divide(price - ref, ref) * 100, F.lit(0.0))

    return with_ticker_info(metrics, info).withColumns({
        "pct_from_high": distance("week52_high"),
        "pct_from_low": distance("week52_low"),
        "name": F.coalesce("short_name", "ticker"),
        "pe_ratio": F.coalesce("trailing_pe", F.lit(0.0)),
        "market_cap": F.coalesce("market_cap", F.lit(0.0)),
        "revenue_growth": F.coalesce("revenue_growth", F.lit(0.0)),
        "profit_margin": F.coalesce("profit_margin", F.lit(0.0)),
    })


@dataclass(frozen=True)
class Rule:
    """One outcome of the analysis: its condition, points, side, and text round a number."""

    when: Column
    score: int
    side: str
    before: str
    value: Column | None = None
    after: str = ""

    def text(self) -> Column:
        if self.value is None:
            return F.lit(self.before)
        return F.concat(F.lit(self.before), self.value, F.lit(self.after))


def rule_groups() -> list[list[Rule]]:
    """Thresholds, points and texts. The first rule that holds in a group counts."""
    ret5, ret20, rsi_, surge = (F.col(c) for c in ("ret_5d", "ret_20d", "rsi", "volume_surge"))
    high, low, vol = F.col("pct_from_high"), F.col("pct_from_low"), F.col("volatility")
    growth, pe, margin = F.col("revenue_growth"), F.col("pe_ratio"), F.col("profit_margin")
    over20, over50 = F.col("above_ma_20"), F.col("above_ma_50")

    def n(x: Column, decimals: int = 0, signed: bool = False) -> Column:
        return number_text(x, decimals, signed)

    return [
        [
            Rule(ret5 > 5, 15, "buy", "🚀 Strong 5-day momentum: +", n(ret5, 1), "%"),
            Rule(ret5 > 2, 8, "buy", "📈 Positive 5-day trend: +", n(ret5, 1), "%"),
            Rule(ret5 < -5, -10, "sell", "📉 Weak 5-day momentum: ", n(ret5, 1), "%"),
            Rule(ret5 < -2, 0, "sell", "⚠️ Slight 5-day decline: ", n(ret5, 1), "%"),
        ],
        [
            Rule(ret20 > 15, 15, "buy", "🔥 Excellent monthly performance: +", n(ret20, 1), "%"),
            Rule(ret20 > 8, 10, "buy", "💪 Strong 20-day gains: +", n(ret20, 1), "%"),
            Rule(ret20 < -15, -15, "sell", "🔻 Significant 20-day decline: ", n(ret20, 1), "%"),
            Rule(ret20 < -8, -8, "sell", "📉 Bearish 20-day trend: ", n(ret20, 1), "%"),
        ],
        [
            Rule(over20 & over50, 15, "buy",
                 "✅ Trading above both 20-day and 50-day moving averages (bullish)"),
            Rule(over20, 8, "buy", "📊 Above 20-day moving average"),
            Rule(~over20 & ~over50, -12, "sell", "❌ Below both moving averages (bearish trend)"),
        ],
        [
            Rule(rsi_ < 30, 12, "buy", "💰 RSI at ", n(rsi_),
                 " - Oversold, potential bounce opportunity"),
            Rule(rsi_ < 40, 6, "buy", "👀 RSI at ", n(rsi_), " - Approaching oversold territory"),
            Rule(rsi_ > 70, -12, "sell", "⚠️ RSI at ", n(rsi_),
                 " - Overbought, potential pullback"),
            Rule(rsi_ > 60, 0, "buy", "📈 RSI at ", n(rsi_), " - Healthy momentum"),
        ],
        [
            Rule(surge > 50, 8, "buy", "📊 High volume surge: +", n(surge),
                 "% above average (strong interest)"),
            Rule(surge > 20, 0, "buy", "📈 Increasing volume: +", n(surge), "% above average"),
            Rule(surge < -30, 0, "sell", "📉 Declining volume: ", n(surge), "% (waning interest)"),
        ],
        [
            Rule(high > -5, 10, "buy", "🎯 Near 52-week high (", n(high, 1, True),
                 "%) - Breakout potential"),
            Rule((high < -30) & (ret20 > 5), 8, "buy", "💎 Down ", n(F.abs(high)),
                 "% from high but recovering - Value opportunity"),
            Rule(high < -30, 0, "sell", "📉 Down ", n(F.abs(high)), "% from 52-week high"),
        ],
        [
            Rule((low < 10) & (ret5 > 0), 8, "buy",
                 "📈 Near 52-week low with positive momentum - Potential reversal"),
        ],
        [
            Rule((vol > 20) & (vol < 40), 0, "buy", "⚖️ Moderate volatility (", n(vol),
                 "%) - Good risk/reward"),
            Rule(vol > 60, 0, "sell", "⚡ High volatility (", n(vol), "%) - Increased risk"),
            Rule(vol < 15, 0, "buy", "🛡️ Low volatility (", n(vol), "%) - More stable"),
        ],
        [
            Rule(growth > 0.20, 10, "buy", "📊 Strong revenue growth: ", n(growth * 100), "% YoY"),
            Rule(growth > 0.10, 5, "buy", "📈 Solid revenue growth: ", n(growth * 100), "% YoY"),
            Rule(growth < -0.10, 0, "sell", "📉 Declining revenue: ", n(growth * 100), "% YoY"),
        ],
        [
            Rule((pe > 10) & (pe < 25), 0, "buy", "💰 Reasonable P/E ratio: ", n(pe, 1)),
            Rule(pe > 50, 0, "sell", "⚠️ High P/E ratio: ", n(pe, 1), " - Potentially overvalued"),
            Rule((pe < 10) & (pe > 0), 0, "buy", "💎 Low P/E ratio: ", n(pe, 1),
                 " - Potential value"),
        ],
        [
            Rule(margin > 0.20, 0, "buy", "💵 Strong profit margin: ", n(margin * 100, 1), "%"),
            Rule(margin < 0, 0, "sell", "📉 Negative profit margin: ", n(margin * 100, 1), "%"),
        ],
    ]


def buy_score(positioned: DataFrame) -> DataFrame:
    """Add ``score``, clamped to 0..100."""
    total = F.lit(START_SCORE)
    for group in rule_groups():
        total = total + points(*[(r.when, r.score) for r in group])
    return positioned.withColumn("score", F.least(F.lit(100), F.greatest(F.lit(0), total)))


def reasons(side: str, limit: int) -> Column:
    """Texts of one side in rule order, the first ``limit`` of them."""
    def text(group: list[Rule]) -> Column:
        return first_match(*[(r.when, r.text() if r.side == side else F.lit(None).cast("string"))
                             for r in group])

    return F.slice(F.array_compact(F.array(*[text(g) for g in rule_groups()])), 1, limit)


def buy_reasons() -> Column:
    return reasons("buy", MAX_BUY_REASONS)


def sell_reasons() -> Column:
    return reasons("sell", MAX_SELL_REASONS)


# The least score of each signal.
def signal_label(score: Column) -> Column:
    return first_match((score >= 75, "STRONG BUY"), (score >= 60, "BUY"), (score >= 45, "HOLD"),
                       (score >= 30, "SELL"), otherwise="STRONG SELL")


# Units and decimals of the labels.
def market_cap_label(cap: Column) -> Column:
    def scaled(unit: float, decimals: int, letter: str) -> Column:
        return F.concat(F.lit("$"), number_text(cap / unit, decimals), F.lit(letter))

    return first_match((cap > 1e12, scaled(1e12, 2, "T")), (cap > 1e9, scaled(1e9, 1, "B")),
                       (cap > 1e6, scaled(1e6, 0, "M")), otherwise="N/A")


def analysis(bars: DataFrame, info: DataFrame) -> DataFrame:
    """Score, signal and reasons of every ticker with enough bars."""
    scored = buy_score(week52_position(analyzer_metrics(bars), info))
    return scored.select(
        "ticker", "name", "price", signal_label(F.col("score")).alias("signal"), "score",
        "ret_5d", "ret_20d", "rsi", "volatility", "pct_from_high",
        buy_reasons().alias("buy_reasons"), sell_reasons().alias("sell_reasons"),
        "pe_ratio", "market_cap",
    )


def buy_list(analysed: DataFrame, universe: DataFrame | None = None, rows: int = BUY_LIST_ROWS) -> DataFrame:
    """The ``rows`` best tickers scoring 50 or more; ties keep the universe order."""
    return (
        universe_position(analysed.filter(F.col("score") >= BUY_LIST_SCORE), universe)
        .orderBy(F.desc("score"), F.asc_nulls_last("pos"), "ticker")
        .limit(rows)
    )


def price_band_filter(listed: DataFrame, band: str = "all") -> DataFrame:
    """Buy-list rows in a price band (lower bound included), the first 15 of them.

    It filters the finished list: a narrower band never brings in further tickers. An
    unknown band filters nothing, and the top band has no upper bound.
    """
    low, high = PRICE_BANDS.get(band, PRICE_BANDS["all"])
    inside = F.col("price") >= low
    if high is not None:
        inside = inside & (F.col("price") < high)
    return (
        listed.filter(inside)
        .orderBy(F.desc("score"), F.asc_nulls_last("pos"), "ticker")
        .limit(BUY_LIST_SHOWN)
    )
