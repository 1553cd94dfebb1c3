"""Market screen: six-month metrics, three style scores and their leader lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmatide.functions.columns import first_match, points, ratio_change
from sigmatide.operators.estimators import panel_percentile, regime_label, volatility_frame
from sigmatide.sources.bars import min_history

MIN_BARS = 30
VOLUME_BARS = 20
TOP = 50
STYLES = ["daytrade", "swing", "longterm"]


def screen_metrics(bars: DataFrame, window: int = 21) -> DataFrame:
    """Price, volatility, changes, liquidity and regime per ticker of a period's bars.

    Changes compare the last panel row with the k-th row from the end, and are 0 in a panel
    shorter than k. Dollar volume averages the last raw bars.
    """
    frame = volatility_frame(min_history(bars, MIN_BARS), window)

    def close_at(age: int) -> Column:
        return F.max(F.when(F.col("panel_age") == age, F.col("close")))

    def change(age: int) -> Column:
        return F.coalesce(ratio_change(F.col("price"), F.col(f"close_{age}")), F.lit(0.0))

    per_ticker = frame.groupBy("ticker").agg(
        close_at(1).alias("price"), close_at(5).alias("close_5"), close_at(20).alias("close_20"),
        F.max("last_yang_zhang").alias("volatility"),
        F.avg(F.when(F.col("in_panel"), F.col("yang_zhang"))).alias("avg_volatility"),
        F.avg(F.when(F.col("bar_age") <= VOLUME_BARS, F.col("close") * F.col("volume")))
        .alias("dollar_volume"),
        panel_percentile().alias("percentile"),
    )
    return per_ticker.filter("price is not null").select(
        "ticker", "price", "volatility", "avg_volatility",
        F.try_divide(F.col("volatility") - F.col("avg_volatility"), F.col("avg_volatility"))
        .alias("vol_trend"),
        regime_label(F.col("percentile")).alias("regime"),
        change(5).alias("price_change_5d"),
        change(20).alias("price_change_20d"),
        "dollar_volume",
    )


# The thresholds and points of the three scores and of the direction.
def score_daytrade() -> Column:
    """High volatility, liquidity and recent movement."""
    regime, vol, dollars = F.col("regime"), F.col("volatility"), F.col("dollar_volume")
    return (
        points((regime.isin("High", "Extreme"), 30), (regime == "Normal", 15))
        + points((vol > 0.40, 25), (vol > 0.25, 15))
        + points((dollars > 1e9, 25), (dollars > 500e6, 15))
        + points((F.abs("price_change_5d") > 0.05, 20))
    )


def score_swing() -> Column:
    """Moderate volatility, a trend in either direction, liquidity."""
    regime, vol, change = F.col("regime"), F.col("volatility"), F.col("price_change_20d")
    return (
        points((regime.isin("Normal", "High"), 25), (regime == "Low", 10))
        + points(((vol > 0.20) & (vol < 0.50), 25))
        + points((F.col("dollar_volume") > 200e6, 20))
        + points((change > 0.05, 30), (change < -0.05, 20))
    )


def swing_direction() -> Column:
    change = F.col("price_change_20d")
    return first_match((change > 0.05, "📈 Bullish"), (change < -0.05, "📉 Bearish"),
                       otherwise="➡️ Neutral")


def score_longterm() -> Column:
    """Low volatility, stability, an established price."""
    regime, vol, price = F.col("regime"), F.col("volatility"), F.col("price")
    return (
        points((regime == "Low", 35), (regime == "Normal", 20))
        + points((vol < 0.25, 30), (vol < 0.35, 15))
        + points((price > 100, 20), (price > 50, 10))
        + points((F.abs("price_change_20d") < 0.10, 15))
    )


def screen_scores(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns({
        "score_daytrade": score_daytrade(),
        "score_swing": score_swing(),
        "swing_direction": swing_direction(),
        "score_longterm": score_longterm(),
    })


def screen_top(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` tickers of each style by score; ties go by ticker.

    The rank filter is applied as a group limit before the three-way shuffle.
    """
    styles = F.array(*[F.struct(F.lit(s).alias("style"), F.col(f"score_{s}").alias("score"))
                       for s in STYLES])
    best = Window.partitionBy("style").orderBy(F.desc("score"), "ticker")
    return (
        scored.select("*", F.inline(styles))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= top)
        .select("style", "rank", "ticker", "score", "price", "volatility", "regime",
                "price_change_5d", "price_change_20d", "dollar_volume", "swing_direction")
    )


def screen_cube(top: DataFrame, labels: DataFrame) -> DataFrame:
    """Tickers and scores of a screen over every combination of style, regime and cap label, totals included.

    ``labels`` has ticker and cap_label; a ticker without one has a null label. ``level`` has a bit for each of the three that
    is summed over (style 4, regime 2, cap label 1), which tells totals from null labels. One shuffle for all.
    """
    rows = top.join(labels.select("ticker", "cap_label"), "ticker", "left")
    return rows.cube("style", "regime", "cap_label").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("tickers"),
        F.avg("score").alias("mean_score"), F.max("score").alias("best_score"))
