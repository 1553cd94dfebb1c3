"""Forecast steps, mean reversion, signals, cones and the data behind the charts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmatide.functions.columns import TRADING_DAYS, by_block, business_day, first_match, whole
from sigmatide.operators.estimators import (
    panel_percentile,
    regime_label,
    volatility_frame,
    with_ewma,
    with_returns,
)
from sigmatide.session import partitions_of

REVERSION_SPEED = 0.03
MIN_CONFIDENCE = 0.3
RANGE_DAYS = 30
RECENT = 21


def business_days(last: DataFrame, days: int = 30) -> DataFrame:
    """One row per future business day after ``dt``: adds ``step`` 1..days and its date."""
    return (
        last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(days))))
        .withColumn("dt", business_day(F.col("dt"), F.col("step")))
    )


def last_bar_dates(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.max("dt").alias("dt"))


def _ewma_state(bars: DataFrame, span: int, recent: int) -> DataFrame:
    """Per ticker: last date, last / mean EWMA volatility and the spread of the latest ones."""
    frame = with_ewma(with_returns(bars), span=span)
    frame = frame.withColumn("age", F.count(F.lit(1)).over(whole()) - F.col("rn") + 1)
    return frame.groupBy("ticker").agg(
        F.max("dt").alias("dt"),
        F.max_by("ewma", "dt").alias("ewma_last"),
        F.avg("ewma").alias("ewma_mean"),
        F.stddev_samp(F.when(F.col("age") <= recent, F.col("ewma"))).alias("ewma_spread"),
    ).filter("ewma_last is not null")


def reverted(last: Column, mean: Column, step: Column) -> Column:
    """v <- v + speed * (mean - v), applied ``step`` times."""
    return mean + (last - mean) * F.pow(F.lit(1 - REVERSION_SPEED), step.cast("double"))


def confidence(spread: Column, last: Column) -> Column:
    """1 - spread/last, at least MIN_CONFIDENCE; an undefined ratio gives the minimum."""
    return F.greatest(F.lit(MIN_CONFIDENCE),
                      F.coalesce(1 - F.try_divide(spread, last), F.lit(MIN_CONFIDENCE)))


def forecast_mean_reversion(bars: DataFrame, days: int = 30, span: int = 21) -> DataFrame:
    """Volatility of each future business day, reverting to the ticker's mean EWMA."""
    return business_days(_ewma_state(bars, span, 21), days).select(
        "ticker", "step", "dt",
        reverted(F.col("ewma_last"), F.col("ewma_mean"), F.col("step")).alias("volatility"),
    )


def forecast_confidence(bars: DataFrame, span: int = 21, recent: int = 21) -> DataFrame:
    """Confidence of the mean-reversion forecast from the spread of the latest EWMA values."""
    return _ewma_state(bars, span, recent).select(
        "ticker", confidence(F.col("ewma_spread"), F.col("ewma_last")).alias("confidence"))


def spread_tickers(bars: DataFrame) -> DataFrame:
    """Partition bars by ticker into a fixed number of partitions.

    The later windows and aggregates reuse this shuffle. It is not coalesced at run time:
    few rows per ticker may stand for much work, such as a model fit.
    """
    return bars.repartition(partitions_of(bars.sparkSession), "ticker")


def ticker_state(bars: DataFrame, window: int = 21) -> DataFrame:
    """Everything the bundle and the signals need per ticker, from one pass over the panel.

    Price, last Yang-Zhang, its percentile and regime, EWMA state, and the ordered returns
    (in percent) for the variance model. The list holds at most one value per calendar day.
    """
    frame = volatility_frame(spread_tickers(bars), window, span=21)
    state = frame.groupBy("ticker").agg(
        F.max("dt").alias("dt"),
        F.count_if("in_panel").alias("data_points"),
        F.max(F.when(F.col("panel_age") == 1, F.col("close"))).alias("current_price"),
        F.max("last_yang_zhang").alias("current_volatility"),
        panel_percentile().alias("percentile"),
        F.max_by("ewma", "dt").alias("ewma_last"),
        F.avg("ewma").alias("ewma_mean"),
        F.stddev_samp(F.when(F.col("bar_age") <= RECENT, F.col("ewma"))).alias("ewma_spread"),
        *return_aggregates(),
    )
    return state.filter("data_points > 0").withColumns({
        "regime": regime_label(F.col("percentile")),
        "confidence": confidence(F.col("ewma_spread"), F.col("ewma_last")),
    })


def _return_list() -> Column:
    day = F.when(F.col("returns").isNotNull(), F.struct("dt", (F.col("returns") * 100).alias("r")))
    return F.array_sort(F.collect_list(day))


def return_aggregates() -> list[Column]:
    """Aggregates: a ticker's returns in percent, oldest first (NULLs left out), with their
    number, mean and range."""
    pct = F.col("returns") * 100
    return [
        F.transform(_return_list(), lambda x: x["r"]).alias("pct_returns"),
        F.count("returns").alias("n_obs"),
        F.avg(pct).alias("mu"),
        (F.max(pct) - F.min(pct)).alias("return_range"),
    ]


def ordered_days() -> Column:
    """Aggregate: the days of the returns in return_aggregates()."""
    return F.transform(_return_list(), lambda x: x["dt"]).alias("return_days")


def predict_bundle(fitted: DataFrame, days: int = 30) -> DataFrame:
    """Per ticker and step: price, volatility, regime, both forecasts, the confidence and the
    variance model's fit (number of returns, parameters, log-likelihood, AIC, BIC).

    ``fitted`` is ticker_state with a variance model's columns (see operators.garch).
    """
    from sigmatide.operators.garch import step_variance, variance_volatility

    variance = step_variance(F.col("step"))
    return business_days(fitted, days).select(
        "ticker", "step", "dt", "current_price", "current_volatility", "regime",
        variance_volatility(variance).alias("garch_volatility"),
        reverted(F.col("ewma_last"), F.col("ewma_mean"), F.col("step")).alias("simple_volatility"),
        "confidence", "n_obs", "mu", "omega", "alpha", "beta", "log_likelihood", "aic", "bic",
    )


def trading_signals(bundle: DataFrame) -> DataFrame:
    """Expected daily and 30-day price ranges with recommendations, one row per ticker.

    The 30-day range uses 30 days whatever horizon was forecast. No floor at zero.
    """
    # Values that are the same on all steps are keys, which keeps this a hash aggregate.
    signals = bundle.groupBy(
        "ticker", "current_price", "current_volatility",
        F.col("regime").alias("volatility_regime"),
    ).agg(F.avg("garch_volatility").alias("forecast_volatility"))
    price, vol = F.col("current_price"), F.col("current_volatility")
    daily = vol / math.sqrt(TRADING_DAYS)
    month = F.col("forecast_volatility") * math.sqrt(RANGE_DAYS / TRADING_DAYS)
    return signals.withColumns({
        "daily_low": price * (1 - daily),
        "daily_high": price * (1 + daily),
        "d30_low": price * (1 - month),
        "d30_high": price * (1 + month),
        "recommendations": volatility_recommendations(
            F.col("volatility_regime"), vol, F.col("forecast_volatility")),
    })


# Recommendation texts per regime and per forecast trend.
REGIME_TEXTS = {
    "Low": ["📉 Low volatility environment - consider selling options (premium is cheap)",
            "💡 Good time for buy-and-hold strategies"],
    "Normal": ["📊 Normal volatility - balanced approach recommended",
               "💡 Standard position sizing appropriate"],
    "High": ["📈 High volatility - reduce position sizes",
             "💡 Consider buying protective puts",
             "⚠️ Wider stop-losses may be needed"],
    "Extreme": ["🔴 EXTREME volatility - highest caution required",
                "💡 Consider hedging or reducing exposure",
                "⚠️ Avoid leverage and speculative positions"],
}
TREND_UP = "⬆️ Volatility expected to INCREASE - consider buying options"
TREND_DOWN = "⬇️ Volatility expected to DECREASE - consider selling options"
TREND_FLAT = "➡️ Volatility expected to remain STABLE"


def volatility_recommendations(regime: Column, current: Column, forecast: Column) -> Column:
    """Array of the regime's texts followed by the trend text."""
    def texts(name: str) -> Column:
        return F.array(*[F.lit(t) for t in REGIME_TEXTS[name]])

    by_regime = first_match(*[(regime == name, texts(name)) for name in ("Low", "Normal", "High")],
                            otherwise=texts("Extreme"))
    trend = first_match((forecast > current * 1.1, TREND_UP), (forecast < current * 0.9, TREND_DOWN),
                        otherwise=TREND_FLAT)
    return F.concat(by_regime, F.array(trend))


def price_cone(forecast: DataFrame) -> DataFrame:
    """Price bands of 1 and 2 accumulated deviations round a flat expected price.

    ``forecast``: ticker, step, dt, current_price, volatility.
    """
    so_far = (Window.partitionBy("ticker").orderBy("step")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    daily = F.col("volatility") * F.col("volatility") / TRADING_DAYS
    price, cum = F.col("current_price"), F.col("cum_volatility")
    return (
        forecast.withColumn("cum_volatility", F.sqrt(F.sum(daily).over(so_far)))
        .select(
            "ticker", "step", "dt", "cum_volatility",
            price.alias("expected_price"),
            (price * (1 - cum)).alias("lower_1sd"), (price * (1 + cum)).alias("upper_1sd"),
            (price * (1 - 2 * cum)).alias("lower_2sd"), (price * (1 + 2 * cum)).alias("upper_2sd"),
        )
    )


def vol_histogram(bars: DataFrame, bins: int = 50, window: int = 21) -> DataFrame:
    """Counts of the Yang-Zhang values in ``bins`` equal-width bins per ticker."""
    everything = by_block().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    panel = volatility_frame(bars, window).filter("in_panel").withColumns({
        "lowest": F.min("yang_zhang").over(everything),
        "highest": F.max("yang_zhang").over(everything),
    })
    lowest, highest = F.col("lowest"), F.col("highest")
    place = F.floor((F.col("yang_zhang") - lowest) / (highest - lowest) * bins) + 1
    bin_no = F.when(highest > lowest, F.least(place, F.lit(bins))).otherwise(1)
    width = (highest - lowest) / bins
    return (
        panel.withColumn("bin", bin_no)
        .groupBy("ticker", "bin")
        .agg(
            F.first(lowest + width * (F.col("bin") - 1)).alias("bin_low"),
            F.first(lowest + width * F.col("bin")).alias("bin_high"),
            F.count(F.lit(1)).alias("frequency"),
            F.first("last_yang_zhang").alias("current"),
        )
    )


def recent_tail(bars: DataFrame, rows: int = 60, window: int = 21) -> DataFrame:
    """Close and Yang-Zhang of the last ``rows`` panel rows."""
    return (
        volatility_frame(bars, window)
        .filter(F.col("panel_age") <= rows)
        .select("ticker", "dt", F.col("panel_age").alias("age"), "close", "yang_zhang")
    )
