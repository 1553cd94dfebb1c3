"""Returns, the six annualised volatility estimators, and what is read off them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmatide.functions.columns import (
    ANNUAL,
    TRADING_DAYS,
    by_block,
    by_time,
    first_match,
    ratio_change,
    root,
)
from sigmatide.operators.time_joins import row_blocks

METRICS = ["historical", "parkinson", "garman_klass", "rogers_satchell", "yang_zhang", "ewma"]
PANEL = ["close", "returns", *METRICS]


def with_returns(bars: DataFrame) -> DataFrame:
    """Bars with ``rn`` (1 = first bar), ``prev_close``, ``returns`` and ``log_returns``."""
    close, before = F.col("close"), F.col("prev_close")
    return (
        bars.withColumns({
            "rn": F.row_number().over(by_time()),
            "prev_close": F.lag("close").over(by_time()),
        })
        .withColumns({
            "returns": ratio_change(close, before),
            "log_returns": F.ln(close / before),
        })
    )


def _decay(span: int) -> float:
    if span <= 1:
        raise ValueError("span must exceed 1")
    return 1 - 2 / (span + 1)


def _power(base: float, exponent: Column) -> Column:
    return F.pow(F.lit(base), exponent)


def with_ewma(returns: DataFrame, span: int = 21, block_rows: int | None = None) -> DataFrame:
    """Add ``ewma``: bias-corrected exponentially weighted deviation of ``returns``.

    With q = 1 - 2/(span + 1) the weighted sums are running sums of r * q^-k. To keep q^-k
    in range, a long series is cut into blocks of ``block_rows``; a row takes its own block's
    sum plus the decayed sum at the end of the block before. Older blocks weigh q^block_rows,
    1e-250 by default, and cannot change a double.

    Also adds ``block``: later windows ordered by (block, dt) reuse the sort made here.
    """
    q = _decay(span)
    if block_rows is None:
        block_rows = max(1, int(250 * math.log(10) / -math.log(q)))
    i = F.col("rn") - 2  # number of the return, from 0
    k, r = F.col("_k"), F.col("returns")
    in_block = (Window.partitionBy("ticker", "block").orderBy("dt")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = by_block().rowsBetween(Window.unboundedPreceding, -1)

    def block_end(name: str) -> Column:
        value = F.when(k == block_rows - 1, F.col(name))
        return F.coalesce(F.last(value, ignorenulls=True).over(before), F.lit(0.0))

    df = returns.withColumns({
        "block": F.floor(i / block_rows),
        "_k": F.pmod(i, F.lit(block_rows)).cast("double"),
        "_q_i": _power(q, (i + 1).cast("double")),
    })
    df = df.withColumns({
        "_s1": _power(q, k) * F.sum(r * _power(q, -k)).over(in_block),
        "_s2": _power(q, k) * F.sum(r * r * _power(q, -k)).over(in_block),
        "_s0": (1 - F.col("_q_i")) / (1 - q),
        "_q0": (1 - F.col("_q_i") * F.col("_q_i")) / (1 - q * q),
    })
    df = df.withColumns({
        "_mean": (F.col("_s1") + _power(q, k + 1) * block_end("_s1")) / F.col("_s0"),
        "_square": (F.col("_s2") + _power(q, k + 1) * block_end("_s2")) / F.col("_s0"),
    })
    s0, mean = F.col("_s0"), F.col("_mean")
    variance = F.greatest(F.col("_square") - mean * mean, F.lit(0.0)) * F.try_divide(
        s0 * s0, s0 * s0 - F.col("_q0"))
    return (
        df.withColumn("ewma", F.when(i >= 1, F.sqrt(variance)) * ANNUAL)
        .drop("_k", "_q_i", "_s0", "_q0", "_s1", "_s2", "_mean", "_square")
    )


def _price_terms() -> dict[str, Column]:
    """Per-bar terms whose trailing mean or variance makes up the estimators."""
    def log(a: str, b: str) -> Column:
        return F.ln(F.col(a) / F.col(b))

    return {
        "_range": log("high", "low"),
        "_intraday": log("close", "open"),
        "_overnight": log("open", "prev_close"),
        "_drift": log("high", "close") * log("high", "open")
        + log("low", "close") * log("low", "open"),
    }


def _moments(window: int) -> dict[str, Column]:
    frame = by_block().rowsBetween(-(window - 1), Window.currentRow)
    span, intraday = F.col("_range"), F.col("_intraday")
    return {
        "_sd_returns": F.stddev_samp("returns").over(frame),
        "_mean_range": F.avg(span * span).over(frame),
        "_mean_gk": F.avg(0.5 * (span * span)
                          - (2 * math.log(2) - 1) * (intraday * intraday)).over(frame),
        "_mean_drift": F.avg("_drift").over(frame),
        "_var_overnight": F.var_samp("_overnight").over(frame),
        "_var_intraday": F.var_samp(intraday).over(frame),
    }


def _estimators(window: int) -> dict[str, Column]:
    """Annualised volatilities, NULL unless ``window`` values are there.

    Valid bars lack only the first return, so the row number tells whether a window is full.
    """
    k = 0.34 / (1.34 + (window + 1) / (window - 1))
    bars_full, returns_full = F.col("rn") >= window, F.col("rn") > window
    combined = (F.col("_var_overnight") + k * F.col("_var_intraday")
                + (1 - k) * F.col("_mean_drift"))
    return {
        # Close-to-close.
        "historical": F.when(returns_full, F.col("_sd_returns") * ANNUAL),
        # High-low range.
        "parkinson": F.when(
            bars_full, root(F.col("_mean_range") * (TRADING_DAYS / (4 * math.log(2))))),
        # Range and open-to-close; no overnight term.
        "garman_klass": F.when(bars_full, root(F.col("_mean_gk") * TRADING_DAYS)),
        # Range allowing for drift.
        "rogers_satchell": F.when(bars_full, root(F.col("_mean_drift") * TRADING_DAYS)),
        # Overnight, open-to-close and range variance combined.
        "yang_zhang": F.when(returns_full, root(combined * TRADING_DAYS)),
    }


def volatility_frame(bars: DataFrame, window: int = 21, span: int | None = None) -> DataFrame:
    """Every valid bar with returns and estimators; NULL where a window is not full.

    ``in_panel`` marks the rows where all of them exist. ``panel_age`` ranks those from the
    last (1), ``n_panel`` is their number, ``bar_age`` ranks all bars from the last, and
    ``last_yang_zhang`` is the latest panel value. One shuffle by ticker and two sorts;
    columns that a caller does not select are not computed.
    """
    df = with_ewma(with_returns(bars), span=window if span is None else span)
    df = df.withColumns(_price_terms()).withColumns(_moments(window))
    df = df.withColumns(_estimators(window))
    df = df.withColumn("in_panel", F.expr(" and ".join(f"{c} is not null" for c in PANEL)))

    hit = F.when(F.col("in_panel"), F.lit(1))
    everything = by_block().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = by_block().rowsBetween(Window.currentRow, Window.unboundedFollowing)
    df = df.withColumns({
        "panel_age": F.when(F.col("in_panel"), F.count(hit).over(rest)),
        "n_panel": F.count(hit).over(everything),
        "bar_age": F.count(F.lit(1)).over(everything) - F.col("rn") + 1,
        "last_yang_zhang": F.last(F.when(F.col("in_panel"), F.col("yang_zhang")),
                                  ignorenulls=True).over(everything),
    })
    return df.drop(*_price_terms(), *_moments(window))


def estimator(bars: DataFrame, name: str, window: int = 21) -> DataFrame:
    """One estimator for every bar (ticker, dt, value), NULL during warm-up."""
    return volatility_frame(bars, window).select("ticker", "dt", name)


def vol_panel(bars: DataFrame, window: int = 21) -> DataFrame:
    """Close, returns and the six estimators on the rows where all of them exist."""
    return volatility_frame(bars, window).filter("in_panel").select("ticker", "dt", *PANEL)


def panel_percentile(noise: float = 0.0) -> Column:
    """Aggregate over a volatility_frame: percentage of the panel's Yang-Zhang values that
    are below the last one by more than ``noise``."""
    panel = F.col("in_panel")
    below = panel & (F.col("yang_zhang") < F.col("last_yang_zhang") - noise)
    return F.try_divide(F.count_if(below), F.count_if(panel)) * 100


def regime_label(percentile: Column) -> Column:
    return first_match((percentile < 25, "Low"), (percentile < 75, "Normal"),
                       (percentile < 90, "High"), otherwise="Extreme")


def vol_summary(bars: DataFrame, window: int = 21, noise: float = 0.0) -> DataFrame:
    """Current, average, extremes and percentile of each estimator, one row per metric.

    Aggregated wide and turned to rows afterwards, so the panel is not multiplied.
    """
    everything = by_block().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    panel = volatility_frame(bars, window).filter("in_panel")
    panel = panel.withColumns({f"last_{m}": F.last(m).over(everything) for m in METRICS})
    wide = panel.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("data_points"),
        F.max_by("close", "dt").alias("current_price"),
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.max(f"last_{m}").alias("current"),
                F.avg(m).alias("average"),
                F.min(m).alias("min"),
                F.max(m).alias("max"),
                (F.count_if(F.col(m) < F.col(f"last_{m}") - noise) / F.count(F.lit(1)) * 100)
                .alias("percentile"),
            ).alias(m)
            for m in METRICS
        ],
    )
    return wide.select("ticker", "data_points", "current_price", F.inline(F.array(*METRICS)))


def vol_regime(bars: DataFrame, window: int = 21, noise: float = 0.0) -> DataFrame:
    """Percentile of the last Yang-Zhang value within the panel, and its regime."""
    return (
        volatility_frame(bars, window).groupBy("ticker").agg(
            F.max("last_yang_zhang").alias("current"),
            panel_percentile(noise).alias("percentile"),
        )
        .filter("current is not null")
        .withColumn("regime", regime_label(F.col("percentile")))
    )


# Upper bound of annual volatility and its description.
INTERPRETATIONS = [
    (0.15, "Very Low - Stock is quite stable, lower risk but potentially lower returns"),
    (0.25, "Low - Relatively stable stock, moderate risk profile"),
    (0.40, "Moderate - Average volatility, balanced risk/reward"),
    (0.60, "High - Significant price swings expected, higher risk"),
]
INTERPRETATION_ABOVE = "Very High - Extreme volatility, very high risk, speculative"


def vol_interpretation(volatility: Column) -> Column:
    """Description of an annualised volatility."""
    return first_match(*[(volatility < limit, text) for limit, text in INTERPRETATIONS],
                       otherwise=INTERPRETATION_ABOVE)


def regime_days(bars: DataFrame, window: int = 21) -> DataFrame:
    """(ticker, dt, regime) of every panel day: the regime of its Yang-Zhang value among all of its ticker's."""
    panel = volatility_frame(bars, window).filter("in_panel").select(
        "ticker", "dt", F.round("yang_zhang", 9).alias("yang_zhang"))
    below = F.rank().over(Window.partitionBy("ticker").orderBy("yang_zhang")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    return panel.select("ticker", "dt", regime_label(below / n * 100).alias("regime"))


def intraday_volatility(bars: DataFrame, window: int = 21, periods: float = TRADING_DAYS, size: int = 4096) -> DataFrame:
    """The five windowed estimators of bars of any width; ``periods`` is the number of bars in a year.

    Bars of a day are bounded by the calendar, those of a minute or a tick are not: a ticker is cut into blocks of
    ``size`` bars, each with the ``window`` bars before it, and a block is what a task holds.
    """
    blocks = row_blocks(bars, "ticker", "dt", max(size, window), window)
    keyed = blocks.withColumn("ticker", F.struct("ticker", "block")).drop("block", "row")
    scale = math.sqrt(periods / TRADING_DAYS)
    return volatility_frame(keyed, window).filter(~F.col("in_halo")).select(
        F.col("ticker.ticker").alias("ticker"), "dt", *((F.col(m) * scale).alias(m) for m in METRICS if m != "ewma"))
