"""Investment metrics, scoring, model portfolios and their allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmatide.functions.columns import TRADING_DAYS, by_block, points, ratio_change
from sigmatide.operators.estimators import panel_percentile, regime_label, volatility_frame
from sigmatide.sources.bars import min_history
from sigmatide.sources.dimensions import PORTFOLIO_WEIGHTS, PORTFOLIOS

MIN_BARS = 252
HALF_YEAR = 126
TREND_ROWS = 60
RANKING_ROWS = 20
PICKS = {name: picks for name, _, _, _, _, picks, _ in PORTFOLIOS}


def _frame(bars: DataFrame) -> DataFrame:
    return volatility_frame(min_history(bars, MIN_BARS))


def _drawdown_column(frame: DataFrame) -> DataFrame:
    """Add ``drawdown`` from the running maximum of the last 252 panel rows."""
    in_year = F.when(F.col("panel_age") <= TRADING_DAYS, F.col("close"))
    peak = F.max(in_year).over(
        by_block().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return frame.withColumn("peak", peak).withColumn(
        "drawdown", (in_year - F.col("peak")) / F.col("peak"))


def _trend_slope() -> Column:
    """Aggregate: least-squares slope of the last 60 closes per row."""
    recent = F.col("panel_age") <= TREND_ROWS
    return F.regr_slope(F.when(recent, F.col("close")), F.when(recent, -F.col("panel_age").cast("double")))


def invest_metrics(bars: DataFrame) -> DataFrame:
    """One- and half-year returns, return per risk, drawdown, trend and regime per ticker.

    A return starts at the 252nd / 126th panel row from the end, or at the first row of a
    shorter panel. All of it is one aggregation after one shuffle by ticker.
    """
    frame = _drawdown_column(_frame(bars))

    def close_at(age: int) -> Column:
        return F.max(F.when(F.col("panel_age") == F.least(F.lit(age), F.col("n_panel")), F.col("close")))

    per_ticker = frame.groupBy("ticker").agg(
        close_at(1).alias("price"),
        F.max("last_yang_zhang").alias("volatility"),
        close_at(TRADING_DAYS).alias("close_1y"),
        close_at(HALF_YEAR).alias("close_6m"),
        F.min("drawdown").alias("max_drawdown"),
        _trend_slope().alias("slope"),
        panel_percentile().alias("percentile"),
    ).filter("price is not null")
    price, vol, year = F.col("price"), F.col("volatility"), F.col("return_1y")
    return (
        per_ticker.withColumns({
            "return_1y": ratio_change(price, F.col("close_1y")),
            "return_6m": ratio_change(price, F.col("close_6m")),
            "trend_strength": F.col("slope") / price * TRADING_DAYS,
            "regime": regime_label(F.col("percentile")),
        })
        .withColumn("sharpe_approx", F.when(vol > 0, year / vol).otherwise(0.0))
        .select("ticker", "price", "volatility", "return_1y", "return_6m", "sharpe_approx",
                "max_drawdown", "trend_strength", "regime")
    )


def max_drawdown(bars: DataFrame) -> DataFrame:
    """Deepest fall from the running maximum within the last 252 panel rows."""
    return (_drawdown_column(_frame(bars)).groupBy("ticker")
            .agg(F.min("drawdown").alias("max_drawdown")))


def trend_strength(bars: DataFrame) -> DataFrame:
    """Slope of the last 60 closes, relative to the price and per year."""
    return (
        _frame(bars).groupBy("ticker")
        .agg(_trend_slope().alias("slope"),
             F.max(F.when(F.col("panel_age") == 1, F.col("close"))).alias("price"))
        .select("ticker", (F.col("slope") / F.col("price") * TRADING_DAYS).alias("trend_strength"))
    )


# The thresholds and points of the score.
def invest_score(metrics: DataFrame) -> DataFrame:
    """Add ``score``: points for return, momentum, risk, drawdown, trend and volatility."""
    year, half, sharpe = F.col("return_1y"), F.col("return_6m"), F.col("sharpe_approx")
    drop, trend, vol = F.col("max_drawdown"), F.col("trend_strength"), F.col("volatility")
    return metrics.withColumn(
        "score",
        points((year > 0.50, 30), (year > 0.25, 20), (year > 0.10, 10), (year < -0.10, -10))
        + points((half > 0.20, 20), (half > 0.10, 15), (half > 0, 10))
        + points((sharpe > 1.5, 25), (sharpe > 1.0, 15), (sharpe > 0.5, 10))
        + points((drop > -0.15, 15), (drop > -0.25, 5), (drop < -0.40, -15))
        + points((trend > 0.30, 20), (trend > 0.15, 10), (trend < -0.10, -10))
        + points(((vol > 0.15) & (vol < 0.35), 15), (vol > 0.60, -10)),
    )


def portfolio_picks(scored: DataFrame) -> DataFrame:
    """Picks of the three portfolios and the overall ranking (``portfolio`` = 'ranking').

    A ticker is copied to each portfolio it qualifies for; the rank filter is applied as a
    group limit before the shuffle. Ties go by ticker.
    """
    year, trend, vol, score = (F.col(c) for c in ("return_1y", "trend_strength", "volatility",
                                                  "score"))
    groups = F.array_compact(F.array(
        F.when((vol < 0.35) & (year > 0), F.lit("conservative")),
        F.when(score > 20, F.lit("moderate")),
        F.when((year > 0.20) | (trend > 0.20), F.lit("aggressive")),
        F.lit("ranking"),
    ))
    size = F.element_at(
        F.create_map(*[F.lit(x) for pair in {**PICKS, "ranking": RANKING_ROWS}.items()
                       for x in pair]), F.col("portfolio"))
    best = Window.partitionBy("portfolio").orderBy(F.desc("score"), "ticker")
    return (
        scored.withColumn("portfolio", F.explode(groups))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= RANKING_ROWS)
        .filter(F.col("rank") <= size)
    )


def portfolio_allocation(picks: DataFrame, investment: float) -> DataFrame:
    """Weight, dollars and whole shares of each pick; weights are renormalised over the picks."""
    listed = F.coalesce(*[
        F.when(F.col("portfolio") == name,
               F.get(F.array(*[F.lit(w) for w in weights]), F.col("rank") - 1))
        for name, weights in PORTFOLIO_WEIGHTS.items()
    ])
    group = Window.partitionBy("portfolio")  # at most ten picks each
    return (
        picks.filter(F.col("portfolio").isin(*PICKS))
        .withColumn("raw", F.coalesce(listed, 1 / F.count(F.lit(1)).over(group)))
        .withColumn("weight", F.col("raw") / F.sum("raw").over(group))
        .withColumn("dollars", F.lit(float(investment)) * F.col("weight"))
        .select(
            "portfolio", "rank", "ticker", "price", "weight", "dollars",
            (F.col("dollars") / F.col("price")).cast("bigint").alias("shares"),
            "return_1y", "volatility", "score",
        )
    )
