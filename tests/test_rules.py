"""Scores and labels at their thresholds, on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from sigmatide.operators import analyzer as an
from sigmatide.operators import forecast as fc
from sigmatide.operators import market_boards as mb
from sigmatide.operators import portfolio as po
from sigmatide.operators import screener as sc


def screen_row(**kw):
    row = dict(ticker="X", price=10.0, volatility=0.6, regime="Extreme", price_change_5d=0.0,
               price_change_20d=0.2, dollar_volume=0.0)
    return {**row, **kw}


def scores(spark, make, rows, column):
    df = spark.createDataFrame([dict(r, ticker=f"{i:03d}") for i, r in enumerate(rows)])
    return [r[column] for r in make(df).orderBy("ticker").collect()]


def test_daytrade(spark):
    rows = [screen_row(), screen_row(regime="High"), screen_row(regime="Normal"),
            screen_row(regime="Low", volatility=0.40), screen_row(regime="Low", volatility=0.25),
            screen_row(dollar_volume=1e9), screen_row(dollar_volume=1.1e9),
            screen_row(dollar_volume=5e8), screen_row(price_change_5d=-0.06),
            screen_row(price_change_5d=0.05)]
    assert scores(spark, sc.screen_scores, rows, "score_daytrade") == [
        55, 55, 40, 15, 0, 70, 80, 55, 75, 55]


def test_swing_and_direction(spark):
    rows = [screen_row(), screen_row(regime="Normal", volatility=0.3),
            screen_row(regime="Low", volatility=0.20), screen_row(price_change_20d=-0.06),
            screen_row(price_change_20d=0.05), screen_row(dollar_volume=2.1e8)]
    assert scores(spark, sc.screen_scores, rows, "score_swing") == [30, 80, 40, 20, 0, 50]
    got = scores(spark, sc.screen_scores, rows, "swing_direction")
    assert [g.split()[1] for g in got] == [
        "Bullish", "Bullish", "Bullish", "Bearish", "Neutral", "Bullish"]


def test_longterm(spark):
    rows = [screen_row(), screen_row(regime="Low", volatility=0.2, price=101.0),
            screen_row(regime="Normal", volatility=0.25, price=100.0),
            screen_row(price=50.0, price_change_20d=0.09), screen_row(price_change_20d=-0.10)]
    assert scores(spark, sc.screen_scores, rows, "score_longterm") == [0, 85, 45, 15, 0]


def test_top_breaks_ties_by_ticker(spark):
    df = spark.createDataFrame([dict(screen_row(), ticker=f"T{i:02d}") for i in range(60)])
    rows = sc.screen_top(sc.screen_scores(df)).filter("style = 'swing'").orderBy("rank").collect()
    assert [r.ticker for r in rows] == [f"T{i:02d}" for i in range(50)]


def invest_row(**kw):
    row = dict(ticker="X", price=10.0, volatility=0.5, return_1y=0.0, return_6m=-0.1,
               sharpe_approx=0.0, max_drawdown=-0.3, trend_strength=0.0, regime="Low")
    return {**row, **kw}


@pytest.mark.parametrize("column, values, want", [
    ("return_1y", [0.51, 0.50, 0.25, 0.10, -0.10, -0.11], [30, 20, 10, 0, 0, -10]),
    ("return_6m", [0.21, 0.20, 0.10, 0.0], [20, 15, 10, 0]),
    ("sharpe_approx", [1.6, 1.5, 1.0, 0.5], [25, 15, 10, 0]),
    ("max_drawdown", [-0.14, -0.15, -0.25, -0.40, -0.41], [15, 5, 0, 0, -15]),
    ("trend_strength", [0.31, 0.30, 0.15, -0.10, -0.11], [20, 10, 0, 0, -10]),
    ("volatility", [0.15, 0.16, 0.34, 0.35, 0.60, 0.61], [0, 15, 15, 0, 0, -10]),
])
def test_invest_score(spark, column, values, want):
    assert scores(spark, po.invest_score, [invest_row(**{column: v}) for v in values],
                  "score") == want


def test_portfolios_and_allocation(spark):
    rows = [dict(invest_row(return_1y=0.3, volatility=0.2, price=7.0), ticker=f"T{i:02d}")
            for i in range(12)]
    picks = po.portfolio_picks(po.invest_score(spark.createDataFrame(rows)))
    counts = {r["portfolio"]: r["count"] for r in picks.groupBy("portfolio").count().collect()}
    assert counts == {"conservative": 6, "moderate": 8, "aggressive": 10, "ranking": 12}
    out = po.portfolio_allocation(picks, 1000.0).collect()
    for name in ("conservative", "moderate", "aggressive"):
        assert math.isclose(sum(r.weight for r in out if r.portfolio == name), 1.0)
    first = next(r for r in out if r.portfolio == "aggressive" and r["rank"] == 1)
    assert first.ticker == "T00" and first.shares == int(250.0 / 7)
    few = po.portfolio_picks(po.invest_score(spark.createDataFrame(rows[:2])))
    weights = [r.weight for r in po.portfolio_allocation(few, 1.0)
               .filter("portfolio = 'moderate'").orderBy("rank").collect()]
    assert [round(w, 6) for w in weights] == [round(0.20 / 0.38, 6), round(0.18 / 0.38, 6)]


def analysis_row(**kw):
    row = dict(ticker="X", price=10.0, ret_5d=0.0, ret_20d=0.0, rsi=50.0, volume_surge=0.0,
               pct_from_high=-10.0, pct_from_low=50.0, volatility=45.0, revenue_growth=0.0,
               pe_ratio=0.0, profit_margin=0.0, above_ma_20=False, above_ma_50=True)
    return {**row, **kw}


@pytest.mark.parametrize("column, values, want", [
    ("ret_5d", [5.1, 5.0, 2.0, -2.1, -5.0, -5.1], [65, 58, 50, 50, 50, 40]),
    ("ret_20d", [15.1, 15.0, 8.0, -8.0, -8.1, -15.1], [65, 60, 50, 50, 42, 35]),
    ("rsi", [29.9, 30.0, 40.0, 60.1, 70.0, 70.1], [62, 56, 50, 50, 50, 38]),
    ("volume_surge", [50.1, 50.0, -31.0], [58, 50, 50]),
    ("pct_from_high", [-4.9, -5.0, -30.1], [60, 50, 50]),
    ("revenue_growth", [0.21, 0.20, 0.10, -0.11], [60, 55, 50, 50]),
])
def test_buy_score(spark, column, values, want):
    assert scores(spark, an.buy_score, [analysis_row(**{column: v}) for v in values],
                  "score") == want


def test_buy_score_combinations(spark):
    rows = [analysis_row(above_ma_20=True), analysis_row(above_ma_20=True, above_ma_50=False),
            analysis_row(above_ma_50=False), analysis_row(pct_from_high=-31.0, ret_20d=5.1),
            analysis_row(pct_from_low=9.9, ret_5d=0.1),
            analysis_row(ret_5d=9.0, ret_20d=20.0, above_ma_20=True, rsi=20.0, volume_surge=60.0,
                         pct_from_high=0.0, revenue_growth=0.3),
            analysis_row(ret_5d=-9.0, ret_20d=-20.0, above_ma_50=False, rsi=80.0)]
    assert scores(spark, an.buy_score, rows, "score") == [65, 58, 38, 58, 58, 100, 1]


def test_reasons_keep_rule_order_and_limits(spark):
    row = analysis_row(ret_5d=9.04, ret_20d=20.0, above_ma_20=True, rsi=20.5, volume_surge=60.0,
                       pct_from_high=-0.04, volatility=30.0, revenue_growth=0.3, pe_ratio=24.45)
    out = spark.createDataFrame([row]).select(an.buy_reasons().alias("b"),
                                              an.sell_reasons().alias("s")).first()
    assert len(out.b) == 6 and out.s == []
    assert out.b[0].endswith("momentum: +9.0%") and out.b[1].endswith("performance: +20.0%")
    assert "RSI at 20 " in out.b[3] and "+60%" in out.b[4] and "(-0.0%)" in out.b[5]
    row = analysis_row(ret_5d=-6.25, ret_20d=-9.0, above_ma_50=False, rsi=75.0, volume_surge=-40.0)
    out = spark.createDataFrame([row]).select(an.buy_reasons().alias("b"),
                                              an.sell_reasons().alias("s")).first()
    assert out.b == [] and len(out.s) == 4 and out.s[0].endswith("-6.2%")


def test_labels(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([75, 74, 60, 59, 45, 44, 30, 29])],
                               "i int, s int")
    assert [r[0] for r in df.orderBy("i").select(an.signal_label(F.col("s"))).collect()] == [
        "STRONG BUY", "BUY", "BUY", "HOLD", "HOLD", "SELL", "SELL", "STRONG SELL"]
    caps = [(0, 1.5e12), (1, 1e12), (2, 2.25e9), (3, 1e9), (4, 1.5e6), (5, 1e6), (6, 0.0)]
    df = spark.createDataFrame(caps, "i int, c double")
    got = [r[0] for r in df.orderBy("i").select(an.market_cap_label(F.col("c"))).collect()]
    assert got == ["$1.50T", "$1000.0B", "$2.2B", "$1000M", "$2M", "N/A", "N/A"]


def test_price_bands_filter_the_finished_list(spark):
    rows = [(f"T{i:02d}", 50 + i, float(p)) for i, p in enumerate(
        [5, 10, 99.99, 100, 499, 500, 2000] + [50] * 20)]
    df = spark.createDataFrame(rows, "ticker string, score int, price double")
    best = an.buy_list(df)
    assert best.count() == 20
    inside = {b: {r.ticker for r in an.price_band_filter(best, b).collect()} for b in an.PRICE_BANDS}
    assert inside["0-10"] == set() and inside["500-1000"] == set()  # cut by the top 20
    assert len(inside["10-100"]) == 15 and len(inside["all"]) == 15
    small = an.buy_list(df.limit(7))
    inside = {b: {r.ticker for r in an.price_band_filter(small, b).collect()}
              for b in an.PRICE_BANDS}
    assert inside["0-10"] == {"T00"} and inside["10-100"] == {"T01", "T02"}
    assert inside["100-500"] == {"T03", "T04"} and inside["500-1000"] == {"T05", "T06"}


def test_news_categories_are_substrings_and_first_group_wins(spark):
    titles = ["Quarterly revenue up", "Ideal steps", "Second thoughts", "Deal upgrade", "An ideal",
              "ANALYST day", "Weather"]
    df = spark.createDataFrame(list(enumerate(titles)), "i int, title string")
    got = [r.category for r in mb.news_category(df).orderBy("i").collect()]
    assert got == ["earnings", "earnings", "fda", "mergers", "mergers", "upgrades", "general"]


def test_recommendations(spark):
    df = spark.createDataFrame([("Low", 1.0, 1.2), ("Normal", 1.0, 1.05), ("High", 1.0, 0.8),
                                ("Extreme", 1.0, 0.95)], "r string, c double, f double")
    got = {r[0]: r[1] for r in df.select(
        "r", fc.volatility_recommendations(F.col("r"), F.col("c"), F.col("f"))).collect()}
    assert [len(got[k]) for k in ("Low", "Normal", "High", "Extreme")] == [3, 3, 4, 4]
    assert "INCREASE" in got["Low"][-1] and "STABLE" in got["Normal"][-1]
    assert "DECREASE" in got["High"][-1] and "STABLE" in got["Extreme"][-1]
