import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from series import flat_bars, pandas_panel, random_bars, to_spark
from sigmatide.functions.columns import business_day
from sigmatide.operators import estimators as es
from sigmatide.operators import forecast as fc


@pytest.fixture(scope="module")
def frames():
    return [random_bars("A", 300, 1), random_bars("B", 90, 2, vol=0.05), random_bars("C", 22, 3),
            random_bars("D", 21, 4), random_bars("E", 1, 5), flat_bars("F", 40)]


@pytest.fixture(scope="module")
def bars(spark, frames):
    return to_spark(spark, pd.concat(frames))


def as_pandas(df):
    rows = df.orderBy("ticker", "dt").collect()
    return pd.DataFrame([r.asDict() for r in rows], columns=df.columns)


def test_estimators_match_pandas_with_the_same_gaps(bars, frames):
    got = as_pandas(es.volatility_frame(bars).select("ticker", "dt", *es.PANEL))
    want = pd.concat([pandas_panel(f) for f in frames]).reset_index(drop=True)
    for name in es.PANEL:
        g = got[name].astype(float).to_numpy()
        w = want[name].to_numpy()
        assert (np.isnan(g) == np.isnan(w)).all(), name
        np.testing.assert_allclose(g, w, rtol=1e-9, atol=1e-12, err_msg=name)


def test_panel_loses_the_first_rows_only(bars):
    counts = {r["ticker"]: r["count"] for r in es.vol_panel(bars).groupBy("ticker").count().collect()}
    assert counts == {"A": 279, "B": 69, "C": 1, "F": 19}


def test_ewma_over_several_blocks_equals_one_block(spark):
    one = random_bars("L", 1500, 7)
    df = to_spark(spark, one)
    got = as_pandas(es.with_ewma(es.with_returns(df), block_rows=420).select("ticker", "dt", "ewma"))
    want = one.close.pct_change().ewm(span=21).std() * np.sqrt(252)
    np.testing.assert_allclose(got["ewma"].astype(float)[2:], want[2:], rtol=1e-10)


def test_ewma_survives_a_series_longer_than_a_block(spark):
    one = random_bars("L", 13_000, 8, start="1975-01-06")
    got = as_pandas(es.with_ewma(es.with_returns(to_spark(spark, one))).select("ticker", "dt", "ewma"))
    want = one.close.pct_change().ewm(span=21).std() * np.sqrt(252)
    np.testing.assert_allclose(got["ewma"].astype(float)[2:], want[2:], rtol=1e-9)


def test_span_must_exceed_one(bars):
    with pytest.raises(ValueError):
        es.with_ewma(es.with_returns(bars), span=1)


def test_summary_and_regime(bars, frames):
    panel = pandas_panel(frames[0]).dropna()
    row = es.vol_summary(bars).filter("ticker = 'A' and metric = 'yang_zhang'").first()
    last = panel.yang_zhang.iloc[-1]
    share = (panel.yang_zhang < last).sum() / len(panel) * 100
    assert row.data_points == len(panel)
    np.testing.assert_allclose(
        [row.current_price, row.current, row.average, row["min"], row["max"], row.percentile],
        [panel.close.iloc[-1], last, panel.yang_zhang.mean(), panel.yang_zhang.min(),
         panel.yang_zhang.max(), share], rtol=1e-9)
    regime = es.vol_regime(bars).filter("ticker = 'A'").first()
    assert abs(regime.percentile - share) < 1e-9 and 0 <= regime.percentile < 100


def test_a_constant_price_has_no_volatility(bars):
    row = es.vol_panel(bars).filter("ticker = 'F'").orderBy(F.desc("dt")).first()
    assert [row[m] for m in es.METRICS] == [0.0] * 6


def test_estimators_ignore_the_price_level(bars):
    scaled = bars.select("ticker", "dt", *[(F.col(c) * 7.0).alias(c)
                                           for c in ("open", "high", "low", "close")], "volume")
    a, b = as_pandas(es.vol_panel(bars)), as_pandas(es.vol_panel(scaled))
    for m in es.METRICS:
        np.testing.assert_allclose(a[m], b[m], rtol=1e-7, atol=1e-9)


def test_regime_and_interpretation_limits(spark):
    df = spark.createDataFrame([(x,) for x in (24.9, 25.0, 74.9, 75.0, 89.9, 90.0)], "p double")
    got = [r[0] for r in df.select(es.regime_label(F.col("p"))).collect()]
    assert got == ["Low", "Normal", "Normal", "High", "High", "Extreme"]
    df = spark.createDataFrame([(x,) for x in (0.149, 0.15, 0.25, 0.40, 0.599, 0.60)], "v double")
    got = [r[0].split(" - ")[0] for r in df.select(es.vol_interpretation(F.col("v"))).collect()]
    assert got == ["Very Low", "Low", "Moderate", "High", "High", "Very High"]


def test_business_days_follow_the_calendar(spark):
    starts = pd.date_range("2024-02-20", periods=14)
    df = spark.createDataFrame([(d.date(), n) for d in starts for n in range(1, 40)],
                               "dt date, step int")
    for r in df.withColumn("day", business_day(F.col("dt"), F.col("step"))).collect():
        want = pd.bdate_range(pd.Timestamp(r.dt) + pd.Timedelta(days=1), periods=r.step)[-1]
        assert r.day == want.date()


def test_mean_reversion_equals_the_loop(bars, frames):
    vol = (frames[0].close.pct_change().ewm(span=21).std() * np.sqrt(252))
    v, m = vol.iloc[-1], vol.mean()
    want = []
    for _ in range(30):
        v = v + 0.03 * (m - v)
        want.append(v)
    got = (fc.forecast_mean_reversion(bars).filter("ticker = 'A'").orderBy("step").collect())
    np.testing.assert_allclose([r.volatility for r in got], want, rtol=1e-10)
    conf = fc.forecast_confidence(bars).filter("ticker = 'A'").first().confidence
    assert abs(conf - max(0.3, 1 - vol.tail(21).std() / vol.iloc[-1])) < 1e-10


def test_confidence_of_a_constant_price_is_the_minimum(bars):
    assert fc.forecast_confidence(bars).filter("ticker = 'F'").first().confidence == 0.3


def test_histogram_counts_every_row(bars):
    rows = fc.vol_histogram(bars).filter("ticker = 'A'").collect()
    assert sum(r.frequency for r in rows) == 279
    assert max(r.bin for r in rows) == 50 and min(r.bin for r in rows) == 1
    assert [(r.bin, r.frequency) for r in fc.vol_histogram(bars).filter("ticker = 'F'").collect()] \
        == [(1, 19)]


def test_equal_and_nearly_equal_values_are_counted_strictly_unless_told(spark):
    rows = [("A", 1.0, True, 1.0), ("A", 1.0 - 1e-13, True, 1.0), ("A", 0.5, True, 1.0), ("A", 0.1, False, 1.0)]
    df = spark.createDataFrame(rows, "ticker string, yang_zhang double, in_panel boolean, last_yang_zhang double")
    strict, rounded = df.agg(es.panel_percentile().alias("a"), es.panel_percentile(1e-12).alias("b")).first()
    assert abs(strict - 200 / 3) < 1e-9 and abs(rounded - 100 / 3) < 1e-9
