"""Literal bars and independent pandas versions of the formulas."""

import numpy as np
import pandas as pd

A = np.sqrt(252)


def random_bars(ticker, rows, seed, start="2015-01-05", vol=0.02):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, vol, rows)))
    open_ = close * np.exp(rng.normal(0, vol / 2, rows))
    high = np.maximum(open_, close) * np.exp(np.abs(rng.normal(0, vol / 3, rows)))
    low = np.minimum(open_, close) * np.exp(-np.abs(rng.normal(0, vol / 3, rows)))
    return pd.DataFrame({
        "ticker": ticker, "dt": pd.bdate_range(start, periods=rows).date,
        "open": open_, "high": high, "low": low, "close": close,
        "volume": rng.integers(1, 1000, rows) * 1e3,
    })


def flat_bars(ticker, rows, price=10.0, start="2015-01-05"):
    return pd.DataFrame({
        "ticker": ticker, "dt": pd.bdate_range(start, periods=rows).date,
        "open": price, "high": price, "low": price, "close": price, "volume": 1e3,
    })


def to_spark(spark, frame):
    return spark.createDataFrame(
        frame, "ticker string, dt date, open double, high double, low double, close double, "
               "volume double")


def pandas_panel(bars, n=21):
    """The panel of one ticker, before incomplete rows are dropped."""
    b = bars.sort_values("dt").reset_index(drop=True)
    log = np.log
    r = b.close.pct_change()
    rs = log(b.high / b.close) * log(b.high / b.open) + log(b.low / b.close) * log(b.low / b.open)
    gk = 0.5 * log(b.high / b.low) ** 2 - (2 * log(2) - 1) * log(b.close / b.open) ** 2
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    yz = (log(b.open / b.close.shift()).rolling(n).var()
          + k * log(b.close / b.open).rolling(n).var() + (1 - k) * rs.rolling(n).mean())
    return pd.DataFrame({
        "ticker": b.ticker, "dt": b.dt, "close": b.close, "returns": r,
        "historical": r.rolling(n).std() * A,
        "parkinson": np.sqrt((log(b.high / b.low) ** 2).rolling(n).mean() * 252 / (4 * log(2))),
        "garman_klass": np.sqrt(gk.rolling(n).mean() * 252),
        "rogers_satchell": np.sqrt(rs.rolling(n).mean().clip(lower=0) * 252),
        "yang_zhang": np.sqrt(yz * 252),
        "ewma": r.ewm(span=n).std() * A,
    })
