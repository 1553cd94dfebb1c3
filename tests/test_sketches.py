"""Monthly sketches against exact values; totals of the screen; changes of the boards."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigmatide.operators import market_boards as mb
from sigmatide.operators import screener as sc
from sigmatide.operators import sketches as sk


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    days = pd.date_range("2015-01-01", periods=3000).date
    frames = [pd.DataFrame({"ticker": t, "dt": days, "close": rng.integers(1, 900, 3000) / 100.0,
                            "yang_zhang": rng.lognormal(0, s, 3000)}) for t, s in (("A", 0.1), ("B", 2.0))]
    frames.append(pd.DataFrame({"ticker": "C", "dt": days[:1], "close": 5.0, "yang_zhang": 0.3}))
    frames.append(pd.DataFrame({"ticker": "D", "dt": days[:5], "close": 5.0, "yang_zhang": None}))
    return spark.createDataFrame(pd.concat(frames), "ticker string, dt date, close double, yang_zhang double").cache()


@pytest.mark.parametrize("since", [None, "2018-06-01", "2023-03-01"])
def test_merged_sketches_are_within_their_error(spark, rows, since):
    months = sk.month_sketches(rows)
    bound = None if since is None else F.lit(since).cast("date")
    got = {r.ticker: r for r in sk.sketched_percentile(sk.merged_sketches(months, bound)).collect()}
    frame = rows.toPandas()
    if since:
        frame = frame[frame.dt >= pd.Timestamp(since).date()]
    for ticker, own in frame.dropna().groupby("ticker"):
        r, last = got[ticker], own.sort_values("dt").yang_zhang.iloc[-1]
        assert (r.n, r["last"]) == (len(own), last)
        assert abs(r.percentile - (own.yang_zhang < last).mean() * 100) <= 100 * sk.RANK_ERROR
        assert abs(r.prices - own.close.nunique()) <= sk.COUNT_ERROR * own.close.nunique() + 1
    assert set(got) == set(frame.dropna().ticker)


def test_a_month_is_one_row_whatever_its_size(rows):
    months = sk.month_sketches(rows)
    assert months.groupBy("ticker", "month").count().filter("count > 1").count() == 0
    assert months.filter("ticker = 'A'").count() == rows.filter("ticker = 'A'").select(F.trunc("dt", "MM")).distinct().count()
    assert "partial_kll" in months._jdf.queryExecution().executedPlan().toString()


def test_cube_tells_totals_from_missing_labels(spark):
    top = spark.createDataFrame([("day", "A", "Low", 3), ("day", "B", "High", 5), ("long", "A", "Low", 9)],
                                "style string, ticker string, regime string, score int")
    labels = spark.createDataFrame([("A", "$1B")], "ticker string, cap_label string")
    got = {(r.style, r.regime, r.cap_label, r.level): (r.n, r.tickers, r.best_score) for r in sc.screen_cube(top, labels).collect()}
    assert got[None, None, None, 7] == (3, 2, 9)
    assert got[None, None, None, 6] == (1, 1, 5) and got[None, None, "$1B", 6] == (2, 1, 9)
    assert got["day", None, None, 3] == (2, 2, 5) and got["day", "High", None, 0] == (1, 1, 5)
    assert sc.screen_cube(top.limit(0), labels).filter("level < 7").count() == 0


def test_changes_are_those_of_multisets(spark):
    schema = "board string, ticker string, rank int"
    now = [("g", "A", 1), ("g", "A", 2), ("g", None, 3), ("g", "N", 4), ("l", "B", 1)]
    before = [("g", "A", 5), ("g", None, 1), ("g", "Z", 2), ("l", "N", 1), (None, "A", 1)]
    got = mb.board_changes(spark.createDataFrame(now, schema), spark.createDataFrame(before, schema))
    one, two = (Counter(r[:2] for r in rows) for rows in (now, before))
    want = [(*k, "entered") for k in (one - two).elements()] + [(*k, "left") for k in (two - one).elements()]
    want += [(*k, "stayed") for k in (one & two).elements()]
    rows = got.collect()
    assert Counter((r.board, r.ticker, r.change) for r in rows) == Counter(want)
    ranks = {(r.board, r.ticker, r.change): (r.rank_now, r.rank_before, r.newcomer) for r in rows}
    assert ranks["g", None, "stayed"] == (3, 1, False) and ranks["g", "Z", "left"] == (None, 2, False)
    assert ranks["l", "B", "entered"] == (1, None, True) and ranks["g", "N", "entered"] == (4, None, False)
    empty = spark.createDataFrame([], schema)
    assert mb.board_changes(empty, empty).count() == 0


def test_bars_before_are_those_of_the_days_with_bars(spark):
    days = pd.bdate_range("2024-01-01", periods=30).date
    bars = spark.createDataFrame([("A", d, 1.0) for d in days] + [("B", days[3], 2.0)], "ticker string, dt date, close double")
    assert mb.bars_before(bars, 20).agg(F.max("dt")).first()[0] == days[9]
    assert mb.bars_before(bars, 0).count() == 31
