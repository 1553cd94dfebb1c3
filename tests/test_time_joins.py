"""Joins by time against DuckDB and plain loops; the plans deal a hot key over many tasks."""

import random
from datetime import date, datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigmatide.operators import estimators as es
from sigmatide.operators import time_joins as tj

T0 = datetime(2024, 1, 1)


def moments(n, seed, keys=("a", "a", "a", "b", None), span=40):
    """Rows (id, key, time) on few minutes, so that ties abound; a key holds most rows, some keys and times are null."""
    rng = random.Random(seed)
    return [(i, rng.choice(keys), None if rng.random() < 0.05 else T0 + timedelta(minutes=rng.randrange(span)))
            for i in range(n)]


def frames(spark, left, right):
    return (spark.createDataFrame(left, "id long, key string, at timestamp"),
            spark.createDataFrame(right, "rid long, key string, since timestamp"))


def latest_by_hand(left, right, strict):
    out = []
    for i, key, at in left:
        found = [(since, rid) for rid, k, since in right if k is not None and k == key and since is not None
                 and at is not None and (since < at if strict else since <= at)]
        since, rid = max(found, default=(None, None))
        out.append((i, key, at, since, rid))
    return sorted(out, key=str)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("block", [60, 420, 10**6])
def test_asof_equals_the_loop(spark, strict, block):
    left, right = moments(200, 1) + moments(3, 2), moments(25, 3, ("a", "b", "c", None))
    l, r = frames(spark, left, right)
    got = tj.asof_join(l, r, "key", "at", "since", ["rid"], block, strict)
    assert sorted(map(tuple, got.collect()), key=str) == latest_by_hand(left, right, strict)


def test_asof_equals_duckdb(spark):
    """With one right row per key and time, so that both engines have one answer."""
    left = [r for r in moments(300, 5, ("a", "b")) if r[2]]
    right = list({(k, t): (i, k, t) for i, k, t in moments(30, 6, ("a", "b")) if t}.values())
    l, r = frames(spark, left, right)
    con = duckdb.connect()
    con.register("l", pd.DataFrame(left, columns=["id", "key", "at"]))
    con.register("r", pd.DataFrame(right, columns=["rid", "key", "since"]))
    want = con.execute("SELECT id, rid FROM l ASOF LEFT JOIN r ON l.key = r.key AND l.at >= r.since").fetchall()
    got = tj.asof_join(l, r, "key", "at", "since", ["rid"], 300).select("id", "rid").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_asof_of_empty_sides_and_clashing_names(spark):
    l, r = frames(spark, moments(5, 1), moments(5, 2))
    none = tj.asof_join(l, r.limit(0), "key", "at", "since", ["rid"])
    assert none.count() == 5 and none.filter("rid IS NOT NULL").count() == 0
    assert tj.asof_join(l.limit(0), r, "key", "at", "since", ["rid"]).columns == ["id", "key", "at", "since", "rid"]
    with pytest.raises(ValueError):
        tj.asof_join(l, r.withColumnRenamed("rid", "id"), "key", "at", "since", ["id"])


def intervals(n, seed, span=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = T0 + timedelta(minutes=rng.randrange(span))
        end = start + timedelta(minutes=rng.choice([-2, 0, 1, 5, 30, 300]))
        rows.append((i, rng.choice(["a", "a", "b", None]), rng.choice([start, start, start, None]), end))
    return rows


SPANS = "{0}id long, key string, start timestamp, end timestamp"


@pytest.mark.parametrize("block", [60, 700, 10**6])
def test_interval_join_equals_the_loop(spark, block):
    points, spans = moments(150, 8), intervals(60, 9)
    p, s = spark.createDataFrame(points, "id long, key string, at timestamp"), spark.createDataFrame(spans, SPANS.format("s"))
    got = tj.interval_join(p, s, "key", "at", "start", "end", block)
    want = [(i, k, at, sid, a, b) for i, k, at in points for sid, key, a, b in spans
            if k is not None and k == key and at is not None and a is not None and a <= at < b]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    assert got.columns == ["id", "key", "at", "sid", "start", "end"]


@pytest.mark.parametrize("block", [60, 700, 10**6])
def test_overlaps_come_once(spark, block):
    one, two = intervals(50, 11), intervals(50, 12)
    l, r = (spark.createDataFrame(x, SPANS.format("")) for x in (one, two))
    got = tj.overlap_join(l, r, "key", "start", "end", block).select(
        "key", "left.id", F.col("right.id").alias("rid"), "overlap_start", "overlap_end")
    want = [(k, i, j, max(a, c), min(b, d)) for i, k, a, b in one for j, key, c, d in two
            if k is not None and k == key and a is not None and c is not None and a < b and c < d and max(a, c) < min(b, d)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_stretches_with_null_states(spark):
    states = ["x", "x", None, None, "y", "x", "x"]
    rows = [("k", date(2024, 1, i + 1), s) for i, s in enumerate(states)] + [("one", date(2024, 1, 1), None)]
    got = tj.stretches(spark.createDataFrame(rows, "key string, dt date, state string"), "key", "dt", "state")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        ("k", "x", 1, date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 3), 2),
        ("k", None, 2, date(2024, 1, 3), date(2024, 1, 4), date(2024, 1, 5), 2),
        ("k", "y", 3, date(2024, 1, 5), date(2024, 1, 5), date(2024, 1, 6), 1),
        ("k", "x", 4, date(2024, 1, 6), date(2024, 1, 7), None, 2),
        ("one", None, 1, date(2024, 1, 1), date(2024, 1, 1), None, 1)], key=str)


def minute_bars(n, seed):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    gaps = np.cumsum(rng.choice([1, 1, 1, 500], n))  # empty blocks of time between filled ones
    spread = np.exp(np.abs(rng.normal(0, 0.01, (2, n))))
    return pd.DataFrame({"ticker": f"S{seed}", "dt": pd.Timestamp(T0) + pd.to_timedelta(gaps, "min"), "open": close * 1.001,
                         "high": close * 1.001 * spread[0], "low": close / spread[1], "close": close, "volume": 1.0})


@pytest.fixture(scope="module")
def minutes(spark):
    return spark.createDataFrame(pd.concat([minute_bars(n, s) for n, s in ((1500, 1), (64, 2), (20, 3), (1, 4))])).cache()


@pytest.mark.parametrize("size,seconds", [(21, 600), (64, 3600), (4096, 10**7)])
def test_intraday_equals_the_plain_window(minutes, size, seconds, monkeypatch):
    blocks = tj.row_blocks
    monkeypatch.setattr(es, "row_blocks", lambda *a: blocks(*a, seconds))
    plain = es.volatility_frame(minutes).select("ticker", "dt", *es.METRICS[:5]).orderBy("ticker", "dt").toPandas()
    got = es.intraday_volatility(minutes, size=size).orderBy("ticker", "dt").toPandas()
    assert len(got) == len(plain) == 1585
    pd.testing.assert_frame_equal(got[["ticker", "dt"]], plain[["ticker", "dt"]])
    np.testing.assert_allclose(got[es.METRICS[:5]].to_numpy(float), plain[es.METRICS[:5]].to_numpy(float), rtol=1e-9)


def test_row_blocks_bound_a_task_and_number_every_row(minutes):
    got = tj.row_blocks(minutes, "ticker", "dt", 64, 21, 3600)
    sizes = got.groupBy("ticker", "block").count().collect()
    assert max(r["count"] for r in sizes) <= 64 + 21 and len(sizes) > 1500 / 64
    rows = got.filter("NOT in_halo AND ticker = 'S1'").orderBy("dt").select("row").collect()
    assert [r.row for r in rows] == list(range(1, 1501))
    with pytest.raises(ValueError):
        tj.row_blocks(minutes, "ticker", "dt", 5, 6)


def test_annual_scale_of_intraday_bars(minutes):
    day, minute = (es.intraday_volatility(minutes, periods=p).filter("ticker = 'S1'").agg(F.max("historical")).first()[0]
                   for p in (252, 252 * 4))
    assert abs(minute / day - 2) < 1e-9


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_nested_loop_and_split_keys(spark, minutes):
    l, r = frames(spark, moments(5, 1), moments(5, 2))
    spans = spark.createDataFrame(intervals(5, 1), SPANS.format("s"))
    for df in (tj.asof_join(l, r, "key", "at", "since", ["rid"]), tj.interval_join(l, spans, "key", "at", "start", "end"),
               tj.overlap_join(spans, spans, "key", "start", "end"), es.intraday_volatility(minutes)):
        text = plan(df)
        assert "NestedLoop" not in text and "CartesianProduct" not in text
    asof = plan(tj.asof_join(l, r, "key", "at", "since", ["rid"]))
    assert "hashpartitioning(_key" in asof and "_block" in asof
    # Windows of the numbering run over (key, block of time), or over the blocks of a key; never over its rows.
    numbering = plan(tj.row_blocks(minutes, "ticker", "dt", 64, 21))
    windows = [line for line in numbering.split("\n") if "windowspecdefinition(" in line]
    assert windows and all("_time_block" in line.split("windowspecdefinition(")[1] for line in windows)
