import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from series import random_bars
from sigmatide.session import shared_folder
from sigmatide.sources.tables import Tables
from sigmatide.streaming import bars as sb
from sigmatide.streaming import ewma as sw
from sigmatide.streaming import movers as sm
from sigmatide.streaming import reactions as rx
from sigmatide.streaming import windows as wi

TICKS = "event_id bigint, ticker string, ts timestamp, price double"


def run_ticks(spark, batches, folder, out, **kw):
    """Append each batch of ticks as a file and process it."""
    for rows in batches:
        frame = spark.createDataFrame(
            [(i, t, pd.Timestamp(ts).to_pydatetime(), p) for i, t, ts, p in rows], TICKS)
        frame.coalesce(1).write.mode("append").parquet(folder)
        stream = sb.read_stream(spark, folder, frame.schema)
        sb.append_to_parquet(sb.stream_bars(stream, **kw), out).awaitTermination()
    return spark.read.parquet(out)


def test_late_ticks_are_dropped_and_closed_bars_are_final(spark):
    batches = [
        [(1, "A", "2024-01-01 00:10", 5.0), (2, "A", "2024-01-01 00:50", 7.0),
         (3, "A", "2024-01-01 03:30", 1.0), (4, "B", "2024-01-01 00:20", 0.0)],
        [(5, "A", "2024-01-01 00:55", 99.0), (6, "A", "2024-01-01 06:00", 2.0)],
    ]
    out = run_ticks(spark, batches, shared_folder(spark, "ticks"), shared_folder(spark, "bars"),
                    width="1 hour", delay="1 hour")
    got = {str(r.dt): (r.open, r.high, r.low, r.close, r.volume) for r in out.collect()}
    assert got == {"2024-01-01 00:00:00": (5.0, 7.0, 5.0, 7.0, 2.0),
                   "2024-01-01 03:00:00": (1.0, 1.0, 1.0, 1.0, 1.0)}


def test_stream_equals_batch_but_for_open_windows(spark, folder):
    batch = sb.stream_bars(Tables(spark, folder).ticks(), "1 day", "1 hour")
    t = Tables(spark, folder)
    stream = t.ticks(sb.read_stream(spark, folder, t.table("events").schema, "events.parquet"))
    out = shared_folder(spark, "daily")
    sb.append_to_parquet(sb.stream_bars(stream, "1 day", "1 hour"), out).awaitTermination()
    closed = spark.read.parquet(out)
    assert closed.exceptAll(batch).count() == 0
    assert batch.count() - closed.count() == 5  # the last day of each ticker is still open


def test_ewma_state_carries_over_batches(spark):
    frames = [random_bars("A", 60, 1), random_bars("B", 45, 2)]
    source, out = shared_folder(spark, "bars"), shared_folder(spark, "ewma")
    for lo, hi in [(0, 1), (1, 20), (20, 21), (21, 60)]:
        part = pd.concat([f.iloc[lo:hi] for f in frames])[["ticker", "dt", "close"]]
        df = (spark.createDataFrame(part, "ticker string, dt date, close double")
              .withColumn("dt", F.col("dt").cast("timestamp")))
        df.coalesce(1).write.mode("append").parquet(source)
        stream = sb.read_stream(spark, source, df.schema)
        sb.append_to_parquet(sw.stream_ewma(stream), out).awaitTermination()
    for f in frames:
        got = (spark.read.parquet(out).filter(F.col("ticker") == f.ticker[0]).orderBy("dt").collect())
        want = (f.close.pct_change().ewm(span=21).std() * np.sqrt(252)).to_numpy()
        have = np.array([np.nan if r.ewma is None else r.ewma for r in got])
        assert len(have) == len(f)
        np.testing.assert_allclose(have, want, rtol=1e-9)


def test_a_bar_older_than_an_earlier_batch_is_reported_and_changes_nothing(spark):
    frame = random_bars("A", 30, 4)
    source, out = shared_folder(spark, "bars"), shared_folder(spark, "ewma")
    order = [list(range(0, 10)) + list(range(11, 20)), [10, 5] + list(range(20, 30))]
    for rows in order:
        part = frame.iloc[rows][["ticker", "dt", "close"]]
        df = (spark.createDataFrame(part, "ticker string, dt date, close double")
              .withColumn("dt", F.col("dt").cast("timestamp")))
        df.coalesce(1).write.mode("append").parquet(source)
        stream = sb.read_stream(spark, source, df.schema, files_per_trigger=1)
        sb.append_to_parquet(sw.stream_ewma(stream), out).awaitTermination()
    got = spark.read.parquet(out).orderBy("dt", "late").collect()
    late = [r for r in got if r.late]
    assert sorted(r.dt.date() for r in late) == sorted(frame.dt.iloc[[5, 10]]) and all(r.ewma is None for r in late)
    kept = frame.drop(frame.index[10])
    want = (kept.close.pct_change().ewm(span=21).std() * np.sqrt(252)).to_numpy()
    have = np.array([np.nan if r.ewma is None else r.ewma for r in got if not r.late])
    np.testing.assert_allclose(have, want, rtol=1e-9)


def test_a_backlog_is_cut_into_batches_of_files(spark):
    source, out = shared_folder(spark, "bars"), shared_folder(spark, "ewma")
    frame = random_bars("A", 40, 6)
    for i in range(0, 40, 10):
        df = (spark.createDataFrame(frame.iloc[i:i + 10][["ticker", "dt", "close"]],
                                    "ticker string, dt date, close double")
              .withColumn("dt", F.col("dt").cast("timestamp")))
        df.coalesce(1).write.mode("append").parquet(source)
    query = sb.append_to_parquet(sw.stream_ewma(
        sb.read_stream(spark, source, df.schema, files_per_trigger=1)), out)
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 4
    assert spark.read.parquet(out).filter("late").count() == 0


def test_movers_follow_batches_and_survive_a_repeat(spark, folder):
    from test_sources import info_rows

    info = info_rows(spark, [])
    out = shared_folder(spark, "movers")
    frame = pd.concat([random_bars("A", 6, 1), random_bars("B", 6, 2)])
    schema = "ticker string, dt date, open double, high double, low double, close double, volume double"
    days = sorted(frame.dt.unique())
    parts = [spark.createDataFrame(frame[frame.dt.isin(ds)], schema)
             for ds in (days[:1], days[1:3], days[3:])]
    for n, part in enumerate(parts):
        sm.refresh_movers(part, n, info, out)
        sm.refresh_movers(part, n, info, out)  # the same batch again
    got = {r.ticker: r for r in sm.current_boards(spark, out).filter("board = 'gainers'").collect()}
    for t in ("A", "B"):
        close = frame[frame.ticker == t].close.to_numpy()
        assert abs(got[t].change - (close[-1] / close[-2] - 1) * 100) < 1e-9
        assert got[t].high_52w == frame[frame.ticker == t].high.max()


def test_movers_keep_two_batches_and_see_no_later_price(spark):
    from test_sources import info_rows

    info, out = info_rows(spark, []), shared_folder(spark, "movers")
    frame = pd.concat([random_bars("A", 8, 1), random_bars("B", 8, 2)])
    schema = "ticker string, dt date, open double, high double, low double, close double, volume double"
    days = sorted(frame.dt.unique())
    for n in range(4):
        part = frame[frame.dt.isin(days[2 * n:2 * n + 2])]
        sm.refresh_movers(spark.createDataFrame(part, schema), n, info, out)
        seen = frame[frame.dt.isin(days[:2 * n + 2])]
        boards = sm.current_boards(spark, out).filter("board = 'gainers'").collect()
        for r in boards:
            own = seen[seen.ticker == r.ticker]
            assert (r.high_52w, r.low_52w) == (own.high.max(), own.low.min())
        for kind in ("latest", "levels", "boards"):
            kept = sorted(p for p in os.listdir(f"{out}/{kind}") if p.startswith("batch="))
            assert kept == [f"batch={i}" for i in range(max(0, n - 1), n + 1)]


# Windows, pairs and expiry

def tick_rows(seed, n=400, tickers=("A", "A", "A", "B"), hours=30):
    """Ticks in time order; one ticker holds most of them."""
    rng = np.random.default_rng(seed)
    at = np.sort(rng.uniform(0, hours * 3600, n)).round(3)
    return [(i, str(rng.choice(tickers)), pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=float(s)), float(rng.integers(0, 50)))
            for i, s in enumerate(at)]


def frame_of(spark, rows):
    return spark.createDataFrame([(i, t, ts.to_pydatetime() if ts is not None else None, p) for i, t, ts, p in rows], TICKS)


def run_files(spark, batches, operator, schema_of=frame_of):
    """Each batch is one file and one micro-batch of a single run."""
    folder, out = shared_folder(spark, "ticks"), shared_folder(spark, "out")
    for rows in batches:
        frame = schema_of(spark, rows)
        frame.coalesce(1).write.mode("append").parquet(folder)
    query = sb.append_to_parquet(operator(sb.read_stream(spark, folder, frame.schema, files_per_trigger=1)), out)
    query.awaitTermination()
    return spark.read.parquet(out), query


def chunks(rows, n):
    return [rows[i:i + n] for i in range(0, len(rows), n)]


def on_time(batches, delay):
    """Ticks that the watermark of the batches before does not drop."""
    kept, newest = [], None
    for rows in batches:
        kept += [r for r in rows if newest is None or r[2] > newest - pd.Timedelta(delay)]
        seen = [r[2] for r in rows if r[3] > 0]
        newest = max([newest, *seen] if newest is not None else seen)
    return kept, newest


def test_sessions_of_a_stream_equal_those_of_a_batch(spark):
    rows = tick_rows(1)
    batches = chunks(rows, 90)
    batches[3] = batches[3] + [(900, "A", pd.Timestamp("2024-01-01 00:00:30"), 7.0)]  # hours late
    got, query = run_files(spark, batches, lambda s: wi.stream_sessions(s, "10 minutes", "1 hour"))
    kept, newest = on_time(batches, "1 hour")
    assert len(kept) == len(rows)
    whole = wi.stream_sessions(frame_of(spark, kept), "10 minutes", "1 hour")
    closed = whole.filter(F.col("last") + F.expr("INTERVAL 10 MINUTES") <= F.lit(newest - pd.Timedelta("1 hour")))
    assert got.exceptAll(closed).count() == closed.exceptAll(got).count() == 0 and got.count() > 20
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == len(batches)


def test_a_late_tick_within_the_delay_joins_two_sessions(spark):
    t = pd.Timestamp
    batches = [[(1, "A", t("2024-01-01 10:00"), 5.0), (2, "A", t("2024-01-01 10:16"), 6.0), (3, "B", t("2024-01-01 10:20"), 1.0)],
               [(4, "A", t("2024-01-01 10:08"), 9.0), (5, None, t("2024-01-01 10:09"), 9.0), (6, "B", t("2024-01-01 20:00"), 2.0)]]
    got, _ = run_files(spark, batches, lambda s: wi.stream_sessions(s, "10 minutes", "1 hour"))
    rows = {(r.ticker, str(r.start), str(r["last"]), r.open, r.high, r.close, r.n) for r in got.collect()}
    assert rows == {("A", "2024-01-01 10:00:00", "2024-01-01 10:16:00", 5.0, 9.0, 6.0, 3),
                    ("B", "2024-01-01 10:20:00", "2024-01-01 10:20:00", 1.0, 1.0, 1.0, 1)}


def test_sliding_windows_equal_a_loop(spark):
    rows = tick_rows(2)
    got, _ = run_files(spark, chunks(rows, 110), lambda s: wi.stream_sliding(s, "1 hour", "15 minutes", "1 hour"))
    newest = max(r[2] for r in rows if r[3] > 0)
    want = set()
    for ticker in ("A", "B"):
        for start in pd.date_range("2023-12-31 23:15", "2024-01-02 08:00", freq="15min"):
            end = start + pd.Timedelta("1 hour")
            own = [r for r in rows if r[1] == ticker and start <= r[2] < end and r[3] > 0]
            if own and end <= newest - pd.Timedelta("1 hour"):
                prices = [r[3] for r in own]
                want.add((ticker, start, prices[0], max(prices), min(prices), prices[-1], len(own)))
    assert {(r.ticker, pd.Timestamp(r.dt), r.open, r.high, r.low, r.close, r.n) for r in got.collect()} == want


def test_a_tick_is_aggregated_in_one_pane(spark):
    plan = wi.stream_sliding(frame_of(spark, tick_rows(3, 20)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") <= 1 and plan.index("Expand") < plan.index("partial_min_by(price") if "Expand" in plan else True


NEWS = "ticker string, doc_id long, published timestamp"


def news_of(spark, rows):
    return spark.createDataFrame([(t, i, ts.to_pydatetime()) for i, t, ts in rows], NEWS)


def test_pairs_of_two_streams_equal_the_join_and_leave_the_state(spark):
    ticks = tick_rows(4, 600)
    rng = np.random.default_rng(5)
    news = [(i, str(rng.choice(["A", "B", "C"])), ts) for i, ts in enumerate(
        pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 30 * 3600, 120)), "s"))]
    folders = [shared_folder(spark, n) for n in ("ticks", "news", "pairs")]
    for part in chunks(ticks, 100):
        frame = frame_of(spark, part)
        frame.coalesce(1).write.mode("append").parquet(folders[0])
    for part in chunks(news, 20):
        told = news_of(spark, part)
        told.coalesce(1).write.mode("append").parquet(folders[1])
    streams = [sb.read_stream(spark, f, d.schema, files_per_trigger=1) for f, d in zip(folders, (frame, told))]
    query = sb.append_to_parquet(rx.stream_reactions(streams[1], streams[0], 600, "1 hour"), folders[2])
    query.awaitTermination()
    got = {(r.doc_id, r.event_id) for r in spark.read.parquet(folders[2]).collect()}
    want = {(i, e) for i, t, at in news for e, ticker, ts, price in ticks
            if t == ticker and price > 0 and at <= ts <= at + pd.Timedelta("10 minutes")}
    assert got == want and len(want) > 50
    batch = rx.stream_reactions(news_of(spark, news), frame_of(spark, ticks), 600)
    assert {(r.doc_id, r.event_id) for r in batch.collect()} == want
    state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    recent = sum(r[2] >= ticks[-1][2] - pd.Timedelta("80 minutes") for r in ticks)
    recent += 2 * sum(r[2] >= ticks[-1][2] - pd.Timedelta("80 minutes") for r in news)
    assert 0 < state <= recent < 0.2 * (len(ticks) + 2 * len(news))


BARS = "ticker string, dt timestamp, close double"


def close_bars(spark, rows):
    return spark.createDataFrame([(t, ts.to_pydatetime(), c) for t, ts, c in rows], BARS)


def test_expiring_ewma_equals_the_batch_and_forgets_idle_tickers(spark):
    rng = np.random.default_rng(8)
    days = pd.date_range("2024-01-01", periods=90, freq="D")
    rows = [("A", d, float(c)) for d, c in zip(days, 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 90))))]
    rows += [("B", d, float(c)) for d, c in zip(days[:25], 50 * np.exp(np.cumsum(rng.normal(0, 0.02, 25))))]
    rows += [("C", d, float(c)) for d, c in zip([*days[:10], *days[60:80]], 20 * np.exp(np.cumsum(rng.normal(0, 0.02, 30))))]
    rows.sort(key=lambda r: r[1])
    with sw.rocksdb_state(spark):
        got, query = run_files(spark, chunks(rows, 29), lambda s: sw.stream_ewma_expiring(s, idle_seconds=10 * 86_400, delay="1 day"),
                               close_bars)
    assert spark.conf.get(sw.PROVIDER) != sw.ROCKSDB
    got = got.orderBy("ticker", "dt").toPandas()
    assert len(got) == len(rows) and not got.late.any()
    for ticker, parts in {"A": [slice(0, 90)], "B": [slice(0, 25)], "C": [slice(0, 10), slice(10, 30)]}.items():
        closes = pd.Series([c for t, _, c in rows if t == ticker])
        have = got[got.ticker == ticker].ewma.to_numpy(float)
        for part in parts:  # a pause of more than ten days begins anew
            want = (closes.iloc[part].pct_change().ewm(span=21).std() * np.sqrt(252)).to_numpy()
            np.testing.assert_allclose(have[part], want, rtol=1e-9)
    # The last bars of B and C are more than ten days before the end; only A is left, with its timer's entries.
    assert query.lastProgress["stateOperators"][0]["customMetrics"]["rocksdbNumInternalColFamiliesKeys"] >= 0
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert kept[-1] < max(kept)


def test_running_sums_in_blocks_equal_a_loop():
    closes = 100 * np.exp(np.cumsum(np.random.default_rng(3).normal(0, 0.01, 6000)))
    want = (pd.Series(closes).pct_change().ewm(span=21).std() * np.sqrt(252)).to_numpy()
    state, parts = (0.0, 0.0, 0.0, 0.0, None), []
    for part in np.split(closes, [1, 2, 500, 5000]):
        values, state = sw._run(1 - 2 / 22, state, part)
        parts.append(values)
    np.testing.assert_allclose(np.concatenate(parts), want, rtol=1e-8)
