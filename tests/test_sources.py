import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from series import random_bars, to_spark
from sigmatide.operators import market_boards as mb
from sigmatide.sources import bars as ba
from sigmatide.sources import dimensions as di
from sigmatide.sources import news as ne
from sigmatide.sources.tables import Tables


def test_bars_daily_uses_the_whole_order(spark):
    d = dt.date(2024, 1, 2)
    rows = [("A", d, 3.0, 1.0, 1, 2), ("A", d, 9.0, 2.0, 1, 1), ("A", d, 1.0, 4.0, 2, 1),
            ("A", d, 5.0, 8.0, 2, 2), ("B", d, 7.0, 1.0, 1, 1)]
    df = spark.createDataFrame(rows, "ticker string, dt date, price double, qty double, k int, n int")
    got = {r.ticker: r for r in ba.bars_daily(df, ["k", "n"], 10.0).collect()}
    assert (got["A"].open, got["A"].high, got["A"].low, got["A"].close, got["A"].volume) \
        == (9.0, 9.0, 1.0, 5.0, 150.0)
    assert (got["B"].open, got["B"].close) == (7.0, 7.0)


def test_scan_drops_bad_prices_and_normalises(spark):
    d = dt.date(2024, 1, 2)
    rows = [(" aapl ", d, 1.0, 1.0, 1.0, 1.0, float("nan")), ("X", d, 0.0, 1.0, 1.0, 1.0, 1.0),
            ("Y", d, 1.0, float("nan"), 1.0, 1.0, 1.0), ("Z", d, 1.0, 1.0, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "ticker string, dt date, open double, high double, "
                                     "low double, close double, volume double")
    got = ba.scan_bars(df).collect()
    assert [(r.ticker, r.volume) for r in got] == [("AAPL", None)]


def test_periods(spark):
    bars = to_spark(spark, random_bars("A", 800, 1, start="2020-01-01"))
    last = bars.agg(F.max("dt")).first()[0]
    assert ba.period_filter(bars, "5d").count() == 5
    for name, months in ba.PERIOD_MONTHS.items():
        first = (pd.Timestamp(last) - pd.DateOffset(months=months)).date()
        got = ba.period_filter(bars, name).agg(F.min("dt")).first()[0]
        assert got > first
    early = F.lit("2021-06-30").cast("date")
    assert ba.period_filter(bars, "3mo", early).agg(F.max("dt")).first()[0] == dt.date(2021, 6, 30)
    with pytest.raises(ValueError):
        ba.period_filter(bars, "2w")


def test_min_history_and_universe(spark):
    bars = to_spark(spark, pd.concat([random_bars("A", 29, 1), random_bars("B", 30, 2)]))
    assert {r.ticker for r in ba.min_history(bars, 30).select("ticker").distinct().collect()} == {"B"}
    lists = spark.createDataFrame([("x", " b ", 1), ("y", "A", 1)], "name string, ticker string, pos int")
    got = di.universe_filter(bars, lists, "x").select("ticker").distinct().collect()
    assert [r.ticker for r in got] == ["B"]


def test_named_universes(spark):
    counts = {r["name"]: r["count"] for r in di.universes(spark).groupBy("name").count().collect()}
    assert counts == {"investment": 65, "movers": 31, "buy_list": 40, "news": 21}
    assert all(len(set(ts)) == len(ts) for ts in di.NAMED_UNIVERSES.values())


def info_rows(spark, rows):
    names = ["ticker", "short_name", *di.INFO_NUMBERS]
    schema = "ticker string, short_name string, " + ", ".join(f"{c} double" for c in di.INFO_NUMBERS)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def test_info_defaults(spark):
    tickers = spark.createDataFrame([("A",), ("B",)], "ticker string")
    info = info_rows(spark, [{"ticker": "A", "short_name": "Alpha", "market_cap": 5.0}])
    got = {r.ticker: r for r in di.scan_ticker_info(tickers, info).collect()}
    assert got["A"].short_name == "Alpha" and got["A"].market_cap == 5.0 and got["A"].trailing_pe == 0
    assert got["B"].short_name == "B" and got["B"].week52_high == 0


def test_movers(spark):
    frames = [random_bars(t, n, i) for i, (t, n) in enumerate(
        [("A", 5), ("B", 2), ("C", 1), ("D", 9)])]
    info = info_rows(spark, [{"ticker": "A", "week52_high": 200.0, "week52_low": 0.0,
                              "dividend_yield": 0.03}])
    bars = pd.concat(frames)
    metrics = mb.mover_metrics(to_spark(spark, bars), info)
    got = {r.ticker: r for r in metrics.collect()}
    assert set(got) == {"A", "B", "D"}
    a = frames[0].close
    assert math.isclose(got["A"].change, (a.iloc[-1] / a.iloc[-2] - 1) * 100)
    assert math.isclose(got["A"].pct_from_high, (a.iloc[-1] - 200) / 2)
    assert got["A"].pct_from_low == 0 and math.isclose(got["A"].div_yield, 3.0)
    assert got["B"].high_52w == 0 and got["B"].pct_from_high == 0
    places = spark.createDataFrame([("m", "D", 1), ("m", "B", 2), ("m", "A", 3)],
                                   "name string, ticker string, pos int")
    tops = mb.movers_top(metrics, places).collect()
    assert len(tops) == 18
    order = [r.ticker for r in sorted(tops, key=lambda r: r["rank"]) if r.board == "dividends"]
    assert order == ["A", "D", "B"]  # equal yields keep the universe order
    up = [r.change for r in sorted(tops, key=lambda r: r["rank"]) if r.board == "gainers"]
    assert up == sorted(up, reverse=True)


def test_news_forms(spark):
    feed = spark.sql("""
        select 'A' ticker, array(
          named_struct('content', named_struct('title', 'Nested', 'clickThroughUrl',
            named_struct('url', 'u1'), 'provider', named_struct('displayName', 'P'),
            'pubDate', '2024-01-02T03:04:05Z'), 'title', null, 'link', null, 'publisher', null,
            'providerPublishTime', null),
          named_struct('content', null, 'title', 'Flat', 'link', 'u2', 'publisher', 'Q',
            'providerPublishTime', 1704067200),
          named_struct('content', null, 'title', null, 'link', null, 'publisher', null,
            'providerPublishTime', null),
          named_struct('content', null, 'title', 'Fourth', 'link', null, 'publisher', null,
            'providerPublishTime', null)) as raw
    """).select("ticker", F.col("raw").cast(f"array<{ne.ITEM_TYPE}>").alias("news"))
    items = ne.news_items(feed).withColumn("pos", F.lit(1))
    got = ne.news_flatten(items).orderBy("ord").collect()
    assert [(r.title, r.link, r.publisher, str(r.time)) for r in got] == [
        ("Nested", "u1", "P", "2024-01-02 03:04:05"), ("Flat", "u2", "Q", "2024-01-01 00:00:00"),
        ("No title", "#", "Unknown", "1970-01-01 00:00:00")]
    latest = mb.news_latest(ne.news_flatten(items))
    assert [r.title for r in mb.news_by_category(latest).collect()] == ["Nested", "Flat", "No title"]
    assert mb.news_by_category(latest, "earnings").count() == 0


def test_sequence_key_sorts_like_the_pair(spark):
    pairs = [(h, low) for h in (0, 1, 7, 9 * 10 ** 18) for low in (0, 5, 10 ** 18 - 1)]
    df = spark.createDataFrame(pairs, "h bigint, l bigint")
    got = df.orderBy(ba.sequence_key(F.col("h"), F.col("l"), 18)).collect()
    assert [(r.h, r.l) for r in got] == sorted(pairs)


def test_a_hot_ticker_gives_the_same_bars(spark):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("T"), F.col("id") % 200))
        .alias("ticker"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 7).cast("int")).alias("dt"),
        (1 + F.pmod(F.col("id") * 7919, F.lit(1009)) / 100).alias("price"),
        F.lit(1.0).alias("qty"),
        ba.sequence_key(F.pmod(F.col("id") * 31, F.lit(997)), F.col("id"), 18).alias("seq"),
    )
    bars = ba.bars_daily(rows, ["seq"])
    assert "SortAggregate" not in bars._jdf.queryExecution().executedPlan().toString()
    got = {(r.ticker, r.dt): (r.open, r.high, r.low, r.close, r.volume) for r in bars.collect()}
    want = {}
    for key, part in rows.toPandas().sort_values("seq").groupby(["ticker", "dt"]):
        p = part.price
        want[key] = (p.iloc[0], p.max(), p.min(), p.iloc[-1], float(len(p)))
    assert got == want


def test_a_hot_ticker_sends_only_its_first_news(spark):
    items = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("T"), F.col("id") % 50))
        .alias("ticker"), F.col("id").alias("ord"))
    got = ne.first_items(items, 3).collect()
    assert [r["ord"] for r in sorted(got, key=lambda r: r["ord"]) if r.ticker == "HOT"] == [0, 3, 6]
    assert len(got) == 51 * 3


def test_two_spellings_of_a_ticker_are_one_bar_a_day(spark):
    d = dt.date(2024, 1, 2)
    rows = [("aapl", d, 1.0, 1.0, 1.0, 1.0, 5.0), (" AAPL ", d, 2.0, 2.0, 2.0, 2.0, 9.0),
            ("Aapl", d, 3.0, 3.0, 3.0, 3.0, None), ("AAPL", d, 4.0, 4.0, 4.0, 4.0, 9.0),
            ("AAPL", dt.date(2024, 1, 3), 5.0, 5.0, 5.0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "ticker string, dt date, open double, high double, "
                                     "low double, close double, volume double")
    got = sorted((r.ticker, r.dt.day, r.close) for r in ba.scan_bars(df).collect())
    assert got == [("AAPL", 2, 4.0), ("AAPL", 3, 5.0)]
    assert ba.scan_bars(df, one_per_day=False).count() == 5


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from sigmatide.session import shared_folder

    def session(master, base=None):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda k, d=None: base or d),
            sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError):
            shared_folder(session(master), "x")
        assert shared_folder(session(master, "hdfs://shared/"), "x").startswith("hdfs://shared/x-")
    one = session("local[2]")
    assert shared_folder(one, "x").rpartition("/")[0] == shared_folder(one, "y").rpartition("/")[0]


def test_movers_leave_out_tickers_that_stopped_trading(spark):
    bars = pd.concat([random_bars("OLD", 30, 1, start="2019-01-01"), random_bars("NEW", 30, 2, start="2024-01-01")])
    df = to_spark(spark, bars)
    assert {r.ticker for r in mb.recent_days(df).collect()} == {"NEW"}
    assert mb.recent_days(df).count() == mb.LOOK_BACK


def test_a_long_list_is_read_from_a_file_in_its_order(spark, tmp_path):
    from sigmatide.sources.dimensions import read_universe

    path = tmp_path / "screen.txt"
    path.write_text("# screener\nmsft\n\n aapl  # first\nTSLA\nmsft\n")
    rows = sorted(map(tuple, read_universe(spark, str(path), "screen").collect()), key=lambda r: r[2])
    assert rows == [("screen", "MSFT", 1), ("screen", "AAPL", 2), ("screen", "TSLA", 3)]


def test_staged_folders_are_removed_on_request(spark):
    from sigmatide.session import clear_staged, is_folder, staged

    clear_staged(spark)
    folders = [staged(spark.range(3), "x").inputFiles()[0].rsplit("/", 1)[0] for _ in range(2)]
    assert all(is_folder(spark, f) for f in folders)
    assert clear_staged(spark) == 2 and clear_staged(spark) == 0
    with pytest.raises(Exception):
        is_folder(spark, folders[0])


def test_the_state_of_the_source_is_a_digest(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    for name in ("lineitem", "part"):
        spark.range(10).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    first = t._source_state()
    assert first == Tables(spark, str(tmp_path))._source_state() and len(first) == 2 and first[0][0] == 3
    spark.range(1).write.mode("append").parquet(f"{tmp_path}/part.parquet")
    assert t._source_state() != first
