"""The shape of the plans that matter at scale."""

import re

from pyspark.sql import functions as F

from sigmatide import Market
from sigmatide.session import shared_folder
from sigmatide.sources.bars import MONTH, stored_period, write_bars
from sigmatide.operators import estimators as es
from sigmatide.plans.catalog import all_queries
from sigmatide.sources.tables import Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(df, node):
    return len(re.findall(rf"\b{node}\b", plan(df)))


def test_no_query_multiplies_rows_by_a_cross_join(spark, folder):
    for name in ("vol_summary", "screen_top50", "portfolio_allocation", "buy_list", "movers_top10",
                 "news_latest50", "trading_signals", "scan_ticker_info"):
        text = plan(all_queries()[name](spark, folder))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_the_panel_needs_one_shuffle_by_ticker_and_two_sorts(spark):
    bars = spark.createDataFrame([], "ticker string, dt date, open double, high double, low double, "
                                     "close double, volume double").repartition(2)
    for df in (es.vol_panel(bars), es.vol_summary(bars), es.vol_regime(bars)):
        text = plan(df)
        assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
        assert len(re.findall(r"\bSort \[", text)) == 2


def test_unused_estimators_are_not_computed(spark, folder):
    text = plan(es.estimator(Tables(spark, folder).bars(), "parkinson"))
    assert "stddev_samp" not in text and "var_samp" not in text and "POWER" not in text


def test_bars_are_aggregated_before_the_shuffle(spark, folder):
    text = plan(Tables(spark, folder).bars())
    assert text.index("partial_max") > text.index("Exchange hashpartitioning(ticker")


def test_ranked_cuts_are_limited_before_the_shuffle(spark, folder):
    for name in ("period_filter_5d", "screen_top5", "portfolio_picks", "movers_top10",
                 "news_flatten"):
        assert "WindowGroupLimit" in plan(all_queries()[name](spark, folder)), name


def test_news_texts_are_cut_before_they_are_shuffled(spark, folder):
    text = plan(all_queries()["news_flatten"](spark, folder))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    shuffle = text.index("Exchange hashpartitioning(ticker")
    limit = text.index("WindowGroupLimit", shuffle)
    assert shuffle < limit < text.index("BroadcastHashJoin")


def scanned_rows(spark, df):
    """Rows that left the scans of a query."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        query = df._jdf.queryExecution()
        query.toRdd().count()
        leaves = query.executedPlan().collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_period_prunes_months_and_row_groups(spark):
    days = spark.range(3000).select(
        F.lit("A").alias("ticker"), F.expr("date_add(date '2015-01-01', cast(id as int))").alias("dt"),
        *[F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "volume")])
    rows = days.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(40)))).withColumn(
        "ticker", F.concat("ticker", "k")).drop("k")
    folder = shared_folder(spark, "months")
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "4096")
    try:
        write_bars(rows, folder)
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    stored = spark.read.parquet(folder)
    read = stored_period(stored, "3mo")
    assert read.columns == rows.columns
    want = 40 * read.agg(F.count_distinct("dt")).first()[0]
    assert read.count() == want
    got = scanned_rows(spark, read)
    assert want <= got <= want + 40 * 31 < rows.count() / 20
    assert stored.filter(F.col("dt") > F.add_months(F.lit("2023-03-19").cast("date"), -3)).count() == want


def test_stored_bars_are_built_once_and_serve_every_period(spark, folder):
    t = Tables(spark, folder)
    first = t.stored_bars().inputFiles()
    assert Tables(spark, folder + "/").stored_bars().inputFiles() == first
    assert "l_shipdate" not in plan(t.bars("6mo"))
    assert t.bars().exceptAll(t.stored_bars().drop(MONTH)).count() == 0


def test_market_runs_on_plain_bars(spark, folder):
    t = Tables(spark, folder)
    named = t.universe().withColumn("name", F.lit("all"))
    market = Market(t.bars(), t.ticker_info(), named, t.news())
    some = market.only("brand#1", " BRAND#2 ")
    assert some.period("3mo").agg(F.max("dt")).first() <= market.period(None).agg(F.max("dt")).first()
    assert market.insufficient().count() == 0
    assert some.regime().count() == 2
    assert some.signals(days=7).count() == 2
    assert some.predict(days=7).count() == 14
    assert some.price_cone(days=7).count() == 14
    assert some.summary(period="1y").count() == 12
    assert market.screen("all").filter("style = 'swing'").count() == 25
    assert market.portfolio(50_000.0, "all").select("portfolio").distinct().count() == 3
    assert market.ranking("all").count() == 20
    assert market.buy_list("all", "all").count() <= 15
    assert market.movers("all").count() == 60
    assert market.news(universe="all").count() == 30
    assert market.facts().count() == 25
    assert some.forecast_simple(5).count() == 10
    assert some.garch_forecast(5).count() == 10
    assert some.histogram().count() > 10 and some.recent(10).count() == 20
    assert some.ensemble(5).count() == 10
    news = t.dated_news()
    assert market.latest_bar(news, "published").count() == news.count()
    assert market.in_regimes(news, "published").columns[-4:] == ["regime", "stretch", "start", "end"]
    assert {r.change for r in market.board_changes(20, "all").collect()} <= {"entered", "left", "stayed"}
    assert some.garch_forecast(5, p=2).count() == 10 and some.garch_conditional_vol(p=1, q=2).count() > 100
    assert some.learned_forecast(5, 20, boosted=True).count() == 10
