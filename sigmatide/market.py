"""One object over the operators, for a table of bars of many tickers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmatide.operators import analyzer, estimators, forecast, garch, learned, market_boards, time_joins
from sigmatide.operators import portfolio as invest
from sigmatide.operators import screener
from sigmatide.session import staged
from sigmatide.sources import news as feeds
from sigmatide.sources.bars import period_filter, scan_bars
from sigmatide.sources.dimensions import (
    portfolio_definitions,
    scan_ticker_info,
    universe_filter,
)


class Market:
    """Daily bars (ticker, dt, open, high, low, close, volume) of all tickers.

    ``info`` holds facts per ticker, ``universe`` named ticker lists (name, ticker, pos) and
    ``news`` rows of (ticker, ord, item). Every method returns a DataFrame over all tickers.
    """

    def __init__(self, bars: DataFrame, info: DataFrame | None = None,
                 universe: DataFrame | None = None, news: DataFrame | None = None,
                 as_of: Column | None = None):
        self.bars = scan_bars(bars)
        self.info, self.universe, self.news_items = info, universe, news
        self.as_of = as_of

    def only(self, *tickers: str) -> Market:
        """The same market restricted to some tickers."""
        wanted = [t.strip().upper() for t in tickers]
        as_of = self.bars.agg(F.max("dt")).scalar() if self.as_of is None else self.as_of
        return Market(self.bars.filter(F.col("ticker").isin(wanted)), self.info, self.universe,
                      self.news_items, as_of)

    def period(self, name: str | None) -> DataFrame:
        """Bars of a period (5d, 3mo, 6mo, 1y, 2y, 5y), or all."""
        return self.bars if name is None else period_filter(self.bars, name, self.as_of)

    def _listed(self, name: str | None) -> DataFrame:
        if name is None or self.universe is None:
            return self.bars
        return universe_filter(self.bars, self.universe, name)

    def _in(self, universe: str | None, period: str) -> DataFrame:
        as_of = self.bars.agg(F.max("dt")).scalar() if self.as_of is None else self.as_of
        return period_filter(self._listed(universe), period, as_of)

    def _places(self, name: str | None) -> DataFrame | None:
        if name is None or self.universe is None:
            return self.universe
        return self.universe.filter(F.col("name") == name)

    # Volatility

    def volatility(self, metric: str, window: int = 21, period: str | None = "2y") -> DataFrame:
        return estimators.estimator(self.period(period), metric, window)

    def panel(self, window: int = 21, period: str | None = "2y") -> DataFrame:
        return estimators.vol_panel(self.period(period), window)

    def summary(self, window: int = 21, period: str | None = "2y") -> DataFrame:
        return estimators.vol_summary(self.period(period), window)

    def regime(self, window: int = 21, period: str | None = "2y") -> DataFrame:
        return estimators.vol_regime(self.period(period), window)

    def histogram(self, bins: int = 50, period: str | None = "2y") -> DataFrame:
        return forecast.vol_histogram(self.period(period), bins)

    def recent(self, rows: int = 60, period: str | None = "2y") -> DataFrame:
        return forecast.recent_tail(self.period(period), rows)

    # Forecasts

    def forecast_simple(self, days: int = 30, period: str | None = "2y") -> DataFrame:
        bars = self.period(period)
        return forecast.forecast_mean_reversion(bars, days).join(
            forecast.forecast_confidence(bars), "ticker")

    def garch_fit(self, period: str | None = "2y", p: int = 1, q: int = 1) -> DataFrame:
        return garch.garch_fit(self.period(period), p, q)

    def garch_forecast(self, horizon: int = 30, period: str | None = "2y", p: int = 1, q: int = 1) -> DataFrame:
        fitted = garch.garch_search(garch.return_series(self.period(period)), p, q)
        return garch.garch_forecast(fitted, horizon)

    def garch_conditional_vol(self, period: str | None = "2y", p: int = 1, q: int = 1) -> DataFrame:
        fitted = garch.garch_search(garch.return_series(self.period(period)), p, q)
        return garch.conditional_vol_orders(fitted)

    def learned_forecast(self, horizon: int = 30, lookback: int = 60,
                         period: str | None = "2y", boosted: bool = False) -> DataFrame:
        return learned.learned_forecast(self.period(period), horizon, lookback, boosted)

    def ensemble(self, horizon: int = 30, garch_weight: float = 0.5,
                 period: str | None = "2y") -> DataFrame:
        market = Market(staged(self.period(period), "bars"))
        return learned.forecast_ensemble(
            market.garch_forecast(horizon, None),
            market.learned_forecast(horizon, learned.ENSEMBLE_LOOKBACK, None), garch_weight)

    def predict(self, days: int = 30, period: str | None = "2y") -> DataFrame:
        """Price, volatility, regime and both forecasts per ticker and step."""
        state = forecast.ticker_state(self.period(period))
        return forecast.predict_bundle(garch.garch_search(state), days)

    def signals(self, days: int = 30, period: str | None = "2y") -> DataFrame:
        return forecast.trading_signals(self.predict(days, period))

    def price_cone(self, days: int = 30, period: str | None = "2y") -> DataFrame:
        return forecast.price_cone(
            self.predict(days, period).withColumnRenamed("garch_volatility", "volatility"))

    # Joins by time

    def latest_bar(self, rows: DataFrame, time: str, period: str | None = None) -> DataFrame:
        """Rows (with a ticker) and the close and day of their ticker's latest bar at that time."""
        bars = self.period(period).select("ticker", F.col("dt").alias("bar_dt"), "close")
        return time_joins.asof_join(rows, bars, "ticker", time, "bar_dt", ["close"])

    def regime_stretches(self, period: str | None = None) -> DataFrame:
        """Runs of days in one volatility regime: ticker, regime, stretch, start, last, end, rows."""
        days = estimators.regime_days(self.period(period))
        runs = time_joins.stretches(days, "ticker", "dt", "regime")
        return runs.withColumn("end", F.coalesce("end", F.date_add("last", 1)))

    def in_regimes(self, rows: DataFrame, time: str, period: str | None = None) -> DataFrame:
        """Rows (with a ticker) and the regime stretch that their time lies in."""
        runs = self.regime_stretches(period).select("ticker", "regime", "stretch", "start", "end")
        return time_joins.interval_join(rows, runs, "ticker", time, "start", "end")

    # Screens, portfolios, analysis

    def screen(self, universe: str | None = None) -> DataFrame:
        scored = screener.screen_scores(screener.screen_metrics(self._in(universe, "6mo")))
        return screener.screen_top(scored)

    def invest(self, universe: str | None = "investment") -> DataFrame:
        return invest.invest_score(invest.invest_metrics(self._in(universe, "2y")))

    def portfolio(self, investment: float, universe: str | None = "investment") -> DataFrame:
        """Allocations of the three portfolios with their names and targets."""
        picks = invest.portfolio_picks(self.invest(universe))
        defined = portfolio_definitions(self.bars.sparkSession).withColumn(
            "target", F.col("target_multiple") * float(investment))
        return invest.portfolio_allocation(picks, investment).join(defined, "portfolio")

    def ranking(self, universe: str | None = "investment") -> DataFrame:
        """The 20 best scored tickers."""
        picks = invest.portfolio_picks(self.invest(universe))
        return picks.filter(F.col("portfolio") == "ranking").drop("portfolio")

    def analyze(self, universe: str | None = None) -> DataFrame:
        return analyzer.analysis(self._in(universe, "3mo"), self.info)

    def insufficient(self, universe: str | None = None) -> DataFrame:
        """Tickers that analyze leaves out, with their number of bars and the reason."""
        return analyzer.insufficient(self._in(universe, "3mo"))

    def buy_list(self, band: str = "all", universe: str | None = "buy_list") -> DataFrame:
        listed = analyzer.buy_list(self.analyze(universe), self._places(universe))
        return analyzer.price_band_filter(listed, band)

    def board_changes(self, days: int = 20, universe: str | None = "movers") -> DataFrame:
        """What entered, left and stayed on the boards of movers since ``days`` days with bars ago."""
        bars, places = self._listed(universe), self._places(universe)
        now, before = (market_boards.movers_top(
            market_boards.mover_metrics(market_boards.recent_days(b), self.info), places)
            for b in (bars, market_boards.bars_before(bars, days)))
        return market_boards.board_changes(now, before)

    def movers(self, universe: str | None = "movers") -> DataFrame:
        bars = self._listed(universe)
        return market_boards.movers_top(
            market_boards.mover_metrics(market_boards.recent_days(bars), self.info),
            self._places(universe))

    def facts(self) -> DataFrame:
        """Ticker facts with defaults, for every ticker with bars."""
        return scan_ticker_info(self.bars.select("ticker").distinct(), self.info)

    def news(self, category: str | None = None, universe: str = "news",
             tickers: int = 15) -> DataFrame:
        items = feeds.news_tickers(self.news_items, self._places(universe), tickers)
        latest = market_boards.news_latest(feeds.news_flatten(feeds.first_items(items)))
        return market_boards.news_by_category(latest, category)
