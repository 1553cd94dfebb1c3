"""The catalog's results as SQL for a second engine, written from the formulas."""

from __future__ import annotations

from sigmatide.operators import analyzer
from sigmatide.operators import forecast as fc
from sigmatide.operators.estimators import INTERPRETATION_ABOVE, INTERPRETATIONS, METRICS
from sigmatide.operators.market_boards import NEWS_KEYWORDS
from sigmatide.plans.catalog import (
    ALPHA,
    ALPHAS,
    BETA,
    BETAS,
    BOARD_DAYS,
    BOOSTED_LOOKBACK,
    GRID,
    HISTORY_GATE,
    INVESTMENT,
    LAG_INTERCEPT,
    LAG_WEIGHTS,
)
from sigmatide.sources.dimensions import PORTFOLIO_WEIGHTS


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0::DOUBLE AS {name or expr}"


def rs(names: str, digits: int = 6) -> str:
    return ", ".join(r(n, digits=digits) for n in names.split())


def day(expr: str = "dt", name: str = "dt") -> str:
    return f"strftime({expr}, '%Y-%m-%d') AS {name}"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


PRINTS = """
parts AS (
  SELECT p_partkey, trim(p_brand) AS short_name, upper(trim(p_brand)) AS ticker,
         CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS b
  FROM part),
prints AS (
  SELECT ticker, dt,
         100::DOUBLE * exp(6e-4 * (b % 5 - 2) * datediff('day', DATE '1995-01-01', dt))
           * (1 + (l_extendedprice - 55000) / 5e6 * (1 + b // 5)) AS price,
         l_quantity AS qty,
         row(l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS k
  FROM (SELECT *, CAST(l_shipdate AS DATE) AS dt FROM lineitem)
  JOIN parts ON l_partkey = p_partkey)"""
BARS = PRINTS + """,
all_bars AS (
  SELECT ticker, dt, arg_min(price, k) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, k) AS close, sum(qty) * 1e5 AS volume
  FROM prints GROUP BY ticker, dt)"""


def bars(months: int | None = None, gate: int = 0) -> str:
    """CTEs up to ``bars``: all of them, or of a period, for tickers with enough of them."""
    cut = "" if months is None else (
        "WHERE dt > (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem)"
        f" - INTERVAL {months} MONTH")
    return f"""{BARS},
bars AS (
  SELECT * FROM all_bars {cut}
  QUALIFY count(*) OVER (PARTITION BY ticker) >= {gate})"""


RETURNS = """
rets AS (
  SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS prev,
         close / lag(close) OVER w - 1 AS returns,
         ln(close / lag(close) OVER w) AS log_returns
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY dt))"""

Q21 = 1 - 2 / 22


def frame(months: int | None = None, gate: int = 0, n: int = 21, head: str | None = None) -> str:
    k = f"(0.34::DOUBLE / (1.34::DOUBLE + {n + 1}::DOUBLE / {n - 1}))"
    q = f"{Q21!r}::DOUBLE"
    return f"""{head or bars(months, gate)},{RETURNS},
terms AS (
  SELECT *, ln(high / low) AS hl, ln(close / open) AS co, ln(open / prev) AS oc,
         ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs,
         sum(returns * pow({q}, -(rn - 2))) OVER w * pow({q}, rn - 2) AS s1,
         sum(returns * returns * pow({q}, -(rn - 2))) OVER w * pow({q}, rn - 2) AS s2,
         (1 - pow({q}, rn - 1)) / (1 - {q}) AS s0,
         (1 - pow({q} * {q}, rn - 1)) / (1 - {q} * {q}) AS q0
  FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY dt ROWS UNBOUNDED PRECEDING)),
est AS (
  SELECT ticker, dt, rn, open, high, low, close, volume, returns,
    CASE WHEN rn > {n} THEN stddev_samp(returns) OVER w * sqrt(252) END AS historical,
    CASE WHEN rn >= {n} THEN sqrt(avg(hl * hl) OVER w * 252 / (4 * ln(2))) END AS parkinson,
    CASE WHEN rn >= {n} THEN
      sqrt(avg(hl * hl / 2 - (2 * ln(2) - 1) * co * co) OVER w * 252) END AS garman_klass,
    CASE WHEN rn >= {n} THEN
      sqrt(greatest(avg(rs) OVER w, 0) * 252) END AS rogers_satchell,
    CASE WHEN rn > {n} THEN
      sqrt((var_samp(oc) OVER w + {k} * var_samp(co) OVER w + (1 - {k}) * avg(rs) OVER w) * 252)
      END AS yang_zhang,
    CASE WHEN rn > 2 THEN
      sqrt(greatest(s2 / s0 - (s1 / s0) * (s1 / s0), 0) * s0 * s0 / (s0 * s0 - q0)) * sqrt(252)
      END AS ewma
  FROM terms
  WINDOW w AS (PARTITION BY ticker ORDER BY dt ROWS {n - 1} PRECEDING)),
panel AS (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS age,
         count(*) OVER (PARTITION BY ticker) AS n_panel,
         last_value(yang_zhang) OVER (PARTITION BY ticker ORDER BY dt
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_yz
  FROM est WHERE rn > {n}),
regimes AS (
  SELECT ticker, percentile, current,
         CASE WHEN percentile < 25 THEN 'Low' WHEN percentile < 75 THEN 'Normal'
              WHEN percentile < 90 THEN 'High' ELSE 'Extreme' END AS regime
  FROM (SELECT ticker, max(last_yz) AS current,
               count(*) FILTER (WHERE yang_zhang < last_yz - 1e-12) / count(*)::DOUBLE * 100
                 AS percentile
        FROM panel GROUP BY ticker))"""


OHLCV = f"ticker, {day()}, {rs('open high low close', 8)}, {r('volume')}"


def business_steps(source: str, days: int = 30) -> str:
    """CTE ``steps``: each row of ``source`` times its future weekdays, by listing days."""
    return f"""
last_days AS (SELECT DISTINCT ticker, dt AS last_dt FROM {source}),
steps AS (
  SELECT ticker, CAST(d AS DATE) AS day,
         row_number() OVER (PARTITION BY ticker ORDER BY d) AS step
  FROM (SELECT ticker, unnest(generate_series(last_dt + INTERVAL 1 DAY,
               last_dt + INTERVAL {2 * days + 7} DAY, INTERVAL 1 DAY)) AS d FROM last_days)
  WHERE isodow(d) <= 5
  QUALIFY step <= {days})"""


EWMA_STATE = """
ewma_state AS (
  SELECT ticker, max(dt) AS dt, arg_max(ewma, dt) AS v0, avg(ewma) AS m,
         stddev_samp(ewma) FILTER (WHERE back <= 21) AS spread
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS back FROM est)
  GROUP BY ticker),
confidences AS (SELECT ticker, greatest(0.3, 1 - spread / v0) AS confidence FROM ewma_state)"""

SERIES = """
series AS (
  SELECT ticker, max(dt) AS dt, list(returns * 100 ORDER BY dt) FILTER (WHERE rn > 1) AS pct,
         list(dt ORDER BY dt) FILTER (WHERE rn > 1) AS days
  FROM rets GROUP BY ticker),
squares AS (
  SELECT *, list_avg(pct) AS mu, len(pct) AS n_obs,
         list_transform(pct, lambda x: (x - list_avg(pct)) * (x - list_avg(pct))) AS sq
  FROM series),
resid AS (
  SELECT ticker, dt, days, mu, n_obs, list_avg(sq) AS s2,
         list_sum(list_transform(sq[1:75], lambda x, i: x * pow(0.94::DOUBLE, i - 1)))
           / list_sum(list_transform(sq[1:75], lambda x, i: pow(0.94::DOUBLE, i - 1))) AS v0,
         list_transform(sq, lambda x: {'e': x, 'f': x, 'w': x, 'l': x, 'v': x}) AS errs
  FROM squares)"""

# Two lags at most: e and f are the last squares, v the variance now, w the one before.
FOLD = ("list_reduce(errs, lambda a, x: {'e': x.e, 'f': a.e, 'w': a.v, 'l': a.l + ln(a.v) + x.e / a.v,"
        " 'v': omega + a1 * x.e + a2 * a.e + b1 * a.v + b2 * a.w},"
        " {'e': v0, 'f': v0, 'w': v0, 'l': 0::DOUBLE, 'v': omega + (a1 + a2 + b1 + b2) * v0})")


def by_lag(p: int, q: int, alpha: str = "alpha", beta: str = "beta") -> str:
    """Columns a1, a2, b1, b2: the sums spread evenly over the lags."""
    return ", ".join(f"{f'{total} / {n}' if k <= n else '0::DOUBLE'} AS {name}{k}"
                     for total, name, n in ((alpha, "a", p), (beta, "b", q)) for k in (1, 2))


GIVEN = f"""
model AS (
  SELECT *, {FOLD} AS f
  FROM (SELECT *, {ALPHA}::DOUBLE AS alpha, {BETA}::DOUBLE AS beta, {by_lag(1, 1, f"{ALPHA}::DOUBLE", f"{BETA}::DOUBLE")},
               (1 - {ALPHA}::DOUBLE - {BETA}::DOUBLE) * s2 AS omega FROM resid)),
fitted AS (SELECT *, f.v AS next, -0.5 * (n_obs * ln(2 * pi()) + f.l) AS ll FROM model)"""


def likelihood_grid(p: int = 1, q: int = 1) -> str:
    """CTE ``floors``: the best log-likelihood over the grid, per ticker."""
    points = ", ".join(f"({a!r}::DOUBLE, {g!r}::DOUBLE)" for a, g in GRID)
    return f"""
points(alpha, gap) AS (VALUES {points}),
scored AS (
  SELECT ticker, n_obs, {FOLD} AS f
  FROM (SELECT r.*, {by_lag(p, q, 'alpha', '(1 - gap - alpha)')}, s2 * gap AS omega FROM resid r CROSS JOIN points)),
floors AS (
  SELECT ticker, n_obs, max(-0.5 * (n_obs * ln(2 * pi()) + f.l)) AS floor FROM scored
  GROUP BY ticker, n_obs)"""


def fit_check(p: int, q: int) -> str:
    return f"""WITH {bars()},{RETURNS},{SERIES},{likelihood_grid(p, q)}
            SELECT ticker, n_obs, {r('floor', 'grid_log_likelihood', 4)},
              1::BIGINT AS fit_reaches_grid, 1::BIGINT AS criteria_follow FROM floors"""


GIVEN_ORDERS = f"""
model AS (
  SELECT *, {FOLD} AS f
  FROM (SELECT *, {ALPHAS[0]}::DOUBLE AS a1, {ALPHAS[1]}::DOUBLE AS a2, {BETAS[0]}::DOUBLE AS b1,
               {BETAS[1]}::DOUBLE AS b2, (1 - {sum(ALPHAS)!r}::DOUBLE - {sum(BETAS)!r}::DOUBLE) * s2 AS omega FROM resid))"""


LEVEL = "(omega / (1 - (alpha + beta)))"
VARIANCE = f"({LEVEL} + pow(alpha + beta, step - 1) * (next - {LEVEL}))"
GARCH_VOL = f"sqrt({VARIANCE} * 252) / 100"

BUNDLE = f"""{frame()},{EWMA_STATE},{SERIES},{GIVEN},{business_steps('fitted')},
bundle AS (
  SELECT g.ticker, step, day, g.n_obs, g.mu, g.omega, g.alpha, g.beta, g.ll, p.close AS current_price, p.yang_zhang AS current_volatility,
         regime, {GARCH_VOL} AS garch_volatility,
         m + (e.v0 - m) * pow(0.97::DOUBLE, step) AS simple_volatility, confidence
  FROM fitted g JOIN steps USING (ticker) JOIN panel p USING (ticker) JOIN regimes USING (ticker)
  JOIN ewma_state e USING (ticker) JOIN confidences USING (ticker)
  WHERE p.age = 1)"""
SIGNALS = f"""{BUNDLE},
signals AS (
  SELECT ticker, any_value(current_price) AS p, any_value(current_volatility) AS v,
         any_value(regime) AS regime, avg(garch_volatility) AS fv
  FROM bundle GROUP BY ticker)"""

SCALED_NAMES = ["returns", "historical", "ewma", "yang_zhang"]
SCALED = frame() + """,
scaled AS (
  SELECT ticker, dt, yang_zhang, """ + ", ".join(
    f"(({c}) - min({c}) OVER w) / CASE WHEN max({c}) OVER w = min({c}) OVER w THEN 1 "
    f"ELSE max({c}) OVER w - min({c}) OVER w END AS {c}_scaled" for c in SCALED_NAMES) + """
  FROM panel WINDOW w AS (PARTITION BY ticker))"""
SEQUENCES = SCALED + """,
seqs AS (
  SELECT ticker, dt, yang_zhang_scaled AS target, n_before * 3 AS n_values,
         first_return, last_ewma, steps_sum,
         row_number() OVER (PARTITION BY ticker ORDER BY dt) AS seq
  FROM (SELECT *, count(*) OVER w AS n_before,
               first_value(returns_scaled) OVER w AS first_return,
               last_value(ewma_scaled) OVER w AS last_ewma,
               sum(returns_scaled + historical_scaled + ewma_scaled) OVER w AS steps_sum
        FROM scaled
        WINDOW w AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
  WHERE n_before = 60)"""

SCREEN = frame(6, 30) + """,
screen AS (
  SELECT p.ticker, max(p.close) FILTER (WHERE age = 1) AS price,
         max(last_yz) AS volatility, avg(yang_zhang) AS avg_volatility,
         coalesce(max(p.close) FILTER (WHERE age = 1)
                  / max(p.close) FILTER (WHERE age = 5) - 1, 0) AS price_change_5d,
         coalesce(max(p.close) FILTER (WHERE age = 1)
                  / max(p.close) FILTER (WHERE age = 20) - 1, 0) AS price_change_20d,
         any_value(regime) AS regime, any_value(dollar_volume) AS dollar_volume
  FROM panel p JOIN regimes USING (ticker)
  JOIN (SELECT ticker, avg(close * volume) AS dollar_volume
        FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS back FROM bars)
        WHERE back <= 20 GROUP BY ticker) USING (ticker)
  GROUP BY p.ticker),
scored AS (
  SELECT *,
    0::BIGINT + CASE WHEN regime IN ('High', 'Extreme') THEN 30 WHEN regime = 'Normal' THEN 15 ELSE 0 END
    + CASE WHEN volatility > 0.40 THEN 25 WHEN volatility > 0.25 THEN 15 ELSE 0 END
    + CASE WHEN dollar_volume > 1e9 THEN 25 WHEN dollar_volume > 5e8 THEN 15 ELSE 0 END
    + CASE WHEN abs(price_change_5d) > 0.05 THEN 20 ELSE 0 END AS score_daytrade,
    0::BIGINT + CASE WHEN regime IN ('Normal', 'High') THEN 25 WHEN regime = 'Low' THEN 10 ELSE 0 END
    + CASE WHEN volatility > 0.20 AND volatility < 0.50 THEN 25 ELSE 0 END
    + CASE WHEN dollar_volume > 2e8 THEN 20 ELSE 0 END
    + CASE WHEN price_change_20d > 0.05 THEN 30 WHEN price_change_20d < -0.05 THEN 20 ELSE 0 END
      AS score_swing,
    CASE WHEN price_change_20d > 0.05 THEN '📈 Bullish' WHEN price_change_20d < -0.05
      THEN '📉 Bearish' ELSE '➡️ Neutral' END AS swing_direction,
    0::BIGINT + CASE regime WHEN 'Low' THEN 35 WHEN 'Normal' THEN 20 ELSE 0 END
    + CASE WHEN volatility < 0.25 THEN 30 WHEN volatility < 0.35 THEN 15 ELSE 0 END
    + CASE WHEN price > 100 THEN 20 WHEN price > 50 THEN 10 ELSE 0 END
    + CASE WHEN abs(price_change_20d) < 0.10 THEN 15 ELSE 0 END AS score_longterm
  FROM screen)"""

INVEST = frame(24, 252) + """,
year AS (
  SELECT *, max(close) OVER (PARTITION BY ticker ORDER BY dt ROWS UNBOUNDED PRECEDING) AS peak
  FROM panel WHERE age <= 252),
drawdowns AS (SELECT ticker, min((close - peak) / peak) AS max_drawdown FROM year GROUP BY ticker),
trends AS (
  SELECT ticker, regr_slope(close, 60 - age) / arg_min(close, age) * 252 AS trend_strength
  FROM panel WHERE age <= 60 GROUP BY ticker),
invest AS (
  SELECT *, price / close_1y - 1 AS return_1y, price / close_6m - 1 AS return_6m,
         CASE WHEN volatility > 0 THEN (price / close_1y - 1) / volatility ELSE 0 END
           AS sharpe_approx
  FROM (SELECT ticker, max(close) FILTER (WHERE age = 1) AS price, max(last_yz) AS volatility,
               max(close) FILTER (WHERE age = least(252, n_panel)) AS close_1y,
               max(close) FILTER (WHERE age = least(126, n_panel)) AS close_6m
        FROM panel GROUP BY ticker)
  JOIN drawdowns USING (ticker) JOIN trends USING (ticker) JOIN regimes USING (ticker)),
ranked AS (
  SELECT *,
    0::BIGINT + CASE WHEN return_1y > 0.50 THEN 30 WHEN return_1y > 0.25 THEN 20 WHEN return_1y > 0.10 THEN 10
         WHEN return_1y < -0.10 THEN -10 ELSE 0 END
    + CASE WHEN return_6m > 0.20 THEN 20 WHEN return_6m > 0.10 THEN 15 WHEN return_6m > 0 THEN 10
           ELSE 0 END
    + CASE WHEN sharpe_approx > 1.5 THEN 25 WHEN sharpe_approx > 1.0 THEN 15
           WHEN sharpe_approx > 0.5 THEN 10 ELSE 0 END
    + CASE WHEN max_drawdown > -0.15 THEN 15 WHEN max_drawdown > -0.25 THEN 5
           WHEN max_drawdown < -0.40 THEN -15 ELSE 0 END
    + CASE WHEN trend_strength > 0.30 THEN 20 WHEN trend_strength > 0.15 THEN 10
           WHEN trend_strength < -0.10 THEN -10 ELSE 0 END
    + CASE WHEN volatility > 0.15 AND volatility < 0.35 THEN 15 WHEN volatility > 0.60 THEN -10
           ELSE 0 END AS score
  FROM invest)"""
PICKS = INVEST + """,
qualified AS (
  SELECT 'conservative' AS portfolio, 6 AS size, * FROM ranked
    WHERE volatility < 0.35 AND return_1y > 0
  UNION ALL SELECT 'moderate', 8, * FROM ranked WHERE score > 20
  UNION ALL SELECT 'aggressive', 10, * FROM ranked WHERE return_1y > 0.20 OR trend_strength > 0.20
  UNION ALL SELECT 'ranking', 20, * FROM ranked),
picks AS (
  SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY score DESC, ticker) AS rank
  FROM qualified QUALIFY rank <= size)"""
WEIGHTS = ", ".join(f"({text(p)}, {i + 1}, {w}::DOUBLE)"
                    for p, ws in PORTFOLIO_WEIGHTS.items() for i, w in enumerate(ws))

INFO = """
brand_list AS (SELECT DISTINCT ticker, short_name, b FROM parts),
info AS (
  SELECT b.ticker, short_name, b,
         CASE WHEN b % 11 <> 0 THEN top END AS week52_high,
         CASE WHEN b % 11 <> 0 THEN bottom END AS week52_low,
         CASE WHEN b % 7 <> 0 THEN 2.5::DOUBLE * b END AS trailing_pe,
         pow(10::DOUBLE, 5 + b % 9) * 1.5::DOUBLE AS market_cap,
         (b - 8) / 50::DOUBLE AS revenue_growth, (b - 4) / 60::DOUBLE AS profit_margin,
         CASE WHEN b % 6 <> 0 THEN (b % 6) / 100::DOUBLE END AS dividend_yield
  FROM brand_list b LEFT JOIN (
    SELECT ticker, max(high) AS top, min(low) AS bottom
    FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS back
          FROM all_bars)
    WHERE back <= 252 GROUP BY ticker) y ON y.ticker = b.ticker)"""

ANALYZER = bars(3, 20) + "," + RETURNS + """,
aged AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS age FROM rets),
am AS (
  SELECT *, (price / c5 - 1) * 100 AS ret_5d, (price / c20 - 1) * 100 AS ret_20d,
         (price / c_first - 1) * 100 AS ret_60d,
         CASE WHEN v20 > 0 THEN (v5 / v20 - 1) * 100 ELSE 0 END AS volume_surge,
         CASE WHEN n >= 50 THEN mean_50 ELSE ma_20 END AS ma_50
  FROM (SELECT ticker, count(*) AS n,
               max(close) FILTER (WHERE age = 1) AS price, max(close) FILTER (WHERE age = 5) AS c5,
               max(close) FILTER (WHERE age = 20) AS c20,
               max(close) FILTER (WHERE rn = 1) AS c_first,
               stddev_samp(returns) * sqrt(252) * 100 AS volatility,
               avg(volume) FILTER (WHERE age <= 5) AS v5,
               avg(volume) FILTER (WHERE age <= 20) AS v20,
               avg(close) FILTER (WHERE age <= 20) AS ma_20,
               avg(close) FILTER (WHERE age <= 50) AS mean_50,
               100 - 100 / (1 + coalesce(avg(returns) FILTER (WHERE returns > 0), 0)
                 / coalesce(abs(avg(returns) FILTER (WHERE returns < 0)), 0.001)) AS rsi
        FROM aged GROUP BY ticker))"""
POSITIONED = ANALYZER + "," + INFO + """,
pos AS (
  SELECT am.*, coalesce(short_name, am.ticker) AS name, b,
         coalesce((price - week52_high) / week52_high * 100, 0) AS pct_from_high,
         coalesce((price - week52_low) / week52_low * 100, 0) AS pct_from_low,
         coalesce(trailing_pe, 0) AS pe, coalesce(revenue_growth, 0) AS growth,
         coalesce(profit_margin, 0) AS margin,
         price > ma_20 AS over20, price > ma_50 AS over50
  FROM am LEFT JOIN info ON info.ticker = am.ticker),
points AS (
  SELECT *, greatest(0::BIGINT, least(100::BIGINT, 50::BIGINT
    + CASE WHEN ret_5d > 5 THEN 15 WHEN ret_5d > 2 THEN 8 WHEN ret_5d < -5 THEN -10 ELSE 0 END
    + CASE WHEN ret_20d > 15 THEN 15 WHEN ret_20d > 8 THEN 10 WHEN ret_20d < -15 THEN -15
           WHEN ret_20d < -8 THEN -8 ELSE 0 END
    + CASE WHEN over20 AND over50 THEN 15 WHEN over20 THEN 8
           WHEN NOT over20 AND NOT over50 THEN -12 ELSE 0 END
    + CASE WHEN rsi < 30 THEN 12 WHEN rsi < 40 THEN 6 WHEN rsi > 70 THEN -12 ELSE 0 END
    + CASE WHEN volume_surge > 50 THEN 8 ELSE 0 END
    + CASE WHEN pct_from_high > -5 THEN 10
           WHEN pct_from_high < -30 AND ret_20d > 5 THEN 8 ELSE 0 END
    + CASE WHEN pct_from_low < 10 AND ret_5d > 0 THEN 8 ELSE 0 END
    + CASE WHEN growth > 0.20 THEN 10 WHEN growth > 0.10 THEN 5 ELSE 0 END)) AS score
  FROM pos),
listed AS (
  SELECT *, CASE WHEN score >= 75 THEN 'STRONG BUY' WHEN score >= 60 THEN 'BUY'
                 WHEN score >= 45 THEN 'HOLD' WHEN score >= 30 THEN 'SELL'
                 ELSE 'STRONG SELL' END AS signal
  FROM points),
best AS (SELECT * FROM listed WHERE score >= 50 ORDER BY score DESC, b, ticker LIMIT 20)"""
LIST_ROW = (f"ticker, name, {r('price', digits=8)}, signal, score, "
            f"{rs('ret_5d ret_20d rsi')}")

# One line per reason: side, condition, text before, number format, number, text after.
# Lines of one group are tried in order.
REASON_SQL = [
    [("buy", "ret_5d > 5", "🚀 Strong 5-day momentum: +", "{:.1f}", "ret_5d", "%"),
     ("buy", "ret_5d > 2", "📈 Positive 5-day trend: +", "{:.1f}", "ret_5d", "%"),
     ("sell", "ret_5d < -5", "📉 Weak 5-day momentum: ", "{:.1f}", "ret_5d", "%"),
     ("sell", "ret_5d < -2", "⚠️ Slight 5-day decline: ", "{:.1f}", "ret_5d", "%")],
    [("buy", "ret_20d > 15", "🔥 Excellent monthly performance: +", "{:.1f}", "ret_20d", "%"),
     ("buy", "ret_20d > 8", "💪 Strong 20-day gains: +", "{:.1f}", "ret_20d", "%"),
     ("sell", "ret_20d < -15", "🔻 Significant 20-day decline: ", "{:.1f}", "ret_20d", "%"),
     ("sell", "ret_20d < -8", "📉 Bearish 20-day trend: ", "{:.1f}", "ret_20d", "%")],
    [("buy", "over20 AND over50",
      "✅ Trading above both 20-day and 50-day moving averages (bullish)", "", "0", ""),
     ("buy", "over20", "📊 Above 20-day moving average", "", "0", ""),
     ("sell", "NOT over20 AND NOT over50", "❌ Below both moving averages (bearish trend)", "",
      "0", "")],
    [("buy", "rsi < 30", "💰 RSI at ", "{:.0f}", "rsi",
      " - Oversold, potential bounce opportunity"),
     ("buy", "rsi < 40", "👀 RSI at ", "{:.0f}", "rsi", " - Approaching oversold territory"),
     ("sell", "rsi > 70", "⚠️ RSI at ", "{:.0f}", "rsi", " - Overbought, potential pullback"),
     ("buy", "rsi > 60", "📈 RSI at ", "{:.0f}", "rsi", " - Healthy momentum")],
    [("buy", "volume_surge > 50", "📊 High volume surge: +", "{:.0f}", "volume_surge",
      "% above average (strong interest)"),
     ("buy", "volume_surge > 20", "📈 Increasing volume: +", "{:.0f}", "volume_surge",
      "% above average"),
     ("sell", "volume_surge < -30", "📉 Declining volume: ", "{:.0f}", "volume_surge",
      "% (waning interest)")],
    [("buy", "pct_from_high > -5", "🎯 Near 52-week high (", "{:+.1f}", "pct_from_high",
      "%) - Breakout potential"),
     ("buy", "pct_from_high < -30 AND ret_20d > 5", "💎 Down ", "{:.0f}", "abs(pct_from_high)",
      "% from high but recovering - Value opportunity"),
     ("sell", "pct_from_high < -30", "📉 Down ", "{:.0f}", "abs(pct_from_high)",
      "% from 52-week high")],
    [("buy", "pct_from_low < 10 AND ret_5d > 0",
      "📈 Near 52-week low with positive momentum - Potential reversal", "", "0", "")],
    [("buy", "volatility > 20 AND volatility < 40", "⚖️ Moderate volatility (", "{:.0f}",
      "volatility", "%) - Good risk/reward"),
     ("sell", "volatility > 60", "⚡ High volatility (", "{:.0f}", "volatility",
      "%) - Increased risk"),
     ("buy", "volatility < 15", "🛡️ Low volatility (", "{:.0f}", "volatility",
      "%) - More stable")],
    [("buy", "growth > 0.20", "📊 Strong revenue growth: ", "{:.0f}", "growth * 100", "% YoY"),
     ("buy", "growth > 0.10", "📈 Solid revenue growth: ", "{:.0f}", "growth * 100", "% YoY"),
     ("sell", "growth < -0.10", "📉 Declining revenue: ", "{:.0f}", "growth * 100", "% YoY")],
    [("buy", "pe > 10 AND pe < 25", "💰 Reasonable P/E ratio: ", "{:.1f}", "pe", ""),
     ("sell", "pe > 50", "⚠️ High P/E ratio: ", "{:.1f}", "pe", " - Potentially overvalued"),
     ("buy", "pe < 10 AND pe > 0", "💎 Low P/E ratio: ", "{:.1f}", "pe", " - Potential value")],
    [("buy", "margin > 0.20", "💵 Strong profit margin: ", "{:.1f}", "margin * 100", "%"),
     ("sell", "margin < 0", "📉 Negative profit margin: ", "{:.1f}", "margin * 100", "%")],
]


def reason_rows(side: str, limit: int) -> str:
    def line(rule):
        where, cond, before, shape, number, after = rule
        if where != side:
            return f"WHEN {cond} THEN NULL"
        return f"WHEN {cond} THEN {text(before)} || format({text(shape)}, {number}) || {text(after)}"

    cases = ", ".join("CASE " + " ".join(line(x) for x in group) + " END" for group in REASON_SQL)
    return f"""WITH {POSITIONED},
texts AS (
  SELECT ticker, list_filter([{cases}], lambda x: x IS NOT NULL)[1:{limit}] AS reasons FROM pos)
SELECT ticker, i - 1 AS pos, reasons[i] AS reason
FROM (SELECT ticker, reasons, unnest(range(1, len(reasons) + 1)) AS i FROM texts)"""


RECENT = """
recent_bars AS (
  SELECT * FROM bars WHERE dt >= (
    SELECT min(dt) FROM (SELECT DISTINCT dt FROM bars ORDER BY dt DESC LIMIT 5)))"""
CAP_LABEL = """CASE WHEN market_cap > 1e12 THEN '$' || format('{:.2f}', market_cap / 1e12) || 'T'
                 WHEN market_cap > 1e9 THEN '$' || format('{:.1f}', market_cap / 1e9) || 'B'
                 WHEN market_cap > 1e6 THEN '$' || format('{:.0f}', market_cap / 1e6) || 'M' ELSE 'N/A' END"""
MOVERS = """
movers AS (
  SELECT m.ticker, price, (price - previous) / previous * 100 AS change, volume,
         coalesce(week52_high, 0) AS high_52w, coalesce(week52_low, 0) AS low_52w,
         coalesce((price - week52_high) / week52_high * 100, 0) AS pct_from_high,
         coalesce((price - week52_low) / week52_low * 100, 0) AS pct_from_low,
         coalesce(dividend_yield, 0) * 100 AS div_yield, b
  FROM (SELECT ticker, max(close) FILTER (WHERE back = 1) AS price,
               max(close) FILTER (WHERE back = 2) AS previous,
               max(volume) FILTER (WHERE back = 1) AS volume
        FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS back
              FROM {bars})
        GROUP BY ticker HAVING count(*) >= 2) m
  LEFT JOIN info ON info.ticker = m.ticker),
boards AS (
  SELECT *, row_number() OVER (PARTITION BY board ORDER BY key DESC, b, ticker) AS rank
  FROM (SELECT 'most_active' AS board, volume AS key, * FROM movers
        UNION ALL SELECT 'gainers', change, * FROM movers
        UNION ALL SELECT 'losers', -change, * FROM movers
        UNION ALL SELECT 'high_52w', pct_from_high, * FROM movers
        UNION ALL SELECT 'low_52w', -pct_from_low, * FROM movers
        UNION ALL SELECT 'dividends', div_yield, * FROM movers)
  QUALIFY rank <= 10)"""
MOVER_ROW = ("ticker, " + rs("price", 8) + ", " + rs("change volume") + ", "
             + rs("high_52w low_52w", 8) + ", " + rs("pct_from_high pct_from_low div_yield"))

CATEGORY = "CASE " + " ".join(
    f"WHEN regexp_matches(lower({{0}}), '{'|'.join(words)}') THEN '{name}'"
    for name, words in NEWS_KEYWORDS.items()) + " ELSE 'general' END"
FEED = """
feed AS (
  SELECT 'BRAND#' || (doc_id % 25 + 1) AS ticker, doc_id % 25 + 1 AS place, doc_id,
         coalesce(text, 'No title') AS title, 'https://news.example/' || doc_id AS link,
         coalesce(source, 'Unknown') AS publisher,
         TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS t
  FROM documents
  WHERE doc_id % 25 + 1 IN (SELECT CAST(replace(p_brand, 'Brand#', '') AS INTEGER) FROM part)
    AND doc_id % 25 + 1 <= 15
  QUALIFY row_number() OVER (PARTITION BY doc_id % 25 ORDER BY doc_id) <= 3)"""
LATEST = FEED + """,
latest AS (
  SELECT *, """ + CATEGORY.format("title") + """ AS category
  FROM feed ORDER BY t DESC, place, doc_id LIMIT 50)"""
STAMP = "strftime(t, '%Y-%m-%d %H:%M:%S') AS time"

# Joins by time, each as a plain join.
DATED_NEWS = """
news AS (
  SELECT 'BRAND#' || (doc_id % 25 + 1) AS ticker, doc_id,
         TIMESTAMP '1992-06-01' + to_minutes(doc_id * 7919 % 3000000) AS published FROM documents)"""
REGIME_RUNS = f"""{frame()},
ranked AS (
  SELECT ticker, dt, (rank() OVER (PARTITION BY ticker ORDER BY round(yang_zhang, 9)) - 1)
           / count(*) OVER (PARTITION BY ticker)::DOUBLE * 100 AS p FROM panel),
day_regimes AS (
  SELECT ticker, dt, CASE WHEN p < 25 THEN 'Low' WHEN p < 75 THEN 'Normal' WHEN p < 90 THEN 'High' ELSE 'Extreme' END AS regime
  FROM ranked),
changes AS (
  SELECT *, lead(dt) OVER w AS following, CASE WHEN regime = lag(regime) OVER w THEN 0 ELSE 1 END AS change
  FROM day_regimes WINDOW w AS (PARTITION BY ticker ORDER BY dt)),
day_runs AS (SELECT *, sum(change) OVER (PARTITION BY ticker ORDER BY dt) AS stretch FROM changes),
regime_runs AS (
  SELECT ticker, regime, stretch::BIGINT AS stretch, min(dt) AS start, max(dt) AS last,
         coalesce(arg_max(following, dt), max(dt) + 1)::DATE AS "end", count(*) AS rows
  FROM (SELECT * REPLACE (coalesce(following, dt + 1) AS following) FROM day_runs) GROUP BY ticker, regime, stretch)"""
INTRADAY = """
ticks AS (
  SELECT event_id, event_type AS ticker, ts, value AS price,
         time_bucket(INTERVAL 30 MINUTE, ts) AS w, row(ts, event_id) AS k
  FROM events WHERE value > 0),
bars AS (
  SELECT ticker, w AS dt, arg_min(price, k) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, k) AS close, count(*)::DOUBLE AS volume FROM ticks GROUP BY ticker, w)"""

TICK_BARS = """
ticks AS (
  SELECT event_id, event_type AS ticker, ts, value AS price,
         date_trunc('hour', ts) AS w, row(ts, event_id) AS k
  FROM events WHERE value > 0),
tick_bars AS (
  SELECT ticker, w AS dt, arg_min(price, k) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, k) AS close, count(*)::DOUBLE AS volume
  FROM ticks GROUP BY ticker, w
  HAVING w + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ticks))"""
ALL_TICK_BARS = TICK_BARS.partition("\n  HAVING")[0].replace("tick_bars AS", "all_tick_bars AS") + ")"
TICK_TIME = "strftime(dt, '%Y-%m-%d %H:%M:%S') AS dt"


TICK_EWMA = f"""{RETURNS},
            w AS (SELECT *, rn - 2 AS i, {Q21!r}::DOUBLE AS q FROM rets),
            sums AS (SELECT a.ticker, a.dt, any_value(a.close) AS close, any_value(a.rn) AS rn,
                sum(pow(a.q, a.i - b.i)) AS s0, sum(pow(a.q, 2 * (a.i - b.i))) AS q0,
                sum(pow(a.q, a.i - b.i) * b.returns) AS s1,
                sum(pow(a.q, a.i - b.i) * b.returns * b.returns) AS s2
              FROM w a LEFT JOIN w b ON a.ticker = b.ticker AND b.rn > 1 AND b.rn <= a.rn
              GROUP BY a.ticker, a.dt)"""
TICK_EWMA_VALUE = """CASE WHEN rn > 2 THEN sqrt(greatest(s2 / s0 - (s1 / s0) * (s1 / s0), 0)
                * s0 * s0 / (s0 * s0 - q0)) * sqrt(252) END"""


def _case(pairs, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {text(v)}" for c, v in pairs) \
        + f" ELSE {text(otherwise)} END"


def _recommendations() -> str:
    lists = {k: "[" + ", ".join(text(x) for x in v) + "]" for k, v in fc.REGIME_TEXTS.items()}
    trend = _case([("fv > v * 1.1::DOUBLE", fc.TREND_UP), ("fv < v * 0.9::DOUBLE", fc.TREND_DOWN)],
                  fc.TREND_FLAT)
    chosen = ("CASE regime " + " ".join(f"WHEN '{k}' THEN {lists[k]}"
                                        for k in ("Low", "Normal", "High"))
              + f" ELSE {lists['Extreme']} END")
    return f"""WITH {SIGNALS},
texts AS (SELECT ticker, list_concat({chosen}, [{trend}]) AS recs FROM signals)
SELECT ticker, i - 1 AS pos, recs[i] AS recommendation
FROM (SELECT ticker, recs, unnest(range(1, len(recs) + 1)) AS i FROM texts)"""


def learned_path(lookback: int) -> str:
    """CTE ``learned``: the forecast of the model with the given weights, step by step."""
    (r2, h2, e2), (r1, h1, e1) = LAG_WEIGHTS

    def d(x: float) -> str:
        return f"({x!r}::DOUBLE)"

    return f"""{SCALED},
aged AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS back FROM scaled),
ends AS (
  SELECT ticker, max(dt) AS dt, min(yang_zhang) AS low,
         CASE WHEN max(yang_zhang) = min(yang_zhang) THEN 1
              ELSE max(yang_zhang) - min(yang_zhang) END AS span,
         max(returns_scaled) FILTER (WHERE back = 1) AS ret,
         max(returns_scaled) FILTER (WHERE back = 2) AS ret2,
         max(historical_scaled) FILTER (WHERE back = 1) AS his,
         max(historical_scaled) FILTER (WHERE back = 2) AS his2,
         max(ewma_scaled) FILTER (WHERE back = 1) AS ew,
         max(ewma_scaled) FILTER (WHERE back = 2) AS ew2
  FROM aged GROUP BY ticker HAVING count(*) >= {lookback}),
walk AS (
  SELECT ticker, 1 AS step, ret, his, ew,
         {d(LAG_INTERCEPT)} + {d(r2)} * ret2 + {d(h2)} * his2 + {d(e2)} * ew2
           + {d(r1)} * ret + {d(h1)} * his + {d(e1)} * ew AS p
  FROM ends
  UNION ALL
  SELECT ticker, step + 1, ret, p, p,
         {d(LAG_INTERCEPT)} + {d(r2)} * ret + {d(h2)} * his + {d(e2)} * ew
           + {d(r1)} * ret + {d(h1)} * p + {d(e1)} * p
  FROM walk WHERE step < 30),{business_steps('ends')},
learned AS (
  SELECT w.ticker, w.step, s.day, w.p * e.span + e.low AS volatility
  FROM walk w JOIN ends e ON e.ticker = w.ticker JOIN steps s ON s.ticker = w.ticker AND s.step = w.step)"""


def all_oracle_sql() -> dict[str, str]:
    sql = {
        "scan_bars": f"WITH {bars()} SELECT {OHLCV} FROM bars",
        "bars_daily": f"WITH {bars()} SELECT {OHLCV} FROM bars",
        "period_filter": f"WITH {bars(6)} SELECT {OHLCV} FROM bars",
        "period_filter_5d": f"""WITH {bars()} SELECT {OHLCV} FROM
            (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY dt DESC)
             <= 5)""",
        "universe_filter": f"""WITH {bars()} SELECT {OHLCV} FROM bars
            WHERE ticker IN (SELECT ticker FROM parts WHERE b % 2 = 0)""",
        "min_history": f"WITH {bars(gate=HISTORY_GATE)} SELECT {OHLCV} FROM bars",
        "scan_ticker_info": f"""WITH {bars()},{INFO}
            SELECT ticker, short_name, {r('coalesce(week52_high, 0)', 'week52_high', 8)},
              {r('coalesce(week52_low, 0)', 'week52_low', 8)},
              {r('coalesce(trailing_pe, 0)', 'trailing_pe')}, {r('market_cap')},
              {r('revenue_growth')}, {r('profit_margin')},
              {r('coalesce(dividend_yield, 0)', 'dividend_yield')} FROM info""",
        "news_flatten": f"""WITH {FEED} SELECT ticker, place AS pos, doc_id AS ord, title, link,
            publisher, {STAMP} FROM feed""",
        "simple_return": f"WITH {bars()},{RETURNS} SELECT ticker, {day()}, {r('returns')} FROM rets",
        "log_return": f"WITH {bars()},{RETURNS} SELECT ticker, {day()}, {r('log_returns')} FROM rets",
        "vol_panel": f"""WITH {frame()} SELECT ticker, {day()}, {r('close', digits=8)},
            {r('returns')}, {rs(' '.join(METRICS))} FROM panel""",
        "vol_summary": f"WITH {frame()} " + " UNION ALL ".join(f"""
            SELECT ticker, count(*) AS data_points,
              {r('max(close) FILTER (WHERE age = 1)', 'current_price', 8)}, '{m}' AS metric,
              {r(f'max({m}) FILTER (WHERE age = 1)', 'current')}, {r(f'avg({m})', 'average')},
              {r(f'min({m})', 'min')}, {r(f'max({m})', 'max')},
              {r(f'count(*) FILTER (WHERE {m} < cur - 1e-12) / count(*)::DOUBLE * 100',
                 'percentile')}
            FROM (SELECT *, max({m}) FILTER (WHERE age = 1) OVER (PARTITION BY ticker) AS cur
                  FROM panel) GROUP BY ticker""" for m in METRICS),
        "vol_regime": f"""WITH {frame()} SELECT ticker, {r('current')}, {r('percentile')}, regime
            FROM regimes""",
        "vol_interpretation": f"""WITH {frame()} SELECT ticker, {r('current')},
            {_case([(f'current < {x}', t) for x, t in INTERPRETATIONS], INTERPRETATION_ABOVE)}
            AS interpretation FROM regimes""",
        "business_days": f"""WITH {bars()},
            last_bar AS (SELECT ticker, max(dt) AS dt FROM bars GROUP BY ticker),
            {business_steps('last_bar')} SELECT ticker, {day('day')}, step FROM steps""",
        "forecast_mean_reversion": f"""WITH {frame()},{EWMA_STATE},{business_steps('ewma_state')}
            SELECT ticker, step, {day('day')},
              {r('m + (v0 - m) * pow(0.97::DOUBLE, step)', 'volatility')}
            FROM ewma_state JOIN steps USING (ticker)""",
        "forecast_confidence": f"""WITH {frame()},{EWMA_STATE}
            SELECT ticker, {r('confidence')} FROM confidences""",
        "garch_fit": fit_check(1, 1),
        "garch_fit_21": fit_check(2, 1),
        "garch_fit_12": fit_check(1, 2),
        "garch_forecast_orders": f"""WITH RECURSIVE {bars()},{RETURNS},{SERIES},{GIVEN_ORDERS},
            {business_steps('model')},
            path AS (
              SELECT ticker, 1 AS step, f.v AS variance, f.e AS square, f.w AS before FROM model
              UNION ALL
              SELECT ticker, step + 1, omega + (a1 + b1) * variance + a2 * square + b2 * before, variance, variance
              FROM path JOIN model USING (ticker) WHERE step < 30)
            SELECT ticker, step, {day('day')}, {r('variance')}, {r('sqrt(variance * 252) / 100', 'volatility')},
              {r('sqrt(variance * 252) / 100 * 0.8::DOUBLE', 'lower_ci')},
              {r('sqrt(variance * 252) / 100 * 1.2::DOUBLE', 'upper_ci')}
            FROM path JOIN steps USING (ticker, step)""",
        "garch_conditional_vol_orders": f"""WITH RECURSIVE {bars()},{RETURNS},{SERIES},{GIVEN_ORDERS},
            path AS (
              SELECT ticker, 1 AS i, omega + (a1 + a2 + b1 + b2) * v0 AS v, v0 AS w FROM model
              UNION ALL
              SELECT ticker, i + 1, omega + a1 * errs[i].e + a2 * coalesce(errs[i - 1].e, v0) + b1 * v + b2 * w, v
              FROM path JOIN model USING (ticker) WHERE i < n_obs)
            SELECT ticker, {day('days[i]')}, {r('sqrt(v * 252) / 100', 'conditional_volatility')}
            FROM path JOIN model USING (ticker)""",
        "predict_bundle_fitted": f"""WITH {BUNDLE},{likelihood_grid()} SELECT ticker, step, {day('day')},
            {r('current_price', digits=8)}, regime, {rs('current_volatility simple_volatility confidence')},
            b.n_obs, {r('floor', 'grid_log_likelihood', 4)}, 1::BIGINT AS fit_reaches_grid,
            1::BIGINT AS likelihood_follows, 1::BIGINT AS forecast_follows FROM bundle b JOIN floors USING (ticker)""",
        "trading_signals_fitted": f"""WITH {SIGNALS},{likelihood_grid()} SELECT ticker, {r('p', 'current_price', 8)},
            {r('v', 'current_volatility')}, regime AS volatility_regime,
            {r('p * (1 - v / sqrt(252))', 'daily_low', 4)}, {r('p * (1 + v / sqrt(252))', 'daily_high', 4)},
            {r('floor', 'grid_log_likelihood', 4)}, 1::BIGINT AS fit_reaches_grid, 1::BIGINT AS ranges_follow
            FROM signals JOIN floors USING (ticker)""",
        "volatility_recommendations_fitted": f"""WITH all_texts AS ({_recommendations()})
            SELECT ticker, pos, CASE WHEN pos = max(pos) OVER (PARTITION BY ticker) THEN 'the trend'
              ELSE recommendation END AS recommendation, 1::BIGINT AS fit_reaches_grid, 1::BIGINT AS trend_follows
            FROM all_texts""",
        "price_cone_fitted": f"""WITH {BUNDLE} SELECT ticker, step, {day('day')},
            {r('current_price', 'expected_price', 8)}, 1::BIGINT AS fit_reaches_grid, 1::BIGINT AS cone_follows
            FROM bundle""",
        "forecast_ensemble_fitted": f"""WITH RECURSIVE {learned_path(30)},{SERIES},{likelihood_grid()}
            SELECT ticker, step, {day('l.day')}, {r('floor', 'grid_log_likelihood', 4)},
              1::BIGINT AS fit_reaches_grid, 1::BIGINT AS garch_follows, 1::BIGINT AS blend_follows
            FROM learned l JOIN floors USING (ticker)""",
        "lag_regression_fit": f"""WITH {SEQUENCES},
            training AS (SELECT count(*) AS n FROM
              (SELECT seq <= floor(count(*) OVER (PARTITION BY ticker) * 0.8::DOUBLE) AS train FROM seqs)
              WHERE train)
            SELECT CAST(i AS BIGINT) AS feature, 0::DOUBLE AS gradient, n
            FROM training, (SELECT unnest(range(0, 181)) AS i)""",
        "boosted_trees_fit": f"""WITH {SCALED}
            SELECT ticker, floor((count(*) - {BOOSTED_LOOKBACK}) * 0.8::DOUBLE)::BIGINT AS n_train,
              1::BIGINT AS trees_follow, 1::BIGINT AS beats_mean FROM scaled GROUP BY ticker""",
        "lag_regression_forecast": f"""WITH RECURSIVE {learned_path(60)}
            SELECT ticker, step, {day('day')}, {r('volatility')},
              {r('volatility * 0.85::DOUBLE', 'lower_ci')}, {r('volatility * 1.15::DOUBLE', 'upper_ci')}
            FROM learned""",
        "forecast_ensemble": f"""WITH RECURSIVE {learned_path(30)},{SERIES},{GIVEN},
            mixed AS (SELECT l.ticker, step, l.day, {GARCH_VOL} AS garch, l.volatility AS learned
              FROM learned l JOIN fitted g ON g.ticker = l.ticker)
            SELECT ticker, step, {day('day')}, {rs('garch learned')},
              {r('(garch + learned) / 2', 'ensemble')},
              {r('(garch + learned) / 2 * 0.8::DOUBLE', 'lower_ci')},
              {r('(garch + learned) / 2 * 1.2::DOUBLE', 'upper_ci')} FROM mixed""",
        "screen_top5": f"""WITH {SCREEN},
            styles AS (SELECT 'daytrade' AS style, score_daytrade AS score, * FROM scored
              UNION ALL SELECT 'swing', score_swing, * FROM scored
              UNION ALL SELECT 'longterm', score_longterm, * FROM scored)
            SELECT style, row_number() OVER (PARTITION BY style ORDER BY score DESC, ticker) AS rank,
              ticker, score, {r('price', digits=8)}, {r('volatility')}, regime,
              {rs('price_change_5d price_change_20d')}, {r('dollar_volume', digits=0)},
              swing_direction FROM styles QUALIFY rank <= 5""",
        "insufficient_data": f"""WITH {bars()} SELECT ticker, least(5, count(*)) AS n_bars,
            'insufficient data: ' || least(5, count(*)) || ' of 20 bars' AS reason
            FROM bars GROUP BY ticker""",
        "news_latest10": f"""WITH {LATEST} SELECT ticker, title, link, publisher, {STAMP}, category
            FROM (SELECT * FROM latest ORDER BY t DESC, place, doc_id LIMIT 10)""",
        "news_by_keyword": f"""WITH items AS (
              SELECT 'BRAND#' || (doc_id % 25 + 1) AS ticker, doc_id, coalesce(text, 'No title') AS title,
                     'https://news.example/' || doc_id AS link,
                     coalesce(source, 'Unknown') AS publisher,
                     TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS t FROM documents)
            SELECT ticker, title, link, publisher, {STAMP}, category
            FROM (SELECT *, {CATEGORY.format('title')} AS category FROM items)
            WHERE category = 'mergers' ORDER BY t DESC, doc_id LIMIT 30""",
        "garch_forecast": f"""WITH {bars()},{RETURNS},{SERIES},{GIVEN},{business_steps('fitted')}
            SELECT ticker, step, {day('day')}, {r(VARIANCE, 'variance')},
              {r(GARCH_VOL, 'volatility')}, {r(f'({GARCH_VOL}) * 0.8::DOUBLE', 'lower_ci')},
              {r(f'({GARCH_VOL}) * 1.2::DOUBLE', 'upper_ci')}
            FROM fitted JOIN steps USING (ticker)""",
        "garch_conditional_vol": f"""WITH RECURSIVE {bars()},{RETURNS},{SERIES},{GIVEN},
            path AS (
              SELECT ticker, 1 AS i, omega + (alpha + beta) * v0 AS v FROM fitted
              UNION ALL
              SELECT ticker, i + 1, omega + alpha * errs[i].e + beta * v
              FROM path JOIN fitted USING (ticker) WHERE i < n_obs)
            SELECT ticker, {day('days[i]')}, {r('sqrt(v * 252) / 100', 'conditional_volatility')}
            FROM path JOIN fitted USING (ticker)""",
        "minmax_scale": f"""WITH {SCALED} SELECT ticker, {day()},
            {rs(' '.join(f'{c}_scaled' for c in SCALED_NAMES))} FROM scaled""",
        "lag_sequences": f"""WITH {SEQUENCES} SELECT ticker, {day()}, seq, n_values,
            {rs('target first_return last_ewma')}, {r('steps_sum', digits=5)} FROM seqs""",
        "chrono_split": f"""WITH {SEQUENCES} SELECT ticker, {day()}, seq,
            CAST(seq <= floor(count(*) OVER (PARTITION BY ticker) * 0.8::DOUBLE) AS BIGINT)
              AS is_train FROM seqs""",
        "regression_metrics": f"""WITH {frame()},
            given AS (SELECT ticker, yang_zhang - lag(historical) OVER
                (PARTITION BY ticker ORDER BY dt) AS e FROM panel)
            SELECT ticker, count(*) AS n, {r('sqrt(avg(e * e))', 'val_rmse')},
              {r('avg(abs(e))', 'val_mae')} FROM given WHERE e IS NOT NULL GROUP BY ticker""",
        "forecast_ensemble_given": f"""WITH {frame()},{EWMA_STATE},{SERIES},{GIVEN},
            {business_steps('fitted')},
            mixed AS (SELECT ticker, step, day, {GARCH_VOL} AS garch,
                m + (e.v0 - m) * pow(0.97::DOUBLE, step) AS learned
              FROM fitted JOIN steps USING (ticker) JOIN ewma_state e USING (ticker))
            SELECT ticker, step, {day('day')}, {rs('garch learned')},
              {r('(garch + learned) / 2', 'ensemble')},
              {r('(garch + learned) / 2 * 0.8::DOUBLE', 'lower_ci')},
              {r('(garch + learned) / 2 * 1.2::DOUBLE', 'upper_ci')} FROM mixed""",
        "predict_bundle": f"""WITH {BUNDLE} SELECT ticker, step, {day('day')},
            {r('current_price', digits=8)}, regime,
            {rs('current_volatility garch_volatility simple_volatility confidence')},
            n_obs, {rs('mu omega alpha beta')}, {r('ll', 'log_likelihood', 4)},
            {r('8 - 2 * ll', 'aic', 4)}, {r('4 * ln(n_obs) - 2 * ll', 'bic', 4)}
            FROM bundle""",
        "trading_signals": f"""WITH {SIGNALS} SELECT ticker, {r('p', 'current_price', 8)},
            {r('v', 'current_volatility')}, regime AS volatility_regime,
            {r('fv', 'forecast_volatility')},
            {r('p * (1 - v / sqrt(252))', 'daily_low', 4)},
            {r('p * (1 + v / sqrt(252))', 'daily_high', 4)},
            {r('p * (1 - fv * sqrt(30 / 252::DOUBLE))', 'd30_low', 4)},
            {r('p * (1 + fv * sqrt(30 / 252::DOUBLE))', 'd30_high', 4)} FROM signals""",
        "volatility_recommendations": _recommendations(),
        "price_cone": f"""WITH {BUNDLE},
            cone AS (SELECT *, current_price AS p, sqrt(sum(garch_volatility * garch_volatility / 252)
                OVER (PARTITION BY ticker ORDER BY step ROWS UNBOUNDED PRECEDING)) AS c FROM bundle)
            SELECT ticker, step, {day('day')}, {r('c', 'cum_volatility')},
              {r('p', 'expected_price', 8)}, {r('p * (1 - c)', 'lower_1sd', 4)},
              {r('p * (1 + c)', 'upper_1sd', 4)}, {r('p * (1 - 2 * c)', 'lower_2sd', 4)},
              {r('p * (1 + 2 * c)', 'upper_2sd', 4)} FROM cone""",
        "vol_histogram": f"""WITH {frame()},
            edges AS (SELECT ticker, min(yang_zhang) AS lo, max(yang_zhang) AS hi FROM panel
              GROUP BY ticker),
            placed AS (SELECT p.*, lo, hi, CASE WHEN hi > lo
                THEN least(50, floor((yang_zhang - lo) / (hi - lo) * 50) + 1) ELSE 1 END AS bin
              FROM panel p JOIN edges USING (ticker))
            SELECT ticker, CAST(bin AS BIGINT) AS bin,
              {r('any_value(lo + (hi - lo) / 50 * (bin - 1))', 'bin_low')},
              {r('any_value(lo + (hi - lo) / 50 * bin)', 'bin_high')},
              count(*) AS frequency, {r('any_value(last_yz)', 'current')}
            FROM placed GROUP BY ticker, bin""",
        "recent_tail": f"""WITH {frame()} SELECT ticker, {day()}, age, {r('close', digits=8)},
            {r('yang_zhang')} FROM panel WHERE age <= 60""",
        "screen_metrics": f"""WITH {SCREEN} SELECT ticker, {r('price', digits=8)},
            {rs('volatility avg_volatility')},
            {r('(volatility - avg_volatility) / avg_volatility', 'vol_trend')}, regime,
            {rs('price_change_5d price_change_20d')}, {r('dollar_volume', digits=0)}
            FROM screen""",
        "score_daytrade": f"WITH {SCREEN} SELECT ticker, score_daytrade FROM scored",
        "score_swing": f"WITH {SCREEN} SELECT ticker, score_swing, swing_direction FROM scored",
        "score_longterm": f"WITH {SCREEN} SELECT ticker, score_longterm FROM scored",
        "screen_top50": f"""WITH {SCREEN},
            styles AS (SELECT 'daytrade' AS style, score_daytrade AS score, * FROM scored
              UNION ALL SELECT 'swing', score_swing, * FROM scored
              UNION ALL SELECT 'longterm', score_longterm, * FROM scored)
            SELECT style, row_number() OVER (PARTITION BY style ORDER BY score DESC, ticker) AS rank,
              ticker, score, {r('price', digits=8)}, {r('volatility')}, regime,
              {rs('price_change_5d price_change_20d')}, {r('dollar_volume', digits=0)},
              swing_direction FROM styles QUALIFY rank <= 50""",
        "invest_metrics": f"""WITH {INVEST} SELECT ticker, {r('price', digits=8)},
            {rs('volatility return_1y return_6m sharpe_approx max_drawdown trend_strength')},
            regime FROM invest""",
        "max_drawdown": f"WITH {INVEST} SELECT ticker, {r('max_drawdown')} FROM drawdowns",
        "trend_strength": f"WITH {INVEST} SELECT ticker, {r('trend_strength')} FROM trends",
        "invest_score": f"WITH {INVEST} SELECT ticker, score FROM ranked",
        "portfolio_picks": f"""WITH {PICKS} SELECT portfolio, rank, ticker, score,
            {r('volatility')} FROM picks""",
        "portfolio_allocation": f"""WITH {PICKS},
            weights(portfolio, rank, listed) AS (VALUES {WEIGHTS}),
            raw AS (SELECT p.*, coalesce(listed, 1 / count(*) OVER (PARTITION BY p.portfolio)) AS w
              FROM picks p LEFT JOIN weights USING (portfolio, rank)
              WHERE portfolio <> 'ranking'),
            final AS (SELECT *, w / sum(w) OVER (PARTITION BY portfolio) AS weight FROM raw)
            SELECT portfolio, rank, ticker, {r('price', digits=8)}, {r('weight')},
              {r(f'{INVESTMENT} * weight', 'dollars', 2)},
              CAST(floor({INVESTMENT} * weight / price) AS BIGINT) AS shares,
              {rs('return_1y volatility')}, score FROM final""",
        "analyzer_metrics": f"""WITH {ANALYZER} SELECT ticker, {r('price', digits=8)},
            {rs('ret_5d ret_20d ret_60d volatility volume_surge')}, {rs('ma_20 ma_50', 4)},
            CAST(price > ma_20 AS BIGINT) AS above_ma_20,
            CAST(price > ma_50 AS BIGINT) AS above_ma_50, {r('rsi')} FROM am""",
        "rsi_mean": f"WITH {ANALYZER} SELECT ticker, {r('rsi')} FROM am",
        "week52_position": f"""WITH {POSITIONED} SELECT ticker,
            {rs('pct_from_high pct_from_low')} FROM pos""",
        "buy_score": f"WITH {POSITIONED} SELECT ticker, score FROM points",
        "buy_reasons": reason_rows("buy", analyzer.MAX_BUY_REASONS),
        "sell_reasons": reason_rows("sell", analyzer.MAX_SELL_REASONS),
        "signal_label": f"WITH {POSITIONED} SELECT ticker, score, signal FROM listed",
        "market_cap_label": f"WITH {bars()},{INFO} SELECT ticker, {CAP_LABEL} AS cap_label FROM info",
        "buy_list": f"WITH {POSITIONED} SELECT {LIST_ROW} FROM best",
        "buy_list_top5": f"""WITH {POSITIONED} SELECT {LIST_ROW} FROM
            (SELECT * FROM best ORDER BY score DESC, b, ticker LIMIT 5)""",
        "price_band_filter": f"""WITH {POSITIONED} SELECT {LIST_ROW} FROM
            (SELECT * FROM best WHERE price >= 10 AND price < 100
             ORDER BY score DESC, b, ticker LIMIT 15)""",
        "mover_metrics": f"""WITH {bars()},{INFO},{RECENT},{MOVERS.format(bars='recent_bars')}
            SELECT {MOVER_ROW} FROM movers""",
        "movers_top10": f"""WITH {bars()},{INFO},{RECENT},{MOVERS.format(bars='recent_bars')}
            SELECT board, rank, {MOVER_ROW} FROM boards""",
        "news_category": f"SELECT doc_id, {CATEGORY.format('text')} AS category FROM documents",
        "news_latest50": f"""WITH {LATEST} SELECT ticker, title, link, publisher, {STAMP}, category
            FROM latest""",
        "news_by_category": f"""WITH {LATEST} SELECT ticker, title, link, publisher, {STAMP},
            category FROM (SELECT * FROM latest WHERE category = 'general'
                           ORDER BY t DESC, place, doc_id LIMIT 30)""",
        "sketch_percentiles": f"""WITH {frame()},
            month_rows AS (SELECT *, date_trunc('month', dt) AS m, date_trunc('month', max(dt) OVER ()) AS newest FROM panel),
            periods(period, months) AS (VALUES ('all', 12000), ('5y', 60), ('1y', 12))
            SELECT period, ticker, count(*) AS merged, count(*) AS n,
              {r('avg((yang_zhang < last_yz - 1e-12)::INT) * 100', 'percentile')}, 1::BIGINT AS rank_within,
              1::BIGINT AS count_within
            FROM month_rows JOIN periods ON m >= newest - to_months(months::INT) GROUP BY period, ticker""",
        "screen_cube": f"""WITH {SCREEN},{INFO},
            styles AS (SELECT 'daytrade' AS style, score_daytrade AS score, * FROM scored
              UNION ALL SELECT 'swing', score_swing, * FROM scored
              UNION ALL SELECT 'longterm', score_longterm, * FROM scored),
            top AS (SELECT * FROM styles QUALIFY row_number() OVER (PARTITION BY style ORDER BY score DESC, ticker) <= 50),
            labelled AS (SELECT top.*, {CAP_LABEL} AS cap_label FROM top LEFT JOIN info USING (ticker))
            SELECT style, regime, cap_label, GROUPING(style, regime, cap_label)::BIGINT AS level, count(*) AS n,
              count(DISTINCT ticker) AS tickers, {r('avg(score)', 'mean_score')}, max(score) AS best_score
            FROM labelled GROUP BY CUBE (style, regime, cap_label)""",
        "board_changes": f"""WITH {bars()},{INFO},
            old_bars AS (SELECT * FROM bars WHERE dt <= (
              SELECT min(dt) FROM (SELECT DISTINCT dt FROM bars ORDER BY dt DESC LIMIT {BOARD_DAYS + 1}))),
            now AS (WITH {RECENT},{MOVERS.format(bars='recent_bars')} SELECT board, ticker, rank FROM boards),
            before AS (WITH {RECENT.replace('FROM bars', 'FROM old_bars')},{MOVERS.format(bars='recent_bars')}
              SELECT board, ticker, rank FROM boards),
            moves AS (
              SELECT *, 'entered' AS change FROM (SELECT board, ticker FROM now EXCEPT ALL SELECT board, ticker FROM before)
              UNION ALL
              SELECT *, 'left' FROM (SELECT board, ticker FROM before EXCEPT ALL SELECT board, ticker FROM now)
              UNION ALL
              SELECT *, 'stayed' FROM (SELECT board, ticker FROM now INTERSECT ALL SELECT board, ticker FROM before))
            SELECT m.board, m.ticker, change, n.rank::BIGINT AS rank_now, b.rank::BIGINT AS rank_before,
              (m.ticker NOT IN (SELECT ticker FROM before))::BIGINT AS newcomer
            FROM moves m LEFT JOIN now n ON n.board = m.board AND n.ticker = m.ticker
            LEFT JOIN before b ON b.board = m.board AND b.ticker = m.ticker""",
        "news_asof_bar": f"""WITH {bars()},{DATED_NEWS}
            SELECT n.ticker, doc_id, strftime(published, '%Y-%m-%d %H:%M:%S') AS published,
              {day('b.dt', 'bar_dt')}, {r('close', digits=8)}, {r('volume')}
            FROM news n ASOF LEFT JOIN bars b ON n.ticker = b.ticker AND n.published >= b.dt""",
        "ticks_asof_bar": f"""WITH {ALL_TICK_BARS}
            SELECT event_id, t.ticker, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
              strftime(finished, '%Y-%m-%d %H:%M:%S') AS finished, {r('close')}
            FROM ticks t ASOF LEFT JOIN (SELECT ticker, dt + INTERVAL 1 HOUR AS finished, close FROM all_tick_bars) b
              ON t.ticker = b.ticker AND t.ts >= b.finished""",
        "prints_before_bar": f"""WITH {bars()}
            SELECT p.ticker, {day('p.dt')}, {day('b.dt', 'before_dt')}, count(*) AS n,
              {r('avg(price / close - 1)', 'mean_move')}
            FROM prints p ASOF LEFT JOIN bars b ON p.ticker = b.ticker AND p.dt > b.dt GROUP BY p.ticker, p.dt, b.dt""",
        "regime_stretches": f"""WITH {REGIME_RUNS}
            SELECT ticker, regime, stretch, {day('start', 'start')}, {day('last', 'last')}, {day('"end"', '"end"')}, rows
            FROM regime_runs""",
        "news_in_regimes": f"""WITH {REGIME_RUNS},{DATED_NEWS}
            SELECT n.ticker, doc_id, strftime(published, '%Y-%m-%d %H:%M:%S') AS published, regime, stretch,
              {day('start', 'start')}, {day('"end"', '"end"')}
            FROM news n JOIN regime_runs g ON g.ticker = n.ticker
              AND published BETWEEN start AND "end"::TIMESTAMP - INTERVAL 1 MICROSECOND""",
        "regime_overlaps": f"""WITH {REGIME_RUNS},
            fall_days AS (SELECT ticker, dt, lead(dt) OVER w AS following, returns < 0 AS falls,
                CASE WHEN (returns < 0) = lag(returns < 0) OVER w THEN 0 ELSE 1 END AS change
              FROM rets WHERE returns IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY dt)),
            fall_runs AS (SELECT ticker, min(dt) AS start, max(coalesce(following, dt + 1))::DATE AS "end", count(*) AS n
              FROM (SELECT *, sum(change) OVER (PARTITION BY ticker ORDER BY dt) AS run FROM fall_days)
              GROUP BY ticker, run, falls HAVING falls AND count(*) >= 2)
            SELECT g.ticker, regime, stretch, {day('f.start', 'falls_from')}, n AS falls,
              {day('greatest(f.start, g.start)', 'overlap_start')}, {day('least(f."end", g."end")', 'overlap_end')}
            FROM regime_runs g JOIN fall_runs f ON f.ticker = g.ticker AND g.start < f."end" AND f.start < g."end" """,
        "vol_intraday": f"""WITH {frame(head=INTRADAY)}
            SELECT ticker, strftime(dt, '%Y-%m-%d %H:%M:%S') AS dt, {', '.join(
                r(f'{m} * sqrt(48)', m, 4) for m in METRICS if m != 'ewma')} FROM est""",
        "stream_bars": f"""WITH {TICK_BARS} SELECT ticker, {TICK_TIME},
            {rs('open high low close volume')} FROM tick_bars""",
        "stream_ewma": f"""WITH {TICK_BARS}, bars AS (SELECT * FROM tick_bars),{TICK_EWMA}
            SELECT ticker, {TICK_TIME}, {r('close')}, 0::BIGINT AS late, {r(TICK_EWMA_VALUE, 'ewma')} FROM sums""",
        "stream_ewma_expiring": f"""WITH {TICK_BARS},
            marked AS (SELECT *, CASE WHEN dt - lag(dt) OVER (PARTITION BY ticker ORDER BY dt) > INTERVAL 2 HOUR
              THEN 1 ELSE 0 END AS new FROM tick_bars),
            bars AS (SELECT * REPLACE (ticker || '#' || sum(new) OVER (PARTITION BY ticker ORDER BY dt) AS ticker)
              FROM marked),{TICK_EWMA}
            SELECT split_part(ticker, '#', 1) AS ticker, {TICK_TIME}, {r('close')}, 0::BIGINT AS late,
              {r(TICK_EWMA_VALUE, 'ewma')} FROM sums""",
        "stream_sessions": f"""WITH {TICK_BARS},
            marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS new
              FROM ticks WINDOW w AS (PARTITION BY ticker ORDER BY ts, event_id)),
            numbered AS (SELECT *, sum(new) OVER (PARTITION BY ticker ORDER BY ts, event_id) AS session FROM marked),
            sessions AS (SELECT ticker, min(ts) AS start, max(ts) AS last, arg_min(price, k) AS open,
                max(price) AS high, min(price) AS low, arg_max(price, k) AS close, count(*) AS n
              FROM numbered GROUP BY ticker, session)
            SELECT ticker, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, strftime(last, '%Y-%m-%d %H:%M:%S') AS last,
              {rs('open high low close')}, n FROM sessions
            WHERE last + INTERVAL 20 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ticks)""",
        "stream_sliding": f"""WITH {TICK_BARS},
            placed AS (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * unnest(range(4))) AS dt FROM ticks)
            SELECT ticker, {TICK_TIME}, {r('arg_min(price, k)', 'open')}, {r('max(price)', 'high')},
              {r('min(price)', 'low')}, {r('arg_max(price, k)', 'close')}, count(*) AS n FROM placed
            GROUP BY ticker, dt HAVING dt + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ticks)""",
        "stream_reactions": f"""WITH {TICK_BARS},
            news AS (SELECT ['click', 'error', 'purchase', 'signup', 'view'][doc_id % 5 + 1] AS ticker, doc_id,
              TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS published FROM documents)
            SELECT n.ticker, doc_id, strftime(published, '%Y-%m-%d %H:%M:%S') AS published, event_id,
              strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {r('price')}
            FROM news n JOIN ticks t ON n.ticker = t.ticker AND ts BETWEEN published AND published + INTERVAL 5 MINUTE""",
        "stream_movers": f"""WITH {TICK_BARS},
            info AS (SELECT ticker, max(high) AS week52_high, min(low) AS week52_low,
                NULL::DOUBLE AS dividend_yield, 0 AS b FROM tick_bars GROUP BY ticker),
            {MOVERS.format(bars='tick_bars')} SELECT board, rank, {MOVER_ROW} FROM boards""",
    }
    for m in METRICS:
        sql[f"vol_{m}"] = f"WITH {frame()} SELECT ticker, {day()}, {r(m)} FROM est"
    return sql
