import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from series import pandas_panel, random_bars, to_spark
from sigmatide.operators import estimators as es
from sigmatide.operators import garch as ga
from sigmatide.operators import garch_batch as gb
from sigmatide.operators import learned as le


def simulated(rows, omega, alpha, beta, seed):
    """Bars whose percent returns follow a known variance process."""
    rng = np.random.default_rng(seed)
    v, pct = omega / (1 - alpha - beta), []
    for _ in range(rows):
        e = rng.normal() * np.sqrt(v)
        pct.append(e)
        v = omega + alpha * e * e + beta * v
    close = 100 * np.cumprod(1 + np.array(pct) / 100)
    days = pd.bdate_range("1990-01-01", periods=rows).date
    return pd.DataFrame({"ticker": f"S{seed}", "dt": days, "open": close, "high": close,
                         "low": close, "close": close, "volume": 1.0})


def fold(errors, omega, alpha, beta, start):
    v, path, total = omega + (alpha + beta) * start, [], 0.0
    for e in errors:
        path.append(v)
        total += np.log(v) + e / v
        v = omega + alpha * e + beta * v
    return path, v, -0.5 * (len(errors) * np.log(2 * np.pi) + total)


@pytest.fixture(scope="module")
def series(spark):
    frames = [simulated(4000, 0.1, 0.1, 0.85, s) for s in (1, 2)]
    return ga.return_series(to_spark(spark, pd.concat(frames))).cache()


def test_the_search_recovers_the_parameters(series):
    for r in ga.garch_search(series).collect():
        assert abs(r.alpha - 0.1) < 0.04 and abs(r.beta - 0.85) < 0.05


def test_the_fit_beats_other_parameters(series):
    fitted = {r.ticker: r.log_likelihood for r in ga.garch_search(series).collect()}
    for alpha, beta in [(0.1, 0.85), (0.05, 0.9), (0.2, 0.7), (0.02, 0.5)]:
        for r in ga.garch_given(series, alpha, beta).collect():
            assert fitted[r.ticker] >= r.log_likelihood - 1e-6


def independent_optimum(returns, start, seed=0):
    """Best log-likelihood of a free random search, all points folded at once."""
    rng = np.random.default_rng(seed)
    variance = returns.var()

    def deviance(p):
        mu, alpha, gap, omega = p.T
        beta = 1 - gap - alpha
        ok = (alpha >= 0) & (gap > 0) & (beta >= 0) & (omega > 0)
        mu, alpha, beta, omega = (np.where(ok, x, 0.1) for x in (mu, alpha, beta, omega))
        v, total = omega + (alpha + beta) * start, np.zeros(len(p))
        for r in returns:
            e = (r - mu) ** 2
            total += np.log(v) + e / v
            v = omega + alpha * e + beta * v
        return np.where(ok, total, np.inf)

    n = 4000
    gap = 10 ** rng.uniform(-5, 0, n)
    points = np.stack([returns.mean() + 0.05 * returns.std() * rng.normal(size=n),
                       rng.uniform(0, 0.4, n) * (rng.random(n) > 0.3), gap,
                       variance * gap * 10 ** rng.uniform(-1, 1, n)], 1)
    best, width = deviance(points), 0.5
    keep = best.argsort()[:30]
    points, best = points[keep], best[keep]
    for _ in range(50):
        near = np.repeat(points, 30, 0)
        move = rng.normal(size=near.shape) * (rng.random(near.shape) < 0.6) * width
        near = np.stack([near[:, 0] + 0.1 * returns.std() * move[:, 0],
                         np.maximum(near[:, 1] + 0.05 * move[:, 1], 0),
                         near[:, 2] * np.exp(move[:, 2]), near[:, 3] * np.exp(move[:, 3])], 1)
        points, best = np.vstack([points, near]), np.concatenate([best, deviance(near)])
        keep = best.argsort()[:12]
        points, best, width = points[keep], best[keep], width * 0.88
    return -0.5 * (len(returns) * np.log(2 * np.pi) + best[0])


@pytest.mark.parametrize("alpha,beta,seed", [
    (0.1, 0.85, 5), (0.3, 0.5, 1), (0.0, 0.0, 3), (0.0, 0.99, 1), (0.05, 0.945, 1), (0.02, 0.975, 2)])
def test_the_fit_reaches_an_independent_optimum(alpha, beta, seed):
    rng, v, out = np.random.default_rng(seed), 1.0, []
    for _ in range(500):
        e = rng.normal() * np.sqrt(v)
        out.append(e)
        v = 1 - alpha - beta + alpha * e * e + beta * v
    returns = np.array(out)
    errors = (returns - returns.mean()) ** 2
    weights = 0.94 ** np.arange(75)
    start = (errors[:75] * weights).sum() / weights.sum()
    *parameters, deviance = ga.fit_returns(returns, errors.mean(), start)
    got = -0.5 * (len(returns) * np.log(2 * np.pi) + deviance)
    assert got >= independent_optimum(returns, start) - 1e-3
    mu, omega, a, b, last = parameters
    want = fold((returns - mu) ** 2, omega, a, b, start)
    np.testing.assert_allclose([last, got], want[1:], rtol=1e-9)
    assert a >= 0 and b >= 0 and 0 < a + b < 1


def test_the_floor_of_the_grid_is_below_the_fit(series):
    rows = ga.garch_search(series).select(
        "log_likelihood", ga.grid_log_likelihood([0.0, 0.1], [0.05, 0.2]).alias("floor")).collect()
    given = [ga.garch_given(series, a, 1 - a - g).collect() for a in (0.0, 0.1) for g in (0.05, 0.2)]
    best = [max(r.log_likelihood for r in rs) for rs in zip(*given)]
    np.testing.assert_allclose([r.floor for r in rows], best, rtol=1e-9)
    assert all(r.log_likelihood >= r.floor for r in rows)


def test_fixed_model_equals_the_loop(series):
    model = ga.garch_given(series, 0.08, 0.9)
    path = {}
    for r in ga.garch_conditional_vol(model, block=100).orderBy("ticker", "dt").collect():
        path.setdefault(r.ticker, []).append(r.conditional_volatility)
    for r in model.collect():
        pct = np.array(r.pct_returns)
        errors = (pct - pct.mean()) ** 2
        weights = 0.94 ** np.arange(75)
        start = (errors[:75] * weights).sum() / weights.sum()
        omega = 0.02 * errors.mean()
        want, last, ll = fold(errors, omega, 0.08, 0.9, start)
        np.testing.assert_allclose(path[r.ticker], np.sqrt(np.array(want) * 252) / 100, rtol=1e-9)
        np.testing.assert_allclose([r.next_variance, r.log_likelihood], [last, ll], rtol=1e-9)


def test_forecast_equals_the_recursion(series):
    model = ga.garch_given(series, 0.08, 0.9)
    r = model.orderBy("ticker").first()
    v, want = r.next_variance, []
    for _ in range(30):
        want.append(v)
        v = r.omega + 0.98 * v
    got = ga.garch_forecast(model).filter(F.col("ticker") == r.ticker).orderBy("step").collect()
    np.testing.assert_allclose([g.variance for g in got], want, rtol=1e-9)
    assert all(abs(g.lower_ci / g.volatility - 0.8) < 1e-12 for g in got)


def test_a_constant_series_has_no_model(spark):
    flat = simulated(100, 0.1, 0.1, 0.8, 9).assign(open=5.0, high=5.0, low=5.0, close=5.0)
    assert ga.garch_fit(to_spark(spark, flat)).count() == 0


def test_derivatives_equal_differences():
    rng = np.random.default_rng(3)
    returns = [rng.standard_t(5, n) for n in (40, 75, 301)]
    series = gb.Series.of(returns, np.array([1.0, 2.0, 0.5]), np.array([r.var() for r in returns]))
    for p, q in ((1, 1), (2, 1), (1, 2), (3, 2)):
        free = np.column_stack((rng.normal(0, 0.1, 3), rng.normal(-1, 0.2, 3), np.log(rng.uniform(0.1, 0.5, 3)),
                                rng.uniform(0.2, 0.7, (3, p + q - 1))))
        model, jacobian = gb.model_of(free, np.ones(3), p)
        value, gradient, second = gb.derivatives(series, model)
        np.testing.assert_allclose(value, gb.deviance(series, model), rtol=1e-12)
        slope = (jacobian.transpose(0, 2, 1) @ gradient[:, :, None])[:, :, 0]
        for k in range(free.shape[1]):
            step = np.zeros(free.shape[1])
            step[k] = 1e-6
            up, down = (gb.deviance(series, gb.model_of(free + s * step, np.ones(3), p)[0]) for s in (1, -1))
            np.testing.assert_allclose(slope[:, k], (up - down) / 2e-6, rtol=1e-4, atol=1e-4)
        assert (np.linalg.eigvalsh(second) > -1e-9).all()


def loop_deviance(returns, mu, omega, alphas, betas, start):
    squares, variances, total = [start] * len(alphas), [start] * len(betas), 0.0
    for r in returns:
        v = omega + np.dot(alphas, squares) + np.dot(betas, variances)
        total += np.log(v) + (r - mu) ** 2 / v
        squares, variances = [(r - mu) ** 2, *squares[:-1]], [v, *variances[:-1]]
    return total, omega + np.dot(alphas, squares) + np.dot(betas, variances)


@pytest.mark.parametrize("p,q", [(1, 1), (2, 1), (1, 2), (2, 3)])
def test_orders_are_fitted_and_folded(spark, p, q):
    """The returned parameters give the returned likelihood; no nearby point and no lower order is better."""
    frames = [simulated(n, 0.1, 0.12, 0.8, s) for n, s in ((300, 4), (1100, 7))]
    state = ga.return_series(to_spark(spark, pd.concat(frames)))
    lower = {r.ticker: r.log_likelihood for r in ga.garch_search(state).collect()}
    rng = np.random.default_rng(1)
    fitted = ga.garch_search(state, p, q, [(0.1, 0.1), (0.0, 0.5)])
    for r in fitted.collect():
        returns = np.array(r.pct_returns)
        least, following = loop_deviance(returns, r.mu, r.omega, r.alphas, r.betas, r.start_variance)
        likelihood = -0.5 * (len(returns) * np.log(2 * np.pi) + least)
        np.testing.assert_allclose([r.log_likelihood, r.next_variance], [likelihood, following], rtol=1e-9)
        assert len(r.alphas) == p and len(r.betas) == q and r.log_likelihood >= lower[r.ticker] - 1e-6
        assert r.log_likelihood >= r.floor_log_likelihood
        np.testing.assert_allclose(r.aic, 2 * (2 + p + q) - 2 * likelihood)
        for _ in range(300):
            size = 10.0 ** rng.uniform(-5, -1)
            x = np.abs(np.array([*r.alphas, *r.betas]) + size * rng.normal(size=p + q) * (rng.random(p + q) < 0.6))
            omega = r.omega * np.exp(size * rng.normal())
            if x.sum() < 1:
                near = loop_deviance(returns, r.mu + size * rng.normal(), omega, x[:p], x[p:], r.start_variance)[0]
                assert near >= least - 1e-6
    days = ga.garch_forecast(fitted, 12).orderBy("ticker", "step").collect()
    for r in fitted.collect():
        squares, variances = list(r.recent_squares), list(r.recent_variances)
        for d in (d for d in days if d.ticker == r.ticker):
            v = r.omega + np.dot(r.alphas, squares) + np.dot(r.betas, variances)
            np.testing.assert_allclose(d.variance, v, rtol=1e-9)
            squares, variances = [v, *squares[:-1]], [v, *variances[:-1]]


def test_a_fit_depends_on_its_own_series_alone(spark):
    """Series of other lengths in a batch change nothing; series longer than a batch are fitted too."""
    frames = [simulated(n, 0.1, 0.1, 0.85, s) for n, s in ((60, 1), (900, 2), (250, 3))]
    together = {r.ticker: r for r in ga.garch_search(ga.return_series(to_spark(spark, pd.concat(frames)))).collect()}
    for f in frames:
        r = ga.garch_search(ga.return_series(to_spark(spark, f))).first()
        np.testing.assert_allclose(together[r.ticker].log_likelihood, r.log_likelihood, atol=1e-6)
    lengths = np.array([5, gb.BATCH_VALUES, 7, 6])
    parts = gb.batches(lengths)
    assert sorted(np.concatenate(parts)) == [0, 1, 2, 3] and [1] in [list(x) for x in parts]


def test_fixed_orders_equal_the_loop(series):
    model = ga.garch_given_orders(series, [0.05, 0.04], [0.5, 0.3])
    vols = {}
    for r in ga.conditional_vol_orders(model).orderBy("ticker", "dt").collect():
        vols.setdefault(r.ticker, []).append(r.conditional_volatility)
    for r in model.collect():
        least, following = loop_deviance(np.array(r.pct_returns), r.mu, r.omega, r.alphas, r.betas, r.start_variance)
        np.testing.assert_allclose(r.log_likelihood, -0.5 * (r.n_obs * np.log(2 * np.pi) + least), rtol=1e-9)
        np.testing.assert_allclose(r.next_variance, following, rtol=1e-9)
        assert len(vols[r.ticker]) == r.n_obs
    plain = ga.garch_given(series, 0.08, 0.9)
    by_lag = ga.garch_given_orders(series, [0.08], [0.9])
    one, two = (sorted(x.collect()) for x in (ga.garch_conditional_vol(plain), ga.conditional_vol_orders(by_lag)))
    np.testing.assert_allclose([r[2] for r in one], [r[2] for r in two], rtol=1e-9)


def test_orders_below_one_are_refused(series):
    with pytest.raises(ValueError):
        ga.garch_search(series, 0, 1)


LOOKBACK = 5


@pytest.fixture(scope="module")
def learned(spark):
    frames = [random_bars("A", 200, 1), random_bars("B", 150, 2, vol=0.04)]
    scaled = le.minmax_scale(es.vol_panel(to_spark(spark, pd.concat(frames)))).cache()
    split = le.chrono_split(le.lag_sequences(scaled, LOOKBACK)).cache()
    return frames, scaled, split, le.lag_regression_fit(split, ridge=0.0)


def scaled_by_hand(frame):
    p = pandas_panel(frame).dropna()
    cols = ["returns", "historical", "ewma", "yang_zhang"]
    return p, (p[cols] - p[cols].min()) / (p[cols].max() - p[cols].min())


def sequences_by_hand(frame):
    _, s = scaled_by_hand(frame)
    x = s[["returns", "historical", "ewma"]].to_numpy()
    rows = [x[i - LOOKBACK:i].ravel() for i in range(LOOKBACK, len(x))]
    return np.array(rows), s.yang_zhang.to_numpy()[LOOKBACK:]


def test_sequences_and_split(learned):
    frames, _, split, _ = learned
    for f in frames:
        x, y = sequences_by_hand(f)
        got = split.filter(F.col("ticker") == f.ticker[0]).orderBy("dt").collect()
        np.testing.assert_allclose([r.steps for r in got], x, atol=1e-9)
        np.testing.assert_allclose([r.target for r in got], y, atol=1e-9)
        assert sum(r.is_train for r in got) == int(len(x) * 0.8)
        assert [r.is_train for r in got] == sorted((r.is_train for r in got), reverse=True)


def test_fit_equals_least_squares(learned):
    frames, _, _, model = learned
    xs, ys = [], []
    for f in frames:
        x, y = sequences_by_hand(f)
        cut = int(len(x) * 0.8)
        xs.append(x[:cut])
        ys.append(y[:cut])
    x = np.vstack(xs)
    want = np.linalg.lstsq(np.hstack([x, np.ones((len(x), 1))]), np.concatenate(ys), rcond=None)[0]
    np.testing.assert_allclose(model.coefficients.toArray(), want[:-1], atol=1e-5)


def test_the_gradient_is_zero_at_the_fit_only(learned):
    _, _, split, model = learned
    at_fit = [r.gradient for r in le.fit_gradient(split, model, 0.0).collect()]
    assert len(at_fit) == 3 * LOOKBACK + 1 and np.abs(at_fit).max() < 1e-6
    off = le.GivenModel([float(c) + 0.05 for c in model.coefficients], model.intercept)
    assert np.abs([r.gradient for r in le.fit_gradient(split, off, 0.0).collect()]).max() > 1e-3


def test_the_full_ensemble_runs_fitted(spark, folder):
    from sigmatide.sources.tables import Tables

    bars = Tables(spark, folder).bars()
    garch = ga.garch_forecast(ga.garch_search(ga.return_series(bars)))
    rows = le.forecast_ensemble(garch, le.learned_forecast(bars, lookback=le.ENSEMBLE_LOOKBACK)).collect()
    assert len(rows) == 25 * 30 and all(r.garch > 0 and np.isfinite(r.learned) for r in rows)


def test_forecasts_on_fitted_models(spark, folder):
    """The fit reaches the SQL grid's likelihood, and every forecast follows from its parameters."""
    import duckdb

    from sigmatide.operators import forecast as fc
    from sigmatide.plans import catalog as ca
    from sigmatide.plans.oracle import all_oracle_sql
    from sigmatide.sources.tables import Tables

    state = ca.fitted_state(Tables(spark, folder))
    frame = fc.predict_bundle(state)
    blend = le.forecast_ensemble(ga.garch_forecast(state), fc.forecast_mean_reversion(
        Tables(spark, folder).bars()))
    got = {name: rows.collect() for name, rows in {
        "predict_bundle_fitted": ca._shown_bundle(frame), "trading_signals_fitted": ca._shown_signals(frame),
        "volatility_recommendations_fitted": ca._shown_recommendations(frame),
        "price_cone_fitted": ca._shown_cone(frame), "forecast_ensemble_fitted": blend}.items()}
    con = duckdb.connect()
    for table in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cursor = con.execute(all_oracle_sql()["garch_fit"])
    at = [d[0] for d in cursor.description]
    floors = {r[at.index("ticker")]: r[at.index("grid_log_likelihood")] for r in cursor.fetchall()}
    returns = {r.ticker: np.array(r.pct_returns) for r in
               ga.return_series(Tables(spark, folder).bars()).collect()}
    bundle = {}
    for r in got["predict_bundle_fitted"]:
        bundle.setdefault(r.ticker, {})[r.step] = r
    assert set(bundle) == set(floors) and len({(r[1].alpha, r[1].beta) for r in bundle.values()}) > 1
    vols = {}
    for ticker, rows in bundle.items():
        r, pct = rows[1], returns[ticker]
        start_errors = (pct[:75] - pct.mean()) ** 2
        weights = 0.94 ** np.arange(len(start_errors))
        start = (start_errors * weights).sum() / weights.sum()
        _, v, ll = fold((pct - r.mu) ** 2, r.omega, r.alpha, r.beta, start)
        assert r.n_obs == len(pct) and r.log_likelihood >= floors[ticker] - 1e-3
        np.testing.assert_allclose(r.log_likelihood, ll, atol=0.01)
        np.testing.assert_allclose([r.aic, r.bic], [8 - 2 * ll, 4 * np.log(len(pct)) - 2 * ll], atol=0.02)
        want = []
        for _ in range(30):
            want.append(np.sqrt(v * 252) / 100)
            v = r.omega + (r.alpha + r.beta) * v
        vols[ticker] = [rows[step].garch_volatility for step in range(1, 31)]
        np.testing.assert_allclose(vols[ticker], want, rtol=1e-3)
    assert {r.ticker for r in got["trading_signals_fitted"]} == set(bundle)
    trends = {}
    for r in got["trading_signals_fitted"]:
        mean = np.mean(vols[r.ticker])
        np.testing.assert_allclose(r.forecast_volatility, mean, atol=2e-6)
        np.testing.assert_allclose([r.d30_low, r.d30_high],
                                   r.current_price * (1 + np.array([-1, 1]) * mean * np.sqrt(30 / 252)), rtol=1e-4)
        ratio = r.forecast_volatility / r.current_volatility
        trends[r.ticker] = "INCREASE" if ratio > 1.1 else "DECREASE" if ratio < 0.9 else "STABLE"
    last = {}
    for r in got["volatility_recommendations_fitted"]:
        last[r.ticker] = max(last.get(r.ticker, (-1, "")), (r.pos, r.recommendation))
    assert set(last) == set(trends) and all(trends[t] in last[t][1] for t in trends)
    for r in got["price_cone_fitted"]:
        wide = np.sqrt((np.array(vols[r.ticker][:r.step]) ** 2).sum() / 252)
        np.testing.assert_allclose([r.cum_volatility, r.upper_2sd / r.expected_price], [wide, 1 + 2 * wide], rtol=1e-4)
    assert len(got["price_cone_fitted"]) == 30 * len(bundle)
    for r in got["forecast_ensemble_fitted"]:
        np.testing.assert_allclose(r.garch, vols[r.ticker][r.step - 1], atol=2e-6)
        np.testing.assert_allclose(r.ensemble, (r.garch + r.learned) / 2, atol=2e-6)


def test_forecast_feeds_predictions_back(learned):
    frames, scaled, _, model = learned
    w, b = model.coefficients.toArray(), model.intercept
    for f in frames:
        panel, s = scaled_by_hand(f)
        window = s[["returns", "historical", "ewma"]].to_numpy()[-LOOKBACK:]
        want = []
        for _ in range(12):
            guess = window.ravel() @ w + b
            want.append(guess)
            window = np.vstack([window[1:], [window[-1][0], guess, guess]])
        low, high = panel.yang_zhang.min(), panel.yang_zhang.max()
        got = (le.lag_regression_forecast(scaled, model, 12, LOOKBACK)
               .filter(F.col("ticker") == f.ticker[0]).orderBy("step").collect())
        np.testing.assert_allclose([r.volatility for r in got],
                                   np.array(want) * (high - low) + low, rtol=1e-6)


@pytest.fixture(scope="module")
def boosted(learned):
    """Sequences and trees of a target that no linear model explains."""
    _, scaled, _, _ = learned
    last_return = F.element_at("steps", -3)
    split = le.lag_sequences(scaled, LOOKBACK).withColumns({
        "target": F.abs(last_return - 0.5) + 0.1 * F.element_at("steps", -1),
        "is_train": F.pmod(F.xxhash64("ticker", "dt"), F.lit(5)) > 0}).cache()
    return split, le.boosted_model(split, trees=12, depth=4, rate=0.3)


def test_exported_trees_predict_as_the_model_does(boosted):
    """In the engine, and as SQL text in another one."""
    import duckdb
    from pyspark.ml.functions import array_to_vector

    split, model = boosted
    trees = le.BoostedTrees.of(model)
    assert len(trees.trees) == len(trees.weights) == len(model.trees) <= 12
    rows = model.transform(split.withColumn("features", array_to_vector("steps"))).select(
        "steps", "prediction", trees.column(F.col("steps")).alias("own")).collect()
    np.testing.assert_allclose([r.own for r in rows], [r.prediction for r in rows], rtol=1e-12)
    con = duckdb.connect()
    con.register("rows", pd.DataFrame({"i": range(len(rows)), "steps": [list(r.steps) for r in rows]}))
    got = con.execute(f"SELECT {trees.sql('steps')} FROM rows ORDER BY i").fetchall()
    np.testing.assert_allclose([g[0] for g in got], [r.prediction for r in rows], rtol=1e-12)


def test_trees_beat_the_linear_model_where_it_is_wrong(boosted):
    split, model = boosted
    linear = le.lag_regression_fit(split)
    trees = le.BoostedTrees.of(model)

    def rmse(m):
        error = F.col("target") - le._dot(F.col("steps"), m)
        return split.filter("NOT is_train").agg(F.sqrt(F.avg(error * error))).first()[0]

    assert rmse(trees) < rmse(linear)


def test_boosting_stops_early(learned):
    """A target of pure noise: further trees don't help the rows kept back."""
    _, scaled, _, _ = learned
    split = le.chrono_split(le.lag_sequences(scaled, LOOKBACK)).withColumn(
        "target", F.pmod(F.xxhash64("ticker", "dt"), F.lit(1000)) / 1000).cache()
    assert len(le.boosted_model(split, trees=30, depth=3).trees) < 30


def test_boosted_forecast_feeds_predictions_back(learned, boosted):
    frames, scaled, _, _ = learned
    trees = le.BoostedTrees.of(boosted[1])

    def guess(tree, x):
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    f = frames[0]
    panel, s = scaled_by_hand(f)
    window = s[["returns", "historical", "ewma"]].to_numpy()[-LOOKBACK:]
    want = []
    for _ in range(6):
        value = sum(w * guess(t, window.ravel()) for t, w in zip(trees.trees, trees.weights))
        want.append(value)
        window = np.vstack([window[1:], [window[-1][0], value, value]])
    low, high = panel.yang_zhang.min(), panel.yang_zhang.max()
    got = (le.lag_regression_forecast(scaled, trees, 6, LOOKBACK)
           .filter(F.col("ticker") == f.ticker[0]).orderBy("step").collect())
    np.testing.assert_allclose([r.volatility for r in got], np.array(want) * (high - low) + low, rtol=1e-6)


def test_scaling_a_constant_gives_zero_and_train_only_bounds(spark):
    rows = [("A", d, 1.0, 0.5, float(i), 2.0) for i, d in enumerate(
        pd.bdate_range("2020-01-01", periods=10).date)]
    df = spark.createDataFrame(rows, "ticker string, dt date, returns double, historical double, "
                                     "ewma double, yang_zhang double")
    got = le.minmax_scale(df).orderBy("dt").collect()
    assert {r.returns_scaled for r in got} == {0.0}
    assert got[-1].ewma_scaled == 1.0
    got = le.minmax_scale(df, train_fraction=0.5).orderBy("dt").collect()
    assert got[4].ewma_scaled == 1.0 and got[-1].ewma_scaled == 2.25


def test_metrics_and_ensemble(spark):
    df = spark.createDataFrame([("A", 1.0, 2.0), ("A", 2.0, 2.0), ("B", 1.0, 4.0)],
                               "ticker string, actual double, predicted double")
    got = {r.ticker: (r.n, r.val_rmse, r.val_mae) for r in le.regression_metrics(df).collect()}
    assert got == {"A": (2, np.sqrt(0.5), 0.5), "B": (1, 3.0, 3.0)}
    one = spark.sql("select 'A' ticker, 1 step, date '2024-01-01' dt, 0.4D volatility")
    two = spark.sql("select 'A' ticker, 1 step, date '2024-01-01' dt, 0.2D volatility")
    r = le.forecast_ensemble(one, two, 0.75).first()
    np.testing.assert_allclose([r.ensemble, r.lower_ci, r.upper_ci], [0.35, 0.28, 0.42])
