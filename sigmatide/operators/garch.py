"""GARCH(p, q) with constant mean and normal errors; p = q = 1 by default.

variance[t] = omega + alpha * e[t-1]^2 + beta * variance[t-1], on returns in percent, with more lags of
both for higher orders. Fixed parameters are a fold over a ticker's ordered returns: one shuffle by
ticker, then a projection per ticker. The fit works on batches of tickers (see garch_batch).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmatide.functions.columns import TRADING_DAYS
from sigmatide.operators import garch_batch as gb
from sigmatide.operators.estimators import with_returns
from sigmatide.operators.forecast import (
    business_days,
    ordered_days,
    return_aggregates,
    spread_tickers,
)

BACKCAST_ROWS = 75
BACKCAST_DECAY = 0.94
N_PARAMS = 4  # mean, omega, alpha and beta
FIT = ("fit_mu double, omega double, alphas array<double>, betas array<double>, recent_squares array<double>, "
       "recent_variances array<double>, next_variance double, deviance double, floor_deviance double")
CI_LOW, CI_HIGH = 0.8, 1.2


def residual_state(state: DataFrame) -> DataFrame:
    """Add squared residuals, their mean and the start variance to ``pct_returns``.

    The start is the mean of the first 75 squared residuals, weighted by 0.94^k.
    """
    head = F.slice("sq_residuals", 1, BACKCAST_ROWS)
    weighted = F.aggregate(
        head,
        F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("weights"), F.lit(1.0).alias("w")),
        lambda a, e: F.struct((a["sum"] + a["w"] * e).alias("sum"),
                              (a["weights"] + a["w"]).alias("weights"),
                              (a["w"] * BACKCAST_DECAY).alias("w")),
        lambda a: a["sum"] / a["weights"],
    )
    # The filter uses plain aggregates only: pushed below a projection, a condition on the
    # lists would be computed again, once per element.
    return (
        state.filter("n_obs >= 2 and return_range > 0")
        .withColumn("sq_residuals",
                    F.transform("pct_returns", lambda r: (r - F.col("mu")) * (r - F.col("mu"))))
        .withColumns({
            "sample_variance":
                F.aggregate("sq_residuals", F.lit(0.0), lambda a, e: a + e) / F.col("n_obs"),
            "start_variance": weighted,
        })
    )


def _deviance(omega: Column, alpha: Column, beta: Column) -> Column:
    """Struct of the next variance and the sum of ln(variance) + e^2/variance."""
    start = F.struct((omega + (alpha + beta) * F.col("start_variance")).alias("next"),
                     F.lit(0.0).alias("sum"))
    return F.aggregate(
        "sq_residuals", start,
        lambda a, e: F.struct((omega + alpha * e + beta * a["next"]).alias("next"),
                              (a["sum"] + F.ln(a["next"]) + e / a["next"]).alias("sum")))


def _log_likelihood(deviance_sum: Column) -> Column:
    return -0.5 * (F.col("n_obs") * math.log(2 * math.pi) + deviance_sum)


def _points(grid: list[tuple[float, float]], p: int, q: int) -> np.ndarray:
    """Rows of alphas, betas and gap: the sums are spread evenly over the lags."""
    return np.array([(*[a / p] * p, *[(1 - a - g) / q] * q, g) for a, g in grid])


def _fitted_rows(own: pd.DataFrame, p: int, q: int, grid: list[tuple[float, float]]) -> list[tuple]:
    """FIT of each series of a batch; the floor is the least deviance on ``grid``."""
    series = gb.Series.of([np.asarray(r) for r in own["returns"]], own["start"].to_numpy(), own["variance"].to_numpy())
    model, least = gb.fit(series, p, q)
    e, v, _ = gb.variances(series, model)
    floor = np.full(len(own), np.nan)
    if grid:
        mean = np.array([np.mean(r) for r in own["returns"]])
        x = _points(grid, p, q)
        floor = np.min([gb.deviance(series, gb.Model(mean, w[-1] * series.variance, np.tile(w[:p], (len(own), 1)),
                                                     np.tile(w[p:-1], (len(own), 1)))) for w in x], axis=0)
    rows = []
    for i, n in enumerate(series.inside.sum(1)):
        before = np.full(max(p, q), series.start[i])
        squares = np.concatenate((before, e[i, :n] ** 2))[::-1][:p]
        values = np.concatenate((before, v[i, :n]))[::-1][:q]
        following = model.omega[i] + squares @ model.alpha[i] + values @ model.beta[i]
        rows.append((model.mu[i], model.omega[i], model.alpha[i], model.beta[i], squares, values, following,
                     least[i], floor[i]))
    return rows


def _fit_function(p: int, q: int, grid: list[tuple[float, float]]):
    names = [c.split()[0] for c in FIT.split(", ")]

    def fit(chunks: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for returns, variance, start in chunks:
            given = pd.DataFrame({"returns": returns, "variance": variance, "start": start})
            out: list[tuple] = [()] * len(given)
            for rows in gb.batches(returns.map(len).to_numpy(int)):
                for row, found in zip(rows, _fitted_rows(given.iloc[rows], p, q, grid)):
                    out[row] = found
            yield pd.DataFrame(out, columns=names)

    return F.pandas_udf(fit, FIT)


def garch_search(state: DataFrame, p: int = 1, q: int = 1,
                 floor: list[tuple[float, float]] | None = None) -> DataFrame:
    """Fitted mean, omega, alphas and betas per ticker by maximum likelihood.

    ``state`` needs pct_returns; it gains mu, omega, alpha and beta (their sums over the lags), alphas and betas
    (by lag), recent_squares and recent_variances (newest first), next_variance, log_likelihood, aic and bic.
    ``p`` counts the lags of squared residuals, ``q`` those of variances. The start variance is that of the returns
    around their sample mean. With ``floor``, points (alpha, gap), also floor_log_likelihood: the best on these
    points with the sample mean and omega from the sample variance, which no fit should be below.
    """
    if p < 1 or q < 1:
        raise ValueError("p and q are 1 or more")
    df = residual_state(state).withColumn(
        "_fit", _fit_function(p, q, floor or [])("pct_returns", "sample_variance", "start_variance"))
    lists = ("alphas", "betas", "recent_squares", "recent_variances")
    sums = [F.aggregate(f"_fit.{c}s", F.lit(0.0), lambda a, x: a + x).alias(c) for c in ("alpha", "beta")]
    return with_criteria(
        df.drop("mu").select(
            "*", F.col("_fit.fit_mu").alias("mu"), "_fit.omega", *sums, *(f"_fit.{c}" for c in lists), "_fit.next_variance",
            _log_likelihood(F.col("_fit.deviance")).alias("log_likelihood"),
            *([_log_likelihood(F.col("_fit.floor_deviance")).alias("floor_log_likelihood")] if floor else []))
        .drop("_fit"), 2 + p + q)


def fit_returns(returns: np.ndarray, variance: float, start: float) -> tuple[float, ...]:
    """Mean, omega, alpha, beta, next variance and deviance of the (1, 1) model of one series."""
    own = pd.DataFrame({"returns": [returns], "variance": [variance], "start": [start]})
    mu, omega, alphas, betas, _, _, following, least, _ = _fitted_rows(own, 1, 1, [])[0]
    return mu, omega, alphas[0], betas[0], following, least


def grid_log_likelihood(alphas: list[float], gaps: list[float]) -> Column:
    """Best log-likelihood over a grid of alpha and gap, with the sample mean and omega from the
    sample variance: a floor for any fit. For rows of residual_state or garch_search."""
    points = [(a, g) for a in alphas for g in gaps if a + g <= 1]
    return _log_likelihood(F.least(*[
        _deviance(F.lit(g) * F.col("sample_variance"), F.lit(a), F.lit(1 - g - a))["sum"] for a, g in points]))


def with_criteria(fitted: DataFrame, n_params: int = N_PARAMS) -> DataFrame:
    """Add the information criteria of the parameters."""
    ll = F.col("log_likelihood")
    return fitted.withColumns({
        "aic": 2 * n_params - 2 * ll,
        "bic": n_params * F.ln("n_obs") - 2 * ll,
    })


def garch_given_orders(state: DataFrame, alphas: list[float], betas: list[float]) -> DataFrame:
    """The model with fixed coefficients by lag, the sample mean, and omega from the sample variance."""
    def numbers(values: list[float]) -> Column:
        return F.array(*map(F.lit, values))

    df = residual_state(state).withColumns({
        "alphas": numbers(alphas), "betas": numbers(betas),
        "omega": (1 - math.fsum(alphas) - math.fsum(betas)) * F.col("sample_variance")})
    start = F.struct(F.array_repeat("start_variance", len(alphas)).alias("squares"),
                     F.array_repeat("start_variance", len(betas)).alias("variances"), F.lit(0.0).alias("sum"))

    def advance(state: Column, e: Column) -> Column:
        # A one-element transform binds the variance, so it is computed once per step.
        return F.transform(F.array(_following(state)), lambda v: F.struct(
            _pushed(e, state["squares"], len(alphas)).alias("squares"),
            _pushed(v, state["variances"], len(betas)).alias("variances"),
            (state["sum"] + F.ln(v) + e / v).alias("sum")))[0]

    return with_criteria(
        df.withColumn("_fold", F.aggregate("sq_residuals", start, advance)).withColumns({
            "recent_squares": F.col("_fold.squares"), "recent_variances": F.col("_fold.variances"),
            "next_variance": _following(F.col("_fold")),
            "log_likelihood": _log_likelihood(F.col("_fold.sum"))}).drop("_fold"),
        2 + len(alphas) + len(betas))


def _following(state: Column) -> Column:
    """The variance after the newest-first lags of ``state``."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    return F.col("omega") + dot(F.col("alphas"), state["squares"]) + dot(F.col("betas"), state["variances"])


def _pushed(first: Column, values: Column, keep: int) -> Column:
    return F.slice(F.concat(F.array(first), values), 1, keep)


def variance_path(horizon: int) -> Column:
    """Variance forecasts 1 to ``horizon`` days ahead for a model of any orders: unknown squares are expected ones."""
    start = F.struct(F.col("recent_squares").alias("squares"), F.col("recent_variances").alias("variances"),
                     F.array().cast("array<double>").alias("path"))

    def advance(state: Column, _: Column) -> Column:
        return F.transform(F.array(_following(state)), lambda v: F.struct(
            _pushed(v, state["squares"], F.size("alphas")).alias("squares"),
            _pushed(v, state["variances"], F.size("betas")).alias("variances"),
            F.concat(state["path"], F.array(v)).alias("path")))[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, advance, lambda s: s["path"])


def garch_given(state: DataFrame, alpha: float, beta: float) -> DataFrame:
    """The model with fixed alpha and beta, the sample mean, and omega from the sample variance."""
    return with_criteria(with_variance(
        residual_state(state).withColumns({
            "alpha": F.lit(alpha), "beta": F.lit(beta),
            "omega": (1 - alpha - beta) * F.col("sample_variance"),
        })))


def with_variance(df: DataFrame) -> DataFrame:
    """Add the variance after the last return and the log-likelihood of the parameters."""
    fold = _deviance(F.col("omega"), F.col("alpha"), F.col("beta"))
    return (
        df.withColumn("_fold", fold)
        .withColumns({
            "next_variance": F.col("_fold.next"),
            "log_likelihood": _log_likelihood(F.col("_fold.sum")),
        })
        .drop("_fold")
    )


def return_series(bars: DataFrame) -> DataFrame:
    """Last date, ordered percent returns and their days; at most one per calendar day."""
    return with_returns(spread_tickers(bars)).groupBy("ticker").agg(
        F.max("dt").alias("dt"), *return_aggregates(), ordered_days())


def refolded(fitted: DataFrame) -> DataFrame:
    """Add ``refold_next`` and ``refold_log_likelihood``: a (1, 1) model's returned parameters folded over its returns
    again by the engine, for checks of a fit."""
    errors = F.transform("pct_returns", lambda r: (r - F.col("mu")) * (r - F.col("mu")))
    return (
        fitted.withColumn("sq_residuals", errors)
        .withColumn("_fold", _deviance(F.col("omega"), F.col("alpha"), F.col("beta")))
        .withColumns({"refold_next": F.col("_fold.next"), "refold_log_likelihood": _log_likelihood(F.col("_fold.sum"))})
        .drop("_fold"))


def garch_fit(bars: DataFrame, p: int = 1, q: int = 1) -> DataFrame:
    """Fitted parameters, log-likelihood, AIC and BIC per ticker; alphas and betas by lag, and their sums."""
    return garch_search(return_series(bars), p, q).select(
        "ticker", "n_obs", "mu", "omega", "alpha", "beta", "alphas", "betas", "log_likelihood", "aic", "bic")


def step_variance(step: Column) -> Column:
    """Variance forecast of a (1, 1) model ``step`` days ahead, in closed form."""
    persistence = F.col("alpha") + F.col("beta")
    level = F.col("omega") / (1 - persistence)
    return level + F.pow(persistence, step.cast("double") - 1) * (F.col("next_variance") - level)


def variance_volatility(variance: Column) -> Column:
    """Daily percent variance to annual volatility."""
    return F.sqrt(variance * TRADING_DAYS) / 100


def garch_forecast(fitted: DataFrame, horizon: int = 30) -> DataFrame:
    """Variance and volatility of each future business day, with an approximate band; a model with
    coefficients by lag may have any orders."""
    if "alphas" in fitted.columns:
        steps = business_days(fitted.withColumn("_path", variance_path(horizon)), horizon).withColumn(
            "variance", F.element_at("_path", F.col("step")))
    else:
        steps = business_days(fitted, horizon).withColumn("variance", step_variance(F.col("step")))
    vol = F.col("volatility")
    return steps.withColumn("volatility", variance_volatility(F.col("variance"))).select(
        "ticker", "step", "dt", "variance", "volatility",
        (vol * CI_LOW).alias("lower_ci"), (vol * CI_HIGH).alias("upper_ci"))


def _path_function():
    """Variance of each return under given parameters."""
    def path(returns: pd.Series, start: pd.Series, mu: pd.Series, omega: pd.Series, alphas: pd.Series,
             betas: pd.Series) -> pd.Series:
        out = []
        for r, s, m, w, a, b in zip(returns, start, mu, omega, alphas, betas):
            series = gb.Series.of([np.asarray(r)], np.array([s]), np.ones(1))
            model = gb.Model(np.array([m]), np.array([w]), np.asarray(a)[None], np.asarray(b)[None])
            out.append(gb.variances(series, model)[1][0, :len(r)])
        return pd.Series(out)

    return F.pandas_udf(path, "array<double>")


def conditional_vol_orders(fitted: DataFrame) -> DataFrame:
    """garch_conditional_vol for a model with coefficients by lag. ``fitted`` needs pct_returns and return_days."""
    variances = _path_function()("pct_returns", "start_variance", "mu", "omega", "alphas", "betas")
    return (
        fitted.select("ticker", "return_days", variances.alias("variances"))
        .select("ticker", F.inline(F.arrays_zip(F.col("return_days").alias("dt"), F.col("variances").alias("variance"))))
        .select("ticker", "dt", variance_volatility(F.col("variance")).alias("conditional_volatility")))


def garch_conditional_vol(fitted: DataFrame, block: int = 256) -> DataFrame:
    """The model's volatility on each day of the series, annualised, one row per return.

    ``fitted`` needs return_days. The fold appends to lists of at most ``block`` values, and
    those to one list of blocks, so a long series is not copied once per day.
    """
    omega, alpha, beta = F.col("omega"), F.col("alpha"), F.col("beta")
    n_blocks = F.ceil(F.size("sq_residuals") / block).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1),
                         lambda b: F.slice("sq_residuals", b * block + 1, block))

    def run(first: Column, errors: Column) -> Column:
        return F.aggregate(
            errors,
            F.struct(first.alias("next"), F.array().cast("array<double>").alias("values")),
            lambda a, e: F.struct((omega + alpha * e + beta * a["next"]).alias("next"),
                                  F.concat(a["values"], F.array(a["next"])).alias("values")))

    first = omega + (alpha + beta) * F.col("start_variance")
    done = F.aggregate(
        blocks,
        F.array(F.struct(first.alias("next"), F.array().cast("array<double>").alias("values"))),
        lambda acc, b: F.concat(acc, F.array(run(F.element_at(acc, -1)["next"], b))))
    variances = F.flatten(F.transform(done, lambda x: x["values"]))
    return (
        fitted.select("ticker", F.inline(F.arrays_zip(
            F.col("return_days").alias("dt"), variances.alias("variance"))))
        .select("ticker", "dt",
                variance_volatility(F.col("variance")).alias("conditional_volatility"))
    )
