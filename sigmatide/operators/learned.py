"""Learned forecast of Yang-Zhang volatility from lagged panel rows.

One pooled model over the scaled series of all tickers, fitted with MLlib, instead of one network per
ticker: its size does not grow with the number of tickers. The linear model is a single distributed
pass; boosted trees are the non-linear form, with the last rows of each ticker to stop them by.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmatide.functions.columns import by_time, whole
from sigmatide.operators.estimators import vol_panel
from sigmatide.operators.forecast import business_days, spread_tickers
from sigmatide.session import staged

FEATURES = ["returns", "historical", "ewma"]
TARGET = "yang_zhang"
SCALED = [*FEATURES, TARGET]
CI_LOW, CI_HIGH = 0.85, 1.15
ENSEMBLE_CI_LOW, ENSEMBLE_CI_HIGH = 0.8, 1.2
ENSEMBLE_LOOKBACK = 30


@dataclass
class GivenModel:
    """A linear model with fixed weights, in place of a fitted one."""

    coefficients: list[float]
    intercept: float


#: A leaf's value, or (feature, threshold, tree up to the threshold, tree above it).
Tree = float | tuple


@dataclass
class BoostedTrees:
    """Regression trees with weights, as data: usable in any expression, without a vector column or a model object."""

    trees: list[Tree]
    weights: list[float]

    @classmethod
    def of(cls, model: GBTRegressionModel) -> BoostedTrees:
        return cls([_read_tree(t.toDebugString) for t in model.trees], [float(w) for w in model.treeWeights])

    def column(self, steps: Column) -> Column:
        """The prediction for an array of features."""
        def value(tree: Tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            feature, threshold, low, high = tree
            return F.when(F.get(steps, F.lit(feature)) <= threshold, value(low)).otherwise(value(high))

        total = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights):
            total = total + weight * value(tree)
        return total

    def sql(self, steps: str) -> str:
        """The same as SQL text over a list column counted from 1."""
        def value(tree: Tree) -> str:
            if not isinstance(tree, tuple):
                return f"({tree!r}::DOUBLE)"
            feature, threshold, low, high = tree
            return f"CASE WHEN {steps}[{feature + 1}] <= {threshold!r}::DOUBLE THEN {value(low)} ELSE {value(high)} END"

        return " + ".join(f"{w!r}::DOUBLE * {value(t)}" for t, w in zip(self.trees, self.weights))


def _read_tree(text: str) -> Tree:
    """A tree from MLlib's printed form: lines of If, Else and Predict, in depth-first order."""
    lines = iter(re.findall(r"If \(feature (\d+) <= (\S+)\)|Else|Predict: (\S+)", text))

    def node() -> Tree:
        feature, threshold, leaf = next(lines)
        if leaf:
            return float(leaf)
        low = node()
        next(lines)  # Else
        return int(feature), float(threshold), low, node()

    return node()


def minmax_scale(panel: DataFrame, train_fraction: float | None = None) -> DataFrame:
    """Scale returns, historical, EWMA and the target to [0, 1] per ticker; range 0 gives 0.

    Adds ``<name>_scaled`` and keeps ``<name>_min`` / ``<name>_range``. By default the bounds
    come from the full history; with ``train_fraction`` from its first rows only.
    """
    rows = panel
    seen = F.lit(True)
    if train_fraction is not None:
        rows = rows.withColumns({
            "_row": F.row_number().over(by_time()),
            "_rows": F.count(F.lit(1)).over(whole()),
        })
        seen = F.col("_row") <= F.floor(F.col("_rows") * train_fraction)
    rows = rows.withColumns({
        **{f"{c}_min": F.min(F.when(seen, F.col(c))).over(whole()) for c in SCALED},
        **{f"{c}_max": F.max(F.when(seen, F.col(c))).over(whole()) for c in SCALED},
    })
    spread = {c: F.col(f"{c}_max") - F.col(f"{c}_min") for c in SCALED}
    rows = rows.withColumns({f"{c}_range": F.when(s == 0, F.lit(1.0)).otherwise(s)
                             for c, s in spread.items()})
    return (
        rows.withColumns({
            f"{c}_scaled": (F.col(c) - F.col(f"{c}_min")) / F.col(f"{c}_range") for c in SCALED})
        .drop("_row", "_rows", *[f"{c}_max" for c in SCALED])
    )


def _feature_row() -> Column:
    return F.array(*[F.col(f"{c}_scaled") for c in FEATURES])


def lag_sequences(scaled: DataFrame, lookback: int = 60) -> DataFrame:
    """Each row with the ``lookback`` rows before it, and the scaled target of the row itself.

    ``steps`` is the flat feature array, oldest first; ``seq`` numbers the sequences from 1.
    """
    before = by_time().rowsBetween(-lookback, -1)
    return (
        spread_tickers(scaled).withColumn("_rows", F.collect_list(_feature_row()).over(before))
        .filter(F.size("_rows") == lookback)
        .select(
            "ticker", "dt", F.flatten("_rows").alias("steps"),
            F.col(f"{TARGET}_scaled").alias("target"),
            F.col(TARGET).alias("actual"),
            f"{TARGET}_min", f"{TARGET}_range",
        )
        .withColumn("seq", F.row_number().over(by_time()))
    )


def chrono_split(sequences: DataFrame, train_fraction: float = 0.8) -> DataFrame:
    """Mark the first ``train_fraction`` of each ticker's rows as training rows."""
    return sequences.withColumn(
        "is_train",
        F.row_number().over(by_time())
        <= F.floor(F.count(F.lit(1)).over(whole()) * train_fraction))


def lag_regression_fit(split: DataFrame, ridge: float = 1e-6) -> LinearRegressionModel:
    """Pooled ridge regression of the target on the lagged steps, on training rows.

    The normal equations need one pass over the rows and a matrix of lookback * 3 squared.
    """
    rows = split.filter("is_train").select(
        array_to_vector("steps").alias("features"), F.col("target").alias("label"))
    return LinearRegression(solver="normal", regParam=ridge, standardization=False).fit(rows)


def boosted_fit(split: DataFrame, **options: float) -> BoostedTrees:
    """The trees of boosted_model as data."""
    return BoostedTrees.of(boosted_model(split, **options))


def boosted_model(split: DataFrame, trees: int = 20, depth: int = 4, rate: float = 0.1, tolerance: float = 1e-4,
                  features: str = "all", seed: int = 7) -> GBTRegressionModel:
    """Boosted regression trees on the lagged steps of the training rows.

    The rows that are not for training stop the fit: once another tree lowers their mean squared error by less than
    ``tolerance`` times the greater of it and 0.01, the trees up to the best one stay. Each level of a tree is one pass over binned rows with an aggregate of
    features times bins, so rows are never gathered; ``features`` is how many of them a split may choose from (as
    MLlib's featureSubsetStrategy). The rows are staged by the caller if they are dear.
    """
    rows = split.select(array_to_vector("steps").alias("features"), F.col("target").alias("label"),
                        (~F.col("is_train")).alias("stops"))
    return GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, validationIndicatorCol="stops",
                        validationTol=tolerance, featureSubsetStrategy=features).fit(rows)


def fit_gradient(split: DataFrame, model: LinearRegressionModel, ridge: float = 1e-6) -> DataFrame:
    """(feature, gradient, n): the derivative of the training loss by each weight, per row; the
    intercept is the last feature. All are zero at the least-squares solution."""
    error = F.col("target") - _dot(F.col("steps"), model)
    terms = F.posexplode(F.concat("steps", F.array(F.lit(1.0)))).alias("feature", "x")
    weights = F.array(*[F.lit(float(c)) for c in [*model.coefficients, 0.0]])
    rows = split.filter("is_train").select(error.alias("error"), "steps").select("error", terms)
    return rows.groupBy("feature").agg(
        F.avg(F.col("error") * F.col("x")).alias("mean"), F.count(F.lit(1)).alias("n"),
    ).select("feature", (F.col("mean") - ridge * F.get(weights, F.col("feature"))).alias("gradient"), "n")


def lag_predictions(split: DataFrame, model: LinearRegressionModel | BoostedTrees) -> DataFrame:
    """Unscaled one-step predictions next to the actual values."""
    predicted = F.col("prediction") * F.col(f"{TARGET}_range") + F.col(f"{TARGET}_min")
    if isinstance(model, BoostedTrees):
        return split.withColumn("prediction", model.column(F.col("steps"))).select(
            "ticker", "dt", "is_train", "actual", predicted.alias("predicted"))
    rows = split.withColumn("features", array_to_vector("steps"))
    return model.transform(rows).select("ticker", "dt", "is_train", "actual",
                                        predicted.alias("predicted"))


def _dot(steps: Column, model: LinearRegressionModel | GivenModel | BoostedTrees) -> Column:
    if isinstance(model, BoostedTrees):
        return model.column(steps)
    weights = F.array(*[F.lit(float(c)) for c in model.coefficients])
    products = F.zip_with(steps, weights, lambda x, w: x * w)
    return F.aggregate(products, F.lit(float(model.intercept)), lambda a, p: a + p)


def regression_metrics(predictions: DataFrame) -> DataFrame:
    """RMSE and MAE of (ticker, actual, predicted) rows, per ticker."""
    error = F.col("actual") - F.col("predicted")
    return predictions.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(error * error)).alias("val_rmse"),
        F.avg(F.abs(error)).alias("val_mae"),
    )


def lag_regression_forecast(scaled: DataFrame, model: LinearRegressionModel | GivenModel | BoostedTrees,
                            horizon: int = 30, lookback: int = 60) -> DataFrame:
    """Forecast step by step, feeding each prediction back as historical and EWMA value.

    The window of the last ``lookback`` rows is cut by rank before it is collected, and the
    recursion is a fold over the steps. The last return is repeated.
    """
    recent = Window.partitionBy("ticker").orderBy(F.desc("dt"))
    tail = (
        scaled.withColumn("_rank", F.row_number().over(recent))
        .filter(F.col("_rank") <= lookback)
        .groupBy("ticker")
        .agg(
            F.max("dt").alias("dt"),
            F.transform(F.array_sort(F.collect_list(F.struct("dt", _feature_row().alias("x")))),
                        lambda r: r["x"]).alias("rows"),
            F.first(f"{TARGET}_min").alias("low"),
            F.first(f"{TARGET}_range").alias("range"),
        )
        .filter(F.size("rows") == lookback)
        .withColumn("steps", F.flatten("rows"))
    )
    width = len(FEATURES)
    last_return = F.element_at("steps", -width)

    def advance(state: Column, _: Column) -> Column:
        guess = _dot(state["window"], model)
        # A one-element transform binds the prediction, so it is computed once per step.
        return F.transform(F.array(guess), lambda p: F.struct(
            F.concat(F.slice(state["window"], width + 1, (lookback - 1) * width),
                     F.array(last_return, p, p)).alias("window"),
            F.concat(state["path"], F.array(p)).alias("path")))[0]

    start = F.struct(F.col("steps").alias("window"),
                     F.array().cast("array<double>").alias("path"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, advance, lambda s: s["path"])
    vol = F.col("volatility")
    return (
        business_days(tail.withColumn("path", path), horizon)
        .withColumn("volatility",
                    F.element_at("path", F.col("step")) * F.col("range") + F.col("low"))
        .select("ticker", "step", "dt", "volatility", (vol * CI_LOW).alias("lower_ci"),
                (vol * CI_HIGH).alias("upper_ci"))
    )


def learned_forecast(bars: DataFrame, horizon: int = 30, lookback: int = 60, boosted: bool = False) -> DataFrame:
    """Fit on the bars and forecast every ticker with enough rows, by the linear model or by boosted trees.

    Fit and forecast both read the panel, so it is written once; boosting reads the sequences for every tree, so
    they are written too.
    """
    scaled = staged(minmax_scale(vol_panel(bars)), "scaled-panel")
    split = chrono_split(lag_sequences(scaled, lookback))
    model = boosted_fit(staged(split, "split")) if boosted else lag_regression_fit(split)
    return lag_regression_forecast(scaled, model, horizon, lookback)


def forecast_ensemble(garch: DataFrame, learned: DataFrame, garch_weight: float = 0.5) -> DataFrame:
    """Weighted mean of two forecasts of the same (ticker, step)."""
    left = garch.select("ticker", "step", "dt", F.col("volatility").alias("garch"))
    right = learned.select("ticker", "step", F.col("volatility").alias("learned"))
    mixed = garch_weight * F.col("garch") + (1 - garch_weight) * F.col("learned")
    return left.join(right, ["ticker", "step"]).select(
        "ticker", "step", "dt", "garch", "learned", mixed.alias("ensemble"),
        (mixed * ENSEMBLE_CI_LOW).alias("lower_ci"), (mixed * ENSEMBLE_CI_HIGH).alias("upper_ci"))
