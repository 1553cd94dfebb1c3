"""Percentiles and distinct counts of any period from sketches kept per month.

A month of a ticker is one row: a KLL sketch of a value's ranks, an HLL sketch of its distinct prices, and how many
values there are. Sketches merge without looking at the values again, so a period of any length reads one
row per month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KLL_K = 800
RANK_ERROR = 0.0133  # of a KLL sketch with k = 200, which one with KLL_K is well inside of, as share of the values
GRID = 1000
HLL_BITS = 12
COUNT_ERROR = 0.05  # three standard errors of 2**HLL_BITS registers


def cents(price: Column) -> Column:
    return F.round(price * 100).cast("bigint")


def month_sketches(rows: DataFrame, value: str = "yang_zhang", price: str = "close") -> DataFrame:
    """ticker, month, n, ranks, prices, last_dt, last: one row per ticker and month with a value.

    ``rows`` has ticker, dt and the two columns; rows without a value, or with NaN, count nowhere. Both sketches are partial
    aggregates, so a hot ticker leaves a map task as one row per month.
    """
    return rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy("ticker", F.trunc("dt", "MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"),
        F.kll_sketch_agg_double(value, F.lit(KLL_K)).alias("ranks"),
        F.hll_sketch_agg(cents(F.col(price)), HLL_BITS).alias("prices"),
        F.max("dt").alias("last_dt"), F.max_by(value, "dt").alias("last"))


def merged_sketches(months: DataFrame, since: Column | None = None) -> DataFrame:
    """The sketches of each ticker over its months from ``since``, or over all."""
    kept = months if since is None else months.filter(F.col("month") >= since)
    return kept.groupBy("ticker").agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("ranks").alias("ranks"), F.hll_union_agg("prices").alias("prices"),
        F.max("last_dt").alias("last_dt"), F.max_by("last", "last_dt").alias("last"))


def sketched_percentile(merged: DataFrame) -> DataFrame:
    """ticker, n, last_dt, last, percentile (of the last value among all, from 0 to 100) and prices (distinct ones).

    The percentile, of the values below the last one, is within RANK_ERROR, the number of prices within COUNT_ERROR. Spark
    tells a sketch's rank of a fixed value only, so the last value is looked up among GRID + 1 quantiles.
    """
    grid = F.kll_sketch_get_quantile_double("ranks", F.array(*(F.lit(i / GRID) for i in range(GRID + 1))))
    below = F.size(F.filter(grid, lambda q: q < F.col("last"))) / (GRID + 1)
    return merged.select("ticker", "n", "last_dt", "last", (below * 100).alias("percentile"),
                         F.hll_sketch_estimate("prices").alias("prices"))
