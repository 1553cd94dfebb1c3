"""Daily bars: building them from prints, validating, and cutting them to a period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmatide.functions.columns import whole

PRICES = ["open", "high", "low", "close"]
# Calendar months of each named look-back period; "5d" counts bars instead.
PERIOD_MONTHS = {"3mo": 3, "6mo": 6, "1y": 12, "2y": 24, "5y": 60}
PERIOD_BARS = {"5d": 5}


def sequence_key(high: Column, low: Column, low_digits: int) -> Column:
    """Two non-negative integers as one DECIMAL(38, 0) that sorts by (high, low).

    A struct would sort the same way but cannot be updated in a hash aggregate's buffer, so
    every map task would have to sort its rows first.
    """
    shift = F.lit(str(10 ** low_digits)).cast(f"decimal({low_digits + 1}, 0)")
    return (high.cast("decimal(19, 0)") * shift + low.cast("decimal(19, 0)")).cast("decimal(38, 0)")


def bars_daily(prints: DataFrame, order: Sequence[str], volume_scale: float = 1.0) -> DataFrame:
    """Prints (ticker, dt, price, qty, order columns) to one OHLCV bar per ticker and day.

    ``order`` must be a total order within a (ticker, dt); a single column (see sequence_key)
    keeps the plan a hash aggregate. Every aggregate has a partial form, so a ticker with
    most of the prints leaves each map task as one row per day.
    """
    key = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return prints.groupBy("ticker", "dt").agg(
        F.min_by("price", key).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", key).alias("close"),
        (F.sum("qty") * volume_scale).alias("volume"),
    )


def scan_bars(bars: DataFrame, one_per_day: bool = True) -> DataFrame:
    """Bars in the library's schema: normalised ticker, DATE, positive prices, no NaN.

    Names that differ in case or outer space are one ticker. Of its bars on one day the one
    with the largest volume stays (ties: the largest close, then the other prices), since
    every window counts on one row per ticker and day. ``one_per_day=False`` leaves out this
    step, for bars that come from bars_daily with normalised names.
    """
    def number(name: str) -> Column:
        return F.when(~F.isnan(name), F.col(name).cast("double")).alias(name)

    valid = F.lit(True)
    for name in PRICES:
        valid = valid & (F.col(name) > 0)
    rows = (
        bars.select(
            F.upper(F.trim("ticker")).alias("ticker"),
            F.col("dt").cast("date").alias("dt"),
            *[number(c) for c in PRICES + ["volume"]],
        )
        .filter(valid)
    )
    if not one_per_day:
        return rows
    best = F.max(F.struct("volume", "close", *[c for c in PRICES if c != "close"])).alias("_bar")
    return rows.groupBy("ticker", "dt").agg(best).select(
        "ticker", "dt", *[F.col(f"_bar.{c}").alias(c) for c in PRICES + ["volume"]])


def last_date(df: DataFrame) -> Column:
    """Latest ``dt`` of a table, as a scalar subquery."""
    return df.agg(F.max("dt")).scalar()


def period_start(bars: DataFrame, period: str, as_of: Column | None = None) -> Column:
    """Rows later than this date belong to the named calendar period.

    Without ``as_of`` the arithmetic is done within the aggregate: only a comparison with a bare
    subquery reaches the scan's filters.
    """
    if as_of is not None:
        return F.add_months(as_of, -PERIOD_MONTHS[period])
    return bars.agg(F.add_months(F.max("dt"), -PERIOD_MONTHS[period])).scalar()


def last_bars(bars: DataFrame, count: int) -> DataFrame:
    """The latest ``count`` bars per ticker.

    The rank filter becomes a group limit before the shuffle, so each map task sends at
    most ``count`` rows per ticker.
    """
    latest = Window.partitionBy("ticker").orderBy(F.desc("dt"))
    return (
        bars.withColumn("_rank", F.row_number().over(latest))
        .filter(F.col("_rank") <= count)
        .drop("_rank")
    )


def period_filter(bars: DataFrame, period: str, as_of: Column | None = None) -> DataFrame:
    """Bars of a named period ending at ``as_of`` (default: the table's last date).

    Apply it before any window: the warm-up rows come out of the period itself.
    """
    if period in PERIOD_BARS:
        return last_bars(bars, PERIOD_BARS[period])
    if period not in PERIOD_MONTHS:
        raise ValueError(f"unknown period {period!r}")
    inside = F.col("dt") > period_start(bars, period, as_of)
    return bars.filter(inside if as_of is None else inside & (F.col("dt") <= as_of))


MONTH = "month"


def write_bars(bars: DataFrame, folder: str) -> None:
    """Write bars as a table partitioned by the first day of the month."""
    by_month = bars.withColumn(MONTH, F.trunc("dt", "month"))
    by_month.repartition(MONTH).sortWithinPartitions(MONTH, "ticker", "dt").write.partitionBy(
        MONTH).parquet(folder)


def stored_period(stored: DataFrame, period: str) -> DataFrame:
    """Bars of a calendar period from a table of write_bars: only its months are listed and, within
    the first one, only the row groups after the start are read."""
    first = period_start(stored, period)
    month = stored.agg(F.trunc(F.add_months(F.max("dt"), -PERIOD_MONTHS[period]), "month")).scalar()
    return stored.filter((F.col(MONTH) >= month) & (F.col("dt") > first)).drop(MONTH)


def min_history(bars: DataFrame, rows: int) -> DataFrame:
    """Drop every ticker with fewer than ``rows`` bars."""
    return (
        bars.withColumn("_bars", F.count(F.lit(1)).over(whole()))
        .filter(F.col("_bars") >= rows)
        .drop("_bars")
    )
