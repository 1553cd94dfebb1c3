"""Column builders shared by the operators.

A daily bar table holds one row per (ticker, calendar day), so a ticker's window
partition is bounded by the calendar (36,525 rows per century) however large the
table is. Data without that bound (prints, ticks, news) never reaches a per-ticker
window before it is pre-aggregated or cut to its top rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

TRADING_DAYS = 252
ANNUAL = math.sqrt(TRADING_DAYS)
# Two values nearer than this are the same value; the difference is summation noise.
NOISE = 1e-12


def by_time() -> WindowSpec:
    """Rows of one ticker, oldest first."""
    return Window.partitionBy("ticker").orderBy("dt")


def whole() -> WindowSpec:
    """All rows of one ticker; same sort as by_time(), so both share one Window node."""
    return by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def by_block() -> WindowSpec:
    """The order of by_time(), sorted on (block, dt).

    ``block`` grows with dt. Windows after one over (ticker, block) need no new sort this way.
    """
    return Window.partitionBy("ticker").orderBy("block", "dt")


def root(x: Column) -> Column:
    """Square root, NULL (not NaN) for negative input."""
    return F.when(x >= 0, F.sqrt(x))


def ratio_change(now: Column, before: Column) -> Column:
    return F.try_divide(now, before) - 1


def first_match(*rules: tuple[Column, object], otherwise: object = None) -> Column:
    """Value of the first rule whose condition holds."""
    expr = None
    for cond, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    if otherwise is None:
        return expr
    return expr.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def points(*rules: tuple[Column, int]) -> Column:
    """Score of the first rule that holds, else 0."""
    return first_match(*rules, otherwise=0)


def business_day(last: Column, step: Column) -> Column:
    """The step-th Monday-to-Friday date after ``last``.

    Counted from the last weekday on or before ``last``: every five steps skip one weekend.
    """
    weekday = F.weekday(last)  # Monday = 0
    pos = F.least(weekday, F.lit(4))
    base = F.date_sub(last, weekday - pos)
    return F.date_add(base, step + F.floor((pos + step) / 5).cast("int") * 2)


def number_text(x: Column, decimals: int, signed: bool = False) -> Column:
    """Fixed-decimal text, rounded half-even on the exact binary value."""
    shape = "0" if decimals == 0 else "0." + "0" * decimals
    if signed:
        shape = f"+{shape};-{shape}"
    return F.call_function("format_number", x, F.lit(shape))
