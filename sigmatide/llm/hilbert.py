"""Sharding along a Hilbert curve.

Several metadata columns are quantised to a grid of 2**BITS cells a side, documents are put in
the order of their cell on the curve, and the order is cut into runs. Neighbours on the curve
are near in every dimension, so that each run covers a small box and a reader can skip the
files whose box misses its filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigmatide.llm.common import RANK, TOTAL, ranked
from sigmatide.session import staged

BITS = 5
ACCURACY = 100_000
DIMENSIONS = ("source", "lang", "n_chars")
VALUE_BLOCK = 1 << 16  # distinct strings that are counted together


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """(digit, next state) by state * 2**dims + corner, for one level of the curve.

    A state is an entry corner and an axis; the corner order within a cell is the Gray code,
    turned by the state (the public compact Hilbert index construction).
    """
    side = 1 << dims

    def turn(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & (side - 1)

    def gray_rank(g: int) -> int:
        rank = 0
        while g:
            rank ^= g
            g >>= 1
        return rank

    def trailing_ones(x: int) -> int:
        n = 0
        while x & 1:
            x, n = x >> 1, n + 1
        return n

    digits, states = [], []
    for entry in range(side):
        for axis in range(dims):
            for corner in range(side):
                w = gray_rank(turn(corner ^ entry, -(axis + 1)))
                start = 0 if w == 0 else (p := 2 * ((w - 1) // 2)) ^ (p >> 1)
                move = 0 if w == 0 else trailing_ones(w if w & 1 else w - 1) % dims
                digits.append(w)
                states.append((entry ^ turn(start, axis + 1)) * dims + (axis + move + 1) % dims)
    return digits, states


def curve_index(codes: Sequence[Column], bits: int = BITS) -> Column:
    """Place on the curve of a grid cell, given its code in each dimension."""
    dims = len(codes)
    digits, states = curve_tables(dims)
    side = 1 << dims
    digit, state = (F.array(*map(F.lit, t)) for t in (digits, states))
    planes = F.array(*[
        reduce(add, (F.shiftright(c, level).bitwiseAND(F.lit(1)) * (1 << axis)
                     for axis, c in enumerate(codes)))
        for level in reversed(range(bits))])

    def step(acc: Column, corner: Column) -> Column:
        at = acc["s"] * side + corner
        return F.struct((acc["h"] * side + F.get(digit, at)).alias("h"), F.get(state, at).alias("s"))

    zero = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s"))
    return F.aggregate(planes, zero, step, lambda acc: acc["h"])


def _string_codes(df: DataFrame, name: str, bits: int) -> DataFrame:
    """(value, code) of a string column: equal shares of the rows, in the order of the values.

    Values are counted first, so a value is a row however many documents have it, and placed by the number of rows
    before them; a value with many rows has the code of its middle row.
    """
    values = df.filter(df[name].isNotNull()).groupBy(df[name].alias("__value")).agg(F.count(F.lit(1)).alias("__rows"))
    placed = ranked(values, ["__value"])
    part = F.floor(F.col(RANK) / VALUE_BLOCK)
    blocks = placed.groupBy(part.alias("__block")).agg(F.sum("__rows").alias("__of_block"))
    # One row per VALUE_BLOCK distinct values, so this window of one task stays small.
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select(
        "__block", F.coalesce(F.sum("__of_block").over(before), F.lit(0)).alias("__base"),
        F.sum("__of_block").over(Window.partitionBy()).alias("__all"))
    inside = Window.partitionBy("__block").orderBy(RANK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("__base") + F.sum("__rows").over(inside) - (F.col("__rows") + 1) / 2
    code = F.least(F.floor(middle * (1 << bits) / F.col("__all")), F.lit((1 << bits) - 1))
    return staged(placed.withColumn("__block", part).join(bases, "__block")
                  .select("__value", code.cast("int").alias("__code")), "value-codes")


def with_cells(df: DataFrame, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """The table with ``cell``, the curve place of each row; dimensions are cut into equal shares of the rows.

    Strings are cut by their rank among the counted distinct values, numbers at their quantiles, one bounded row
    (2**bits - 1 numbers a dimension). Nulls take code 0. Numbers, codes and places are columns of their own:
    written as one expression, each number would be computed again for every cut it is compared with.
    """
    strings = [c for c in dimensions if isinstance(df.schema[c].dataType, T.StringType)]
    names = {c: f"__d{i}" for i, c in enumerate(dimensions)}
    coded = df.withColumns({names[c]: df[c].cast("double") for c in dimensions if c not in strings})
    for c in strings:
        codes = _string_codes(df, c, bits).withColumnsRenamed({"__value": f"{names[c]}v", "__code": f"{names[c]}c"})
        coded = coded.join(codes, coded[c] == codes[f"{names[c]}v"], "left").drop(f"{names[c]}v").withColumn(
            f"{names[c]}c", F.coalesce(f"{names[c]}c", F.lit(0)))
    numbers = [names[c] for c in dimensions if c not in strings]
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    if numbers:
        cuts = coded.agg(*[F.percentile_approx(n, shares, ACCURACY).alias(n) for n in numbers]).first()
        coded = coded.withColumns({f"{n}c": reduce(add, (
            F.coalesce((F.col(n) > F.lit(x)).cast("int"), F.lit(0)) for x in cuts[n] or [None])) for n in numbers})
    columns = [f"{names[c]}c" for c in dimensions]
    return coded.withColumn("cell", curve_index([F.col(c) for c in columns], bits)).drop(*numbers, *columns)


def hilbert_shards(
    docs: DataFrame,
    shards: int,
    keep: Sequence[str | Column] = (),
    dimensions: Sequence[str] = DIMENSIONS,
    id_col: str = "doc_id",
    bits: int = BITS,
) -> DataFrame:
    """doc_id, the columns ``keep``, cell, shard, slot: every row in exactly one shard.

    Runs of the curve order with row counts at most one apart; ``slot`` is the place within the
    shard from 0. Ties of a cell go by id, null first, then by the kept columns; full repeats
    are placed side by side. With fewer rows than shards some shards are empty; an empty table
    gives an empty result. Null or missing metadata falls in the lowest code of its dimension.
    Only the named columns are read; kept columns may have any names but those of the result.
    """
    kept = [docs[c] if isinstance(c, str) else c for c in keep]
    clash = {"doc_id", "cell", "shard", "slot"}.intersection(docs.select(*kept).columns)
    if clash:
        raise ValueError(f"kept columns are named as the result's: {sorted(clash)}")
    facts = docs.select(docs[id_col].alias("doc_id"), *kept,
                        *[docs[d].alias(f"__{d}") for d in dimensions])
    placed = with_cells(facts, [f"__{d}" for d in dimensions], bits).drop(*[f"__{d}" for d in dimensions])
    order = ["cell", "doc_id", *[c for c in placed.columns if c not in ("cell", "doc_id")]]
    run = F.expr(f"cast({RANK} * {shards} div {TOTAL} as int)")
    return (
        ranked(placed, order)
        .withColumn("shard", run)
        .withColumn("slot", F.expr(f"{RANK} - (shard * {TOTAL} + {shards - 1}) div {shards}"))
        .drop(RANK, TOTAL)
    )


def shard_boxes(placed: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Per shard the row count and the range of each dimension, for choosing files by a filter."""
    return placed.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"),
        *[f(c).alias(f"{name}_{c}") for c in dimensions
          for name, f in (("min", F.min), ("max", F.max))])
