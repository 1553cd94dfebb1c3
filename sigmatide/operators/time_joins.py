"""Joins by time: the latest row before a moment, moments inside intervals, intervals that overlap.

All of them deal rows out by key and a block of time, so a key with most of the rows is many tasks, and
all are equi-joins or windows over (key, block): no nested loop, no list per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_SECONDS = 86_400


def time_block(time: Column, seconds: int) -> Column:
    """Number of the block of ``seconds`` that a date or timestamp lies in."""
    micros, width = F.unix_micros(time.cast("timestamp")), F.lit(seconds * 1_000_000)
    return ((micros - F.pmod(micros, width)) / width).cast("long")


def asof_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, columns: Sequence[str],
              block_seconds: int = 30 * DAY_SECONDS, strict: bool = False) -> DataFrame:
    """Every row of ``left`` with ``right_time`` and ``columns`` of the latest row of ``right`` not after it.

    With ``strict`` the right row must be earlier. Rows of ``left`` without such a row, or without key or time, stay with
    nulls; rows of ``right`` without key or time match nothing. Of right rows with one time the greatest by
    ``columns`` counts. Repeated left rows stay repeated. The right names must not be names of ``left``.

    Both sides are sorted together within (key, block). What a block needs from before it is one row, carried from the
    last filled block: a running maximum over the blocks of the key, which are as many as the calendar has.
    """
    names = [right_time, *columns]
    if set(names) & set(left.columns):
        raise ValueError(f"columns {sorted(set(names) & set(left.columns))} are on both sides")
    value = F.struct(*(F.col(c) for c in names))
    found = right.select(F.col(on).alias("_key"), value.alias("_value")).filter(
        F.col("_key").isNotNull() & F.col(f"_value.{right_time}").isNotNull())
    found = found.withColumn("_at", F.col(f"_value.{right_time}").cast("timestamp"))
    rows = left.select(F.col(on).alias("_key"), F.col(left_time).cast("timestamp").alias("_at"),
                       F.struct(*(F.col(c) for c in left.columns)).alias("_row"))
    complete = F.col("_key").isNotNull() & F.col("_at").isNotNull()
    found, rows = (df.withColumn("_block", time_block(F.col("_at"), block_seconds)) for df in (found, rows))

    ends = found.groupBy("_key", "_block").agg(F.max("_value").alias("_end"))
    asked = rows.filter(complete).select("_key", "_block").distinct().withColumn("_asked", F.lit(True))
    earlier = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    seeds = (
        ends.join(asked, ["_key", "_block"], "full")
        .withColumn("_value", F.max("_end").over(earlier)).filter("_asked AND _value IS NOT NULL")
        .select("_key", "_block", F.col(f"_value.{right_time}").cast("timestamp").alias("_at"), "_value"))
    side = F.lit(-1 if strict else 1)  # against equal times of the right side, which is 0
    both = (
        rows.filter(complete).withColumn("_side", side)
        .unionByName(found.unionByName(seeds).withColumn("_side", F.lit(0)), allowMissingColumns=True))
    so_far = (Window.partitionBy("_key", "_block").orderBy("_at", "_side")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    matched = both.withColumn("_value", F.max("_value").over(so_far)).filter(F.col("_side") == side).select("_row", "_value")
    without = rows.filter(~complete).select("_row", F.lit(None).cast(matched.schema["_value"].dataType).alias("_value"))
    matched = matched.unionByName(without)
    return matched.select("_row.*", *(F.col(f"_value.{c}").alias(c) for c in names))


def _blocks(start: Column, end: Column, seconds: int) -> Column:
    """The blocks that [start, end) touches."""
    last = F.greatest(time_block(start, seconds), time_block(end - F.expr("INTERVAL 1 MICROSECOND"), seconds))
    return F.sequence(time_block(start, seconds), last)


def _bounds(df: DataFrame, on: str, start: str, end: str, row: str) -> DataFrame:
    own = [F.col(c) for c in df.columns]
    rows = df.select(F.col(on).alias("_key"), F.struct(*own).alias(row), F.col(start).cast("timestamp").alias(f"{row}_start"),
                     F.col(end).cast("timestamp").alias(f"{row}_end"))
    return rows.filter(F.col("_key").isNotNull() & (F.col(f"{row}_start") < F.col(f"{row}_end")))


def interval_join(points: DataFrame, intervals: DataFrame, on: str, at: str, start: str, end: str,
                  block_seconds: int = 30 * DAY_SECONDS) -> DataFrame:
    """Pairs of a point and an interval of its key with start <= at < end; the interval's key is left out.

    Rows without key or time and empty intervals match nothing; a point in several intervals gives several rows. A point
    is in one block, an interval is repeated in every block it touches: a block should be near the usual length.
    Names must differ, but for the key.
    """
    clash = (set(points.columns) & set(intervals.columns)) - {on}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are on both sides")
    moments = points.filter(F.col(on).isNotNull() & F.col(at).isNotNull()).withColumn(
        "_block", time_block(F.col(at), block_seconds)).withColumn("_key", F.col(on))
    spans = _bounds(intervals, on, start, end, "_span").withColumn(
        "_block", F.explode(_blocks(F.col("_span_start"), F.col("_span_end"), block_seconds)))
    moment = F.col(at).cast("timestamp")
    joined = moments.join(spans, ["_key", "_block"]).filter((moment >= F.col("_span_start")) & (moment < F.col("_span_end")))
    return joined.select(*points.columns, *(F.col(f"_span.{c}").alias(c) for c in intervals.columns if c != on))


def overlap_join(left: DataFrame, right: DataFrame, on: str, start: str, end: str,
                 block_seconds: int = 30 * DAY_SECONDS) -> DataFrame:
    """Pairs of intervals [start, end) of one key that overlap: the key, ``left`` and ``right`` rows, and the overlap.

    A pair that shares several blocks is given once, in the block where its overlap starts. Intervals without key or
    bound, and empty ones, match nothing.
    """
    sides = [
        _bounds(df, on, start, end, name).withColumn(
            "_block", F.explode(_blocks(F.col(f"{name}_start"), F.col(f"{name}_end"), block_seconds)))
        for df, name in ((left, "left"), (right, "right"))]
    first = F.greatest("left_start", "right_start")
    last = F.least("left_end", "right_end")
    return (
        sides[0].join(sides[1], ["_key", "_block"])
        .filter((first < last) & (time_block(first, block_seconds) == F.col("_block")))
        .select(F.col("_key").alias(on), "left", "right", first.alias("overlap_start"), last.alias("overlap_end")))


def stretches(states: DataFrame, on: str, at: str, state: str) -> DataFrame:
    """Runs of equal ``state`` of a key in the order of ``at``: key, state, stretch (from 1), start, last, end, rows.

    A stretch ends where the next one starts; the last one has no end. Null is a state like others. One row per key and
    time, so a key is as long as the calendar.
    """
    order = Window.partitionBy(on).orderBy(at)
    before = F.lag(F.struct(state)).over(order)
    change = F.when(before.isNull() | ~before.eqNullSafe(F.struct(state)), 1).otherwise(0)
    numbered = states.select(on, at, state, F.sum(change).over(order).alias("stretch"), F.lead(at).over(order).alias("_next"))
    runs = numbered.groupBy(on, "stretch").agg(
        F.min_by(state, at).alias(state), F.min(at).alias("start"), F.max(at).alias("last"),
        F.max_by("_next", at).alias("end"), F.count(F.lit(1)).alias("rows"))
    return runs.select(on, state, "stretch", "start", "last", "end", "rows")


def row_blocks(rows: DataFrame, on: str, at: str, size: int, halo: int,
               block_seconds: int = 30 * DAY_SECONDS) -> DataFrame:
    """Rows numbered in time and cut into blocks of ``size`` rows of a key, each with the ``halo`` rows before it.

    Adds ``row`` (from 1), ``block`` and ``in_halo``. Rows that stand in a halo occur twice. A window of at most halo + 1 rows
    over (key, block) then equals the window over the key, while no task holds a key: rows are numbered within
    blocks of time, and the numbers that blocks start with come from their counts. A key and time occur once.
    """
    if halo > size:
        raise ValueError("a halo comes from one block, so it is no longer than a block")
    timed = rows.withColumn("_time_block", time_block(F.col(at), block_seconds))
    counts = timed.groupBy(on, "_time_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(on).orderBy("_time_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(on, "_time_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy(on, "_time_block").orderBy(at))
    numbered = timed.withColumn("row", own).join(bases, [on, "_time_block"]).withColumn("row", F.col("row") + F.col("_base"))
    block = F.floor((F.col("row") - 1) / size)
    at_end = F.pmod(F.col("row") - 1, F.lit(size)) >= size - halo
    places = F.when(at_end, F.array(F.struct(block.alias("block"), F.lit(False).alias("in_halo")),
                                    F.struct((block + 1).alias("block"), F.lit(True).alias("in_halo")))
                    ).otherwise(F.array(F.struct(block.alias("block"), F.lit(False).alias("in_halo"))))
    return numbered.select(*rows.columns, "row", F.inline(places))
