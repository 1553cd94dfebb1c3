"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmatide.session import staged

ROW_BITS = 33  # monotonically_increasing_id keeps the row of a partition in the lower 33 bits
WHITE = " \t\n\x0b\x0c\r"


def documents_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, so that no other column can clash with an operator's own."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))


def row_digest(text: Column) -> Column:
    """Together with doc_id the identity of a row, where ids repeat."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def same(left: Column, right: Column) -> Column:
    """Equality that also matches null with null."""
    return left.eqNullSafe(right)


# What tasks remember in their worker, by name, and how it is emptied.
_REMEMBERED: dict[str, Callable[[], None]] = {}


def remembered(name: str, clear: Callable[[], None]) -> None:
    """Register what outlives a task, so that a worker that goes on to another operator can forget it."""
    _REMEMBERED[name] = clear


def trim() -> None:
    """Give unused memory back, that of Arrow's pool and, with the system pool, that of the C library."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def in_worker(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              *own: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, in a worker that remembers nothing but ``own`` when a task begins.

    A worker lives on between stages, so what the tables of one operator take would be added
    to those of the next. At its end a task gives the memory back that it does not use any more.
    Only speed and memory depend on it.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, clear in _REMEMBERED.items():
            if name not in own:
                clear()
        trim()
        yield from run(batches)
        trim()

    return task


KEY = "__row_key"


def row_key(doc_id: Column, *content: Column) -> Column:
    """One string key of an id and content hashes; null is a value like others."""
    return F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("none")) for c in (doc_id, *content)))


def only_rows(docs: DataFrame, key: Column, chosen: DataFrame, drop: bool = False) -> DataFrame:
    """Rows of ``docs`` whose key is, or with ``drop`` is not, in the one column of ``chosen``.

    The key stays as column KEY, which the result is partitioned by.
    """
    keys = chosen.toDF(KEY).distinct()
    return docs.withColumn(KEY, key).join(keys, KEY, "left_anti" if drop else "left_semi")


def one_per_key(df: DataFrame) -> DataFrame:
    """One row of each KEY, without it; a rank filter, so a task sends on at most one row of a key."""
    first = F.row_number().over(Window.partitionBy(KEY).orderBy(KEY))
    return df.withColumn("__first", first).filter("__first = 1").drop("__first", KEY)


RANK, TOTAL = "__rank", "__total"


def ranked(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows in the total order of ``order`` with RANK from 0 and TOTAL, without a global sort task.

    Rows are range partitioned and sorted, each partition numbers its own rows, and the
    partitions' first ranks come from their sizes: one row per partition, which bounds the
    broadcast and the single-task window. The numbered rows are written once, since a second
    evaluation could cut the ranges elsewhere. Rows equal in ``order`` get ranks in any order.
    Names that begin with two underscores are the library's own; others cannot clash.
    """
    numbered = staged(
        df.repartitionByRange(*(f"`{c}`" for c in order)).sortWithinPartitions(*(f"`{c}`" for c in order))
        .withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", ROW_BITS)
    row = F.col("__at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    sizes = numbered.groupBy(part.alias("__part")).agg((F.max(row) + 1).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "__part",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"),
        F.sum("__n").over(Window.partitionBy()).alias(TOTAL))
    return (
        numbered.withColumn("__part", part)
        .join(F.broadcast(starts), "__part")
        .withColumn(RANK, F.col("__base") + row)
        .drop("__part", "__at", "__base")
    )
