"""Exact duplicates by skew-safe combining.

Copies are merged three times, each time on digest and full content: within a map task, then
per digest and salt, then over the salts. A digest shared by a third of all rows reaches a task
as one row per map task and salt, never as its documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmatide.llm.common import documents_of, one_per_key, only_rows, row_key, same
from sigmatide.session import staged

SALTS = 16


def normalised(text: Column) -> Column:
    """The text compared: every run of white space is one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    """One row per distinct text: digest, keep_id, group_size; ``content`` only where two
    texts share a digest."""
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "salt", "content")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    merged = (
        salted.repartition("digest").groupBy("digest", "content")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    )
    texts = F.count(F.lit(1)).over(Window.partitionBy("digest"))  # one, but for digest clashes
    return merged.select(
        "digest", "keep_id", "group_size", F.when(texts > 1, F.col("content")).alias("content"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white space runs become one space; null counts as
    empty, so null, and only null and '', are copies of each other. The smallest id of a group
    stays. Rows without id never win over rows with one; a group without any id has no keep_id
    and all of it is kept. Rows that repeat id and text are one document and get the same
    answer. An empty table gives an empty result; other columns are ignored.
    """
    content = documents_of(docs, id_col, text_col).select(
        "doc_id", normalised(F.col("text")).alias("content"))
    rows = content.select("doc_id", "content", digest(F.col("content")).alias("digest"))
    winners = staged(_winners(rows, salts), "exact-winners")
    narrow = rows.select("doc_id", "digest", F.sha2("content", 256).alias("text_sha256"))
    plain = winners.filter("content IS NULL").drop("content")
    found = narrow.join(plain, "digest")
    if not winners.filter("content IS NOT NULL").isEmpty():
        # Different texts under one digest: their rows are told apart by content.
        clashing = winners.filter("content IS NOT NULL")
        wide = rows.withColumn("text_sha256", F.sha2("content", 256))
        found = found.unionByName(
            wide.join(clashing, ["digest", "content"]).select(*found.columns))
    return found.select(
        "doc_id", "keep_id", "group_size",
        same(F.col("doc_id"), F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; one row where id and text repeat."""
    kept = exact_dedup(docs, id_col, text_col).filter("kept")
    own = row_key(docs[id_col], F.sha2(normalised(docs[text_col]), 256))
    return one_per_key(only_rows(docs, own, kept.select(row_key(F.col("doc_id"), F.col("text_sha256")))))
