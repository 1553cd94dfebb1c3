"""Lines that many documents share.

Each line is normalised and hashed; documents are counted per hash; lines of frequent hashes go
from every document but one; texts are put together again by line position.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmatide.llm.common import WHITE, documents_of, row_digest, same
from sigmatide.session import staged

MIN_LENGTH, MIN_DOCUMENTS = 40, 5


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), ascii_uppercase, ascii_lowercase)


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """One row per document: doc_id, text (lines that stay), n_lines, n_dropped.

    A line's key is the line without white space at its ends and with A-Z in lower case. Keys of
    at least ``min_length`` code points that at least ``min_documents`` documents hold lose all
    their lines, except in the largest doc_id that holds them. A null or empty text is one empty
    line. Rows that repeat an id are one document, whose lines all count once; each of them keeps the line if the id is
    the largest. Rows without id are no document: they make no line frequent, and lose those that are. An empty
    table gives an empty result.

    Counting is a partial aggregate, so a line in every document leaves a map task as one row.
    Frequent hashes are written before lines are joined to them: the optimizer then knows their
    size, and can split a hot hash of the join.
    """
    rows = documents_of(docs, id_col, text_col).select(
        "doc_id", row_digest(F.col("text")).alias("row"),
        F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))

    def mark(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.length(key) >= min_length, F.unhex(F.md5(key)))

    hashed = rows.select("doc_id", "row", F.transform("lines", mark).alias("hashes"))
    held = hashed.filter("doc_id IS NOT NULL").select(
        "doc_id", F.explode(F.array_distinct("hashes")).alias("hash")).filter("hash IS NOT NULL")
    repeated = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeated.isEmpty():  # else rows are documents already
        held = held.distinct()
    frequent = staged(
        held.groupBy("hash")
        .agg(F.count(F.lit(1)).alias("holders"), F.max("doc_id").alias("keeper"))
        .filter(F.col("holders") >= min_documents).select("hash", "keeper"), "frequent-lines")
    drops = (
        hashed.select("doc_id", "row", F.posexplode("hashes").alias("pos", "hash"))
        .filter("hash IS NOT NULL").join(frequent, "hash")
        .filter(~same(F.col("doc_id"), F.col("keeper")))
        .groupBy(F.col("doc_id").alias("of"), F.col("row").alias("of_row"))
        .agg(F.collect_set("pos").alias("drops"))
    )
    joined = rows.join(
        drops, same(rows["doc_id"], drops["of"]) & (rows["row"] == drops["of_row"]), "left")
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    dropped = F.coalesce("drops", F.array().cast("array<int>"))
    kept = F.array_except(places, dropped)
    return joined.select(
        "doc_id",
        F.concat_ws("\n", F.transform(kept, lambda i: F.get("lines", i))).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(dropped).cast("long").alias("n_dropped"))
