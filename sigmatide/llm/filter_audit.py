"""Filter interaction audit: what each filter removes in every order of the filters.

Documents are counted in cells, one per part and set of failed filters, at most 32 a part for five
filters. A recursive common table expression then extends filter prefixes by an unused letter,
joins the cells of the part and carries the bits of the filters applied so far; each level of the
recursion gives the figures of that step.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmatide.llm.common import WHITE
from sigmatide.session import staged

MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 200, 50, 2
MARKS = "[#$%&*|]"
COPY = "E"  # the filter that needs other documents: a copy of a document with a smaller id
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def words(text: Column) -> Column:
    """Maximal runs of characters that are not white space."""
    inner = F.btrim(text, F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def text_filters() -> dict[str, Column]:
    """Failure conditions by letter, for rows with ``text`` and its ``words``."""
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    return {
        "A": n < MIN_WORDS,
        "B": 100 * distinct < MIN_DISTINCT_PERCENT * n,
        "C": 100 * upper > MAX_UPPER_PERCENT * F.length("text"),
        "D": F.col("text").rlike(MARKS),
    }


def failure_cells(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], part_col: str = "source",
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents per part and mask of failed filters: part, mask, n, good, toxic.

    Bit i of the mask stands for the i-th filter, the last bit for the copies. A row is a copy if its text is
    that of a row with a smaller id (compared by SHA-256); a row without id never is one, and makes none.
    Rows are added up per id and text before labels are joined, and per text before copies are marked, so
    a text in a third of all rows is a few rows by then. Null text and part count as empty.
    """
    bits = [F.when(fails, F.lit(1 << i)).otherwise(0) for i, fails in enumerate(filters.values())]
    mask = sum(bits, F.lit(0))
    rows = (
        docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
                    F.coalesce(docs[text_col], F.lit("")).alias("text"))
        .withColumn("words", words(F.col("text")))
        .select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
        .groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n")))
    known = labels.select(labels["doc_id"], labels["quality"], labels["toxic"]).groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    texts = staged(
        rows.join(known, "doc_id", "left")
        .groupBy("digest", "part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
        .agg(F.sum("n").alias("n"), F.min(own).alias("first"),
             F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without")), "audited-texts")
    repeated = (
        texts.groupBy("digest").agg(F.min("first.doc_id").alias("least"), F.sum("n").alias("_rows"))
        .filter("_rows > 1 AND least IS NOT NULL").select("digest", "least"))
    originals = F.col("without") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    copies = F.when(F.col("least").isNull(), 0).otherwise(F.col("n") - originals)
    split = F.array(F.struct("mask", (F.col("n") - copies).alias("n")),
                    F.struct((F.col("mask") + (1 << len(filters))).alias("mask"), copies.alias("n")))
    n = F.col("n")
    return (
        texts.join(repeated, "digest", "left").select("part", "good", "toxic", F.inline(split)).filter("n > 0")
        .groupBy("part", "mask").agg(
            F.sum(n).alias("n"),
            F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic")))


def _total(what: str, condition: str) -> str:
    return f"aggregate(filter(c.cells, x -> {condition}), 0L, (a, x) -> a + x.{what})"


_PASSED, _FAILS = "(x.mask & s.applied) = 0", "(x.mask & u.bit) != 0"

# Prefixes of filters with the bits applied; one level of the recursion is one step.
STEPS_SQL = f"""
WITH RECURSIVE
letters AS (
  SELECT letter, shiftleft(1, pos) AS bit FROM (SELECT posexplode(split({{letters}}, ',')) AS (pos, letter))),
unused AS (
  SELECT applied, letter, bit
  FROM (SELECT letter, bit, explode(sequence(0, {{last}})) AS applied FROM letters)
  WHERE (applied & bit) = 0),
steps AS (
  SELECT part, '' AS prefix, '' AS letter, 0 AS applied, 0 AS step, 0L AS kept, 0L AS removed, 0L AS redundant,
         0L AS unique_fails, 0L AS good_lost, 0L AS toxic_lost
  FROM {{cells}}
  UNION ALL
  SELECT s.part, concat(s.prefix, u.letter), u.letter, s.applied | u.bit, s.step + 1,
         {_total("n", "(x.mask & (s.applied | u.bit)) = 0")},
         {_total("n", f"{_PASSED} AND {_FAILS}")},
         {_total("n", f"NOT {_PASSED} AND {_FAILS}")},
         {_total("n", "x.mask = u.bit")},
         {_total("good", f"{_PASSED} AND {_FAILS}")},
         {_total("toxic", f"{_PASSED} AND {_FAILS}")}
  FROM steps s JOIN unused u ON u.applied = s.applied JOIN {{cells}} c ON c.part = s.part)
SELECT * FROM steps WHERE step > 0"""


@contextmanager
def _rows_unlimited(spark: SparkSession) -> Iterator[None]:
    """Lift the limit on a recursion's rows, which are in proportion to the parts."""
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.set(ROW_LIMIT, before)


def prefix_steps(cells: DataFrame, letters: list[str]) -> DataFrame:
    """Figures of the last step of every prefix of every order: part, prefix, letter, applied, step and counts."""
    spark = cells.sparkSession
    of_part = staged(
        cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), "mask-cells")
    with _rows_unlimited(spark):
        found = spark.sql(STEPS_SQL, letters=",".join(letters), last=(1 << len(letters)) - 1, cells=of_part)
        return staged(found, "filter-steps")


def filter_interactions(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None,
                        part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per part, order of the filters and step: filter_order, step, letter, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    ``filters`` are failure conditions by letter over ``text`` and ``words``; the filter of copies comes last.
    Within the part: kept after the step; removed by it; redundant, failing its filter but removed before;
    unique_fails, failing its filter only; good_lost and toxic_lost, removed here with quality or toxic 1 in any row
    of ``labels`` for the id; shapley, removed by its filter summed over all orders.

    Null text and part are empty strings; a null label is no label; a row without id has no label. Repeated rows
    count as often as they are there, and a row that repeats the least id of its text is no copy. An empty table
    gives an empty result; other columns are ignored.
    """
    chosen = text_filters() if filters is None else dict(filters)
    letters = [*chosen, COPY]
    steps = prefix_steps(failure_cells(docs, labels, chosen, part_col, id_col, text_col), letters)
    orders = (
        steps.filter(F.col("step") == len(letters)).select("part", F.col("prefix").alias("filter_order"))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
        .withColumn("prefix", F.expr("substring(filter_order, 1, step)")))
    found = orders.join(steps.drop("step"), ["part", "prefix"])
    return found.select(
        "part", "filter_order", "step", "letter", "kept", "removed", "redundant", "unique_fails", "good_lost",
        "toxic_lost", F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley"))
