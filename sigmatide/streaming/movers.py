"""Leader boards kept up to date from a stream of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sigmatide.operators.market_boards import mover_metrics, movers_top
from sigmatide.session import remove
from sigmatide.sources.bars import last_bars

PAIR = ["ticker", "dt", "close", "volume"]
LEVELS = ["ticker", "week52_high", "week52_low"]
KEPT = 2  # batches: the newest, and the one before it for a repeat of the newest


def refresh_movers(batch: DataFrame, batch_id: int, facts: DataFrame, folder: str,
                   universe: DataFrame | None = None) -> None:
    """Write the running state and the boards as of micro-batch ``batch_id``.

    The state is two bars and the highest and lowest price per ticker. Batch N is built from the
    state of batch N - 1 and the new bars and overwrites its own folders, so repeating a
    batch after a failure gives the same result. No trigger reads more than the last state, and
    no price of a later batch; folders older than the batch before are removed.
    """
    spark = batch.sparkSession

    def at(kind: str, n: int) -> str:
        return f"{folder}/{kind}/batch={n}"

    pairs = batch.select(*PAIR)
    levels = batch.select("ticker", F.col("high").alias("week52_high"), F.col("low").alias("week52_low"))
    if batch_id > 0:
        pairs = pairs.unionByName(spark.read.parquet(at("latest", batch_id - 1)))
        levels = levels.unionByName(spark.read.parquet(at("levels", batch_id - 1)))
    last_bars(pairs, 2).write.mode("overwrite").parquet(at("latest", batch_id))
    levels.groupBy("ticker").agg(
        F.max("week52_high").alias("week52_high"), F.min("week52_low").alias("week52_low"),
    ).write.mode("overwrite").parquet(at("levels", batch_id))
    info = facts.drop(*LEVELS[1:]).join(spark.read.parquet(at("levels", batch_id)), "ticker", "outer")
    newest = spark.read.parquet(at("latest", batch_id))
    movers_top(mover_metrics(newest, info), universe).write.mode("overwrite").parquet(at("boards", batch_id))
    for kind in ("latest", "levels", "boards"):
        if batch_id >= KEPT:
            remove(spark, at(kind, batch_id - KEPT))


def stream_movers(bars: DataFrame, facts: DataFrame, folder: str,
                  universe: DataFrame | None = None) -> StreamingQuery:
    """Refresh the boards on every trigger; processes what is available and stops.

    ``facts`` are ticker facts; their price levels are replaced by those of the stream.
    """
    return (
        bars.writeStream.outputMode("append")
        .foreachBatch(lambda df, n: refresh_movers(df, n, facts, folder, universe))
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def current_boards(spark: SparkSession, folder: str) -> DataFrame:
    """The boards of the last finished micro-batch; at most two are stored."""
    boards = spark.read.parquet(f"{folder}/boards")
    newest = boards.select("batch").distinct().agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{folder}/boards/batch={newest}")
