"""Running EWMA volatility per ticker over a stream of bars."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sigmatide.functions.columns import ANNUAL

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

OUTPUT = "ticker string, dt timestamp, close double, ewma double, late boolean"
STATE = "s0 double, s1 double, s2 double, q0 double, last_close double, last_micros long"


def _updater(span: int) -> Callable:
    q = 1 - 2 / (span + 1)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        s0, s1, s2, q0, last, seen = state.get if state.exists else (0.0, 0.0, 0.0, 0.0, None, None)
        # Two numbers a bar are kept of the micro-batch, for their order in time.
        parts = [(b["dt"].to_numpy("datetime64[us]").astype(np.int64), b["close"].to_numpy(float))
                 for b in batches if len(b)]
        micros, closes = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(micros, kind="stable")
        micros, closes = micros[order], closes[order]
        late = np.zeros(len(micros), bool) if seen is None else micros <= seen
        values = np.full(len(micros), np.nan)
        for i in np.flatnonzero(~late):
            close = float(closes[i])
            if last is not None:
                r = close / last - 1
                s0, s1, s2, q0 = 1 + q * s0, r + q * s1, r * r + q * s2, 1 + q * q * q0
                bias = s0 * s0 - q0
                if bias > 0:
                    mean = s1 / s0
                    values[i] = math.sqrt(max(s2 / s0 - mean * mean, 0.0) * s0 * s0 / bias) * ANNUAL
            last, seen = close, int(micros[i])
        state.update((s0, s1, s2, q0, last, seen))
        yield pd.DataFrame({"ticker": key[0], "dt": micros.astype("datetime64[us]"), "close": closes,
                            "ewma": pd.Series(values).where(~np.isnan(values), None).astype("float64"),
                            "late": late})

    return update


def stream_ewma(bars: DataFrame, span: int = 21) -> DataFrame:
    """EWMA volatility of each arriving bar, equal to the batch estimator.

    State per ticker is six numbers. A call sees one ticker's bars of one micro-batch, sixteen
    bytes each; bound the batch at the source (``files_per_trigger`` of read_stream). A bar that is
    not later than its ticker's last one of an earlier batch can't change values already given: it is
    returned with ``late`` set and no volatility, and leaves the state as it is.
    """
    return bars.groupBy("ticker").applyInPandasWithState(
        _updater(span), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def _run(q: float, sums: tuple, closes: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Volatility at each close of an unbroken series, and the sums (s0, s1, s2, q0, last close) after it.

    The sums decay by q per return: over a stretch they are dot products with the powers of q, so the loop of a
    running sum is a running product and sum in blocks short enough for q^-k to stay in range.
    """
    s0, s1, s2, q0, last = sums
    values = np.full(len(closes), np.nan)
    before = np.append(np.nan if last is None else last, closes[:-1])
    returns = closes / before - 1
    block = max(1, int(100 / -math.log10(q)))  # squares of the powers too
    for a in range(1 if last is None else 0, len(closes), block):
        r = returns[a:a + block]
        up = q ** np.arange(1, len(r) + 1)  # what is left of the sums before, by row
        run = [up * (x + np.cumsum(y / up)) for x, y in ((s0, np.ones(len(r))), (s1, r), (s2, r * r))]
        squares = up * up * (q0 + np.cumsum(1 / (up * up)))
        mean, bias = run[1] / run[0], run[0] ** 2 - squares
        with np.errstate(divide="ignore", invalid="ignore"):
            deviation = np.sqrt(np.maximum(run[2] / run[0] - mean * mean, 0) * run[0] ** 2 / bias)
        values[a:a + len(r)] = np.where(bias > 1e-12, deviation * ANNUAL, np.nan)
        s0, s1, s2, q0 = (float(x[-1]) for x in (*run, squares))
    return values, (s0, s1, s2, q0, float(closes[-1]))


class _Expiring(StatefulProcessor):
    """One ticker's running sums; they leave the state ``idle`` microseconds after its last bar."""

    def __init__(self, span: int, idle: int):
        self.q, self.idle = 1 - 2 / (span + 1), idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sums", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = self.state.get() if self.state.exists() else None
        sums, seen = ((0.0, 0.0, 0.0, 0.0, None), None) if found is None else (tuple(found[:5]), found[5])
        parts = [(b["dt"].to_numpy("datetime64[us]").astype(np.int64), b["close"].to_numpy(float)) for b in rows]
        micros, closes = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(micros, kind="stable")
        micros, closes = micros[order], closes[order]
        late = np.zeros(len(micros), bool) if seen is None else micros <= seen
        values, fresh = np.full(len(micros), np.nan), np.flatnonzero(~late)
        if len(fresh):
            times = micros[fresh]
            gaps = np.diff(times, prepend=times[0] if seen is None else seen) > self.idle
            bounds = np.unique(np.concatenate(([0], np.flatnonzero(gaps), [len(fresh)])))
            for a, b in zip(bounds[:-1], bounds[1:]):
                if gaps[a]:
                    sums = (0.0, 0.0, 0.0, 0.0, None)  # the ticker's state is too old, gone or not
                values[fresh[a:b]], sums = _run(self.q, sums, closes[fresh[a:b]])
            seen = int(times[-1])
            self.state.update((*sums, seen))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((seen + self.idle) // 1000 + 1)
        yield pd.DataFrame({"ticker": key[0], "dt": micros.astype("datetime64[us]"), "close": closes,
                            "ewma": pd.Series(values).where(~np.isnan(values), None).astype("float64"), "late": late})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, on disk with changelogs, not in the heap."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def stream_ewma_expiring(bars: DataFrame, span: int = 21, idle_seconds: int = 30 * 86_400, delay: str = "1 hour") -> DataFrame:
    """stream_ewma whose state forgets idle tickers; start it inside ``rocksdb_state``.

    A bar more than ``idle_seconds`` after its ticker's last one begins a new series, whether the state is still there
    or not, so results don't depend on how the stream is cut into batches. A timer on event time removes the state
    once the watermark has passed that moment. Bars older than the watermark are dropped; a bar not later than its
    ticker's last one of an earlier batch is returned with ``late`` set.
    """
    timed = bars.select("ticker", F.col("dt").cast("timestamp").alias("dt"), "close").withWatermark("dt", delay)
    return timed.groupBy("ticker").transformWithStateInPandas(
        statefulProcessor=_Expiring(span, idle_seconds * 1_000_000), outputStructType=OUTPUT, outputMode="append",
        timeMode="EventTime")
