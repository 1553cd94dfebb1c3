"""Time the headline queries and print one JSON line.

Each query is built and run in full against a sink that keeps nothing; BENCH_SF_DIR and
BENCH_CPUS choose the tables and the cores. The table of stored bars, which several queries read,
is built first and has its own line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sigmatide.plans.catalog import all_queries
from sigmatide.session import local_session
from sigmatide.sources.tables import Tables

HEADLINE = [
    "bars_daily", "vol_panel", "vol_summary", "vol_regime", "forecast_mean_reversion",
    "garch_fit", "trading_signals_fitted", "lag_regression_fit", "forecast_ensemble_fitted", "screen_top50",
    "portfolio_allocation", "buy_list", "movers_top10", "news_category", "stream_bars",
    "stream_ewma", "prints_before_bar", "regime_overlaps", "vol_intraday", "stream_sliding",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, partitions=cores)
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    queries["bars_daily"](spark, folder).limit(1).collect()  # start the engine
    start = time.perf_counter()
    Tables(spark, folder).stored_bars()
    seconds = {"stored_bars_build": round(time.perf_counter() - start, 3)}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
