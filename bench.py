"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores, ``BENCH_KEYS`` (optional) the queries.
Each query runs once to warm up, then three times; the median counts. Building a query is part of its time.
The derived market tables are stored before the clock starts, as an ingest would have left them.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import Observation
from pyspark.sql import functions as F

from equiscan.checks.catalog import spark_query
from equiscan.checks.desk import Desk
from equiscan.session import build_session

HEADLINE = [
    "integrated_score",
    "liquidity",
    "volatility",
    "chart",
    "fundamental",
    "valuation",
    "market_environment",
    "earnings_next",
    "backtest_signals",
    "win_avg_k",
    "win_max_min_k",
    "win_stddev_k",
    "price_history",
    "report_screening",
    "report_price_matrix",
    "return_quartiles",
    "sector_heatmap",
    "positions",
    "fund_nav",
    "holdings_summary",
    "holding_alerts",
    "upsert",
    "job_daily_bars",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    keys = os.environ.get("BENCH_KEYS", "").split() or HEADLINE
    spark = build_session(f"local[{cpus}]", cpus, **{"spark.driver.memory": "16g"})

    start = time.perf_counter()
    desk = Desk(spark, sf_dir)
    for name in ("daily_bars", "index_bars", "quotes", "financial_summary", "earnings_calendar", "summary", "signals"):
        getattr(desk, name)()
    derive = time.perf_counter() - start

    seconds, rows = {}, {}
    for key in keys:
        times = []
        for attempt in range(4):
            seen = Observation()
            start = time.perf_counter()
            df = spark_query(key)(spark, sf_dir)
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
            if attempt:
                times.append(time.perf_counter() - start)
            rows[key] = int(seen.get["n"])
        seconds[key] = round(statistics.median(times), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_out": rows,
                "derive_sec": round(derive, 3),
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
