"""Past entry signals and what followed them."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiscan.functions import safe_divide
from equiscan.operators.filters import lookback, traded
from equiscan.operators.windows import Slide, count_last, series, sliding
from equiscan.plans.indicators import YEAR_SESSIONS, session_return, true_range
from equiscan.plans.integrate import PRIME

# Fixed value: calendar days of history the study covers.
BACKTEST_DAYS = 500
HORIZONS = (5, 10, 20)


def backtest_signals(bars: DataFrame, master: DataFrame, as_of: date, market_like: str = PRIME) -> DataFrame:
    """One row per past signal with returns 5, 10 and 20 sessions later.

    Every session is a candidate here, so sliding statistics are needed. They share one exchange and one sort
    on ``(code, date)``; a group holds at most one row per day of the lookback.
    """
    listed = master.filter(F.col("market_name").contains(market_like)).select("code")
    w = series()
    daily = (
        traded(lookback(bars, as_of, BACKTEST_DAYS))
        .select("code", "date", "high", "low", "close", "volume")
        .join(listed, "code", "left_semi")
        .withColumn("prev_close", F.lag("close").over(w))
        .withColumns({"tr": true_range(), "ret": session_return()})
    )
    year = math.sqrt(YEAR_SESSIONS)
    framed = sliding(
        daily,
        {
            "ma200": Slide("avg", "close", 200),
            "avg_vol_20d": Slide("avg", "volume", 20),
            "atr_14": Slide("avg", "tr", 14),
            "std_20d": Slide("stddev", "ret", 20),
            "std_60d": Slide("stddev", "ret", 60),
            "high_10d": Slide("max", "high", 10),
            "low_10d": Slide("min", "low", 10),
            "high_30d": Slide("max", "high", 30),
            "low_30d": Slide("min", "low", 30),
        },
    )
    measured = framed.withColumns(
        {
            "row_cnt": count_last(200, w),
            **{f"close_{h}d": F.lead("close", h).over(w) for h in HORIZONS},
            "hv_20d": F.col("std_20d") * year,
            "hv_60d": F.col("std_60d") * year,
            "contraction": safe_divide(F.col("high_10d") - F.col("low_10d"), F.col("high_30d") - F.col("low_30d")),
            "vol_ratio": safe_divide("volume", "avg_vol_20d"),
            "atr_ratio": safe_divide("atr_14", "close"),
        }
    )
    signals = measured.filter(
        (F.col("row_cnt") >= 150)
        & (F.col("close") > F.col("ma200"))
        & (F.col("atr_ratio") >= 0.015)
        & (F.col("hv_20d") < F.col("hv_60d"))
        & (F.col("contraction") < 0.5)
        & (F.col("vol_ratio") >= 1.5)
        & F.col("close_5d").isNotNull()
    )
    close = F.col("close")

    def forward(h: int):
        return F.round(safe_divide(F.col(f"close_{h}d") - close, close) * 100, 2).alias(f"return_{h}d_pct")

    return signals.select(
        "code",
        F.col("date").alias("signal_date"),
        F.round(close, 0).alias("entry_price"),
        F.round("vol_ratio", 2).alias("volume_ratio"),
        F.round(F.col("atr_ratio") * 100, 2).alias("atr_pct"),
        F.round(F.col("hv_20d") * 100, 1).alias("hv_20d_pct"),
        F.round(F.col("hv_60d") * 100, 1).alias("hv_60d_pct"),
        F.round("contraction", 3).alias("range_contraction"),
        *[forward(h) for h in HORIZONS],
        F.when(F.col("close_5d") > close, 1).otherwise(0).alias("win_5d"),
        F.when(F.col("close_10d") > close, 1).otherwise(0).alias("win_10d"),
        F.when(F.col("close_20d").isNotNull(), (F.col("close_20d") > close).cast("int")).alias("win_20d"),
    )


def ordered(signals: DataFrame) -> DataFrame:
    return signals.orderBy(F.col("signal_date").desc(), "code")
