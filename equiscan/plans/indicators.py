"""Per-stock price indicators as of one day.

Only the newest row of each series is ever reported, so no sliding frame is needed: rows are ranked from
the newest backwards once, and every "last k rows" statistic is a conditional aggregate over that rank.
One exchange and one sort on ``(code, date desc)`` serve all three scores; the per-score lookbacks are
conditions on the date, because a lookback keeps a suffix of the series and leaves the ranks unchanged.
The cost per stock is linear in the rows read, where sliding frames would cost rows times frame length.
"""

from __future__ import annotations

import math
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiscan.functions import greatest_strict, safe_divide
from equiscan.operators.filters import lookback

# Lookbacks in calendar days.
LIQUIDITY_DAYS = 60
VOLATILITY_DAYS = 120
CHART_DAYS = 300
PRICE_DAYS = 10
MARKET_DAYS = 300

# Liquidity grades by 20-session mean turnover in yen.
GRADE_A, GRADE_B, GRADE_C = 5_000_000_000, 3_000_000_000, 1_000_000_000
# Fixed value: trading days per year for annualised volatility.
YEAR_SESSIONS = 250
# Fixed value: the index that stands for the whole market.
MARKET_INDEX = "0000"


def true_range(prev_close: Column | str = "prev_close") -> Column:
    """max(h-l, |h-pc|, |l-pc|); without a previous close the session's own range. NULL without high or low."""
    high, low = F.col("high"), F.col("low")
    previous = F.col(prev_close) if isinstance(prev_close, str) else prev_close
    return greatest_strict(
        high - low,
        F.abs(high - F.coalesce(previous, high)),
        F.abs(low - F.coalesce(previous, low)),
    )


def session_return(prev_close: Column | str = "prev_close") -> Column:
    previous = F.col(prev_close) if isinstance(prev_close, str) else prev_close
    return safe_divide(F.col("close") - previous, previous)


def _ranked(bars: DataFrame, as_of: date, days: int, columns: list[str], key: str = "code") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col("date").desc())
    wanted = list(dict.fromkeys([key, "date", "close", *columns]))
    return lookback(bars, as_of, days).select(*wanted).withColumns(
        {
            "r": F.row_number().over(w),
            "_older_close": F.lead("close").over(w),
            "_older_date": F.lead("date").over(w),
        }
    )


class _Frame:
    """Conditions on the rank, restricted to the rows a score may see."""

    def __init__(self, as_of: date, days: int):
        self.since = F.lit(as_of - timedelta(days=days))
        self.visible = F.col("date") >= self.since

    def rows(self, first: int, last: int, value: Column | str) -> Column:
        column = F.col(value) if isinstance(value, str) else value
        return F.when(self.visible & F.col("r").between(first, last), column)

    def newest(self, value: Column | str) -> Column:
        return F.max(self.rows(1, 1, value))

    def previous_close(self) -> Column:
        return F.when(F.col("_older_date") >= self.since, F.col("_older_close"))


def _liquidity_aggregates(as_of: date) -> list[Column]:
    f = _Frame(as_of, LIQUIDITY_DAYS)
    return [
        f.newest("date").alias("liq_date"),
        f.newest("turnover_value").alias("liq_turnover"),
        F.avg(f.rows(1, 20, "turnover_value")).alias("liq_avg"),
        F.stddev_samp(f.rows(1, 20, "turnover_value")).alias("liq_std"),
        F.count(f.rows(1, 20, F.lit(1))).alias("liq_rows"),
    ]


def _volatility_aggregates(as_of: date) -> list[Column]:
    f = _Frame(as_of, VOLATILITY_DAYS)
    previous = f.previous_close()
    year = F.lit(math.sqrt(YEAR_SESSIONS))
    return [
        f.newest("date").alias("vol_date"),
        f.newest("close").alias("vol_close"),
        F.avg(f.rows(1, 14, true_range(previous))).alias("vol_atr"),
        F.max(f.rows(1, 22, "high")).alias("vol_high"),
        F.min(f.rows(1, 22, "low")).alias("vol_low"),
        (F.stddev_samp(f.rows(1, 20, session_return(previous))) * year).alias("vol_hv20"),
        (F.stddev_samp(f.rows(1, 60, session_return(previous))) * year).alias("vol_hv60"),
    ]


def _chart_aggregates(as_of: date) -> list[Column]:
    f = _Frame(as_of, CHART_DAYS)
    return [
        f.newest("date").alias("cht_date"),
        f.newest("close").alias("cht_close"),
        f.newest("volume").alias("cht_volume"),
        F.avg(f.rows(1, 200, "close")).alias("cht_ma200"),
        F.avg(f.rows(21, 220, "close")).alias("cht_ma200_before"),
        F.avg(f.rows(1, 25, "close")).alias("cht_ma25"),
        F.avg(f.rows(1, 20, "volume")).alias("cht_avg_volume"),
        F.max(f.rows(1, 10, "high")).alias("cht_high10"),
        F.min(f.rows(1, 10, "low")).alias("cht_low10"),
        F.max(f.rows(1, 30, "high")).alias("cht_high30"),
        F.min(f.rows(1, 30, "low")).alias("cht_low30"),
        F.max(f.rows(2, 11, "high")).alias("cht_high10_prior"),
        F.max(f.rows(1, 250, "high")).alias("cht_high250"),
    ]


def _price_aggregates(as_of: date) -> list[Column]:
    f = _Frame(as_of, PRICE_DAYS)
    return [f.newest("date").alias("px_date"), f.newest("close").alias("px_close")]


def _liquidity_values() -> dict[str, Column]:
    avg, std = F.col("liq_avg"), F.col("liq_std")
    cv = safe_divide(std, avg)
    return {
        "latest_turnover": F.col("liq_turnover"),
        "avg_turnover_20d_oku": F.round(avg / 100_000_000, 2),
        "cv_value": F.round(cv, 3),
        "liquidity_grade": F.when(avg >= GRADE_A, "PASS_A")
        .when(avg >= GRADE_B, "PASS_B")
        .when(avg >= GRADE_C, "PASS_C")
        .otherwise("FAIL"),
        "cv_grade": F.when(cv < 1.0, "PASS").when(cv < 1.5, "WARN").otherwise("FAIL"),
    }


def _has_liquidity() -> Column:
    # The 20-row count never falls along a series, so the newest row has it if any row does.
    return F.col("liq_rows") >= 15


def _volatility_values() -> dict[str, Column]:
    close, atr = F.col("vol_close"), F.col("vol_atr")
    hv20, hv60 = F.col("vol_hv20"), F.col("vol_hv60")
    spread = safe_divide(F.col("vol_high") - F.col("vol_low"), F.col("vol_low"))
    return {
        "atr_14": F.round(atr, 1),
        "atr_pct": F.round(safe_divide(atr, close) * 100, 2),
        "range_1m_pct": F.round(spread * 100, 1),
        "hv_20d_pct": F.round(hv20 * 100, 1),
        "hv_60d_pct": F.round(hv60 * 100, 1),
        "volatility_score": F.when(safe_divide(atr, close) >= 0.015, 2).otherwise(0)
        + F.when(hv20 < hv60, 2).otherwise(0)
        + F.when(spread.between(0.15, 0.80), 1).otherwise(0),
        "hv_contraction": F.when(hv20 < hv60, True).otherwise(False),
    }


def _trend(ma: Column, ma_before: Column, up: str, down: str, flat: str) -> Column:
    """Direction of a mean against its value 20 rows earlier, ±0.5 %; NULL counts as flat."""
    change = safe_divide(ma - ma_before, ma_before)
    return F.when(change > 0.005, up).when(change < -0.005, down).otherwise(flat)


def _chart_values() -> dict[str, Column]:
    close, ma200 = F.col("cht_close"), F.col("cht_ma200")
    trend = _trend(ma200, F.col("cht_ma200_before"), "UP", "DOWN", "FLAT")
    ratio = safe_divide(F.col("cht_volume"), F.col("cht_avg_volume"))
    contraction = safe_divide(
        F.col("cht_high10") - F.col("cht_low10"), F.col("cht_high30") - F.col("cht_low30")
    )
    return {
        "ma_200": F.round(ma200, 1),
        "ma_25": F.round("cht_ma25", 1),
        "ma200_trend": trend,
        "price_vs_ma200": F.when(close > ma200, "ABOVE").otherwise("BELOW"),
        "volume_ratio": F.round(ratio, 2),
        "volume_surge": F.when(ratio >= 1.5, True).otherwise(False),
        "range_contraction": F.round(contraction, 3),
        "consolidation": F.when(contraction < 0.5, True).otherwise(False),
        "breakout": F.when(close >= F.col("cht_high10_prior"), True).otherwise(False),
        "near_52w_high": F.when(close >= F.col("cht_high250") * 0.98, True).otherwise(False),
        "chart_score": F.when(trend == "UP", 1).otherwise(0)
        + F.when(close > ma200, 1).otherwise(0)
        + F.when(contraction < 0.5, 2).otherwise(0)
        + F.when(ratio >= 1.5, 1).otherwise(0),
    }


def _named(values: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in values.items()]


def liquidity(bars: DataFrame, as_of: date) -> DataFrame:
    """Turnover size and steadiness; stocks with fewer than 15 sessions in 60 days have no row."""
    tail = _ranked(bars, as_of, LIQUIDITY_DAYS, ["turnover_value"])
    return (
        tail.groupBy("code").agg(*_liquidity_aggregates(as_of)).filter(_has_liquidity())
        .select("code", F.col("liq_date").alias("date"), *_named(_liquidity_values()))
    )


def volatility(bars: DataFrame, as_of: date) -> DataFrame:
    """ATR, historical volatility, one-month range and the 0–5 volatility score."""
    tail = _ranked(bars, as_of, VOLATILITY_DAYS, ["high", "low"])
    return tail.groupBy("code").agg(*_volatility_aggregates(as_of)).select(
        "code", F.col("vol_date").alias("date"), F.col("vol_close").alias("close"), *_named(_volatility_values())
    )


def chart(bars: DataFrame, as_of: date) -> DataFrame:
    """Moving-average trend, contraction, breakout, volume surge and the 0–5 chart score."""
    tail = _ranked(bars, as_of, CHART_DAYS, ["high", "low", "volume"])
    return tail.groupBy("code").agg(*_chart_aggregates(as_of)).select(
        "code", F.col("cht_date").alias("date"), F.col("cht_close").alias("close"), *_named(_chart_values())
    )


def latest_price(bars: DataFrame, as_of: date) -> DataFrame:
    """Newest close of the last ten days; an aggregate, so only one row per code and task is shuffled."""
    return (
        lookback(bars, as_of, PRICE_DAYS).groupBy("code")
        .agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))
    )


def scored(ranked: DataFrame, as_of: date) -> DataFrame:
    """The three scores and the newest price from rows that are ranked from the newest backwards.

    Struct columns ``liq``, ``vol``, ``cht`` and ``px``; each is NULL where the stand-alone operator
    would have no row for the code.
    """
    wide = ranked.groupBy("code").agg(
        *_liquidity_aggregates(as_of),
        *_volatility_aggregates(as_of),
        *_chart_aggregates(as_of),
        *_price_aggregates(as_of),
    )
    return wide.select(
        "code",
        F.when(_has_liquidity(), F.struct(*_named(_liquidity_values()))).alias("liq"),
        F.when(F.col("vol_date").isNotNull(), F.struct(*_named(_volatility_values()))).alias("vol"),
        F.struct(F.col("cht_close").alias("close"), *_named(_chart_values())).alias("cht"),
        F.when(
            F.col("px_date").isNotNull(),
            F.struct(F.col("px_date").alias("date"), F.col("px_close").alias("close")),
        ).alias("px"),
    )


def all_indicators(bars: DataFrame, as_of: date) -> DataFrame:
    """:func:`scored` from one pass over the bars of the lookback."""
    return scored(_ranked(bars, as_of, CHART_DAYS, ["high", "low", "volume", "turnover_value"]), as_of)


def market_environment(index_bars: DataFrame, as_of: date, index_code: str = MARKET_INDEX) -> DataFrame:
    """Market phase of one index: at most one row."""
    f = _Frame(as_of, MARKET_DAYS)
    series = _ranked(index_bars.filter(F.col("index_code") == index_code), as_of, MARKET_DAYS, [], "index_code")
    state = series.groupBy("index_code").agg(
        f.newest("date").alias("date"),
        f.newest("close").alias("close"),
        F.avg(f.rows(1, 200, "close")).alias("ma200"),
        F.avg(f.rows(21, 220, "close")).alias("ma200_before"),
    )
    close, ma200 = F.col("close"), F.col("ma200")
    phase = _trend(ma200, F.col("ma200_before"), "BULL", "BEAR", "NEUTRAL")
    return state.select(
        "date",
        F.round(close, 2).alias("topix_close"),
        F.round(ma200, 2).alias("topix_ma200"),
        phase.alias("market_phase"),
        F.when((close > ma200) & (phase == "BULL"), 3).when(close > ma200, 2).otherwise(1).alias("environment_score"),
    )
