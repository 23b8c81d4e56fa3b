"""The integrated score: one row per listed stock of the chosen market."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiscan.operators.aggregates import sector_average_per
from equiscan.operators.joins import attach_single_row, left_chain
from equiscan.plans.fundamentals import earnings_next, fundamental, price_multiples, valuation_points, valued
from equiscan.plans.indicators import all_indicators, latest_price, market_environment

# Fixed value: the market segment that is ranked.
PRIME = "プライム"
# Grade names on either side of the integration.
GRADE_LETTERS = {"PASS_A": "A", "PASS_B": "B", "PASS_C": "C", "FAIL": "D"}

RANKING_COLUMNS = [
    "code", "company_name", "sector33_name", "market_segment",
    "avg_turnover_20d_oku", "cv_value", "liquidity_grade", "cv_grade",
    "atr_pct", "range_1m_pct", "hv_contraction", "volatility_score",
    "latest_close", "ma200_trend", "price_vs_ma200", "volume_ratio", "volume_surge",
    "consolidation", "breakout", "near_52w_high", "chart_score",
    "sales_cagr_3y_pct", "op_cagr_3y_pct", "roe_pct", "roic_pct", "equity_ratio_pct",
    "sales_cagr_score", "op_cagr_score", "roe_score", "roic_score", "financial_health", "fundamental_total",
    "per", "pbr", "per_score", "pbr_score", "valuation_total",
    "topix_close", "market_phase", "environment_score",
    "next_earnings_date", "days_to_earnings",
    "kubota_trade_score", "growth_invest_score", "screening_status", "kubota_signal", "price_strength_score",
]


def grade_letter(col: str = "liquidity_grade") -> Column:
    grade = F.col(col)
    letter = F.when(grade == "PASS_A", "A")
    for name, short in list(GRADE_LETTERS.items())[1:]:
        letter = letter.when(grade == name, short)
    return letter


def signal_rule() -> Column:
    """Entry signal from the grades, flags and market phase of one row."""
    grade = F.col("liquidity_grade")
    buy = (
        grade.isin("A", "B")
        & (F.col("volatility_score") >= 3)
        & F.col("breakout")
        & F.col("volume_surge")
        & ((F.col("ma200_trend") == "UP") | (F.col("price_vs_ma200") == "ABOVE"))
        & (F.col("market_phase") == "BULL")
    )
    wait = (
        grade.isin("A", "B", "C")
        & (F.col("volatility_score") >= 2)
        & F.col("consolidation")
        & (F.col("breakout") == F.lit(False))
    )
    return F.when(buy, "buy_signal").when(wait, "wait").otherwise("-")


def status_rule() -> Column:
    return (
        F.when(F.col("financial_health") == "FAIL", "FAIL_FINANCIAL")
        .when(F.col("liquidity_grade") == "D", "FAIL_LIQUIDITY")
        .otherwise("ACTIVE")
    )


def _sum0(*names: str) -> Column:
    total = F.coalesce(F.col(names[0]), F.lit(0))
    for name in names[1:]:
        total = total + F.coalesce(F.col(name), F.lit(0))
    return total


def integrated_score(
    bars: DataFrame,
    statements: DataFrame,
    calendar: DataFrame,
    index_bars: DataFrame,
    master: DataFrame,
    as_of: date,
    market: str = PRIME,
) -> DataFrame:
    """All scores of one day joined on ``code``.

    The bars are scanned once for the three price scores and the newest price. The sector means cover every
    market, so they are a second, much smaller branch: ten days of two columns, grouped before the shuffle.
    Without a market state there is no result.
    """
    return integrated(all_indicators(bars, as_of), latest_price(bars, as_of), statements, calendar, index_bars, master, as_of, market)


def integrated(
    prices: DataFrame,
    newest: DataFrame,
    statements: DataFrame,
    calendar: DataFrame,
    index_bars: DataFrame,
    master: DataFrame,
    as_of: date,
    market: str = PRIME,
) -> DataFrame:
    """:func:`integrated_score` from price scores and newest prices, computed from bars or from a stored state."""
    fundamentals = fundamental(statements)
    sector_means = sector_average_per(
        valued(newest, fundamentals, master).filter("listed")
    )
    listed = master.filter(F.col("market_name") == market).select(
        "code", "company_name", "sector33_name", F.col("market_name").alias("market_segment")
    )
    joined = left_chain(
        listed, [prices, fundamentals, earnings_next(calendar, as_of)]
    ).join(sector_means, "sector33_name", "left")
    flat = joined.select(
        "code", "company_name", "sector33_name", "market_segment",
        "liq.avg_turnover_20d_oku", "liq.cv_value", grade_letter("liq.liquidity_grade").alias("liquidity_grade"),
        "liq.cv_grade",
        "vol.atr_pct", "vol.range_1m_pct", "vol.hv_contraction", "vol.volatility_score",
        F.col("cht.close").alias("latest_close"), "cht.ma200_trend", "cht.price_vs_ma200", "cht.volume_ratio",
        "cht.volume_surge", "cht.consolidation", "cht.breakout", "cht.near_52w_high", "cht.chart_score",
        "sales_cagr_3y_pct", "op_cagr_3y_pct", "roe_pct", "roic_pct", "equity_ratio_pct",
        "sales_cagr_score", "op_cagr_score", "roe_score", "roic_score", "financial_health",
        "eps", "bps", F.col("px.close").alias("px_close"), F.col("px").isNotNull().alias("priced"),
        "sector_avg_per", "next_earnings_date", "days_to_earnings",
    ).withColumns(price_multiples("px_close"))
    # A stock without a recent price has no valuation row, so its points are NULL rather than 0.
    scored = flat.withColumns({n: F.when(F.col("priced"), c) for n, c in valuation_points().items()})
    market_state = market_environment(index_bars, as_of).select("topix_close", "market_phase", "environment_score")
    fundamental_total = _sum0("sales_cagr_score", "op_cagr_score", "roe_score", "roic_score")
    valuation_total = _sum0("per_score", "pbr_score")
    return (
        attach_single_row(scored, market_state, required=True)
        .withColumns(
            {
                "fundamental_total": fundamental_total,
                "valuation_total": valuation_total,
                "kubota_trade_score": _sum0("volatility_score", "chart_score"),
                "growth_invest_score": fundamental_total + valuation_total,
                "screening_status": status_rule(),
                "kubota_signal": signal_rule(),
                "signal_confidence": F.lit(None).cast("bigint"),
                "price_strength_score": F.when(F.col("near_52w_high"), 2).otherwise(0)
                + F.when(F.col("volume_ratio") >= 1.5, 1).otherwise(0),
            }
        )
        .select(*RANKING_COLUMNS, "signal_confidence")
    )
