"""Scores from financial statements, valuation, and the next earnings date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiscan.functions import safe_divide
from equiscan.operators.aggregates import sector_average_per
from equiscan.operators.filters import annual_statements

STATEMENT_VALUES = [
    "net_sales",
    "operating_profit",
    "net_income",
    "equity",
    "total_assets",
    "eps",
    "bps",
    "equity_to_asset_ratio",
]


def annual_results(statements: DataFrame) -> DataFrame:
    """Newest full-year disclosure per code and calendar year.

    ``max_by`` combines before the shuffle; the document type settles two disclosures on one day.
    """
    latest = (
        annual_statements(statements)
        .withColumn("disc_year", F.year("disclosed_date"))
        .groupBy("code", "disc_year")
        .agg(F.max_by(F.struct(*STATEMENT_VALUES), F.struct("disclosed_date", "document_type")).alias("s"))
    )
    return latest.select("code", "disc_year", "s.*")


def _growth(now: Column, before: Column) -> Column:
    """Three-year compound growth, only between two positive values."""
    return F.when((before > 0) & (now > 0), F.pow(safe_divide(now, before), F.lit(1.0 / 3)) - 1)


def ladder(value: Column, *steps: tuple[float, int]) -> Column:
    """Points of the first threshold reached, else 0."""
    grade = F.when(value >= steps[0][0], steps[0][1])
    for threshold, points in steps[1:]:
        grade = grade.when(value >= threshold, points)
    return grade.otherwise(0)


def fundamental(statements: DataFrame) -> DataFrame:
    """Growth, profitability and health of the latest full year.

    The year three years back is read through a value-range frame on the year, which needs no self join.
    """
    by_year = Window.partitionBy("code").orderBy("disc_year")
    three_back = by_year.rangeBetween(-3, -3)
    latest = (
        annual_results(statements)
        .withColumns(
            {
                "sales_before": F.first("net_sales").over(three_back),
                "op_before": F.first("operating_profit").over(three_back),
                "_next": F.lead("disc_year").over(by_year),
            }
        )
        .filter(F.col("_next").isNull())
    )
    sales, op = F.col("net_sales"), F.col("operating_profit")
    rates = latest.select(
        "code",
        F.col("disc_year").alias("latest_year"),
        "eps",
        "bps",
        "equity_to_asset_ratio",
        _growth(sales, F.col("sales_before")).alias("sales_cagr"),
        _growth(op, F.col("op_before")).alias("op_cagr"),
        safe_divide("net_income", "equity").alias("roe"),
        safe_divide(op * 0.7, F.col("total_assets") - F.col("equity")).alias("roic"),
        safe_divide(op, sales).alias("op_margin"),
    )
    return rates.select(
        "code",
        "latest_year",
        "eps",
        "bps",
        F.round(F.col("sales_cagr") * 100, 1).alias("sales_cagr_3y_pct"),
        F.round(F.col("op_cagr") * 100, 1).alias("op_cagr_3y_pct"),
        F.round(F.col("roe") * 100, 1).alias("roe_pct"),
        F.round(F.col("roic") * 100, 1).alias("roic_pct"),
        F.round(F.col("op_margin") * 100, 1).alias("op_margin_pct"),
        F.round(F.col("equity_to_asset_ratio") * 100, 1).alias("equity_ratio_pct"),
        # Score thresholds.
        ladder(F.col("sales_cagr"), (0.15, 8), (0.10, 6), (0.05, 3)).alias("sales_cagr_score"),
        ladder(F.col("op_cagr"), (0.20, 8), (0.10, 6), (0.05, 3)).alias("op_cagr_score"),
        ladder(F.col("roe"), (0.15, 7), (0.10, 5), (0.08, 3)).alias("roe_score"),
        ladder(F.col("roic"), (0.12, 6), (0.08, 4), (0.05, 2)).alias("roic_score"),
        F.when(F.col("equity_to_asset_ratio") < 0.20, "FAIL")
        .when(F.col("op_margin") < 0, "FAIL")
        .otherwise("PASS")
        .alias("financial_health"),
    )


def price_multiples(close: str = "close") -> dict[str, Column]:
    price = F.col(close)
    return {
        "per": F.when(F.col("eps") > 0, F.round(safe_divide(price, "eps"), 1)),
        "pbr": F.when(F.col("bps") > 0, F.round(safe_divide(price, "bps"), 2)),
    }


def valuation_points() -> dict[str, Column]:
    per, pbr, mean = F.col("per"), F.col("pbr"), F.col("sector_avg_per")
    return {
        "per_score": F.when((per > 0) & (per < mean * 0.8), 5)
        .when((per > 0) & (per <= mean), 3)
        .when((per > 0) & (per <= mean * 1.3), 1)
        .otherwise(0),
        "pbr_score": F.when((pbr > 0) & (pbr < 1.5), 3).otherwise(0) + F.when((pbr > 0) & (pbr < 1.0), 2).otherwise(0),
    }


def valued(prices: DataFrame, fundamentals: DataFrame, master: DataFrame) -> DataFrame:
    """Newest price, its multiples and the sector of every priced code."""
    per_share = fundamentals.select("code", "eps", "bps")
    sectors = master.select("code", "sector33_name", F.lit(True).alias("listed"))
    return (
        prices.join(per_share, "code", "left")
        .select("code", "date", "close", *[c.alias(n) for n, c in price_multiples().items()])
        .join(sectors, "code", "left")
    )


def valuation(prices: DataFrame, fundamentals: DataFrame, master: DataFrame) -> DataFrame:
    """PER and PBR against the sector. ``prices`` has one row per code."""
    base = valued(prices, fundamentals, master)
    means = sector_average_per(base.filter("listed"))
    return base.join(means, "sector33_name", "left").select(
        "code", "date", "close", "per", "pbr", "sector_avg_per", *[c.alias(n) for n, c in valuation_points().items()]
    )


def earnings_next(calendar: DataFrame, as_of: date) -> DataFrame:
    """First announcement on or after ``as_of`` per code, and the days until it."""
    today = F.lit(as_of)
    return (
        calendar.filter(F.col("date") >= today)
        .groupBy("code")
        .agg(F.min("date").alias("next_earnings_date"))
        .withColumn("days_to_earnings", F.date_diff("next_earnings_date", today))
    )
