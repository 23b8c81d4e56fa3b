"""Row filters."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTH = "month"


def date_slice(df: DataFrame, start: date | None = None, end: date | None = None, column: str = "date") -> DataFrame:
    """``start <= column <= end``, either bound optional.

    Tables stored by month carry a ``month`` partition column; the same bounds are stated on it so that
    the scan lists only the directories it needs.
    """
    by_month = MONTH in df.columns
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start))
        if by_month:
            df = df.filter(F.col(MONTH) >= start.strftime("%Y-%m"))
    if end is not None:
        df = df.filter(F.col(column) <= F.lit(end))
        if by_month:
            df = df.filter(F.col(MONTH) <= end.strftime("%Y-%m"))
    return df


def lookback(df: DataFrame, as_of: date, days: int, column: str = "date") -> DataFrame:
    """Rows of the last ``days`` calendar days, seen from ``as_of``."""
    return date_slice(df, as_of - timedelta(days=days), as_of, column)


def traded(df: DataFrame) -> DataFrame:
    return df.filter((F.col("close") > 0) & (F.col("volume") > 0))


def is_annual_document(col: str = "document_type") -> Column:
    # The document labels that mark a full-year statement.
    return F.col(col).contains("FY") | F.col(col).contains("Annual") | F.col(col).contains("通期")


def annual_statements(df: DataFrame) -> DataFrame:
    return df.filter(is_annual_document() & (F.col("net_sales") > 0))


def active(df: DataFrame) -> DataFrame:
    return df.filter(F.col("screening_status") == "ACTIVE")


def signalled(df: DataFrame) -> DataFrame:
    return df.filter(F.col("kubota_signal") != "-")


def screen(
    df: DataFrame,
    sector: str | None = None,
    min_trade_score: int = 0,
    min_growth_score: int = 0,
    signal: str | None = None,
) -> DataFrame:
    """Optional conditions, all of which must hold."""
    if sector is not None:
        df = df.filter(F.col("sector33_name") == sector)
    if min_trade_score > 0:
        df = df.filter(F.col("kubota_trade_score") >= min_trade_score)
    if min_growth_score > 0:
        df = df.filter(F.col("growth_invest_score") >= min_growth_score)
    if signal is not None:
        df = df.filter(F.col("kubota_signal") == signal)
    return df


def text_search(df: DataFrame, pattern: str, columns: tuple[str, ...] = ("code", "company_name")) -> DataFrame:
    """Case-insensitive regular expression over any of ``columns``; a missing value never matches."""
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.coalesce(F.col(column).rlike(f"(?i){pattern}"), F.lit(False))
    return df.filter(hit)
