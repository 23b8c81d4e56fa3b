"""Report files and the log of export runs."""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from equiscan.functions import blank_to_null

# Display labels of the exported columns.
LABELS = {
    "code": "銘柄コード",
    "company_name": "会社名",
    "sector33_name": "セクター",
    "latest_close": "終値",
    "avg_turnover_20d_oku": "平均売買代金(億円)",
    "liquidity_grade": "流動性グレード",
    "volatility_score": "ボラスコア",
    "chart_score": "チャートスコア",
    "kubota_trade_score": "窪田スコア",
    "sales_cagr_3y_pct": "売上CAGR3年(%)",
    "op_cagr_3y_pct": "営業利益CAGR3年(%)",
    "roe_pct": "ROE(%)",
    "roic_pct": "ROIC(%)",
    "growth_invest_score": "成長株スコア",
    "per": "PER",
    "pbr": "PBR",
    "market_phase": "相場フェーズ",
    "kubota_signal": "エントリーシグナル",
    "screening_status": "スクリーニング判定",
    "next_earnings_date": "次回決算日",
    "days_to_earnings": "決算まで(日)",
    "date": "日付",
    "topix_close": "TOPIX終値",
    "topix_ma200": "TOPIX200日MA",
    "environment_score": "環境スコア",
    "snapshot_date": "スナップショット日",
}


def as_text(df: DataFrame) -> DataFrame:
    """Every cell as text, placeholders for nothing as NULL."""
    return df.select([blank_to_null(c).alias(c) for c in df.columns])


def with_labels(df: DataFrame) -> DataFrame:
    """Text rows with the display labels as the first row (``_row`` 0); the data is ``_row`` 1."""
    text = as_text(df)
    labels = df.sparkSession.range(1).select(
        F.lit(0).alias("_row"), *[F.lit(LABELS.get(c, c)).alias(c) for c in df.columns]
    )
    return labels.unionByName(text.select(F.lit(1).alias("_row"), *df.columns))


def export_table(df: DataFrame, path: str) -> int:
    """Write a report as CSV with a header line, its labels as a small file next to it; returns the row count.

    The rows keep their order within and across the part files of a sorted report.
    """
    spark = df.sparkSession
    seen = Observation()
    as_text(df.observe(seen, F.count(F.lit(1)).alias("rows"))).write.mode("overwrite").option("header", True).option(
        "nullValue", ""
    ).csv(f"{path}/rows")
    labels = spark.range(1).select(*[F.lit(LABELS.get(c, c)).alias(c) for c in df.columns])
    labels.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/labels")
    return int(seen.get["rows"])


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(f"{path}/rows")


def export_all(
    reports: dict[str, Callable[[], DataFrame]], root: str, optional: tuple[str, ...] = ()
) -> dict[str, int]:
    """Export each report; -1 marks a failed one, 0 a failed optional one. The cause goes to the log."""
    results: dict[str, int] = {}
    for name, build in reports.items():
        try:
            results[name] = export_table(build(), f"{root}/{name}")
        except Exception as error:
            logging.getLogger(__name__).warning("report %s was not exported: %s", name, error)
            results[name] = 0 if name in optional else -1
    return results


def export_log(spark: SparkSession, results: dict[str, int], run_date: date, table: str) -> int:
    """Append one row per run: the date and a row count per report."""
    from equiscan.sinks.tables import append

    row = spark.range(1).select(
        F.lit(run_date).alias("run_date"), *[F.lit(n).cast("bigint").alias(name) for name, n in results.items()]
    )
    return append(row, table, None, ["run_date"])
