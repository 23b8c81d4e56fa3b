"""Group aggregates. All are built from functions with a map-side partial, so a hot group costs one
row per task in the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiscan.functions import local_code, safe_divide


def sector_average_per(valued: DataFrame) -> DataFrame:
    """Mean PER by sector over ``0 < per < 200``."""
    return (
        valued.filter((F.col("per") > 0) & (F.col("per") < 200))
        .groupBy("sector33_name")
        .agg(F.avg("per").alias("sector_avg_per"))
    )


def latest_fx(external_prices: DataFrame) -> DataFrame:
    """One row: the greatest known USD/JPY rate."""
    return external_prices.agg(F.max("usdjpy_rate").alias("usdjpy_rate"))


def backtest_statistics(signals: DataFrame) -> DataFrame:
    def rate(h: int) -> Column:
        return F.round(F.avg(f"win_{h}d") * 100, 1).alias(f"win_rate_{h}d_pct")

    def mean(h: int) -> Column:
        return F.round(F.avg(f"return_{h}d_pct"), 2).alias(f"avg_return_{h}d_pct")

    return signals.agg(
        F.count("*").alias("total_signals"),
        F.min("signal_date").alias("earliest_signal"),
        F.max("signal_date").alias("latest_signal"),
        rate(5),
        mean(5),
        rate(10),
        mean(10),
        rate(20),
        mean(20),
        F.round(F.min("return_20d_pct"), 2).alias("min_return_20d_pct"),
        F.round(F.max("return_20d_pct"), 2).alias("max_return_20d_pct"),
        F.round(F.stddev_samp("return_20d_pct"), 2).alias("std_return_20d_pct"),
    )


def backtest_dashboard(signals: DataFrame) -> DataFrame:
    """Unrounded means plus the profit factor, which is NULL when there was no loss."""
    r = F.col("return_20d_pct")
    columns: list[Column] = [F.count("*").alias("total_signals")]
    for h in (5, 10, 20):
        columns.append((F.avg(f"win_{h}d") * 100).alias(f"win_rate_{h}d_pct"))
        columns.append(F.avg(f"return_{h}d_pct").alias(f"avg_return_{h}d_pct"))
    columns += [
        F.max(r).alias("max_return_20d_pct"),
        F.min(r).alias("min_return_20d_pct"),
        F.stddev_samp(r).alias("std_return_20d_pct"),
        safe_divide(
            F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)),
            F.abs(F.coalesce(F.sum(F.when(r < 0, r)), F.lit(0.0))),
        ).alias("profit_factor"),
    ]
    return signals.agg(*columns)


def sector_scores(scored: DataFrame) -> DataFrame:
    return scored.groupBy("sector33_name").agg(
        F.count("code").alias("stock_count"),
        F.avg("kubota_trade_score").alias("avg_trade_score"),
        F.avg("growth_invest_score").alias("avg_growth_score"),
        F.count_if(F.col("kubota_signal") == "buy_signal").alias("entry_count"),
    )


def weighted_mean(df: DataFrame, group: str, value: str, weight: str, alias: str) -> DataFrame:
    """Weighted mean per group; the plain mean where the weights sum to nothing."""
    total = F.sum(weight)
    return df.groupBy(group).agg(
        F.when(total > 0, F.sum(F.col(value) * F.col(weight)) / total).otherwise(F.avg(value)).alias(alias)
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def sector_signal_pivot(scored: DataFrame) -> DataFrame:
    """Sector by signal counts; the signal values are listed, so no extra job has to discover them."""
    # The signal vocabulary.
    counts = (
        scored.groupBy("sector33_name").pivot("kubota_signal", ["buy_signal", "wait", "-"]).agg(F.count(F.lit(1)))
        .na.fill(0)
        .withColumnRenamed("-", "other")
    )
    total = F.col("buy_signal") + F.col("wait") + F.col("other")
    return counts.withColumn("total", total).withColumn(
        "buy_share_pct", safe_divide(F.col("buy_signal"), F.greatest(total, F.lit(1))) * 100
    )


def mean_by_local_code(scores: DataFrame, value: str = "atr_pct") -> DataFrame:
    return scores.groupBy(local_code("code").alias("code")).agg(F.avg(value).alias(value))
