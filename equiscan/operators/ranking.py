"""Sorting and top-k. Every ordering ends in a unique column, so ties cannot reshuffle a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score_order() -> list[Column]:
    return [
        F.col("kubota_trade_score").desc_nulls_last(),
        F.col("growth_invest_score").desc_nulls_last(),
        F.col("code").asc(),
    ]


def top_scored(df: DataFrame, n: int) -> DataFrame:
    """Top ``n`` by trade score, then growth score."""
    return df.orderBy(*score_order()).limit(n)


def signals_first(df: DataFrame, signal: str = "buy_signal") -> DataFrame:
    """Rows with the signal first, score order within each part."""
    return df.orderBy((F.col("kubota_signal") == signal).desc_nulls_last(), *score_order())


def top_per_class(df: DataFrame, class_col: str, limits: dict[str, int]) -> DataFrame:
    """First ``limits[c]`` rows of each class.

    One pass over the table: the bound on the rank reaches every task as a group limit, which keeps only the best rows
    of each class before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(class_col).orderBy(*score_order()))
    best = df.filter(F.col(class_col).isin(*limits)).withColumn("_rank", rank).filter(F.col("_rank") <= max(limits.values()))
    wanted = F.coalesce(*(F.when(F.col(class_col) == name, F.col("_rank") <= n) for name, n in limits.items()))
    return best.filter(wanted).drop("_rank")


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep the row with the smallest ``order`` of each key.

    ``min_by`` keeps one row per key in every task before the shuffle, however many copies a key has.
    """
    others = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(order)).alias("_row"))
    return kept.select(*keys, "_row.*").select(*df.columns)
