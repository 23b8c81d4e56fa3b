"""Join shapes.

No side carries a broadcast hint: the size of every table here follows the data, so the choice is left
to the planner's size check and to adaptive execution, which also splits skewed shuffle partitions.
One-row inputs are attached as scalar subqueries, which needs no join at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiscan.functions import local_code


def left_chain(base: DataFrame, sides: list[DataFrame], key: str = "code") -> DataFrame:
    """Left-join one-row-per-key tables in turn; all share one partitioning on ``key``."""
    return reduce(lambda left, right: left.join(right, key, "left"), sides, base)


def attach_single_row(df: DataFrame, one_row: DataFrame, required: bool) -> DataFrame:
    """Put the columns of a one-row table on every row.

    ``required`` gives cross-join behaviour: no row there, no rows here. Otherwise the columns are NULL.
    """
    attached = df.withColumn("_one", one_row.select(F.struct("*").alias("_one")).scalar())
    if required:
        attached = attached.filter(F.col("_one").isNotNull())
    return attached.select(*df.columns, *[F.col(f"_one.{c}").alias(c) for c in one_row.columns])


def lag_year(annual: DataFrame, values: list[str], years: int = 3, key: str = "code", year: str = "disc_year") -> DataFrame:
    """Values of the same key ``years`` earlier, through an equi join on the shifted year."""
    earlier = annual.select(
        key,
        (F.col(year) + years).alias(year),
        *[F.col(v).alias(f"{v}_{years}y_ago") for v in values],
    )
    return annual.join(earlier, [key, year], "left")


def _scattered_key(df: DataFrame, column: str, only: str | None) -> DataFrame:
    """Add ``_key``: ``column`` for rows of product type ``only`` (of any, if None), else a filler no code can equal.

    A left join sends every NULL key to one partition. Rows that cannot match get fillers spread by a hash
    of the row instead, so a large share of code-less rows does not end up in one task.
    """
    filler = F.concat(F.lit("#"), F.pmod(F.xxhash64(*df.columns), F.lit(4096)).cast("string"))
    usable = F.col(column).isNotNull()
    if only is not None:
        usable = usable & (F.col("product_type") == only)
    return df.withColumn("_key", F.when(usable, F.col(column)).otherwise(filler))


def join_by_prefix(holdings: DataFrame, scores: DataFrame, only: str, right_key: str = "code") -> DataFrame:
    """Four-character codes against five-character ones, for rows of product type ``only``.

    Other rows are kept with NULLs. Two scores that share four characters both match.
    """
    right = scores.withColumn("_key", local_code(right_key)).drop(right_key)
    return _scattered_key(holdings, "code", only).join(right, "_key", "left").drop("_key")


def join_where(left: DataFrame, right: DataFrame, left_on: str, right_on: str, only: str) -> DataFrame:
    """Left join that can match only where ``left.product_type`` is ``only``."""
    keyed = right.withColumnRenamed(right_on, "_key")
    return _scattered_key(left, left_on, only).join(keyed, "_key", "left").drop("_key")


def left_on(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Left join on a column that may be NULL on the left."""
    keyed = right.withColumnRenamed(column, "_key")
    return _scattered_key(left, column, None).join(keyed, "_key", "left").drop("_key")


def keep_listed(df: DataFrame, chosen: DataFrame, key: str = "code") -> DataFrame:
    return df.join(chosen.select(key), key, "left_semi")


def drop_listed(df: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    return df.join(present.select(*on), on, "left_anti")
