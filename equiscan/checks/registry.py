"""A query is a function of the derived tables plus, where SQL can say the same, the SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiscan.checks.ctes import with_ctes
from equiscan.checks.desk import Desk


@dataclass(frozen=True)
class Registered:
    run: Callable[[Desk], DataFrame]
    sql: str | None
    extra: dict[str, str] | None


REGISTRY: dict[str, Registered] = {}


def query(key: str, sql: str | None = None, extra: dict[str, str] | None = None):
    def keep(run: Callable[[Desk], DataFrame]) -> Callable[[Desk], DataFrame]:
        if key in REGISTRY:
            raise KeyError(f"query {key} is registered twice")
        REGISTRY[key] = Registered(run, sql, extra)
        return run

    return keep


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to a fixed number of decimals: the two engines add in different orders."""
    return df.select(
        [
            F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def spark_query(key: str) -> Callable[[SparkSession, str], DataFrame]:
    registered = REGISTRY[key]
    return lambda spark, sf_dir: registered.run(Desk(spark, sf_dir))


def oracle(key: str) -> str | None:
    registered = REGISTRY[key]
    return with_ctes(registered.sql, registered.extra) if registered.sql else None
