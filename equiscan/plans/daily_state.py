"""Price scores of one new day from a stored state instead of the whole lookback.

The state of a day has one row per code: its sessions of the chart's lookback, newest first. A day is added by putting its
rows in front and dropping what has left the lookback, so a daily run reads the new day's bars and the last state, whatever
history the bars hold. The rows of a code are together: the scores are the same conditional aggregates over the rank as in
:mod:`equiscan.plans.indicators`, and need neither an exchange of the rows nor a sort.

States are kept by day in one table. A new state is written beside the one it came from, so a run that breaks off is repeated
from that; a day that is added twice replaces itself. After a correction of older bars the state has to be built anew.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiscan.operators.filters import date_slice, lookback
from equiscan.plans.indicators import CHART_DAYS, PRICE_DAYS, scored
from equiscan.sinks import tables
from equiscan.sinks.tables import Buckets

STATE_COLUMNS = ("date", "high", "low", "close", "volume", "turnover_value")
DAY = "state_day"
#: States that a table keeps.
KEPT = 2


def _newest_first(rows: DataFrame) -> DataFrame:
    """(code, sessions): one row per code; its rows are as many as the lookback has days."""
    sessions = F.collect_list(F.struct(*STATE_COLUMNS))
    return rows.groupBy("code").agg(F.sort_array(sessions, asc=False).alias("sessions"))


def built(bars: DataFrame, as_of: date) -> DataFrame:
    """The state of a day from all bars of the lookback."""
    return _newest_first(lookback(bars, as_of, CHART_DAYS).where("date IS NOT NULL"))


def advanced(state: DataFrame, days: DataFrame, as_of: date) -> DataFrame:
    """The state of ``as_of`` from an earlier one and the bars of the days since; bars of a day replace those it had."""
    oldest = F.lit(as_of - timedelta(days=CHART_DAYS))
    new = _newest_first(days.where("date IS NOT NULL")).withColumnRenamed("sessions", "_new")
    # Codes are unique on both sides; those without trades on the new days only grow older.
    both = state.join(new, "code", "full_outer")
    none = F.array().cast(state.schema["sessions"].dataType)
    added, held = F.coalesce("_new", none), F.coalesce("sessions", none)
    kept = F.filter(held, lambda s: ~F.array_contains(F.transform(added, lambda n: n["date"]), s["date"]))
    sessions = F.filter(F.sort_array(F.concat(added, kept), asc=False), lambda s: s["date"].between(oldest, F.lit(as_of)))
    return both.select("code", sessions.alias("sessions")).where(F.size("sessions") > 0)


def _ranked(state: DataFrame) -> DataFrame:
    """The sessions as rows with their rank from the newest, as the scores want them."""
    older = F.get("sessions", F.col("i") + 1)
    return state.select("code", "sessions", F.posexplode("sessions").alias("i", "s")).select(
        "code", "s.*", (F.col("i") + 1).alias("r"), older["close"].alias("_older_close"), older["date"].alias("_older_date")
    )


def all_indicators(state: DataFrame, as_of: date) -> DataFrame:
    """As :func:`equiscan.plans.indicators.all_indicators`, from a state of ``as_of``."""
    return scored(_ranked(state), as_of)


def latest_price(state: DataFrame, as_of: date) -> DataFrame:
    """As :func:`equiscan.plans.indicators.latest_price`."""
    newest = F.get("sessions", F.lit(0))
    recent = state.where(newest["date"] >= F.lit(as_of - timedelta(days=PRICE_DAYS)))
    return recent.select("code", newest["date"].alias("date"), newest["close"].alias("close"))


def stored_days(spark: SparkSession, table: str) -> list[date]:
    """Days of the states in a table, oldest first, from its partitions alone."""
    if not tables.table_exists(spark, table):
        return []
    return sorted(date.fromisoformat(r["partition"].split("=")[1]) for r in spark.sql(f"SHOW PARTITIONS {table}").collect())


def store(state: DataFrame, table: str, as_of: date, buckets: int = 32) -> None:
    """Write the state of a day; states older than the last :data:`KEPT` go."""
    spark = state.sparkSession
    dated = state.withColumn(DAY, F.lit(as_of.isoformat()))
    spread = Buckets("code", buckets)
    if not tables.table_exists(spark, table):
        tables.bucketed(dated, spread).write.partitionBy(DAY).bucketBy(spread.n, spread.key).format("parquet").saveAsTable(table)
    else:
        tables.replace_partitions(tables.bucketed(dated, tables.buckets_of(spark, table)), table)
    for day in stored_days(spark, table)[:-KEPT]:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({DAY} = '{day}')")


def state_of(spark: SparkSession, table: str, day: date) -> DataFrame:
    return spark.table(table).where(F.col(DAY) == day.isoformat()).drop(DAY)


def bring_forward(bars: DataFrame, table: str, as_of: date) -> DataFrame:
    """The stored state of ``as_of``: advanced from the newest earlier one in the table, or built where there is none."""
    spark = bars.sparkSession
    earlier = [d for d in stored_days(spark, table) if d < as_of]
    if earlier:
        since = date_slice(bars, earlier[-1] + timedelta(days=1), as_of).select("code", *STATE_COLUMNS)
        store(advanced(state_of(spark, table, earlier[-1]), since, as_of), table, as_of)
    else:
        store(built(bars.select("code", *STATE_COLUMNS, *[c for c in bars.columns if c == tables.MONTH]), as_of), table, as_of)
    return state_of(spark, table, as_of)
