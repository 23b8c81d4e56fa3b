"""Stored tables: append, overwrite, keyed upsert and the small lookups around them.

Tables are Parquet in the session catalog. A table with a date key is laid out by month (a derived
``month`` column), rows sorted by key inside the files: daily directories would hold a few thousand rows
each. Before a write the rows are rebalanced by month, so adaptive execution merges small months and splits
large ones instead of giving each month to one task.

A table may also be dealt into :class:`Buckets` by the key of its series. Every write, upserts included, keeps
them; a window or join on that key then reads the series without an exchange.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiscan.functions import partition_id_date
from equiscan.session import release_shuffles, staged_while

MONTH = "month"
# Date columns that can bound a merge, in order of preference.
DATE_KEYS = ("date", "trade_date", "disclosed_date", "snapshot_time", "pub_date", "published_date")
_DYNAMIC = "spark.sql.sources.partitionOverwriteMode"


#: Property of a staging table that holds all of what an upsert puts in place; see :func:`recover`.
REDO = "equiscan.redo"
#: Rows that an upsert joins, or puts in place, at once; whole months are. Shuffle files of one round go before the next.
ROUND_ROWS = 8_000_000


@dataclass(frozen=True)
class Buckets:
    """Rows of a table dealt to ``n`` buckets by the hash of ``key``: as many as tasks shall read it side by side."""

    key: str
    n: int


def buckets_of(spark: SparkSession, table: str) -> Buckets | None:
    """The buckets that a stored table was created with."""
    about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    if "Num Buckets" not in about:
        return None
    return Buckets(about["Bucket Columns"].strip("[]`"), int(about["Num Buckets"]))


def create_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`{where}")


def table_exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def row_count(spark: SparkSession, table: str) -> int:
    return spark.table(table).count()


def is_by_month(spark: SparkSession, table: str) -> bool:
    return MONTH in spark.table(table).columns


def create_if_missing(spark: SparkSession, statements: str) -> int:
    """Run ``CREATE … IF NOT EXISTS`` statements separated by ``;``; returns how many there were."""
    parts = [s.strip() for s in statements.split(";") if s.strip()]
    for statement in parts:
        spark.sql(statement)
    return len(parts)


class SchemaMismatch(ValueError):
    """A batch has columns that its table lacks."""


def fit_columns(df: DataFrame, table: str, add_columns: bool = False) -> list[str]:
    """Columns of ``df`` that ``table`` lacks: added to the table if asked, else an error. Nothing is dropped in silence."""
    spark = df.sparkSession
    stored = {c.lower() for c in spark.table(table).columns}
    new = [f for f in df.schema.fields if f.name.lower() not in stored]
    if new and not add_columns:
        raise SchemaMismatch(f"{table} has no column {', '.join(f.name for f in new)}")
    if new:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({kinds})")
        spark.catalog.refreshTable(table)
    return [f.name for f in new]


def _insert(df: DataFrame, table: str, date_column: str | None, sort: list[str], replace: bool) -> int:
    """Write into an existing table and count in one job; columns the batch lacks are NULL, the declared types stay."""
    seen = Observation()
    rows = _laid_out(df.observe(seen, F.count(F.lit(1)).alias("rows")), date_column, sort, buckets_of(df.sparkSession, table))
    aligned = [F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in df.sparkSession.table(table).dtypes]
    rows.select(*aligned).write.insertInto(table, overwrite=replace)
    return int(seen.get["rows"])


def _laid_out(df: DataFrame, date_column: str | None, sort: list[str], buckets: Buckets | None = None) -> DataFrame:
    if date_column is not None:
        df = df.withColumn(MONTH, F.date_format(date_column, "yyyy-MM"))
    return _dealt(df, sort, buckets) if date_column is not None or buckets else df


def _dealt(df: DataFrame, sort: list[str], buckets: Buckets | None = None) -> DataFrame:
    """Rows of a month, and of a bucket in it, together; small ones share a task, large ones are split.

    The month leads the sort: the writer needs it, and would otherwise sort again and lose the rest. Buckets it sorts itself.
    """
    by = [F.col(MONTH)] if MONTH in df.columns else []
    if buckets:
        return df.withColumn("_bucket", F.pmod(F.hash(buckets.key), F.lit(buckets.n))).hint("rebalance", *by, F.col("_bucket")).drop("_bucket")
    return df.hint("rebalance", *by).sortWithinPartitions(*by, *sort)


def bucketed(df: DataFrame, buckets: Buckets) -> DataFrame:
    """Rows of a bucket together, so that it is written as few files."""
    return _dealt(df, [], buckets)


@contextmanager
def _dynamic_partitions(spark: SparkSession):
    before = spark.conf.get(_DYNAMIC)
    spark.conf.set(_DYNAMIC, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(_DYNAMIC, before)


def replace_partitions(df: DataFrame, table: str) -> None:
    """Put ``df`` in place of the partitions that it has rows of; the others stay."""
    with _dynamic_partitions(df.sparkSession):
        df.select(*df.sparkSession.table(table).columns).write.mode("overwrite").insertInto(table)


def _create(df: DataFrame, table: str, date_column: str | None, sort: list[str], mode: str, buckets: Buckets | None = None) -> int:
    """Write all of a table; its rows are counted from the file footers, for a batch may turn out to have none."""
    writer = _laid_out(df, date_column, sort, buckets).write.mode(mode)
    if date_column is not None:
        writer = writer.partitionBy(MONTH)
    if buckets:
        writer = writer.bucketBy(buckets.n, buckets.key).sortBy(buckets.key, *(c for c in sort if c != buckets.key))
    writer.format("parquet").saveAsTable(table)
    return row_count(df.sparkSession, table)


def overwrite(
    df: DataFrame, table: str, date_column: str | None = None, sort: list[str] | None = None, buckets: Buckets | None = None
) -> int:
    """Replace the rows of the table; an empty input leaves the table alone and counts 0.

    A table that exists keeps its declared columns, types and buckets; a column it lacks is an error.
    """
    spark = df.sparkSession
    if df.isEmpty():
        return 0
    sort = sort or df.columns[:2]
    if not table_exists(spark, table):
        return _create(df, table, date_column, sort, "overwrite", buckets)
    recover(spark, table)
    if is_by_month(spark, table) and date_column is None:
        raise ValueError(f"{table} is laid out by month: name its date column")
    fit_columns(df, table)
    return _insert(df, table, date_column if is_by_month(spark, table) else None, sort, replace=True)


def append(
    df: DataFrame, table: str, date_column: str | None = None, sort: list[str] | None = None, add_columns: bool = False
) -> int:
    """Append and return the row count; an empty input writes nothing. A column the table lacks is an error, or is added."""
    spark = df.sparkSession
    if not table_exists(spark, table):
        return overwrite(df, table, date_column, sort)
    recover(spark, table)
    if is_by_month(spark, table) and date_column is None:
        raise ValueError(f"{table} is laid out by month: name its date column")
    fit_columns(df, table, add_columns)
    if df.isEmpty():
        return 0
    return _insert(df, table, date_column if is_by_month(spark, table) else None, sort or df.columns[:2], replace=False)


def load_files(df: DataFrame, table: str, date_column: str | None = None, sort: list[str] | None = None) -> int:
    """Bulk load of many files: one overwrite over all of them.

    Replacing with the first file and appending the rest would leave a partial table after a failure in
    between; a single job swaps the content at its commit.
    """
    return overwrite(df, table, date_column, sort)


def safe_cast_to(df: DataFrame, target: T.StructType) -> DataFrame:
    """Decimal targets: cast the matching column, NULL where the value does not fit."""
    kinds = {f.name: f.dataType for f in target.fields}
    return df.select(
        [
            F.col(c).try_cast(kinds[c]).alias(c) if isinstance(kinds.get(c), T.DecimalType) else F.col(c)
            for c in df.columns
        ]
    )


def date_key(keys: list[str], columns: list[str]) -> str | None:
    return next((k for k in DATE_KEYS if k in keys and k in columns), None)


def bounded_target(target: DataFrame, column: str, bounds: tuple[date, date]) -> DataFrame:
    """The months of the target a batch can touch, as literal partition filters."""
    lo, hi = bounds
    return target.filter(F.col(MONTH).between(lo.strftime("%Y-%m"), hi.strftime("%Y-%m")))


@dataclass(frozen=True)
class BatchProfile:
    rows: int
    bounds: tuple[date, date] | None
    months: list[str]
    undated: bool = False
    #: Rows of each month, and its first and last date.
    of_month: dict[str, tuple[int, date, date]] = field(default_factory=dict)


def profile_batch(df: DataFrame, keys: list[str], column: str | None, keys_unique: bool = False) -> BatchProfile:
    """Size, date range and months of a batch, in one job; two rows for one key are an error.

    Counting per key combines in the map tasks, so a key repeated over and over costs no more than any other. Where the
    batch was already reduced to one row a key (``keys_unique``) it is not shuffled to count again.
    """
    counts = df.withColumn("_n", F.lit(1)) if keys_unique else df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    has_key = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    wanted = [F.sum("_n").alias("rows"), F.max(F.when(has_key, F.col("_n"))).alias("most")]
    by = []
    if column is not None:
        by = [F.date_format(column, "yyyy-MM").alias(MONTH)]
        wanted += [F.min(column).alias("lo"), F.max(column).alias("hi")]
    months = counts.groupBy(*by).agg(*wanted).collect()  # a row for each month
    most = max((m["most"] or 0 for m in months), default=0)
    if most > 1:
        raise ValueError(f"batch has up to {most} rows for one key of {keys}")
    rows = sum(m["rows"] or 0 for m in months)
    if column is None:
        return BatchProfile(rows, None, [])
    dated = sorted((m for m in months if m[MONTH] is not None), key=lambda m: m[MONTH])
    bounds = (min(m["lo"] for m in dated), max(m["hi"] for m in dated)) if dated else None
    of_month = {m[MONTH]: (m["rows"], m["lo"], m["hi"]) for m in dated}
    return BatchProfile(rows, bounds, list(of_month), len(dated) < len(months), of_month)


def merged(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows with the source's columns laid over them, plus the source's new rows.

    Keys are unique on both sides. Columns the source lacks keep the target's value. A NULL key matches
    nothing, so such source rows are only added; they skip the join, which would pile them up in one task.
    """
    shared = [c for c in source.columns if c not in keys and c in target.columns]
    new = source.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in shared], F.lit(True).alias("_matched"))
    has_key = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    joined = target.join(new.filter(has_key), keys, "full_outer")

    def laid_over(c: str) -> Column:
        return F.when(F.col("_matched"), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c)

    def only_new(c: str) -> Column:
        if c in keys:
            return F.col(c)
        return F.col(f"_s_{c}").alias(c) if c in shared else F.lit(None).cast(target.schema[c].dataType).alias(c)

    updated = joined.select([laid_over(c) if c in shared else F.col(c) for c in target.columns])
    keyless = new.filter(~has_key).select([only_new(c) for c in target.columns])
    return updated.unionByName(keyless)


def upsert(
    df: DataFrame,
    table: str,
    keys: list[str],
    match_types: bool = False,
    date_column: str | None = None,
    keys_unique: bool = False,
    add_columns: bool = False,
    buckets: Buckets | None = None,
) -> int:
    """Update rows by key, insert the others, keep everything else. Returns the size of the batch.

    A table that does not exist is created from the batch as it is computed. Otherwise the batch is computed once: it is
    staged, and profiled and written from there. A column the table lacks is an error, or is added. Parquet has no MERGE. A
    batch of dates the table does not have is appended. Otherwise the months the batch touches are joined with it, the
    result is written to a staging table that is marked as complete, and its months are put in place of the stored ones.

    Months are joined and put in place in rounds of up to about :data:`ROUND_ROWS` rows, so what is shuffled at once, and
    copied, does not grow with the batch or the table beyond that.

    A lost executor only repeats tasks. After a lost driver, a staging table that is not complete is worth nothing: the
    batch has changed nothing yet. One that is complete is put in place by the next write, or by :func:`recover`.
    """
    spark = df.sparkSession
    if not table_exists(spark, table):
        return _created(df, table, keys, date_column, keys_unique, buckets)
    recover(spark, table)
    fit_columns(df, table, add_columns)
    with staged_while(df, "upsert-batch") as batch:
        rows, staging = _upsert(batch, table, keys, match_types, date_column, keys_unique)
    if staging is not None:
        _put_in_place(spark, staging, table, keys)
    return rows


def _created(df: DataFrame, table: str, keys: list[str], date_column: str | None, keys_unique: bool, buckets: Buckets | None) -> int:
    """A new table from a batch, which is checked for repeated keys where it is stored; without rows there is no table."""
    spark = df.sparkSession
    column = date_column if date_column in keys else date_key(keys, df.columns)
    rows = _create(df, table, column, keys, "overwrite", buckets)
    try:
        if rows and not keys_unique:
            profile_batch(spark.table(table).select(*keys), keys, None)
    except ValueError:
        rows = 0
        raise
    finally:
        if not rows:
            spark.sql(f"DROP TABLE {table}")
    return rows


def _upsert(
    df: DataFrame, table: str, keys: list[str], match_types: bool, date_column: str | None, keys_unique: bool
) -> tuple[int, str | None]:
    """Rows of the batch, and the staging table with the result where it is not in place yet."""
    spark = df.sparkSession
    column = date_column if date_column in keys else date_key(keys, df.columns)
    batch = profile_batch(df, keys, column, keys_unique)
    if batch.rows == 0:
        return 0, None
    _release_after(spark, batch.rows)
    stored = spark.table(table)
    if match_types:
        df = safe_cast_to(df, stored.schema)
    by_month = MONTH in stored.columns and column is not None
    rounds = [(stored, df)]
    if by_month:
        dated = stored.filter(F.col(MONTH).isin(batch.months))
        if batch.bounds is not None:
            dated = bounded_target(dated, column, batch.bounds)
            overlap = dated.filter(F.col(column).between(*[F.lit(b) for b in batch.bounds]))
        if batch.bounds is None or overlap.isEmpty():
            # No stored row has a date of the batch, so no key can match: the usual case of a new day.
            rows = append(df, table, column, keys)
            _release_after(spark, rows)
            return rows, None
        rounds = _rounds_of_months(stored, dated, df, column, batch)
    staging = f"{table}__staging_{uuid.uuid4().hex[:8]}"
    for target, source in rounds:
        result = merged(target, source, keys)
        if by_month:
            result = result.withColumn(MONTH, F.date_format(column, "yyyy-MM"))
        writer = result.select(*stored.columns).write.format("parquet").mode("append")
        writer.option("compression", "zstd").saveAsTable(staging)
        _release_after(spark, batch.rows)
    spark.sql(f"ALTER TABLE {staging} SET TBLPROPERTIES ('{REDO}' = '{','.join(keys)}')")
    return batch.rows, staging


def _rounds_of_months(
    stored: DataFrame, dated: DataFrame, df: DataFrame, column: str, batch: BatchProfile
) -> list[tuple[DataFrame, DataFrame]]:
    """The stored rows and those of the batch that an upsert joins round by round; undated rows come with the first one."""
    sizes = {m: rows for m, (rows, _, _) in batch.of_month.items()}
    if len(sizes) > 1:
        for m, rows in _rows_by_month(dated).items():
            sizes[m] += rows
    rounds = []
    for months in _in_rounds(sizes):
        target = dated.filter(F.col(MONTH).isin(months))
        lo, hi = batch.of_month[months[0]][1], batch.of_month[months[-1]][2]
        due = F.col(column).between(F.lit(lo), F.lit(hi))
        if batch.undated and not rounds:
            # What replaces the partition of undated rows has to hold those that are there: then it may be repeated.
            target, due = target.unionByName(stored.filter(F.col(MONTH).isNull())), due | F.col(column).isNull()
        rounds.append((target.drop(MONTH), df.filter(due)))
    return rounds


def _rows_by_month(df: DataFrame) -> dict[str | None, int]:
    return {r[MONTH]: r["count"] for r in df.groupBy(MONTH).count().collect()}


def _in_rounds(sizes: dict[str | None, int]) -> list[list[str | None]]:
    """Months in order, undated rows first, as many together as have up to :data:`ROUND_ROWS` rows."""
    rounds: list[list[str | None]] = []
    held = 0
    for month in sorted(sizes, key=lambda m: m or ""):
        if rounds and held + sizes[month] <= ROUND_ROWS:
            rounds[-1].append(month)
            held += sizes[month]
        else:
            rounds.append([month])
            held = sizes[month]
    return rounds


def _release_after(spark: SparkSession, rows: int) -> None:
    """The shuffle files of a job go before the next one adds its own, where they are large."""
    if rows > ROUND_ROWS // 8:
        release_shuffles(spark, times=2)


def _put_in_place(spark: SparkSession, staging: str, table: str, keys: list[str]) -> None:
    """The months of ``staging`` for those of ``table``, or all of it for a table without months; may be repeated."""
    fresh, buckets = spark.table(staging), buckets_of(spark, table)
    if MONTH in fresh.columns:
        sizes = _rows_by_month(fresh)
        for months in _in_rounds(sizes):
            due = F.col(MONTH).isin([m for m in months if m is not None])
            some = fresh.filter(due | F.col(MONTH).isNull() if None in months else due) if len(months) < len(sizes) else fresh
            with _dynamic_partitions(spark):
                _dealt(some, keys, buckets).write.mode("overwrite").insertInto(table)
            _release_after(spark, sum(sizes.values()))
    else:
        (_dealt(fresh, keys, buckets) if buckets else fresh).write.mode("overwrite").insertInto(table)
    spark.sql(f"DROP TABLE IF EXISTS {staging}")


def recover(spark: SparkSession, table: str) -> int:
    """Finish the upsert that a lost driver left unfinished; returns how many complete staging tables there were.

    Every write of a table begins with this, so there is one at most. Staging tables that are not complete are dropped.
    """
    database, _, name = table.rpartition(".")
    within = f" IN {database}" if database else ""
    found = [r["tableName"] for r in spark.sql(f"SHOW TABLES{within} LIKE '{name}__staging_*'").collect()]
    finished = 0
    for staging in (f"{database}.{t}" if database else t for t in found):
        keys = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {staging}").collect()}.get(REDO)
        if keys is None:
            spark.sql(f"DROP TABLE IF EXISTS {staging}")
        else:
            _put_in_place(spark, staging, table, keys.split(","))
            finished += 1
    return finished


def latest_date(spark: SparkSession, table: str, column: str = "date") -> date | None:
    """Newest date. Where the table is laid out by day the partition list answers without a scan;
    by month, only the newest month that has rows is scanned."""
    if not table_exists(spark, table):
        return None
    df = spark.table(table)
    if "day_id" in df.columns:
        days = spark.sql(f"SHOW PARTITIONS {table}").select(F.split("partition", "=")[1].alias("d"))
        return days.agg(F.max(partition_id_date("d")).alias("d")).first()["d"]
    if MONTH in df.columns:
        # Rows without a date are in a partition without a month, which must not hide the others.
        dated = F.col("partition").rlike(rf"^{MONTH}=[0-9]{{4}}-[0-9]{{2}}$")
        months = spark.sql(f"SHOW PARTITIONS {table}").filter(dated).orderBy(F.col("partition").desc()).collect()
        for month in months:
            newest = df.filter(F.col(MONTH) == month["partition"].split("=")[1]).agg(F.max(column).alias("d")).first()["d"]
            if newest is not None:
                return newest
        return None
    return df.agg(F.max(column).alias("d")).first()["d"]


def latest_other_index(index_bars: DataFrame, market_index: str = "0000") -> DataFrame:
    """Newest date of the other indices: the market index is updated separately and must not move it."""
    return index_bars.filter(F.col("index_code") != market_index).agg(F.max("date").alias("latest"))


# ---- scoring outputs --------------------------------------------------------------------------

SNAPSHOT_COLUMNS = [
    "code", "company_name", "sector33_name", "market_segment", "latest_close", "avg_turnover_20d_oku",
    "liquidity_grade", "volatility_score", "chart_score", "kubota_trade_score", "sales_cagr_3y_pct",
    "op_cagr_3y_pct", "roe_pct", "roic_pct", "growth_invest_score", "per", "pbr", "market_phase",
    "kubota_signal", "screening_status",
]
_INTEGER_SCORES = ("volatility_score", "chart_score", "kubota_trade_score", "growth_invest_score")


def snapshot(scores: DataFrame, as_of: date) -> DataFrame:
    """The active rows of one day in the shape of ``score_history``."""
    picked = scores.filter(F.col("screening_status") == "ACTIVE").select(*SNAPSHOT_COLUMNS)
    return picked.withColumns({c: F.col(c).cast("bigint") for c in _INTEGER_SCORES}).select(
        F.lit(as_of).alias("snapshot_date"), *SNAPSHOT_COLUMNS
    )


def snapshot_scores(scores: DataFrame, table: str, as_of: date) -> int:
    """Add the day's snapshot unless the day is there already. Returns the rows added."""
    spark = scores.sparkSession
    today = snapshot(scores, as_of)
    if table_exists(spark, table):
        present = spark.table(table).filter(
            (F.col("snapshot_date") == F.lit(as_of)) & (F.col(MONTH) == as_of.strftime("%Y-%m"))
        )
        today = today.join(present.select("snapshot_date").distinct(), "snapshot_date", "left_anti")
        return append(today, table, "snapshot_date", ["snapshot_date", "code"])
    return overwrite(today, table, "snapshot_date", ["snapshot_date", "code"])


def publish_views(views: dict[str, DataFrame | Exception | object]) -> dict[str, str]:
    """Register named frames as views in order. ``views`` maps a name to a function that builds the frame;
    one failure is reported and does not stop the rest."""
    outcome: dict[str, str] = {}
    for name, build in views.items():
        try:
            build().createOrReplaceTempView(name)
            outcome[name] = "ok"
        except Exception as error:  # the report says which view failed and why
            outcome[name] = f"failed: {type(error).__name__}: {str(error).splitlines()[0][:200]}"
    return outcome
