"""Catch-up windows and an incremental load of landed files."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiscan.plans.jobs import GROUPS, Dataset, normalise, run_group
from equiscan.session import staged_while
from equiscan.sinks import tables
from equiscan.sources.readers import read_bulk_csv, read_pages

# How far one run may reach back.
MAX_DAYS = 30
MINUTE_DAYS = 10
MARGIN_WEEKS = 8
# Days out of reach that a log names.
MAX_LEFT = 400


# How far each dataset of a daily or weekly run reaches back; the others take all that has landed.
_YESTERDAY = {"include_today": False, "empty_start": "window"}
RULES: dict[str, dict] = {
    "financial_summary": {"empty_start": "today"},
    "short_selling": {"empty_start": "today"},
    "minute_bars": {"empty_start": "today", "cap": MINUTE_DAYS, "keep": "oldest"},
    "indices": _YESTERDAY,
    "index_options": _YESTERDAY,
    "short_sale_report": _YESTERDAY,
    "daily_margin_interest": _YESTERDAY,
    "margin_interest": {"fridays": True},
}


def is_weekday(day: Column | str) -> Column:
    return F.weekday(day) < 5


def due_days(
    latest: DataFrame,
    as_of: date,
    include_today: bool = True,
    empty_start: str = "window",
    cap: int = MAX_DAYS,
    keep: str = "newest",
    weekdays_only: bool = False,
) -> DataFrame:
    """The days a dataset still lacks.

    ``latest`` is a one-row frame with the newest stored date in its only column, or NULL. The days run from
    the one after it to ``as_of`` (or the day before). More than ``cap`` days are cut to the newest or, for
    minute bars, to the oldest. An empty table starts today, or ``cap`` days back.
    """
    stored = F.col(latest.columns[0])
    end = F.lit(as_of) if include_today else F.date_sub(F.lit(as_of), 1)
    first = F.lit(as_of) if empty_start == "today" else F.date_sub(F.lit(as_of), cap - 1)
    start = F.coalesce(F.date_add(stored, 1), first)
    if keep == "newest":
        start = F.greatest(start, F.date_sub(end, cap - 1))
    else:
        end = F.least(end, F.date_add(start, cap - 1))
    due = latest.select(start.alias("lo"), end.alias("hi")).filter(F.col("lo") <= F.col("hi"))
    days = due.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return days.filter(is_weekday("day")) if weekdays_only else days


def due_fridays(latest: DataFrame, as_of: date, weeks: int = MARGIN_WEEKS) -> DataFrame:
    """Fridays after the newest stored date up to the last one; an empty table goes ``weeks`` Fridays back."""
    last_friday = F.date_sub(F.lit(as_of), F.pmod(F.weekday(F.lit(as_of)) - 4, F.lit(7)))
    start = F.coalesce(F.date_add(latest.columns[0], 1), F.date_sub(last_friday, 7 * (weeks - 1)))
    due = latest.select(start.alias("lo"), last_friday.alias("hi")).filter(F.col("lo") <= F.col("hi"))
    days = due.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return days.filter(F.weekday("day") == 4)


def due_records(records: DataFrame, days: DataFrame, column: str = "date") -> DataFrame:
    """Landed records of the due days."""
    return records.join(days.select(F.col("day").alias(column)), column, "left_semi")


def _unseen(rows: DataFrame, keys: list[str], memory: str, batch: int) -> DataFrame:
    """Rows whose key no earlier batch of the stream had. A batch that comes again is told from earlier ones by its number."""
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(memory)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return rows
    seen = spark.read.schema(T.StructType([*(rows.schema[k] for k in keys), T.StructField("batch", T.LongType())])).parquet(memory)
    seen = seen.filter(F.col("batch") < batch).select(*(F.col(k).alias(f"_{k}") for k in keys))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return rows.join(seen, same, "left_anti")


def store_batch(batch: DataFrame, number: int, spec: Dataset, table: str, memory: str) -> int | None:
    """Upsert one batch of a stream; None where it lacks a key column.

    For a dataset whose first record of a key counts, the keys of each batch are kept below ``memory``, a partition for every
    batch: a key that an earlier batch had is passed over, whatever it says now. The keys are written after the rows and replace
    those of the same batch, so a batch that is repeated after a failure, wherever that was, changes nothing. (Rows without a
    key match nothing: they are stored again if the failure fell between rows and keys.)
    """
    rows = normalise(batch, spec)
    if rows is None:
        return None
    if not spec.unique:
        return tables.upsert(rows, table, list(spec.keys), spec.safe_types, spec.by)
    keys = list(spec.unique)
    with staged_while(_unseen(rows, keys, memory, number), "stream-batch") as fresh:
        stored = tables.upsert(fresh, table, list(spec.keys), spec.safe_types, spec.by, keys_unique=set(keys) <= set(spec.keys))
        kept = fresh.select(*keys, F.lit(number).cast("long").alias("batch"))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(memory)
    return stored


def upsert_landed(
    spark: SparkSession,
    path: str,
    record: T.StructType,
    spec: Dataset,
    table: str,
    checkpoint: str,
    file_format: str = "json",
    files_a_batch: int | None = None,
) -> int:
    """Load files that arrived since the last call: a file stream run to its end and upserted batch by batch.

    The stream's checkpoint remembers the files, and an upsert repeated after a failure changes nothing, so
    every record counts once. The first record of a key counts over all batches (:func:`store_batch`). Returns the
    number of batches that were stored.
    """
    batches: list[int] = []

    def store(batch: DataFrame, number: int) -> None:
        if store_batch(batch, number, spec, table, f"{checkpoint}-keys") is not None:
            batches.append(number)

    reader = spark.readStream.schema(record).format(file_format)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    query = (
        reader.load(path).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if batches:
        spark.catalog.refreshTable(table)  # a stream writes in a session of its own; this one may remember older files
    return len(batches)


def only_due(as_of: date):
    """For :func:`run_group`: the rows of the days that a table still lacks, and the days that are out of reach.

    The newest stored date moves the cursor, undated rows do not. The market index does not move the cursor
    of the others, with which it shares a table.
    """

    def pick(rows: DataFrame, spec: Dataset, table: str) -> tuple[DataFrame, list[date]]:
        if spec.name not in RULES:
            return rows, []
        spark = rows.sparkSession
        if not tables.table_exists(spark, table):
            newest = None
        elif spec.name == "indices":
            newest = tables.latest_other_index(spark.table(table)).first()["latest"]
        else:
            newest = tables.latest_date(spark, table, spec.by)
        latest = spark.range(1).select(F.lit(newest).cast("date").alias("latest"))
        rule = dict(RULES[spec.name])
        fridays = rule.pop("fridays", False)
        days = due_fridays(latest, as_of) if fridays else due_days(latest, as_of, **rule)
        due = [r["day"] for r in days.collect()]  # at most the cap of a rule
        wanted = F.col(spec.by).isin(due) if due else F.lit(False)
        # Later than what is stored and landed, but cut off by the cap.
        beyond = rows.filter((F.col(spec.by) <= F.lit(as_of)) & ~wanted)
        if newest is not None:
            beyond = beyond.filter(F.col(spec.by) > F.lit(newest))
        left = beyond.select(F.col(spec.by).alias("day")).distinct().orderBy("day").limit(MAX_LEFT).collect()
        return rows.filter(wanted), [r["day"] for r in left]

    return pick


def run_landed(spark: SparkSession, group: str, folders: dict[str, str], database: str, as_of: date) -> DataFrame:
    """Run a group from landed folders, each dataset in one: pages (``*.json``) or, in the first load, bulk files.

    A dataset without a folder is logged as failed, or stops the run if it is required.
    """

    def reader(name: str):
        def read():
            if name not in folders:
                raise FileNotFoundError(f"no landed folder for {name}")
            path = folders[name]
            return read_bulk_csv(spark, path) if path.endswith(("csv", "csv.gz")) else read_pages(spark, path)

        return read

    names = {n: reader(n) for n in GROUPS[group]}
    return run_group(spark, group, names, database, only_due(as_of) if group != "init" else None)
