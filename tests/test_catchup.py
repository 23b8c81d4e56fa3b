import json
import time
from datetime import date, timedelta

import pytest
from pyspark.sql import types as T

from equiscan.plans import jobs
from equiscan.sinks import tables
from equiscan.streaming import catchup

DAY = date(2024, 6, 28)  # a Friday


def latest(spark, day):
    return spark.createDataFrame([(day,)], "latest date")


def days(df):
    return sorted(r.day for r in df.collect())


def span(first, last):
    return [first + timedelta(days=i) for i in range((last - first).days + 1)]


@pytest.mark.parametrize(
    "stored, options, expected",
    [
        (DAY - timedelta(days=3), {}, span(DAY - timedelta(days=2), DAY)),
        (DAY, {}, []),
        (DAY - timedelta(days=1), {"include_today": False}, []),
        (DAY - timedelta(days=90), {}, span(DAY - timedelta(days=29), DAY)),
        (DAY - timedelta(days=90), {"include_today": False}, span(DAY - timedelta(days=30), DAY - timedelta(days=1))),
        (None, {"empty_start": "today"}, [DAY]),
        (None, {"include_today": False}, span(DAY - timedelta(days=29), DAY - timedelta(days=1))),
        (DAY - timedelta(days=90), {"cap": 10, "keep": "oldest"}, span(DAY - timedelta(days=89), DAY - timedelta(days=80))),
        (DAY - timedelta(days=4), {"cap": 10, "keep": "oldest"}, span(DAY - timedelta(days=3), DAY)),
    ],
)
def test_due_days(spark, stored, options, expected):
    assert days(catchup.due_days(latest(spark, stored), DAY, **options)) == expected


def test_weekends_are_left_out(spark):
    got = days(catchup.due_days(latest(spark, DAY - timedelta(days=8)), DAY, weekdays_only=True))
    assert len(got) == 6 and all(d.weekday() < 5 for d in got)


@pytest.mark.parametrize("as_of", [DAY, DAY + timedelta(days=1), DAY + timedelta(days=6)])
def test_fridays(spark, as_of):
    got = days(catchup.due_fridays(latest(spark, None), as_of))
    assert got == [DAY - timedelta(weeks=n) for n in range(7, -1, -1)]
    assert days(catchup.due_fridays(latest(spark, DAY), as_of)) == []


def test_stream_takes_each_file_once(spark, database, tmp_path):
    spec, table = jobs.DATASETS["daily_bars"], f"{database}.bars"
    columns = ["Date", "Code", "O", "C"]

    def deliver(*rows):
        df = spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in columns))
        df.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        return df.schema

    schema = deliver(("2024-01-05", "1301", "1", "1"), ("2024-02-05", "1301", "1", "2"))
    run = lambda: catchup.upsert_landed(spark, str(tmp_path / "in"), schema, spec, table, str(tmp_path / "cp"))
    assert run() == 1 and run() == 0
    deliver(("2024-02-05", "1301", "1", "9"), ("2024-02-06", "1302", "1", "3"))
    assert run() == 1
    assert sorted((r.code, r.close) for r in spark.table(table).collect()) == [("01301", 1.0), ("01301", 9.0), ("01302", 3.0)]
    assert tables.latest_date(spark, table) == date(2024, 2, 6)


def test_the_first_record_of_a_key_counts_over_batches_and_a_replay_changes_nothing(spark, database, tmp_path):
    spec, table = jobs.DATASETS["indices"], f"{database}.index_bars"
    record = T.StructType([T.StructField(c, T.StringType()) for c in ("Date", "Code", "C")])
    path, memory = tmp_path / "in", f"file://{tmp_path}/checkpoint"
    path.mkdir()
    content = lambda: {(str(r.date), r.index_code): r.close for r in spark.table(table).collect()}

    def deliver(name, *rows):
        (path / name).write_text("\n".join(json.dumps(dict(zip(("Date", "Code", "C"), r, strict=True))) for r in rows))
        time.sleep(1.1)  # a file stream takes files by their time

    deliver("a.json", ("2024-01-05", "1", "1"), ("2024-01-05", "2", "2"), ("2024-01-05", "1", "9"))
    deliver("b.json", ("2024-01-05", "1", "7"), ("2024-01-08", "1", "3"))
    assert catchup.upsert_landed(spark, str(path), record, spec, table, memory, files_a_batch=1) == 2
    expected = {("2024-01-05", "1"): 1.0, ("2024-01-05", "2"): 2.0, ("2024-01-08", "1"): 3.0}
    assert content() == expected
    deliver("c.json", ("2024-01-08", "1", "5"), ("2024-01-09", None, "6"), ("2024-01-09", "2", "4"))
    assert catchup.upsert_landed(spark, str(path), record, spec, table, memory) == 1
    expected |= {("2024-01-09", None): 6.0, ("2024-01-09", "2"): 4.0}
    assert content() == expected
    # The driver is lost after a batch was stored and before the stream noted that: the batch comes again.
    for number, name in ((2, "c.json"), (1, "b.json")):
        again = spark.read.schema(record).json(str(path / name))
        catchup.store_batch(again.where("Code IS NOT NULL"), number, spec, table, f"{memory}-keys")
    assert content() == expected
