"""Inputs of the checks and their readers: what is sorted, moved or held must not grow faster than the input."""

from datetime import date

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from equiscan.functions import multi_format_date, strict_date
from equiscan.plans import portfolio as pf
from equiscan.sources import derived, ledger


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "text, day",
    [
        ("2001/6/30", date(2001, 6, 30)), (" 2001-06-30 ", date(2001, 6, 30)), ("6/30/2001", date(2001, 6, 30)), ("2001/2/30", None),
        ("13/1/2001", None), ("2001-6/30", None), ("2001-06", None), ("2001", None), ("2001-06-30T00", None), ("2001/6/30\n", None),
        ("x2001/6/30", None), ("", None), ("-", None), (None, None), ("20010630", None), ("6-30-2001", None),
    ],
)
def test_ledger_dates(spark, text, day):
    assert spark.createDataFrame([(text,)], "x string").select(multi_format_date("x").alias("d")).first().d == day


def test_a_ledger_date_is_computed_from_its_text_once(spark):
    text = plan(spark.range(1).select(multi_format_date(F.reverse(F.col("id").cast("string"))).alias("d")))
    assert text.count("reverse(") == 1


def test_a_strict_date_is_parsed_once(spark):
    assert plan(spark.range(1).select(strict_date(F.reverse(F.col("id").cast("string"))).alias("d"))).count("try_cast(") == 1
    rows = spark.createDataFrame([("2001-06-30",), ("20010630",), ("2001/6/30",), (None,)], "x string")
    assert [r.d for r in rows.select(strict_date("x").alias("d")).collect()] == [date(2001, 6, 30)] * 3 + [None]
    with pytest.raises(Exception, match="unreadable date: -"):
        spark.createDataFrame([("-",)], "x string").select(strict_date("x").alias("d")).collect()


def test_sheets_are_read_in_batches(monkeypatch):
    """However many rows a sheet has, and however many sheets a task: no more than a batch of rows is held."""
    monkeypatch.setattr(ledger, "BATCH_ROWS", 10)
    sheet = "t\nu\na,b\n" + "".join(f'{i},"x\ny"\n' for i in range(95))
    batch = pa.RecordBatch.from_pydict({"path": ["one.csv", "two.csv"], "content": pa.array([sheet.encode()] * 2, pa.binary())})
    out = list(ledger._sheet_rows(iter([batch])))
    assert len(out) == 20 and max(b.num_rows for b in out) == 10
    values = [v for b in out for v in b.column(1).to_pylist()]
    assert values == [[str(i), "x\ny"] for _ in range(2) for i in range(95)] and out[0].column(0).to_pylist()[0] == ["a", "b"]


def test_only_quotes_near_a_point_are_merged(spark):
    quotes = spark.range(2000).select(F.lit("A").alias("ticker"), F.date_add(F.lit(date(2020, 1, 1)), F.col("id").cast("int")).alias("date"), F.col("id").cast("double").alias("close"))
    points = spark.createDataFrame([(1, "A", date(2021, 1, 1)), (2, "A", date(2019, 12, 30)), (3, "B", date(2021, 1, 1))], "id int, ticker string, day date")
    found = pf.price_at(points, quotes)
    assert {r.id: r.price for r in found.collect()} == {1: 366.0, 2: 0.0, 3: None}
    text = plan(found)
    assert "LeftSemi" in text and text.index("Window") < text.index("LeftSemi")


def test_bars_are_dealt_to_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """More lines make more tasks, not larger sorts, and no line is sorted before it is moved."""
    monkeypatch.setattr(derived, "ROWS_A_TASK", 10)
    line = spark.range(500).select(
        F.when(F.col("id") % 10 > 0, F.col("id") % 7).alias("l_suppkey"), F.timestamp_seconds(F.lit(900_000_000) + F.col("id") % 40 * 86_400).alias("l_shipdate"),
        F.lit(0.04).alias("l_tax"), F.lit(0.08).alias("l_discount"), (F.col("id") % 50).cast("double").alias("l_quantity"),
        F.lit(100.0).alias("l_extendedprice"), F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"),
    )
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    market = derived.Market(spark, str(tmp_path))
    steps = plan(market._build_daily_bars())
    assert "hashpartitioning(l_suppkey" in steps and steps.count("Exchange") == 2 and steps.count(", 50), REPARTITION_BY_NUM") == 2
    assert steps.index("partial_min_by") < steps.rindex("Exchange")
    got = {(r.code, r.date): r.volume for r in market.daily_bars().collect()}
    days = {(r["id"] % 7 if r["id"] % 10 else None, r["id"] % 40) for r in spark.range(500).collect()}
    assert len(got) == len([1 for s, _ in days if s is not None]) + len({d for s, d in days if s is None})
    assert sum(got.values()) == sum(i % 50 for i in range(500))
