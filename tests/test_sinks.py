from datetime import date

import pytest
from pyspark.sql import functions as F

from equiscan.sinks import export, tables

SCHEMA = "date date, code string, close double, note string"


def frame(spark, rows):
    return spark.createDataFrame([(date.fromisoformat(d) if d else None, *r) for d, *r in rows], SCHEMA)


def content(spark, table):
    rows = spark.table(table).select("date", "code", "close", "note").collect()
    return sorted(((str(r.date), r.code, r.close, r.note) for r in rows), key=str)


@pytest.fixture()
def table(spark, database):
    name = f"{database}.bars"
    first = frame(
        spark,
        [("2024-01-05", "A", 1.0, "x"), ("2024-01-05", "B", 2.0, "x"), ("2024-02-01", "A", 3.0, "x"), ("2024-03-01", "A", 4.0, "x")],
    )
    assert tables.overwrite(first, name, "date", ["date", "code"]) == 4
    return name


def test_upsert_updates_inserts_and_keeps(spark, table):
    batch = frame(spark, [("2024-01-05", "A", 9.0, "n"), ("2024-02-02", "C", 5.0, "n")]).drop("note")
    assert tables.upsert(batch, table, ["date", "code"]) == 2
    assert content(spark, table) == [
        ("2024-01-05", "A", 9.0, "x"),
        ("2024-01-05", "B", 2.0, "x"),
        ("2024-02-01", "A", 3.0, "x"),
        ("2024-02-02", "C", 5.0, None),
        ("2024-03-01", "A", 4.0, "x"),
    ]


def test_upsert_twice_changes_nothing_more(spark, table):
    batch = frame(spark, [("2024-01-05", "A", 9.0, None), ("2024-04-02", "C", 5.0, "n")])
    tables.upsert(batch, table, ["date", "code"])
    once = content(spark, table)
    tables.upsert(batch, table, ["date", "code"])
    assert content(spark, table) == once
    # A NULL in the batch is a value like any other.
    assert ("2024-01-05", "A", 9.0, None) in once


def test_upsert_leaves_other_months_alone(spark, table):
    files = lambda: {f for f in spark.table(table).filter("month = '2024-03'").inputFiles()}
    before = files()
    tables.upsert(frame(spark, [("2024-01-05", "A", 9.0, "n")]), table, ["date", "code"])
    assert files() == before
    assert [t.name for t in spark.catalog.listTables(table.split(".")[0]) if "staging" in t.name] == []


def test_upsert_refuses_two_rows_for_one_key(spark, table):
    before = content(spark, table)
    batch = frame(spark, [("2024-01-05", "A", 9.0, "n"), ("2024-01-05", "A", 8.0, "n")])
    with pytest.raises(ValueError):
        tables.upsert(batch, table, ["date", "code"])
    assert content(spark, table) == before


def test_upsert_adds_rows_without_a_key(spark, table):
    batch = frame(spark, [(None, "A", 7.0, "n"), (None, "A", 8.0, "n"), ("2024-01-05", None, 6.0, "n")])
    assert tables.upsert(batch, table, ["date", "code"]) == 3
    tables.upsert(frame(spark, [(None, "A", 7.0, "n")]), table, ["date", "code"])
    rows = content(spark, table)
    assert len(rows) == 8
    assert sum(r[0] == "None" for r in rows) == 3 and ("2024-01-05", None, 6.0, "n") in rows


def test_upsert_with_only_keys_updates_nothing(spark, table):
    before = content(spark, table)
    tables.upsert(frame(spark, [("2024-01-05", "A", 0.0, "n")]).select("date", "code"), table, ["date", "code"])
    assert content(spark, table) == before


def test_upsert_creates_a_missing_table_and_skips_an_empty_batch(spark, database):
    name = f"{database}.fresh"
    assert tables.upsert(frame(spark, []), name, ["date", "code"]) == 0
    assert not tables.table_exists(spark, name)
    assert tables.upsert(frame(spark, [("2024-01-05", "A", 1.0, "x")]), name, ["date", "code"]) == 1
    assert tables.is_by_month(spark, name)


def test_decimal_targets_take_null_where_a_value_does_not_fit(spark, database):
    name = f"{database}.dec"
    spark.sql(f"CREATE TABLE {name} (date DATE, code STRING, v DECIMAL(5, 2), month STRING) USING parquet PARTITIONED BY (month)")
    batch = spark.createDataFrame([(date(2024, 1, 5), "A", 12.345), (date(2024, 1, 5), "B", 12345.0)], "date date, code string, v double")
    tables.upsert(batch, name, ["date", "code"], match_types=True)
    assert {r.code: r.v and float(r.v) for r in spark.table(name).collect()} == {"A": 12.35, "B": None}


def test_append_skips_empty_and_counts(spark, table):
    assert tables.append(frame(spark, []), table, "date") == 0
    assert tables.append(frame(spark, [("2024-05-01", "Z", 1.0, "n")]), table, "date", ["date", "code"]) == 1
    assert tables.row_count(spark, table) == 5


def test_latest_date_reads_the_newest_month_only(spark, table, database):
    assert tables.latest_date(spark, table) == date(2024, 3, 1)
    assert tables.latest_date(spark, f"{database}.missing") is None


def test_snapshot_twice_is_once(spark, desk, database):
    name = f"{database}.history"
    first = tables.snapshot_scores(desk.scores(), name, date(2001, 6, 30))
    assert first > 0
    assert tables.snapshot_scores(desk.scores(), name, date(2001, 6, 30)) == 0
    assert tables.snapshot_scores(desk.scores(), name, date(2001, 7, 1)) == first
    assert tables.row_count(spark, name) == 2 * first


def test_views_survive_one_failure(spark, desk):
    outcome = tables.publish_views(
        {"v_ok": lambda: desk.equity_master(), "v_bad": lambda: desk.equity_master().select("nope"), "v_late": lambda: desk.equity_master()}
    )
    assert outcome["v_ok"] == outcome["v_late"] == "ok" and outcome["v_bad"].startswith("failed")


def test_export_keeps_order_and_blanks(spark, tmp_path):
    df = spark.createDataFrame([("a", "nan", 1.5), ("b", "", None)], "code string, per string, latest_close double")
    assert export.export_table(df.orderBy("code"), str(tmp_path / "x")) == 2
    rows = export.read_export(spark, str(tmp_path / "x")).collect()
    assert [(r.code, r.per, r.latest_close) for r in rows] == [("a", None, "1.5"), ("b", None, None)]
    labelled = export.with_labels(df).orderBy("_row").collect()
    assert labelled[0]["code"] == "銘柄コード" and len(labelled) == 3


def test_failed_upsert_leaves_the_table_whole(spark, table):
    before = content(spark, table)
    poison = frame(spark, [("2024-01-05", "A", 9.0, "n")]).withColumn(
        "close", F.when(F.col("code") == "A", F.raise_error(F.lit("lost")).cast("double"))
    )
    with pytest.raises(Exception):
        tables.upsert(poison, table, ["date", "code"])
    assert content(spark, table) == before


def test_a_new_day_is_appended_without_touching_stored_files(spark, table):
    before = set(spark.table(table).inputFiles())
    tables.upsert(frame(spark, [("2024-03-02", "A", 5.0, "n")]), table, ["date", "code"])
    assert before < set(spark.table(table).inputFiles())
    assert tables.row_count(spark, table) == 5


def test_files_are_sorted_by_key_within_a_month(spark, database):
    import random

    rows = [(f"2024-01-{d:02d}", f"{c:03d}", 1.0, "x") for d in range(1, 29) for c in range(40)]
    random.Random(1).shuffle(rows)
    name = f"{database}.sorted"
    tables.overwrite(frame(spark, rows), name, "date", ["code", "date"])
    for path in spark.table(name).inputFiles():
        got = [(r.code, r.date) for r in spark.read.parquet(path).collect()]
        assert got == sorted(got)


class Lost(BaseException):
    """The driver is gone."""


def _lost_after(monkeypatch, months):
    """The swap of an upsert ends after ``months`` months are in place."""
    whole = tables._put_in_place

    def partly(spark, staging, table, keys):
        some = spark.table(staging).filter(F.col("month").isin(months) if months else F.lit(False))
        with tables._dynamic_partitions(spark):
            some.write.mode("overwrite").insertInto(table)
        raise Lost

    monkeypatch.setattr(tables, "_put_in_place", partly)
    return lambda: monkeypatch.setattr(tables, "_put_in_place", whole)


@pytest.mark.parametrize("months", [[], ["2024-01"]])
@pytest.mark.parametrize("then", ["the same batch", "another batch", "append", "recover"])
def test_an_upsert_that_breaks_between_two_months_is_finished_by_the_next_write(spark, table, monkeypatch, months, then):
    batch = frame(spark, [("2024-01-05", "A", 9.0, "n"), ("2024-02-01", "A", 8.0, "n"), (None, "Z", 7.0, "n")])
    whole_again = _lost_after(monkeypatch, months)
    with pytest.raises(Lost):
        tables.upsert(batch, table, ["date", "code"])
    whole_again()
    expected = [("2024-01-05", "A", 9.0, "n"), ("2024-01-05", "B", 2.0, "x"), ("2024-02-01", "A", 8.0, "n"), ("2024-03-01", "A", 4.0, "x"), ("None", "Z", 7.0, "n")]
    if then == "the same batch":
        tables.upsert(batch.filter("date IS NOT NULL"), table, ["date", "code"])
    elif then == "another batch":
        tables.upsert(frame(spark, [("2024-03-01", "A", 5.0, "o")]), table, ["date", "code"])
        expected[3] = ("2024-03-01", "A", 5.0, "o")
    elif then == "append":
        tables.append(frame(spark, [("2024-05-01", "Z", 1.0, "n")]), table, "date")
        expected.insert(4, ("2024-05-01", "Z", 1.0, "n"))
    else:
        assert tables.recover(spark, table) == 1
    assert content(spark, table) == expected
    assert tables.recover(spark, table) == 0
    assert [t.name for t in spark.catalog.listTables(table.split(".")[0]) if "staging" in t.name] == []


def test_an_upsert_that_breaks_before_its_result_is_complete_has_changed_nothing(spark, table):
    before = content(spark, table)
    spark.table(table).limit(1).write.saveAsTable(f"{table}__staging_half")
    assert tables.recover(spark, table) == 0 and content(spark, table) == before
    assert [t.name for t in spark.catalog.listTables(table.split(".")[0]) if "staging" in t.name] == []


@pytest.mark.parametrize("lost", [False, True])
def test_months_are_joined_and_put_in_place_in_rounds(spark, table, monkeypatch, lost):
    monkeypatch.setattr(tables, "ROUND_ROWS", 4)
    joins, writes = [], []
    merged, dealt = tables.merged, tables._dealt
    monkeypatch.setattr(tables, "merged", lambda target, source, keys: joins.append((target.count(), source.count())) or merged(target, source, keys))
    monkeypatch.setattr(tables, "_dealt", lambda df, *a: writes.append(df.count()) or dealt(df, *a))
    tables.append(frame(spark, [(None, "Y", 6.0, "x")]), table, "date")
    batch = frame(spark, [("2024-01-05", "A", 9.0, "n"), ("2024-02-01", "A", 8.0, "n"), ("2024-04-30", "A", 7.0, "n"), (None, "Z", 7.0, "n"), ("2024-01-31", "C", 6.0, "n")])
    writes.clear()
    if lost:
        whole_again = _lost_after(monkeypatch, ["2024-01"])
        with pytest.raises(Lost):
            tables.upsert(batch, table, ["date", "code"])
        whole_again()
        assert tables.recover(spark, table) == 1
    else:
        assert tables.upsert(batch, table, ["date", "code"]) == 5
    assert joins == [(3, 3), (1, 2)]  # January and the undated rows; February and April
    assert writes == [2, 4, 1]  # the undated rows; January and February; April
    assert content(spark, table) == [
        ("2024-01-05", "A", 9.0, "n"),
        ("2024-01-05", "B", 2.0, "x"),
        ("2024-01-31", "C", 6.0, "n"),
        ("2024-02-01", "A", 8.0, "n"),
        ("2024-03-01", "A", 4.0, "x"),
        ("2024-04-30", "A", 7.0, "n"),
        ("None", "Y", 6.0, "x"),
        ("None", "Z", 7.0, "n"),
    ]
    assert [t.name for t in spark.catalog.listTables(table.split(".")[0]) if "staging" in t.name] == []


def test_a_table_without_months_is_put_in_place_again(spark, database, monkeypatch):
    name = f"{database}.plain"
    rows = spark.createDataFrame([("A", 1), ("B", 2)], "code string, n int")
    tables.upsert(rows, name, ["code"])
    whole = tables._put_in_place
    monkeypatch.setattr(tables, "_put_in_place", lambda *a: (_ for _ in ()).throw(Lost()))
    with pytest.raises(Lost):
        tables.upsert(rows.filter("code = 'A'").withColumn("n", F.lit(5)), name, ["code"])
    monkeypatch.setattr(tables, "_put_in_place", whole)
    assert tables.recover(spark, name) == 1
    assert sorted(tuple(r) for r in spark.table(name).collect()) == [("A", 5), ("B", 2)]


def test_a_new_table_refuses_two_rows_for_one_key(spark, database):
    batch = frame(spark, [("2024-01-05", "A", 9.0, "n"), ("2024-01-05", "A", 8.0, "n")])
    with pytest.raises(ValueError):
        tables.upsert(batch, f"{database}.fresh", ["date", "code"])
    assert not tables.table_exists(spark, f"{database}.fresh")


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_series_are_read_without_an_exchange_and_kept_by_every_write(spark, database):
    """Created, upserted, appended and overwritten; then windows and joins by code find the rows of a code in one task."""
    from equiscan.operators.windows import Slide, series, sliding

    name, b = f"{database}.bars", tables.Buckets("code", 4)
    day = lambda i: str(date.fromordinal(date(2024, 1, 1).toordinal() + i))
    bars = frame(spark, [(day(i), f"c{c}", float(i * c), "x") for i in range(80) for c in range(9)])
    assert tables.upsert(bars, name, ["date", "code"], buckets=b) == 720
    assert tables.buckets_of(spark, name) == b
    changed = frame(spark, [(day(40), "c1", -1.0, "n"), (day(41), "new", 1.0, "n"), (None, "c1", 2.0, "u")])
    assert tables.upsert(changed, name, ["date", "code"]) == 3
    assert tables.append(frame(spark, [(day(200), f"c{c}", 1.0, "x") for c in range(9)]), name, "date") == 9
    assert tables.buckets_of(spark, name) == b
    stored = spark.table(name)
    assert stored.count() == 731 and stored.filter("close = -1").count() == 1

    slid = sliding(stored.select("code", "date", "close"), {"m": Slide("avg", "close", 20)})
    text = plan_of(slid)
    assert "Exchange" not in text and "Bucketed: true" in text
    plain = {(r.code, r.date): r.m for r in sliding(spark.createDataFrame(stored.select("code", "date", "close").collect()), {"m": Slide("avg", "close", 20)}).collect()}
    assert {(r.code, r.date): r.m for r in slid.collect()} == plain
    lagged = stored.filter("month >= '2024-02'").select("code", "date", F.lag("close").over(series()).alias("p"))
    assert "Exchange" not in plan_of(lagged)
    # Files of a month: no more than its buckets, though several tasks wrote it.
    files = [f for f in stored.filter("month = '2024-01'").inputFiles()]
    assert len(files) <= 4
    assert tables.overwrite(bars, name, "date", ["date", "code"]) == 720 and tables.buckets_of(spark, name) == b
    assert "Exchange" not in plan_of(sliding(spark.table(name).select("code", "date", "close"), {"m": Slide("max", "close", 5)}))
