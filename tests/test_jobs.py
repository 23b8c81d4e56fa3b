from datetime import date

import pytest
from pyspark.sql import functions as F

from equiscan import schemas
from equiscan.operators.columns import missing_columns, rename_map, unknown_columns
from equiscan.plans import jobs
from equiscan.sinks import tables
from equiscan.sources import readers


def text(spark, columns, *rows):
    return spark.createDataFrame(list(rows), ", ".join(f"`{c}` string" for c in columns))


def first(df):
    return df.collect()[0].asDict()


def test_financial_map_covers_107_columns():
    assert len(schemas.FINANCIAL_SUMMARY) == len(set(schemas.FINANCIAL_SUMMARY.values())) == 107
    assert set(schemas.FINANCIAL_DATES) | set(schemas.FINANCIAL_TEXTS) <= set(schemas.FINANCIAL_SUMMARY.values())


def test_rename_keeps_map_order_and_first_duplicate(spark):
    df = text(spark, ["CompanyName", "CoName", "Code", "Extra"], ("old", "new", "1301", "x"))
    out = rename_map(df, schemas.EQUITY_MASTER)
    assert out.columns == ["code", "company_name"] and first(out)["company_name"] == "old"
    assert unknown_columns(df, schemas.EQUITY_MASTER) == ["Extra"]
    assert missing_columns(out, ("code", "date")) == ["date"]


def test_equity_master_old_and_new_names_agree(spark):
    spec = jobs.DATASETS["equity_master"]
    new = text(spark, ["Code", "CoName", "MktNm"], ("130", "n", "プライム"))
    old = text(spark, ["Code", "CompanyName", "MarketCodeName"], ("130", "n", "プライム"))
    assert first(jobs.normalise(new, spec)) == first(jobs.normalise(old, spec)) == {
        "code": "00130", "company_name": "n", "market_name": "プライム",
    }


def test_codes_longer_than_five_are_kept(spark):
    df = text(spark, ["Code"], ("1234567",))
    assert first(jobs.normalise(df, jobs.DATASETS["equity_master"]))["code"] == "1234567"


def test_daily_bars_coercion(spark):
    df = text(spark, ["Date", "Code", "O", "H", "L", "C", "Vo", "Va"], ("2024-01-05", "1301", "1", "NaN", "x", "2.5", "", "1e3"))
    row = first(jobs.normalise(df, jobs.DATASETS["daily_bars"]))
    assert row == {
        "date": date(2024, 1, 5), "code": "01301", "open": 1.0, "high": None, "low": None, "close": 2.5,
        "volume": 0, "turnover_value": 1000.0,
    }


def test_long_names_only_apply_without_the_short_open(spark):
    spec = jobs.DATASETS["daily_bars"]
    df = text(spark, ["Date", "Code", "Open", "AdjustmentVolume"], ("2024-01-05", "13010", "5", "7.9"))
    assert first(jobs.normalise(df, spec)) == {"date": date(2024, 1, 5), "code": "13010", "open": 5.0, "adjustment_volume": 7}


def test_unreadable_dates_fail_where_they_must_and_pass_where_they_may(spark):
    bars = text(spark, ["Date", "Code", "O"], ("soon", "1301", "1"))
    with pytest.raises(Exception, match="unreadable date"):
        jobs.normalise(bars, jobs.DATASETS["daily_bars"]).collect()
    fin = text(spark, ["DiscDate", "Code", "DocType", "CurFYEn", "Sales"], ("20240105", "1301", "FY", "soon", "-"))
    row = first(jobs.normalise(fin, jobs.DATASETS["financial_summary"]))
    assert (row["disclosed_date"], row["current_fy_end"], row["net_sales"]) == (date(2024, 1, 5), None, None)


def test_missing_key_skips_the_batch(spark, database):
    df = text(spark, ["Date", "SellExShortVa"], ("2024-01-05", "1"))
    assert jobs.normalise(df, jobs.DATASETS["short_selling"]) is None
    assert jobs.run(df, jobs.DATASETS["short_selling"], f"{database}.s") == 0
    assert not tables.table_exists(spark, f"{database}.s")


@pytest.mark.parametrize(
    "name, long_names, short_names",
    [
        ("margin_interest", ["Date", "Code", "LongMarginTradeVolume"], ["Date", "Code", "LongVol"]),
        ("short_selling", ["Date", "Sector33Code", "SellingValue"], ["Date", "S33", "SellExShortVa"]),
        ("indices", ["Date", "IndexCode", "Close"], ["Date", "Code", "C"]),
    ],
)
def test_old_and_new_names(spark, name, long_names, short_names):
    spec = jobs.DATASETS[name]
    values = ("2024-01-05", "12345", "7")
    assert first(jobs.normalise(text(spark, long_names, values), spec)) == first(
        jobs.normalise(text(spark, short_names, values), spec)
    )


def test_topix_gets_its_code(spark):
    row = first(jobs.normalise(text(spark, ["Date", "Close"], ("2024-01-05", "7")), jobs.DATASETS["topix"]))
    assert row == {"date": date(2024, 1, 5), "close": 7.0, "index_code": "0000"}


def test_index_options_without_division_get_a_blank_one(spark):
    df = text(spark, ["Date", "Code", "C"], ("2024-01-05", "1", "7"))
    assert first(jobs.normalise(df, jobs.DATASETS["index_options"]))["em_mrgn_trg_div"] == ""


def test_first_record_of_a_key_wins(spark):
    df = spark.createDataFrame(
        [("2024-01-05", "1", "b", 2), ("2024-01-05", "1", "a", 1), ("2024-01-05", "2", "c", 3)],
        f"Date string, Code string, C string, {jobs.SEQUENCE} int",
    ).withColumn("C", F.when(F.col("C") == "a", "1").otherwise("2"))
    out = jobs.normalise(df, jobs.DATASETS["indices"])
    assert {r.index_code: r.close for r in out.collect()} == {"1": 1.0, "2": 2.0}


def test_daily_margin_reason_is_flattened(spark):
    df = spark.createDataFrame(
        [("2024-01-05", "1301", "2024-01-04", None, ("1", None)), ("2024-01-05", "1302", "2024-01-04", "*", None)],
        "PubDate string, Code string, AppDate string, ShrtOutRatio string, PubReason struct<Restricted string, Monitoring string>",
    )
    rows = {r.code: r for r in jobs.normalise(df, jobs.DATASETS["daily_margin_interest"]).collect()}
    assert set(schemas.PUB_REASON.values()) <= set(rows["1301"].asDict())
    assert (rows["1301"].pub_reason_restricted, rows["1301"].pub_reason_monitoring) == ("1", "")
    assert (rows["1302"].pub_reason_restricted, rows["1302"].shrt_out_ratio, rows["1301"].shrt_out_ratio) == ("", "*", "")


def test_groups_count_failures_as_zero_unless_required(spark, database):
    def broken():
        raise RuntimeError("lost")

    margin = lambda: text(spark, ["Date", "Code", "LongVol"], ("2024-01-05", "1301", "1"))
    log = jobs.run_group(spark, "weekly", {"margin_interest": margin, "investor_types": broken}, database)
    assert {r.dataset: r.rows for r in log.collect()} == {"margin_interest": 1, "investor_types": 0, "total": 1}
    with pytest.raises(RuntimeError):
        jobs.run_group(spark, "weekly", {"margin_interest": broken, "investor_types": margin}, database)


def test_empty_backfill_range(spark, database):
    df = text(spark, ["Date", "Code", "O"], ("2024-01-05", "1301", "1"))
    spec = jobs.DATASETS["daily_bars"]
    assert jobs.backfill(df, spec, f"{database}.b", date(2024, 2, 1), date(2024, 1, 1)) == 0
    assert jobs.backfill(df, spec, f"{database}.b", date(2024, 1, 1), date(2024, 1, 31)) == 1


def test_pages_and_gzip_files(spark, tmp_path):
    import gzip

    (tmp_path / "p1.json").write_text('{"data": [{"Code": "1301", "C": 5}, {"Code": "1302"}], "pagination_key": "k"}')
    (tmp_path / "p2.json").write_text('{\n "data": [\n {"Code": "1303", "C": 6.5}\n ]}')
    record = text(spark, ["Code", "C"], ("a", "b")).schema
    rows = {r.Code: r.C for r in readers.read_pages(spark, f"{tmp_path}/*.json", record).collect()}
    assert rows == {"1301": "5", "1302": None, "1303": "6.5"}
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("Code,C\n1301,5\n")
    (tmp_path / "b.csv.gz").write_bytes(b"not a gzip file")
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(b"Code,C\n" + b"1,2\n" * 50_000)[:-20])
    (tmp_path / "d.csv").write_text("\ufeffC,Code,New\n7,1304,x\n")
    load = readers.read_bulk_csv(spark, [f"{tmp_path}/{n}" for n in ("a.csv.gz", "b.csv.gz", "c.csv.gz", "d.csv")])
    assert sorted((r.Code, r.C) for f in load.frames for r in f.collect()) == [("1301", "5"), ("1304", "7")]
    assert [p.rsplit("/", 1)[1] for p, _ in load.skipped] == ["b.csv.gz", "c.csv.gz"] and all(cause for _, cause in load.skipped)


def test_a_short_load_does_not_cost_a_later_day_its_columns(spark, database):
    spec, table = jobs.DATASETS["daily_bars"], f"{database}.daily_bars"
    jobs.setup(spark, database)
    jobs.run_bulk(text(spark, ["Date", "Code", "O", "C"], ("2024-01-05", "1301", "1", "2")), spec, table)
    long_day = text(spark, ["Date", "Code", "Open", "Close", "AdjustmentFactor", "AdjustmentClose"], ("2024-01-09", "1301", "1", "2", "0.5", "1"))
    assert jobs.run(long_day, spec, table) == 1
    row = spark.table(table).filter("date = DATE '2024-01-09'").first()
    assert (row.adjustment_factor, row.adjustment_close) == (0.5, 1.0)
    with pytest.raises(ValueError):
        jobs.tables.append(spark.table(table).drop("month").withColumn("odd", F.lit(1)), table, "date")


def test_one_bad_day_does_not_stop_a_backfill(spark, database):
    df = text(spark, ["Date", "Code", "O"], ("2024-01-05", "1301", "1"), ("2024-13-05", "1301", "2"), ("2024-01-09", "1301", "3"))
    assert jobs.backfill(df, jobs.DATASETS["daily_bars"], f"{database}.b", date(2024, 1, 1), date(2024, 1, 31)) == 2


def test_required_dataset_without_its_key_stops_the_run(spark, database):
    keyless = lambda: text(spark, ["Date", "LongVol"], ("2024-01-05", "1"))
    with pytest.raises(jobs.MissingKeys):
        jobs.run_group(spark, "weekly", {"margin_interest": keyless, "investor_types": keyless}, database)


def test_setup_creates_every_raw_table_once(spark, database):
    assert jobs.setup(spark, database) == jobs.setup(spark, database) == len(jobs.DATASETS)
    names = {t.name for t in spark.catalog.listTables(database)}
    assert {"equity_master", "daily_bars", "index_bars", "daily_margin_interest"} <= names
    assert len(spark.table(f"{database}.financial_summary").columns) == 108
    df = text(spark, ["Date", "Code", "O"], ("2024-01-05", "1301", "1"))
    assert jobs.run(df, jobs.DATASETS["daily_bars"], f"{database}.daily_bars") == 1
    row = spark.table(f"{database}.daily_bars").first()
    assert (row.code, row.open, row.close, row.month) == ("01301", 1.0, None, "2024-01")
    assert jobs.run(df.withColumn("O", F.lit("2")), jobs.DATASETS["daily_bars"], f"{database}.daily_bars") == 1
    assert [r.open for r in spark.table(f"{database}.daily_bars").collect()] == [2.0]
