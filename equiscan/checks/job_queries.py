"""Sources, sinks, dataset jobs and catch-up, run against scratch tables in the shared folder."""

from __future__ import annotations

import gzip
import itertools
import uuid
from collections.abc import Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiscan import schemas
from equiscan.checks.ctes import AS_OF as AS_OF_SQL
from equiscan.checks.ctes import r
from equiscan.checks.registry import query, rounded
from equiscan.operators import columns, windows
from equiscan.plans import indicators, jobs, reports
from equiscan.session import run_root
from equiscan.sinks import export, tables
from equiscan.sources import landed, ledger, readers
from equiscan.sources.derived import AS_OF
from equiscan.streaming import catchup

_numbers = itertools.count()
SPLIT = date(2001, 6, 1)
BAR_COLUMNS = ["date", "code", "open", "high", "low", "close", "volume", "turnover_value"]


def scratch_database(d) -> str:
    """A database of its own for every query run, stored below the shared folder."""
    name = f"equiscan_{next(_numbers)}_{uuid.uuid4().hex[:8]}"
    tables.create_database(d.spark, name, f"{run_root(d.spark)}/{name}")
    return name


def scratch_table(d, name: str) -> str:
    return f"{scratch_database(d)}.{name}"


def scratch_path(d, name: str) -> str:
    return f"{run_root(d.spark)}/files-{next(_numbers)}-{name}"


def stored(d, table: str) -> DataFrame:
    df = d.spark.table(table)
    return df.drop("month") if "month" in df.columns else df


def all_text(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in df.columns])


def nums(names: list[str] | tuple[str, ...], digits: int = 4) -> str:
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names)


BARS_SQL = f"SELECT date, code, {nums(('open', 'high', 'low', 'close'))}, volume, turnover_value FROM daily_bars"

def write_pages(records: DataFrame, path: str) -> None:
    """Pages of up to 1,000 records each, as an API delivers them: more records make more pages, not longer ones.

    A page holds records that follow each other in a task, so none of them moves; a file, packed with gzip, holds
    up to 300 pages.
    """
    size = 1000

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def page(rows: pa.StructArray, at: range) -> pa.RecordBatch:
            offsets = pa.array([*at, len(rows)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, rows)], ["data"])

        held = None
        for batch in batches:
            rows = batch.to_struct_array()
            held = pa.concat_arrays([held, rows]) if held is not None else rows
            if whole := len(held) // size * size:
                yield page(held[:whole], range(0, whole, size))
                held = held[whole:]
        if held is not None and len(held):
            yield page(held, range(1))

    shape = T.StructType([T.StructField("data", T.ArrayType(records.schema))])
    paged = records.mapInArrow(pages, shape).select("data", F.lit("next").alias("pagination_key"))
    paged.write.option("maxRecordsPerFile", 300).json(path, compression="gzip")


# ---- 2.1 sources -------------------------------------------------------------------------------


@query(
    "src_json",
    f"SELECT {AS_OF_SQL} AS as_of, code, company_name FROM equity_master",
)
def _(d):
    """Pages are written, then read back as one table."""
    records = landed.equity_master(d).select("Code", "CoName")
    path = scratch_path(d, "pages")
    write_pages(records, path)
    rows = readers.read_pages(d.spark, path, all_text(records))
    spec = jobs.DATASETS["equity_master"]
    return jobs.normalise(rows, spec).select(F.lit(AS_OF).alias("as_of"), "code", "company_name")


def gzip_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).option("compression", "gzip").csv(path)


def put_file(d, path: str, content: bytes) -> None:
    """A file in the shared folder, whatever file system that is."""
    where = d.spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(d.spark._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(content))
    out.close()


@query(
    "src_csv_gz",
    BARS_SQL.replace("volume, turnover_value", """CASE WHEN day(date) = 13 AND part <> 3 THEN 0 ELSE volume END AS volume,
      CASE WHEN part <> 1 THEN turnover_value END AS turnover_value""").replace(
        "FROM daily_bars", "FROM (SELECT *, CAST(code AS BIGINT) // 10 % 5 AS part FROM daily_bars)"
    ),
)
def _(d):
    """Five headers in one folder: as specified, a column missing, reordered, the old spelling, a column more. A sixth file
    ends before its end and is left out whole."""
    short, old, path = landed.daily_bars(d), landed.daily_bars_long(d), scratch_path(d, "bulk")
    part = F.floor(F.col("Code").cast("long") / 10) % 5
    layouts = [short, short.drop("Va"), short.select(*reversed(short.columns)), old, short.withColumn("Extra", F.lit("x"))]
    for i, rows in enumerate(layouts):
        gzip_csv(rows.filter(part == i), path)
    damaged = gzip.compress("Date,Code,O\n".encode() + "".join(f"2001-06-{i % 30 + 1:02d},{i},1\n" for i in range(5000)).encode())
    put_file(d, f"{path}/damaged.csv.gz", damaged[: len(damaged) // 2])
    load = readers.read_bulk_csv(d.spark, path)
    if [p.rsplit("/", 1)[1] for p, _ in load.skipped] != ["damaged.csv.gz"]:
        raise ValueError(f"skipped {load.skipped}")
    return rounded(jobs.normalise(load.frames, jobs.DATASETS["daily_bars"])).select(*BAR_COLUMNS)


@query(
    "src_date_slice",
    "SELECT date, code, close FROM daily_bars WHERE date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'",
)
def _(d):
    return readers.read_slice(d.daily_bars(), date(2000, 1, 1), date(2000, 12, 31)).select("date", "code", "close")


@query("src_ledger", "SELECT trade_date, code, company_name, account_type, quantity, unit_price, amount FROM ledger_domestic")
def _(d):
    """Sheets of up to 5,000 trades each as text files: title rows, header, an empty row and the data.

    Every second sheet has its columns in another order, and one more whose cells hold a comma and a line break.
    """
    rows = d.ledger_rows("domestic").withColumn("メモ", F.lit('"one, two\nthree"'))
    path = scratch_path(d, "sheets")
    place = F.floor(F.monotonically_increasing_id() / 5000)
    for layout, names in enumerate((rows.columns[:-1], rows.columns[::-1])):
        numbered = rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(2)) == layout).select(
            place.alias("sheet"), F.lit(9).alias("place"), F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in names]).alias("value")
        )
        titles = ["更新日", "2001/6/30,https://example.org", ",".join(names), "," * (len(names) - 1)]
        top = numbered.select("sheet").distinct().select(
            "sheet", F.posexplode(F.array(*[F.lit(t) for t in titles])).alias("place", "value")
        )
        sheets = top.unionByName(numbered).repartition("sheet").sortWithinPartitions("sheet", "place")
        sheets.select("sheet", "value").write.mode("append").partitionBy("sheet").text(path)
    return ledger.ledger_domestic(ledger.read_ledger(d.spark, path)).select(
        "trade_date", "code", "company_name", "account_type", "quantity", "unit_price", "amount"
    )


@query("src_table", "SELECT code, company_name, sector33_name, market_name FROM equity_master")
def _(d):
    table = scratch_table(d, "equity_master")
    tables.overwrite(d.equity_master(), table)
    return readers.read_table(d.spark, table)


# ---- 2.2 sinks ---------------------------------------------------------------------------------


def _bars(d) -> DataFrame:
    return d.daily_bars().drop("month").select(*BAR_COLUMNS)


@query("sink_append", BARS_SQL)
def _(d):
    table = scratch_table(d, "bars")
    bars = _bars(d)
    tables.append(bars.filter(F.col("date") < F.lit(SPLIT)), table, "date", ["code", "date"])
    tables.append(bars.filter(F.col("date") >= F.lit(SPLIT)), table, "date", ["code", "date"])
    tables.append(bars.filter(F.lit(False)), table, "date", ["code", "date"])
    return rounded(stored(d, table))


@query("sink_overwrite", "SELECT code, company_name, sector33_name, market_name FROM equity_master")
def _(d):
    table = scratch_table(d, "master")
    tables.overwrite(d.equity_master().withColumn("market_name", F.lit("old")), table)
    tables.overwrite(d.equity_master(), table)
    return stored(d, table)


@query("sink_first_overwrite_then_append", BARS_SQL)
def _(d):
    table = scratch_table(d, "bars")
    tables.load_files(_bars(d).withColumn("close", F.lit(0.0)), table, "date", ["code", "date"])
    tables.load_files(_bars(d), table, "date", ["code", "date"])
    return rounded(stored(d, table))


def _upserted(d, match_types: bool = False) -> str:
    """Bars up to the split with an audit column, then a batch of changed June bars and all later ones."""
    table = scratch_table(d, "bars")
    bars = _bars(d)
    old = bars.filter(F.col("date") < F.lit(SPLIT + timedelta(days=10))).withColumn("note", F.lit("old"))
    tables.overwrite(old, table, "date", ["date", "code"])
    batch = bars.filter(F.col("date") >= F.lit(SPLIT)).withColumn("close", F.col("close") + 1)
    tables.upsert(batch, table, ["date", "code"], match_types)
    return table


UPSERT_SQL = f"""
    SELECT date, code, {r("CASE WHEN date >= DATE '2001-06-01' THEN close + 1 ELSE close END", 4)} AS close, volume,
           CASE WHEN date < DATE '2001-06-11' THEN 'old' END AS note
    FROM daily_bars"""


@query("upsert", UPSERT_SQL)
def _(d):
    return rounded(stored(d, _upserted(d)).select("date", "code", "close", "volume", "note"))


@query(
    "upsert_safe_cast",
    "SELECT code, disclosed_date, CAST(net_sales AS DECIMAL(38, 9)) AS net_sales, CAST(NULL AS DECIMAL(9, 2)) AS too_big FROM financial_summary",
)
def _(d):
    target = T.StructType(
        [T.StructField("net_sales", T.DecimalType(38, 9)), T.StructField("too_big", T.DecimalType(9, 2))]
    )
    rows = d.financial_summary().select(
        "code", "disclosed_date", "net_sales", (F.col("net_sales") * 1e6 + 1e9).alias("too_big")
    )
    return tables.safe_cast_to(rows, target)


@query(
    "upsert_partition_bound",
    f"SELECT code, date, {r('close', 4)} AS close FROM daily_bars WHERE date BETWEEN DATE '2001-06-01' AND DATE '2001-06-30'",
)
def _(d):
    batch = _bars(d).filter(F.col("date") >= F.lit(SPLIT))
    profile = tables.profile_batch(batch, ["date", "code"], "date")
    return rounded(tables.bounded_target(d.daily_bars(), "date", profile.bounds).select("code", "date", "close"))


@query("latest_date", "SELECT max(date) AS latest FROM daily_bars")
def _(d):
    table = scratch_table(d, "bars")
    tables.overwrite(_bars(d), table, "date", ["code", "date"])
    return d.spark.range(1).select(F.lit(tables.latest_date(d.spark, table)).alias("latest"))


@query("row_count", "SELECT count(*) AS n FROM daily_bars")
def _(d):
    return d.daily_bars().agg(F.count("*").alias("n"))


@query("table_exists", "SELECT count(*) > 0 AS present, count(*) < 0 AS absent FROM equity_master")
def _(d):
    table = scratch_table(d, "master")
    tables.overwrite(d.equity_master(), table)
    spark = d.spark
    present, absent = tables.table_exists(spark, table), tables.table_exists(spark, f"{table}_other")
    filled = F.count("*") > 0
    return spark.table(table).agg((filled & present).alias("present"), (filled & absent).alias("absent"))


@query(
    "create_if_missing",
    "SELECT fetch_date, ticker, asset_name, asset_type, price_original, currency, usdjpy_rate, price_jpy FROM external_prices",
)
def _(d):
    database = scratch_database(d)
    for _ in range(2):
        jobs.setup_namespaces(d.spark, dict.fromkeys(schemas.DATABASES, database))
    tables.append(d.external_prices(), f"{database}.external_prices")
    return d.spark.table(f"{database}.external_prices")


@query(
    "publish_views",
    "SELECT l.code, l.liquidity_grade, v.volatility_score FROM liquidity l JOIN volatility v ON v.code = l.code",
)
def _(d):
    prefix = f"equiscan_view_{next(_numbers)}"

    def broken():
        return d.daily_bars().select("no_such_column")

    tables.publish_views(
        {
            f"{prefix}_liquidity": lambda: indicators.liquidity(d.daily_bars(), AS_OF),
            f"{prefix}_broken": broken,
            f"{prefix}_volatility": lambda: indicators.volatility(d.daily_bars(), AS_OF),
        }
    )
    left, right = d.spark.table(f"{prefix}_liquidity"), d.spark.table(f"{prefix}_volatility")
    return left.select("code", "liquidity_grade").join(right.select("code", "volatility_score"), "code")


SNAPSHOT_SQL = f"""
    SELECT snapshot_date, {", ".join(tables.SNAPSHOT_COLUMNS)}
    FROM score_history WHERE snapshot_date = DATE '2001-06-30'"""


@query("snapshot_scores", SNAPSHOT_SQL)
def _(d):
    table = scratch_table(d, "score_history")
    tables.snapshot_scores(d.scores(), table, AS_OF)
    tables.snapshot_scores(d.scores(), table, AS_OF)
    return stored(d, table)


@query(
    "cache_ranking",
    "SELECT code, market_segment AS market_name, kubota_trade_score, growth_invest_score, kubota_signal, price_strength_score FROM integrated",
)
def _(d):
    table = scratch_table(d, "cache_integrated_ranking")
    tables.overwrite(reports.cached_ranking(d.scores()), table)
    return d.spark.table(table).select(
        "code", "market_name", "kubota_trade_score", "growth_invest_score", "kubota_signal", "price_strength_score"
    )


@query("cache_market", "SELECT * FROM market_environment")
def _(d):
    table = scratch_table(d, "cache_market_condition")
    tables.overwrite(indicators.market_environment(d.index_bars(), AS_OF), table)
    return d.spark.table(table)


@query("export_table", "SELECT code, kubota_signal, CAST(kubota_trade_score AS VARCHAR) AS kubota_trade_score FROM integrated WHERE kubota_signal <> '-'")
def _(d):
    path = scratch_path(d, "export")
    export.export_table(reports.signals(d.scores()), path)
    return export.read_export(d.spark, path).select("code", "kubota_signal", "kubota_trade_score")


@query(
    "export_log",
    f"""SELECT {AS_OF_SQL} AS run_date, (SELECT least(count(*), 200) FROM integrated WHERE screening_status = 'ACTIVE') AS screening,
           (SELECT count(*) FROM integrated WHERE kubota_signal <> '-') AS signals, CAST(-1 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS optional""",
)
def _(d):
    def broken():
        return d.daily_bars().select("no_such_column")

    results = export.export_all(
        {
            "screening": lambda: reports.screening(d.scores()),
            "signals": lambda: reports.signals(d.scores()),
            "broken": broken,
            "optional": broken,
        },
        scratch_path(d, "exports"),
        optional=("optional",),
    )
    table = scratch_table(d, "export_log")
    export.export_log(d.spark, results, AS_OF, table)
    return d.spark.table(table)


# ---- 2.3 columns -------------------------------------------------------------------------------


@query("rename_map", "SELECT code, company_name, CAST(n_nationkey AS VARCHAR) AS sector33_code FROM (SELECT CAST(s_suppkey * 10 AS VARCHAR) AS code, s_name AS company_name, n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)")
def _(d):
    """Old and new spellings in one input: the first one met counts."""
    rows = landed.equity_master(d).withColumn("CompanyName", F.lit("old"))
    return columns.rename_map(rows.select("Code", "CoName", "CompanyName", "S33"), schemas.EQUITY_MASTER)


@query("unknown_columns", "SELECT 'NewField' AS name, count(*) AS n FROM financial_summary")
def _(d):
    rows = landed.financial_summary(d)
    unknown = columns.unknown_columns(rows, schemas.FINANCIAL_SUMMARY)
    counted = rows.agg(*[F.count(c).alias(c) for c in unknown])
    return counted.unpivot([], unknown, "name", "n")


@query("required_columns", "SELECT CAST(count(*) AS BIGINT) AS kept, CAST(0 AS BIGINT) AS skipped FROM financial_summary")
def _(d):
    rows = landed.financial_summary(d)
    spec = jobs.DATASETS["financial_summary"]
    skipped = 0 if jobs.normalise(rows.drop("DocType"), spec) is None else rows.count()
    return jobs.normalise(rows, spec).agg(F.count("*").alias("kept"), F.lit(skipped).cast("bigint").alias("skipped"))


@query(
    "drop_duplicates",
    """SELECT disc_date, code, ss_name, fund_name, k FROM (
      SELECT CAST(o_orderdate AS DATE) AS disc_date, CAST(CAST(floor(o_custkey / 15) AS BIGINT) * 10 AS VARCHAR) AS code,
             concat('Holder ', o_orderpriority) AS ss_name, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS fund_name,
             o_orderkey AS k, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE), CAST(floor(o_custkey / 15) AS BIGINT),
               o_orderpriority, o_orderstatus ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def _(d):
    from equiscan.functions import fill_blank
    from equiscan.operators.ranking import first_per_key

    rows = landed.short_sale_report(d).select(
        F.col("DiscDate").cast("date").alias("disc_date"), F.col("Code").alias("code"), F.col("SSName").alias("ss_name"),
        fill_blank("FundName").alias("fund_name"), F.col(jobs.SEQUENCE).alias("k"), F.col(jobs.SEQUENCE).alias("_o"),
    )
    return first_per_key(rows, ["disc_date", "code", "ss_name", "fund_name"], "_o").drop("_o")


@query("union_days", "SELECT index_code, date, close FROM index_bars")
def _(d):
    """One file set per year, read back in a single multi-path scan."""
    root = scratch_path(d, "days")
    d.index_bars().select("index_code", "date", "close", F.year("date").alias("y")).write.partitionBy("y").parquet(root)
    return d.spark.read.parquet(f"{root}/y=*").select("index_code", "date", "close")


# ---- 2.15 dataset jobs -------------------------------------------------------------------------


def run_job(d, name: str, rows: DataFrame | None = None) -> DataFrame:
    """Run a job twice over the same records: an upsert must not add anything the second time."""
    spec = jobs.DATASETS[name]
    table = scratch_table(d, name)
    rows = rows if rows is not None else landed.LANDED[name](d)
    jobs.run(rows, spec, table)
    jobs.run(rows, spec, table)
    return stored(d, table)


@query(
    "job_equity_master",
    "SELECT m.code, m.company_name, CAST(n.n_nationkey AS VARCHAR) AS sector33_code, m.sector33_name, m.market_name "
    "FROM equity_master m JOIN nation n ON n.n_name = m.sector33_name",
)
def _(d):
    return run_job(d, "equity_master")


@query("job_daily_bars", BARS_SQL.replace("volume,", "CASE WHEN day(date) = 13 THEN 0 ELSE volume END AS volume,"))
def _(d):
    return rounded(run_job(d, "daily_bars")).select(*BAR_COLUMNS)


@query(
    "job_daily_bars_bulk",
    BARS_SQL.replace(", turnover_value", ", turnover_value, CAST(1 AS DOUBLE) AS adjustment_factor, "
                     f"{r('close', 4)} AS adjustment_close, CAST(0 AS BIGINT) AS adjustment_volume"),
)
def _(d):
    table, path = scratch_table(d, "daily_bars"), scratch_path(d, "bulk")
    gzip_csv(landed.daily_bars_long(d), path)
    jobs.run_bulk(readers.read_bulk_csv(d.spark, path).frames, jobs.DATASETS["daily_bars"], table)
    return rounded(stored(d, table)).select(
        *BAR_COLUMNS, "adjustment_factor", "adjustment_close", "adjustment_volume"
    )


MINUTE_SQL = f"""
    SELECT CAST(t AS DATE) AS date, CASE WHEN length(c) < 5 THEN lpad(c, 5, '0') ELSE c END AS code, strftime(t, '%H:%M') AS time,
           o AS open, h AS high, l AS low, cl AS close, n AS volume, {r('h * n', 4)} AS turnover_value
    FROM (SELECT CAST(user_id * 10 AS VARCHAR) AS c, date_trunc('minute', ts) AS t, arg_min(value, ts) AS o, max(value) AS h,
                 min(value) AS l, arg_max(value, ts) AS cl, count(*) AS n FROM events GROUP BY 1, 2)"""


@query("job_minute_bars", MINUTE_SQL)
def _(d):
    return rounded(run_job(d, "minute_bars"))


FIN_NUMBERS = [
    "net_sales", "operating_profit", "net_income", "total_assets", "equity", "equity_to_asset_ratio", "eps", "bps",
]
FIN_SQL = f"""
    SELECT disclosed_date, '15:00' AS disclosed_time, code, document_type, CAST(NULL AS DATE) AS current_period_like,
           {nums(FIN_NUMBERS)}, CASE WHEN operating_profit >= 0 THEN {r('net_sales', 4)} END AS forecast_sales
    FROM financial_summary"""


def _fin(df: DataFrame) -> DataFrame:
    return rounded(
        df.select(
            "disclosed_date", "disclosed_time", "code", "document_type",
            F.col("current_fy_end").alias("current_period_like"), *FIN_NUMBERS, "forecast_sales",
        )
    )


@query("job_financial_summary", FIN_SQL)
def _(d):
    return _fin(run_job(d, "financial_summary"))


@query("job_financial_bulk", FIN_SQL)
def _(d):
    table, path = scratch_table(d, "financial_summary"), scratch_path(d, "bulk")
    rows = landed.financial_summary(d)
    undated = rows.filter(F.col("DocType") == "AnnualRevision").withColumn("DiscDate", F.lit(None).cast("string"))
    gzip_csv(rows, path)
    gzip_csv(undated.select(*reversed(undated.columns)), path)
    jobs.run_bulk(readers.read_bulk_csv(d.spark, path).frames, jobs.DATASETS["financial_summary"], table)
    return _fin(stored(d, table))


OHLC = ("open", "high", "low", "close")


@query("job_topix", f"SELECT date, index_code, {nums(OHLC)} FROM index_bars WHERE index_code = '0000'")
def _(d):
    return rounded(run_job(d, "topix"))


@query("job_indices", f"SELECT date, index_code, {nums(OHLC)} FROM index_bars WHERE index_code <> '0000'")
def _(d):
    return rounded(run_job(d, "indices"))


OPTIONS_SQL = f"""
    SELECT d AS date, CAST(g AS VARCHAR) AS code, CASE WHEN f <> 'N' THEN f ELSE '' END AS em_mrgn_trg_div, h AS day_high,
           l AS day_low, h * 2 AS whole_day_high, iv AS implied_volatility, CAST(n AS DOUBLE) AS trading_volume,
           strftime(d, '%Y-%m') AS contract_month, CAST(k * 10 AS DOUBLE) AS strike_price,
           CASE WHEN g % 2 = 0 THEN '1' ELSE '2' END AS put_call_division, d + 30 AS last_trading_day,
           CAST(NULL AS DATE) AS special_quotation_day
    FROM (SELECT CAST(floor(l_partkey / 10) AS BIGINT) AS g, CAST(l_shipdate AS DATE) AS d, l_returnflag AS f, max(l_quantity) AS h,
                 min(l_quantity) AS l, count(*) AS n, max(l_tax) AS iv, max(l_partkey) AS k FROM lineitem GROUP BY 1, 2, 3)"""


@query("job_index_options", OPTIONS_SQL)
def _(d):
    return run_job(d, "index_options")


MARGIN_SQL = """
    SELECT friday AS date, CASE WHEN length(c) < 5 THEN lpad(c, 5, '0') ELSE c END AS code, a AS long_margin_trade_volume,
           s AS short_margin_trade_volume, neg AS long_negotiable_margin_trade_volume, std AS long_standard_margin_trade_volume,
           '2' AS issue_type
    FROM (SELECT CAST(l_suppkey * 10 AS VARCHAR) AS c, CAST(date_trunc('week', l_shipdate) AS DATE) + 4 AS friday,
                 sum(l_quantity) FILTER (l_returnflag = 'A') AS a, sum(l_quantity) FILTER (l_returnflag = 'R') AS s,
                 sum(l_quantity) FILTER (l_linestatus = 'F') AS neg, sum(l_quantity) FILTER (l_linestatus = 'O') AS std
          FROM lineitem GROUP BY 1, 2)"""


@query("job_margin_interest", MARGIN_SQL)
def _(d):
    return run_job(d, "margin_interest")


@query(
    "job_short_selling",
    """SELECT CAST(l_shipdate AS DATE) AS date, lpad(CAST(s_nationkey AS VARCHAR), 4, '0') AS sector33_code,
           sum(l_quantity) AS sell_excluding_short_value, sum(l_quantity) FILTER (l_returnflag = 'R') AS short_with_restriction_value,
           sum(l_quantity) FILTER (l_returnflag = 'A') AS short_no_restriction_value
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
)
def _(d):
    return run_job(d, "short_selling")


INVESTOR_SQL = (
    "SELECT friday + 6 AS published_date, friday - 4 AS start_date, friday AS end_date, section, "
    + ", ".join(
        f"CAST(v{i} AS DOUBLE) AS {schemas.INVESTOR_TYPES[v]}" for i, v in enumerate(landed.INVESTOR_VALUES)
    )
    + " FROM (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) + 4 AS friday, o_orderpriority AS section, "
    + ", ".join(f"count(*) FILTER (o_orderkey % 12 = {i}) AS v{i}" for i in range(12))
    + " FROM orders GROUP BY 1, 2)"
)


@query("job_investor_types", INVESTOR_SQL)
def _(d):
    return run_job(d, "investor_types")


@query(
    "job_earnings_calendar",
    "SELECT date, code, concat('Co ', code) AS company_name, CAST(year(date) AS VARCHAR) AS fiscal_year, "
    "CAST(quarter(date) AS VARCHAR) AS fiscal_quarter, CAST(NULL AS VARCHAR) AS sector_name, 'Prime' AS section, TRUE AS stamped "
    "FROM earnings_calendar",
)
def _(d):
    out = run_job(d, "earnings_calendar")
    return out.withColumn("stamped", F.col("_fetched_at").isNotNull()).drop("_fetched_at")


@query(
    "job_short_sale_report",
    """SELECT disc_date, disc_date - 2 AS calc_date, code, ss_name, '' AS ss_addr, fund_name, CAST(k % 97 AS DOUBLE) / 1000.0 AS shrt_pos_to_so,
           CAST(k % 1009 AS DOUBLE) AS shrt_pos_shares, CASE WHEN st <> 'F' THEN DATE '1999-12-31' END AS prev_rpt_date,
           CAST(NULL AS DOUBLE) AS prev_rpt_ratio
    FROM (SELECT CAST(o_orderdate AS DATE) AS disc_date, CAST(CAST(floor(o_custkey / 15) AS BIGINT) * 10 AS VARCHAR) AS code,
             concat('Holder ', o_orderpriority) AS ss_name, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS fund_name,
             o_orderkey AS k, o_orderstatus AS st,
             row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE), CAST(floor(o_custkey / 15) AS BIGINT), o_orderpriority,
               o_orderstatus ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def _(d):
    return run_job(d, "short_sale_report")


@query(
    "job_daily_margin",
    """SELECT d + 1 AS pub_date, CAST(l_suppkey * 10 AS VARCHAR) AS code, d AS app_date, q AS shrt_out,
           CASE WHEN n > 1 THEN CAST(n AS VARCHAR) ELSE '' END AS shrt_out_ratio, CAST(n AS DOUBLE) AS long_out, CAST(NULL AS DOUBLE) AS sl_ratio,
           '' AS tse_mrgn_reg_cls, CASE WHEN f = 'R' THEN '' WHEN n > 1 THEN '1' ELSE '0' END AS pub_reason_restricted,
           '' AS pub_reason_daily_publication, CASE WHEN f = 'N' THEN '1' ELSE '' END AS pub_reason_monitoring,
           '' AS pub_reason_restricted_by_jsf, '' AS pub_reason_precaution_by_jsf, '' AS pub_reason_unclear_or_sec_on_alert
    FROM (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS q, count(*) AS n, max(l_returnflag) AS f
          FROM lineitem GROUP BY 1, 2)""",
)
def _(d):
    return run_job(d, "daily_margin_interest")


@query(
    "job_trading_calendar",
    "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date, CASE WHEN isodow(l_shipdate) < 6 THEN '1' ELSE '0' END AS hol_div FROM lineitem",
)
def _(d):
    return run_job(d, "trading_calendar").drop("_fetched_at")


ROWS = {
    "equity_master": "SELECT count(*) FROM equity_master",
    "daily_bars": "SELECT count(*) FROM daily_bars",
    "minute_bars": "SELECT count(*) FROM (SELECT DISTINCT user_id, date_trunc('minute', ts) FROM events)",
    "financial_summary": "SELECT count(*) FROM financial_summary",
    "topix": "SELECT count(*) FROM index_bars WHERE index_code = '0000'",
    "indices": "SELECT count(*) FROM index_bars WHERE index_code <> '0000'",
    "margin_interest": "SELECT count(*) FROM (SELECT DISTINCT l_suppkey, date_trunc('week', l_shipdate) FROM lineitem)",
    "short_selling": "SELECT count(*) FROM (SELECT DISTINCT CAST(l_shipdate AS DATE), s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)",
    "investor_types": "SELECT count(*) FROM (SELECT DISTINCT date_trunc('week', o_orderdate), o_orderpriority FROM orders)",
    "earnings_calendar": "SELECT count(*) FROM earnings_calendar",
    "trading_calendar": "SELECT count(DISTINCT CAST(l_shipdate AS DATE)) FROM lineitem",
    "index_options": "SELECT count(*) FROM (SELECT DISTINCT floor(l_partkey / 10), CAST(l_shipdate AS DATE), l_returnflag FROM lineitem)",
    "short_sale_report": "SELECT count(*) FROM (SELECT DISTINCT CAST(o_orderdate AS DATE), floor(o_custkey / 15), o_orderpriority, o_orderstatus FROM orders)",
    "daily_margin_interest": "SELECT count(*) FROM (SELECT DISTINCT l_suppkey, CAST(l_shipdate AS DATE) FROM lineitem)",
}


def group_sql(names: list[str]) -> str:
    lines = " UNION ALL ".join(f"SELECT '{n}' AS dataset, ({ROWS[n]}) AS rows" for n in names)
    total = "SELECT 'total', CAST(sum(rows) AS BIGINT) FROM run_lines"
    return f"SELECT dataset, rows, 'ok' AS status FROM (SELECT * FROM run_lines UNION ALL {total})", {"run_lines": lines}


def run_group(d, group: str) -> DataFrame:
    frames = {n: (lambda f=f: f(d)) for n, f in landed.LANDED.items()}
    return jobs.run_group(d.spark, group, frames, scratch_database(d)).select("dataset", "rows", "status")


@query("job_init", *group_sql(jobs.INIT))
def _(d):
    return run_group(d, "init")


@query("job_daily", *group_sql(jobs.DAILY))
def _(d):
    return run_group(d, "daily")


@query("job_weekly", *group_sql(jobs.WEEKLY))
def _(d):
    return run_group(d, "weekly")


@query(
    "job_run_log",
    f"""SELECT 'margin_interest' AS dataset, ({ROWS["margin_interest"]}) AS rows, 'ok' AS status, 0 AS run, 'Odd' AS unknown
    UNION ALL SELECT 'margin_interest', ({ROWS["margin_interest"]}), 'ok', 1, 'Odd'
    UNION ALL SELECT 'investor_types', 0, 'failed', 0, '' UNION ALL SELECT 'investor_types', 0, 'skipped', 1, ''""",
)
def _(d):
    """A column without a place is named; an optional dataset that breaks or lacks its key is told apart from one without rows."""

    def broken() -> DataFrame:
        raise OSError("the feed is down")

    margin = lambda: landed.margin_interest(d).withColumn("Odd", F.lit(1))
    keyless = lambda: landed.investor_types(d).select("Section")
    logs = [
        jobs.run_group(d.spark, "weekly", {"margin_interest": margin, "investor_types": other}, scratch_database(d)).withColumn("run", F.lit(i))
        for i, other in enumerate((broken, keyless))
    ]
    log = logs[0].unionByName(logs[1]).filter("dataset <> 'total'")
    return log.select("dataset", "rows", "status", "run", F.array_join("unknown_columns", ",").alias("unknown"))


@query(
    "job_daily_cursor",
    f"""SELECT 'indices' AS dataset, run, CASE WHEN run = 0 THEN (SELECT count(*) FROM index_bars WHERE index_code <> '0000'
      AND date BETWEEN {AS_OF_SQL} - 29 AND {AS_OF_SQL} - 1) ELSE 0 END AS rows FROM (VALUES (0), (1)) r(run)
    UNION ALL SELECT 'financial_summary', run, CASE WHEN run = 0 THEN (SELECT count(*) FROM financial_summary
      WHERE disclosed_date = {AS_OF_SQL}) ELSE 0 END FROM (VALUES (0), (1)) r(run)""",
)
def _(d):
    """The daily run from folders of pages, twice: only days within reach are stored, then nothing is due. The undated row
    that is stored in between does not move the cursor."""
    database, folders = scratch_database(d), {}
    for name in ("equity_master", "daily_bars", "financial_summary", "topix", "indices"):
        folders[name] = scratch_path(d, name)
        write_pages(landed.LANDED[name](d).drop(jobs.SEQUENCE), folders[name])
    logs = []
    for run in range(2):
        log = catchup.run_landed(d.spark, "daily", folders, database, AS_OF)
        logs.append(log.filter(F.col("dataset").isin("indices", "financial_summary")).select("dataset", F.lit(run).alias("run"), "rows"))
        undated = d.spark.table(f"{database}.financial_summary").drop("month").limit(1).withColumn("disclosed_date", F.lit(None).cast("date"))
        tables.append(undated, f"{database}.financial_summary", "disclosed_date")
    return logs[0].unionByName(logs[1])


@query("first_record_wins", "SELECT CAST(NULL AS DATE) AS date, index_code, min(close) AS close FROM (SELECT index_code, CAST(0 AS DOUBLE) AS close FROM index_bars WHERE index_code <> '0000') GROUP BY index_code")
def _(d):
    """The same key in page files of two deliveries, of which the second is much larger: the first one's value counts."""
    rows = d.index_bars().filter("index_code <> '0000'").select(F.lit("2001-06-29").alias("Date"), F.col("index_code").alias("Code"))
    path = scratch_path(d, "pages")
    first = rows.distinct().withColumn("C", F.lit("0"))
    second = rows.withColumn("C", F.lit("1"))
    for place, part in (("a", first), ("b", second)):
        write_pages(part, f"{path}/{place}")
    read = readers.read_pages(d.spark, f"{path}/*")
    return jobs.normalise(read, jobs.DATASETS["indices"]).select(F.lit(None).cast("date").alias("date"), "index_code", "close")


# ---- 2.10 catch-up -----------------------------------------------------------------------------


def _latest_before(d, day: str) -> DataFrame:
    return d.index_bars().filter(F.col("date") < F.lit(day).cast("date")).agg(F.max("date").alias("latest"))


@query(
    "catchup_window",
    f"""SELECT index_code, date, close FROM index_bars WHERE date BETWEEN {AS_OF_SQL} - 29 AND {AS_OF_SQL}
      AND date > (SELECT max(date) FROM index_bars WHERE date < DATE '2001-01-15')""",
)
def _(d):
    days = catchup.due_days(_latest_before(d, "2001-01-15"), AS_OF)
    return catchup.due_records(d.index_bars(), days).select("index_code", "date", "close")


@query("weekday_filter", "SELECT code, date, close FROM daily_bars WHERE isodow(date) < 6")
def _(d):
    return d.daily_bars().filter(catchup.is_weekday("date")).select("code", "date", "close")


@query(
    "friday_grid",
    f"""SELECT index_code, date, close FROM index_bars WHERE isodow(date) = 5 AND date <= {AS_OF_SQL} - 1
      AND date > (SELECT max(date) FROM index_bars WHERE date < DATE '2001-04-01')""",
)
def _(d):
    days = catchup.due_fridays(_latest_before(d, "2001-04-01"), AS_OF)
    return catchup.due_records(d.index_bars(), days).select("index_code", "date", "close")


@query(
    "backfill_range",
    BARS_SQL.replace("volume,", "CASE WHEN day(date) = 13 THEN 0 ELSE volume END AS volume,")
    + " WHERE date BETWEEN DATE '2001-01-01' AND DATE '2001-03-31'",
)
def _(d):
    table = scratch_table(d, "daily_bars")
    spec = jobs.DATASETS["daily_bars"]
    for _ in range(2):
        jobs.backfill(landed.daily_bars(d), spec, table, date(2001, 1, 1), date(2001, 3, 31))
    return rounded(stored(d, table)).select(*BAR_COLUMNS)


@query(
    "series_buckets",
    f"SELECT code, date, {r('avg(close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)', 4)} AS ma200 FROM daily_bars",
)
def _(d):
    """Bars are loaded and one month upserted again into a table with buckets; a long mean over them needs no exchange."""
    database, spec = scratch_database(d), jobs.DATASETS["daily_bars"]
    jobs.setup(d.spark, database, buckets=8)
    table, rows = f"{database}.daily_bars", landed.daily_bars(d)
    jobs.run_bulk(rows, spec, table)
    jobs.run(rows.filter(F.col("Date").startswith("2001-05")), spec, table)
    bars = d.spark.table(table).select("code", "date", "close")
    return rounded(windows.sliding(bars, {"ma200": windows.Slide("avg", "close", 200)}).drop("close"))


@query("stream_upsert", BARS_SQL.replace("volume,", "CASE WHEN day(date) = 13 THEN 0 ELSE volume END AS volume,"))
def _(d):
    """Two deliveries of landed files, each picked up by one run of the stream."""
    spec, table = jobs.DATASETS["daily_bars"], scratch_table(d, "daily_bars")
    path, memory = scratch_path(d, "landing"), scratch_path(d, "stream")
    rows = landed.daily_bars(d)
    for part in (F.col("Date") < "2001-01-01", F.col("Date") >= "2000-12-01"):
        rows.filter(part).write.mode("append").json(path)
        catchup.upsert_landed(d.spark, path, all_text(rows), spec, table, memory)
    return rounded(stored(d, table)).select(*BAR_COLUMNS)
