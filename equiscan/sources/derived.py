"""Market tables derived from the generic warehouse tables the driver supplies.

Line items become ticks, suppliers become stocks, parts become foreign tickers and fund proxies, orders
become trades. Each table is derived once per application, written as Parquet below the shared folder and
read back from there, like an ingest would leave it: bars are laid out by month, so a lookback prunes
directories, and every operator starts from stored files instead of repeating the derivation.
"""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiscan.functions import pad_code
from equiscan.session import release_shuffles, run_root

AS_OF = date(2001, 6, 30)
# Real ship dates are moved so that the last one falls on AS_OF.
SHIFT_DAYS = 127
#: Rows that a task sorts at once, some 100 bytes each: few enough to stay in memory, however many rows there are in all.
ROWS_A_TASK = 300_000

_stored: dict[tuple[str, str, str], tuple[str, T.StructType]] = {}


def session_day(rank: Column) -> Column:
    """Date of the ``rank``-th newest session: five sessions per seven days, ending at AS_OF."""
    return F.date_sub(F.lit(AS_OF), F.floor((rank - 1) * 7 / F.lit(5.0)).cast("int"))


def stock_code(supplier: Column | str) -> Column:
    return F.concat(pad_code(supplier, 4), F.lit("0"))


def shifted(col: str) -> Column:
    return F.date_sub(F.to_date(col), SHIFT_DAYS)


class Market:
    """The derived tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _tasks(self, name: str) -> int:
        """Tasks for work on all rows of a table; their count comes from the file footers."""
        return max(self.spark.sparkContext.defaultParallelism, math.ceil(self.raw(name).count() / ROWS_A_TASK))

    def _table(self, name: str, build, by_month: str | None = None, sort: tuple[str, ...] = (), rows_of: str | None = None) -> DataFrame:
        """With ``rows_of``, a table of as many rows at least, each month is dealt to tasks by its first sort column."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _stored:
            path = f"{run_root(self.spark)}/derived-{len(_stored)}-{name}"
            _stored[key] = (path, self._written(path, build(), by_month, sort, rows_of))
            release_shuffles(self.spark, times=2)
        path, schema = _stored[key]
        return self.spark.read.schema(schema).parquet(path)

    def _written(self, path: str, df: DataFrame, by_month: str | None, sort: tuple[str, ...], rows_of: str | None) -> T.StructType:
        if by_month:
            df = df.withColumn("month", F.date_format(by_month, "yyyy-MM"))
            if rows_of:
                tasks = self._tasks(rows_of)
                # Two pieces of a month for every two years' share of the tasks: small enough to even out, large enough as files.
                piece = F.pmod(F.hash(sort[0]), F.lit(2 * math.ceil(tasks / 24)))
                df = df.repartition(tasks, F.col("month"), piece)
            else:
                df = df.hint("rebalance", F.col("month"))
        if sort:
            df = df.sortWithinPartitions(*(["month"] if by_month else []), *sort)
        writer = df.write.mode("overwrite")
        if by_month:
            writer = writer.partitionBy("month")
        writer.parquet(path)
        return df.schema

    # ---- price series -------------------------------------------------------------------------

    def daily_bars(self) -> DataFrame:
        return self._table("daily_bars", self._build_daily_bars, by_month="date", sort=("code", "date"), rows_of="lineitem")

    def _build_daily_bars(self) -> DataFrame:
        tick = F.struct("l_orderkey", "l_linenumber", "l_quantity")
        px = 1000 + (F.col("l_quantity") - 25) * 2 * (F.col("l_suppkey") % 10)
        tasks = self._tasks("lineitem")
        # Few lines share a supplier and day, so combining before the exchange would sort every line once more and save nothing.
        day = (
            self.raw("lineitem")
            .select(
                "l_suppkey", F.to_date("l_shipdate").alias("d"), "l_tax", "l_discount", "l_quantity",
                "l_extendedprice", "l_orderkey", "l_linenumber",
            )
            .repartition(tasks, "l_suppkey", "d")
            .groupBy("l_suppkey", "d")
            .agg(
                F.min_by(px, tick).alias("o"),
                F.max(px * (1 + F.col("l_tax") / 8)).alias("h"),
                F.min(px * (1 - F.col("l_discount") / 8)).alias("l"),
                F.max_by(px, tick).alias("c"),
                F.sum("l_quantity").cast("bigint").alias("volume"),
                F.sum("l_extendedprice").alias("amount"),
            )
        )
        # At most one row per supplier and day reaches this window.
        rank = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.col("d").desc()))
        drift = (F.col("l_suppkey") % 3 - 1) * (600 - F.col("rn")) * 0.5
        k = F.when(F.col("rn") % 50 < 20, 0.25).otherwise(1.0)

        def level(c: str) -> Column:
            return 1000 + (F.col(c) - 1000) * k + drift

        return day.repartition(tasks, "l_suppkey").withColumn("rn", rank).select(
            stock_code("l_suppkey").alias("code"),
            session_day(F.col("rn")).alias("date"),
            level("o").alias("open"),
            level("h").alias("high"),
            level("l").alias("low"),
            level("c").alias("close"),
            "volume",
            F.round(F.col("amount") * 20000 * (1 + F.col("l_suppkey") % 5), 0).alias("turnover_value"),
        )

    def index_bars(self) -> DataFrame:
        return self._table("index_bars", self._build_index_bars, by_month="date", sort=("index_code", "date"))

    def _build_index_bars(self) -> DataFrame:
        by_line = (
            self.raw("lineitem")
            .groupBy(F.to_date("l_shipdate").alias("d"), "l_linenumber")
            .agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
        )
        codes = F.array(F.lit("0000"), pad_code("l_linenumber", 4))
        day = (
            by_line.select("d", "q", "n", F.explode(codes).alias("index_code"))
            .groupBy("index_code", "d")
            .agg(F.sum("q").alias("q"), F.sum("n").alias("n"))
        )
        rank = F.row_number().over(Window.partitionBy("index_code").orderBy(F.col("d").desc()))
        close = 2000 + (F.col("q") / F.col("n") - 25) * 4 + (1000 - F.col("rn"))
        opened = F.col("close") - 4 + F.col("n") % 9
        return (
            day.withColumn("rn", rank)
            .withColumn("close", close)
            .select(
                "index_code",
                session_day(F.col("rn")).alias("date"),
                opened.alias("open"),
                (F.greatest(opened, F.col("close")) + F.col("n") % 5).alias("high"),
                (F.least(opened, F.col("close")) - F.col("n") % 3).alias("low"),
                "close",
            )
        )

    def quotes(self) -> DataFrame:
        """Landed foreign and proxy prices: ``ticker, date, close``."""
        return self._table("quotes", self._build_quotes, by_month="date", sort=("ticker", "date"))

    def _build_quotes(self) -> DataFrame:
        group = F.floor(F.col("l_partkey") / 100).cast("string")
        day = (
            self.raw("lineitem")
            .groupBy(group.alias("g"), shifted("l_shipdate").alias("date"))
            .agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
        )
        level = F.col("q") / F.col("n")
        stocks = day.select(F.concat(F.lit("US"), "g").alias("ticker"), "date", (100 + level).alias("close"))
        proxies = day.select(F.concat(F.lit("PX"), "g").alias("ticker"), "date", (1500 + level * 10).alias("close"))
        fx = day.groupBy("date").agg((100 + F.sum("q") / F.sum("n")).alias("close")).select(
            F.lit("USDJPY=X").alias("ticker"), "date", "close"
        )
        return stocks.unionByName(proxies).unionByName(fx)

    # ---- reference data -----------------------------------------------------------------------

    def equity_master(self) -> DataFrame:
        supplier, nation = self.raw("supplier"), self.raw("nation")
        return supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(
            stock_code("s_suppkey").alias("code"),
            F.col("s_name").alias("company_name"),
            F.col("n_name").alias("sector33_name"),
            F.when(F.col("s_suppkey") % 4 == 3, "スタンダード").otherwise("プライム").alias("market_name"),
        )

    def financial_summary(self) -> DataFrame:
        return self._table("financial_summary", self._build_financial_summary)

    def _build_financial_summary(self) -> DataFrame:
        # Whole cents and percents keep the sums exact, so their order does not matter.
        cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        points = F.round(F.col("l_discount") * 100).cast("bigint") - 3
        y = (
            self.raw("lineitem")
            .groupBy("l_suppkey", F.year("l_shipdate").alias("fy"), F.quarter("l_shipdate").alias("q"))
            .agg(
                F.max(F.to_date("l_shipdate")).alias("disclosed_date"),
                (F.sum(cents) / 100.0).alias("net_sales"),
                (F.sum(cents * points) / 10000.0).alias("operating_profit"),
            )
        )
        sales, op, ratio = F.col("net_sales"), F.col("operating_profit"), (1 + F.col("l_suppkey") % 8) / 10.0
        return y.select(
            stock_code("l_suppkey").alias("code"),
            "disclosed_date",
            F.when(F.col("q") == 4, "FYFinancialStatements")
            .when(F.col("q") == 2, "AnnualRevision")
            .otherwise("1QFinancialStatements")
            .alias("document_type"),
            sales.alias("net_sales"),
            op.alias("operating_profit"),
            (op * 0.6).alias("net_income"),
            (sales * 1.5).alias("total_assets"),
            (sales * 1.5 * ratio).alias("equity"),
            ratio.alias("equity_to_asset_ratio"),
            (op * 0.6 / 100).alias("eps"),
            (sales * 1.5 * ratio / 500).alias("bps"),
        )

    def earnings_calendar(self) -> DataFrame:
        """One announcement per stock and ship year, spread over 100 days before to 259 days after AS_OF."""
        return self._table("earnings_calendar", self._build_earnings_calendar)

    def _build_earnings_calendar(self) -> DataFrame:
        offset = (F.col("k") % 360 - 100).cast("int")
        return (
            self.raw("lineitem")
            .groupBy("l_suppkey", F.year("l_shipdate").alias("y"))
            .agg(F.max("l_orderkey").alias("k"))
            .select(stock_code("l_suppkey").alias("code"), F.date_add(F.lit(AS_OF), offset).alias("date"))
        )

    # ---- trades -------------------------------------------------------------------------------

    def _orders(self) -> DataFrame:
        """Orders as trades of all three kinds, still in one table."""
        group = F.floor(F.col("o_custkey") / 75).cast("string")
        stock = pad_code(F.floor(F.col("o_custkey") / 15).cast("string"), 4)
        status = F.col("o_orderstatus")
        kind = F.when(status == "F", "domestic").when(status == "O", "us").otherwise("fund")
        name = F.when(status == "F", F.concat(F.lit("Company "), stock)).when(
            status == "O", F.concat(F.lit("Company US"), group)
        ).otherwise(F.concat(F.lit("Fund "), group))
        return self.raw("orders").select(
            "o_orderkey",
            F.to_date("o_orderdate").alias("traded_on"),
            kind.alias("kind"),
            F.when(kind == "domestic", stock).when(kind == "us", F.concat(F.lit("US"), group)).alias("code"),
            name.alias("name"),
            F.col("o_orderpriority").alias("account"),
            F.when(F.col("o_orderpriority") == "5-LOW", "売付").otherwise("買付").alias("side"),
            (1 + F.col("o_orderkey") % 100).alias("qty"),
            F.round(F.col("o_totalprice") / 100).cast("bigint").alias("price"),
            (100 + F.col("o_orderkey") % 50).alias("fx"),
        )

    def ledger_rows(self, kind: str) -> DataFrame:
        """One ledger as sheet text: the spellings of dates and numbers vary from row to row."""
        o = self._orders().filter(F.col("kind") == kind)
        turn = F.col("o_orderkey") % 3
        traded_on = (
            F.when(turn == 0, F.date_format("traded_on", "yyyy/M/d"))
            .when(turn == 1, F.date_format("traded_on", "yyyy-MM-dd"))
            .otherwise(F.date_format("traded_on", "M/d/yyyy"))
        )
        qty, price = F.col("qty").cast("string"), F.col("price").cast("string")
        common = [traded_on.alias("約定日"), F.col("side")]
        if kind == "domestic":
            return o.select(
                *common[:1], F.col("code").alias("銘柄コード"), F.col("name").alias("銘柄名"),
                F.col("account").alias("口座区分"), F.col("side").alias("売買区分"),
                F.concat(qty, F.lit("株")).alias("数量[株]"), F.concat(F.lit("¥"), price).alias("単価[円]"),
            )
        if kind == "us":
            rate = F.when(F.col("o_orderkey") % 7 == 0, "-").otherwise(F.col("fx").cast("string"))
            return o.select(
                *common[:1], F.col("code").alias("ティッカー"), F.col("name").alias("銘柄名"),
                F.col("account").alias("口座"), F.col("side").alias("売買区分"),
                qty.alias("数量[株]"), F.concat(F.lit("$"), price).alias("単価[USドル]"), rate.alias("為替レート"),
            )
        settled = F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(
            F.concat(F.lit("¥"), F.col("price").cast("string"))
        )
        return o.select(
            *common[:1], F.col("name").alias("ファンド名"), F.col("account").alias("口座"),
            F.col("side").alias("取引"), F.concat((F.col("qty") * 1000).cast("string"), F.lit("口")).alias("数量[口]"),
            price.alias("単価"), settled.alias("受渡金額"),
        )

    def fund_proxies(self) -> DataFrame:
        """Fund name to proxy ticker, one row per fund that was ever bought."""
        funds = self._orders().filter(F.col("kind") == "fund").select("name").distinct()
        return funds.select(
            F.col("name").alias("asset_name"), F.concat(F.lit("PX"), F.substring("name", 6, 20)).alias("proxy_ticker")
        )
