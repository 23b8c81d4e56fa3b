"""Landed API records, derived from the generic warehouse tables.

Every frame has the provider's column names and text values, as a JSON or CSV reader would deliver them, so
the dataset jobs can be run end to end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiscan.sources.readers import SEQUENCE
from equiscan.sources.derived import Market


def _text(**columns: Column) -> list[Column]:
    return [c.cast("string").alias(n) for n, c in columns.items()]


def supplier_code(col: str = "l_suppkey") -> Column:
    """The code without its leading zeros, as a number column of a sheet would hold it."""
    return F.col(col) * 10


def friday_of(day: Column) -> Column:
    return F.date_add(F.trunc(day, "week"), 4)


def equity_master(m: Market) -> DataFrame:
    supplier, nation = m.raw("supplier"), m.raw("nation")
    rows = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
    segment = F.when(F.col("s_suppkey") % 4 == 3, "スタンダード").otherwise("プライム")
    return rows.select(
        *_text(
            Code=supplier_code("s_suppkey"), CoName=F.col("s_name"), S33=F.col("n_nationkey"), S33Nm=F.col("n_name"),
            MktNm=segment, Unlisted=F.lit("x"),
        )
    )


def daily_bars(m: Market) -> DataFrame:
    bars = m.daily_bars()
    volume = F.when(F.day("date") == 13, F.lit("n/a")).otherwise(F.col("volume").cast("string"))
    return bars.select(
        *_text(
            Date=F.col("date"), Code=F.col("code"), O=F.col("open"), H=F.col("high"), L=F.col("low"), C=F.col("close"),
            Vo=volume, Va=F.col("turnover_value"),
        )
    )


def daily_bars_long(m: Market) -> DataFrame:
    """The same bars under the old column names, with the adjustment columns."""
    bars = m.daily_bars()
    return bars.select(
        *_text(
            Date=F.col("date"), Code=F.col("code"), Open=F.col("open"), High=F.col("high"), Low=F.col("low"),
            Close=F.col("close"), Volume=F.col("volume"), TurnoverValue=F.col("turnover_value"),
            AdjustmentFactor=F.lit(1.0), AdjustmentClose=F.col("close"), AdjustmentVolume=F.lit(None),
        )
    )


def minute_bars(m: Market) -> DataFrame:
    tick = F.struct("ts", "event_id")
    rows = m.raw("events").groupBy("user_id", F.date_trunc("minute", "ts").alias("t")).agg(
        F.min_by("value", tick).alias("o"), F.max("value").alias("h"), F.min("value").alias("l"),
        F.max_by("value", tick).alias("c"), F.count("*").alias("n"),
    )
    return rows.select(
        *_text(
            Date=F.to_date("t"), Code=supplier_code("user_id"), Time=F.date_format("t", "HH:mm"), O=F.col("o"),
            H=F.col("h"), L=F.col("l"), C=F.col("c"), Vo=F.col("n"), Va=F.col("h") * F.col("n"),
        )
    )


def financial_summary(m: Market) -> DataFrame:
    return m.financial_summary().select(
        *_text(
            DiscDate=F.col("disclosed_date"), DiscTime=F.lit("15:00"), Code=F.col("code"),
            DocType=F.col("document_type"), Sales=F.col("net_sales"), OP=F.col("operating_profit"),
            NP=F.col("net_income"), TA=F.col("total_assets"), Eq=F.col("equity"),
            EqAR=F.col("equity_to_asset_ratio"), EPS=F.col("eps"), BPS=F.col("bps"), CurFYEn=F.lit("-"),
            FSales=F.when(F.col("operating_profit") < 0, "－").otherwise(F.col("net_sales").cast("string")),
            NewField=F.lit("x"),
        )
    )


def topix(m: Market) -> DataFrame:
    return m.index_bars().filter(F.col("index_code") == "0000").select(
        *_text(Date=F.col("date"), O=F.col("open"), H=F.col("high"), L=F.col("low"), C=F.col("close"))
    )


def indices(m: Market) -> DataFrame:
    """Days overlap between two fetches; the first record of a key counts."""
    rows = m.index_bars().filter(F.col("index_code") != "0000")

    def fetch(n: int, offset: float) -> DataFrame:
        return rows.select(
            *_text(
                Date=F.col("date"), Code=F.col("index_code"), O=F.col("open"), H=F.col("high"), L=F.col("low"),
                C=F.col("close") + offset,
            ),
            F.lit(n).alias(SEQUENCE),
        )

    return fetch(1, 0.0).unionByName(fetch(2, 1.0))


def index_options(m: Market) -> DataFrame:
    rows = m.raw("lineitem").groupBy(
        F.floor(F.col("l_partkey") / 10).alias("g"), F.to_date("l_shipdate").alias("d"), "l_returnflag"
    ).agg(
        F.max("l_quantity").alias("h"), F.min("l_quantity").alias("l"), F.count("*").alias("n"),
        F.max("l_tax").alias("iv"), F.max("l_partkey").alias("k"),
    )
    division = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    return rows.select(
        *_text(
            Date=F.col("d"), Code=F.col("g"), EmMrgnTrgDiv=division, H=F.col("h"), L=F.col("l"),
            WhDayHiP=F.col("h") * 2, StrikePrice=F.col("k") * 10, TradingVolume=F.col("n"),
            ImpliedVolatility=F.col("iv"), ContractMonth=F.date_format("d", "yyyy-MM"),
            PutCallDivision=F.when(F.col("g") % 2 == 0, "1").otherwise("2"), LastTradingDay=F.date_add("d", 30),
            SpecialQuotationDay=F.lit("-"),
        ),
        F.col("k").alias(SEQUENCE),
    )


def margin_interest(m: Market) -> DataFrame:
    q = F.col("l_quantity")

    def held(flag: str, column: str = "l_returnflag") -> Column:
        return F.sum(F.when(F.col(column) == flag, q))

    rows = m.raw("lineitem").groupBy("l_suppkey", friday_of(F.to_date("l_shipdate")).alias("d")).agg(
        held("A").alias("long"), held("R").alias("short"), held("F", "l_linestatus").alias("neg"),
        held("O", "l_linestatus").alias("std"),
    )
    return rows.select(
        *_text(
            Date=F.col("d"), Code=supplier_code(), LongVol=F.col("long"), ShrtVol=F.col("short"),
            LongNegVol=F.col("neg"), LongStdVol=F.col("std"), IssType=F.lit("2"),
        )
    )


def short_selling(m: Market) -> DataFrame:
    lines, supplier = m.raw("lineitem"), m.raw("supplier")
    q = F.col("l_quantity")
    rows = lines.join(supplier, lines["l_suppkey"] == supplier["s_suppkey"]).groupBy(
        F.to_date("l_shipdate").alias("d"), "s_nationkey"
    ).agg(
        F.sum(q).alias("sell"), F.sum(F.when(F.col("l_returnflag") == "R", q)).alias("restricted"),
        F.sum(F.when(F.col("l_returnflag") == "A", q)).alias("free"),
    )
    return rows.select(
        *_text(
            Date=F.col("d"), S33=F.lpad(F.col("s_nationkey").cast("string"), 4, "0"), SellExShortVa=F.col("sell"),
            ShrtWithResVa=F.col("restricted"), ShrtNoResVa=F.col("free"),
        )
    )


INVESTOR_VALUES = [
    f"{who}{side}Value"
    for who in ("Proprietors", "Foreigners", "Individuals", "SecuritiesCos", "InvestmentTrusts", "OtherCorps")
    for side in ("Sell", "Buy")
]


def investor_types(m: Market) -> DataFrame:
    rows = m.raw("orders").groupBy(friday_of(F.to_date("o_orderdate")).alias("d"), "o_orderpriority").agg(
        *[F.count_if(F.col("o_orderkey") % 12 == i).alias(v) for i, v in enumerate(INVESTOR_VALUES)]
    )
    return rows.select(
        *_text(
            PublishedDate=F.date_add("d", 6), StartDate=F.date_sub("d", 4), EndDate=F.col("d"),
            Section=F.col("o_orderpriority"), **{v: F.col(v) for v in INVESTOR_VALUES},
        )
    )


def earnings_calendar(m: Market) -> DataFrame:
    return m.earnings_calendar().select(
        *_text(
            Date=F.col("date"), Code=F.col("code"), CoName=F.concat(F.lit("Co "), "code"), FY=F.year("date"),
            FQ=F.quarter("date"), SectorNm=F.lit(None), Section=F.lit("Prime"),
        )
    )


def short_sale_report(m: Market) -> DataFrame:
    o = m.raw("orders")
    holder = F.concat(F.lit("Holder "), F.col("o_orderpriority"))
    return o.select(
        *_text(
            DiscDate=F.to_date("o_orderdate"), CalcDate=F.date_sub(F.to_date("o_orderdate"), 2),
            Code=F.floor(F.col("o_custkey") / 15) * 10, SSName=holder, SSAddr=F.lit(None),
            FundName=F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.col("o_orderstatus")),
            ShrtPosToSO=F.col("o_orderkey") % 97 / 1000.0, ShrtPosShares=F.col("o_orderkey") % 1009,
            PrevRptDate=F.when(F.col("o_orderstatus") == "F", F.lit("-")).otherwise(F.lit("1999-12-31")),
            PrevRptRatio=F.lit("n/a"),
        ),
        F.col("o_orderkey").alias(SEQUENCE),
    )


def daily_margin_interest(m: Market) -> DataFrame:
    rows = m.raw("lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").alias("d")).agg(
        F.sum("l_quantity").alias("q"), F.count("*").alias("n"), F.max("l_returnflag").alias("flag")
    )
    reason = F.when(
        F.col("flag") != "R",
        F.struct(
            F.when(F.col("n") > 1, "1").otherwise("0").alias("Restricted"),
            F.when(F.col("flag") == "N", "1").alias("Monitoring"),
        ),
    )
    return rows.select(
        *_text(
            PubDate=F.date_add("d", 1), Code=supplier_code(), AppDate=F.col("d"), ShrtOut=F.col("q"),
            ShrtOutRatio=F.when(F.col("n") > 1, F.col("n").cast("string")), LongOut=F.col("n"), SLRatio=F.lit("-"),
            TSEMrgnRegCls=F.lit(None),
        ),
        reason.alias("PubReason"),
    )


def trading_calendar(m: Market) -> DataFrame:
    days = m.raw("lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    return days.select(*_text(Date=F.col("d"), HolDiv=F.when(F.weekday("d") < 5, "1").otherwise("0")))


LANDED = {
    "equity_master": equity_master,
    "daily_bars": daily_bars,
    "minute_bars": minute_bars,
    "financial_summary": financial_summary,
    "topix": topix,
    "indices": indices,
    "index_options": index_options,
    "margin_interest": margin_interest,
    "short_selling": short_selling,
    "investor_types": investor_types,
    "earnings_calendar": earnings_calendar,
    "short_sale_report": short_sale_report,
    "daily_margin_interest": daily_margin_interest,
    "trading_calendar": trading_calendar,
}
