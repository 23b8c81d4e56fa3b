"""Scalar helpers over order and line item columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from equiscan import functions as fn
from equiscan.checks.ctes import AS_OF as AS_OF_SQL
from equiscan.checks.ctes import pad, r
from equiscan.checks.registry import query
from equiscan.sources.derived import AS_OF

K = "o_orderkey"


def _orders(d, *columns):
    return d.raw("orders").select(K, *columns)


def _v(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


@query("S1", f"SELECT o_orderkey, {r('o_totalprice / NULLIF(o_custkey % 5, 0)', 4)} AS v FROM orders")
def _(d):
    return _orders(d, F.round(fn.safe_divide(F.col("o_totalprice"), F.col("o_custkey") % 5), 4).alias("v"))


@query(
    "S2",
    f"SELECT o_orderkey, {r('o_totalprice', 1)} AS one, {r('o_totalprice', 0)} AS zero, {r('0 - o_orderkey / 2', 0)} AS half FROM orders",
)
def _(d):
    return _orders(
        d, F.round("o_totalprice", 1).alias("one"), F.round("o_totalprice", 0).alias("zero"),
        F.round(0 - F.col(K) / 2, 0).alias("half"),
    )


@query(
    "S3",
    "SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE greatest(o_custkey, o_orderkey, 700) END AS v FROM orders",
)
def _(d):
    gap = F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey"))
    return _orders(d, fn.greatest_strict(gap, F.col(K), F.lit(700)).alias("v"))


@query(
    "S4",
    f"SELECT o_orderkey, abs(500 - o_custkey) AS a, {r('sqrt(250)', 6)} AS s, {r('pow(o_totalprice, CAST(1.0 AS DOUBLE) / 3)', 4)} AS p FROM orders",
)
def _(d):
    return _orders(
        d, F.abs(500 - F.col("o_custkey")).alias("a"), F.round(F.sqrt(F.lit(250)), 6).alias("s"),
        F.round(F.pow("o_totalprice", F.lit(1.0 / 3)), 4).alias("p"),
    )


NUMBER_SQL = (
    "CASE o_orderkey % 6 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN concat(' -', o_custkey, '.5') WHEN 2 THEN 'NaN' "
    "WHEN 3 THEN '-' WHEN 4 THEN '' ELSE concat(o_custkey, 'e2') END"
)


def _number_text():
    c = F.col("o_custkey").cast("string")
    t = F.col(K) % 6
    return (
        F.when(t == 0, c).when(t == 1, F.concat(F.lit(" -"), c, F.lit(".5"))).when(t == 2, "NaN").when(t == 3, "-")
        .when(t == 4, "").otherwise(F.concat(c, F.lit("e2")))
    )


@query(
    "S5",
    "SELECT o_orderkey, CAST(CASE o_orderkey % 6 WHEN 0 THEN o_custkey WHEN 1 THEN 0 - (o_custkey + 0.5) WHEN 5 THEN o_custkey * 100 END AS DOUBLE) AS v FROM orders",
)
def _(d):
    return _orders(d, fn.to_number(_number_text()).alias("v"))


@query(
    "S6",
    "SELECT o_orderkey, CAST(CASE o_orderkey % 6 WHEN 0 THEN o_custkey WHEN 1 THEN 0 - o_custkey WHEN 5 THEN o_custkey * 100 ELSE 0 END AS BIGINT) AS v FROM orders",
)
def _(d):
    return _orders(d, fn.to_integer(_number_text()).alias("v"))


@query(
    "S7",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS strict, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS lenient FROM orders",
)
def _(d):
    day = F.to_date("o_orderdate")
    t = F.col(K) % 4
    text = (
        F.when(t == 0, F.date_format(day, "yyyy-MM-dd")).when(t == 1, F.date_format(day, "yyyyMMdd"))
        .when(t == 2, F.date_format(day, "yyyy/M/d")).otherwise("soon")
    )
    return _orders(
        d, fn.strict_date(F.date_format(day, "yyyy-MM-dd")).alias("strict"), fn.lenient_date(text).alias("lenient")
    )


@query("S8", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS v FROM orders")
def _(d):
    day = F.to_date("o_orderdate")
    t = F.col(K) % 4
    text = (
        F.when(t == 0, F.date_format(day, "yyyy/M/d")).when(t == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(t == 2, F.concat(F.lit(" "), F.date_format(day, "M/d/yyyy"))).otherwise("-")
    )
    return _orders(d, fn.multi_format_date(text).alias("v"))


@query(
    "S9",
    "SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN o_custkey * 1000 + 25 WHEN 1 THEN o_custkey WHEN 2 THEN o_custkey + 0.5 END AS DOUBLE) AS v FROM orders",
)
def _(d):
    c = F.col("o_custkey").cast("string")
    t = F.col(K) % 5
    text = (
        F.when(t == 0, F.concat(F.lit("¥"), c, F.lit(",025"))).when(t == 1, F.concat(c, F.lit("口")))
        .when(t == 2, F.concat(F.lit("$ "), c, F.lit(".5 株"))).when(t == 3, "-").otherwise(" ")
    )
    return _orders(d, fn.number_text(text).alias("v"))


@query("S10", f"SELECT o_orderkey, {pad('o_custkey * 100', 5)} AS v FROM orders")
def _(d):
    return _orders(d, fn.pad_code(F.col("o_custkey") * 100).alias("v"))


@query(
    "S11",
    "SELECT code, left(code, 4) AS short, left(code, 4) || '0' AS padded FROM equity_master",
)
def _(d):
    short = fn.local_code("code")
    return d.equity_master().select("code", short.alias("short"), fn.append_market_digit(short).alias("padded"))


@query(
    "S12",
    "SELECT o_orderkey, coalesce(NULLIF(o_custkey % 3, 0), 9) AS a, NULLIF(o_orderstatus, 'F') AS b FROM orders",
)
def _(d):
    return _orders(
        d, F.coalesce(F.nullif(F.col("o_custkey") % 3, F.lit(0)), F.lit(9)).alias("a"),
        F.nullif("o_orderstatus", F.lit("F")).alias("b"),
    )


@query(
    "S13",
    f"SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(o_orderdate AS DATE) - 60 AS back, CAST({AS_OF_SQL} - CAST(o_orderdate AS DATE) AS INTEGER) AS age FROM orders",
)
def _(d):
    day = F.to_date("o_orderdate")
    return _orders(
        d, F.year("o_orderdate").alias("y"), F.date_sub(day, 60).alias("back"),
        fn.age_in_days(F.lit(AS_OF), day).alias("age"),
    )


@query(
    "S14",
    "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole, TRY_CAST(o_orderpriority AS BIGINT) AS safe FROM orders",
)
def _(d):
    return _orders(
        d, F.col("o_totalprice").cast("bigint").alias("whole"), F.col("o_orderpriority").try_cast("bigint").alias("safe")
    )


@query(
    "S15",
    "SELECT o_orderkey, o_orderpriority LIKE '%HIGH%' AS l, o_orderstatus IN ('F', 'P') AS i, o_custkey BETWEEN 100 AND 200 AS b FROM orders",
)
def _(d):
    return _orders(
        d, F.col("o_orderpriority").like("%HIGH%").alias("l"), F.col("o_orderstatus").isin("F", "P").alias("i"),
        F.col("o_custkey").between(100, 200).alias("b"),
    )


@query("S16", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS v FROM orders")
def _(d):
    return _orders(d, fn.partition_id_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("v"))


@query(
    "S17",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS status, "
    "CASE WHEN o_orderstatus = 'P' OR o_custkey % 2 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS cust FROM orders",
)
def _(d):
    nested = F.when(
        F.col("o_orderstatus") != "P",
        F.struct(
            F.col("o_orderstatus").alias("S"), F.when(F.col("o_custkey") % 2 == 1, F.col("o_custkey")).alias("C")
        ),
    )
    rows = _orders(d, nested.alias("n"))
    return rows.select(K, *fn.flatten_struct("n", {"S": "status", "C": "cust"}))


@query("S18", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS v FROM orders")
def _(d):
    return _orders(d, fn.fill_blank(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))).alias("v"))


@query(
    "S19",
    "SELECT o_orderkey, CAST(CASE o_orderkey % 6 WHEN 0 THEN o_custkey WHEN 1 THEN 0 - (o_custkey + 0.5) WHEN 5 THEN o_custkey * 100 ELSE 999 END AS DOUBLE) AS v FROM orders",
)
def _(d):
    return _orders(d, fn.safe_float(_number_text(), 999.0).alias("v"))


@query(
    "S20",
    f"SELECT o_orderkey, {r('least(greatest((o_custkey - 700) / 20.0, 0), 20) / 20 * 100', 4)} AS gauge, "
    f"greatest(CAST(o_custkey AS DOUBLE), 0.1) AS floor_, least(CAST(o_custkey AS DOUBLE), 100) AS cap FROM orders",
)
def _(d):
    c = F.col("o_custkey").cast("double")
    return _orders(
        d, F.round(fn.bar_gauge((c - 700) / 20.0), 4).alias("gauge"), fn.clip(c, low=0.1).alias("floor_"),
        fn.clip(c, high=100).alias("cap"),
    )


@query(
    "S21",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN NULL ELSE o_orderstatus END AS v FROM orders",
)
def _(d):
    t = F.col(K) % 5
    text = F.when(t == 0, "nan").when(t == 1, "None").when(t == 2, "NaT").when(t == 3, "").otherwise(F.col("o_orderstatus"))
    return _orders(d, fn.blank_to_null(text).alias("v"))


@query("S22", "SELECT code, concat(code, '_', company_name) AS v FROM equity_master")
def _(d):
    return d.equity_master().select("code", F.concat_ws("_", "code", "company_name").alias("v"))
