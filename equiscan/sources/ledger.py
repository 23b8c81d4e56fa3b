"""Trade ledgers kept as sheets: two title rows, a header row, then data."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiscan.functions import multi_format_date, number_text
from equiscan.sources.streams import BATCH_CHARS, BATCH_ROWS, listed, text_of

HEADER_ROW = 3
# Header keywords of the three sheets, and the label of a purchase.
DOMESTIC_HEADERS = {
    "trade_date": "約定日",
    "code": "銘柄コード",
    "company_name": "銘柄名",
    "account_type": "口座区分",
    "buy_sell": "売買区分",
    "quantity": "数量",
    "unit_price": "単価",
}
US_HEADERS = {
    "trade_date": "約定日",
    "code": "ティッカー",
    "company_name": "銘柄名",
    "account_type": "口座",
    "buy_sell": "売買区分",
    "quantity": "数量",
    "unit_price": "単価",
    "fx_rate": "為替レート",
}
FUND_HEADERS = {
    "trade_date": "約定日",
    "company_name": "ファンド名",
    "account_type": "口座",
    "buy_sell": "取引",
    "quantity": "数量",
    "unit_price": "単価",
    "settled": "受渡金額",
}
BUY_LABEL = "買付"
# Product type spellings, mapped to one vocabulary.
PRODUCT_TYPES = {
    "国内株式": "domestic",
    "国内株": "domestic",
    "米国株式": "us",
    "米国株": "us",
    "投資信託": "fund",
}

TRADE_COLUMNS = [
    "trade_date", "code", "company_name", "product_type", "account_type",
    "quantity", "unit_price", "amount", "amount_native", "amount_unit", "fx_rate",
]


def _sheet_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(names, values) of the data rows of each sheet: its own third row names them, quotes may hold commas and breaks.

    Sheets are read one row after the other; what is held is :data:`BATCH_CHARS` characters of rows, or one row."""
    kind = pa.list_(pa.string())

    def out(names: list, values: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"names": pa.array(names, kind), "values": pa.array(values, kind)})

    csv.field_size_limit(1 << 30)
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            header, names, values, chars = [], [], [], 0
            with text_of(path, content.as_py()) as text:
                for place, row in enumerate(csv.reader(text), 1):
                    if place == HEADER_ROW:
                        header = row
                    if place <= HEADER_ROW or not any(cell.strip() for cell in row):
                        continue
                    width = max(len(header), len(row))
                    named = [header[i] if i < len(header) and header[i] else f"_blank{i}" for i in range(width)]
                    names.append([n if n not in named[:i] else f"{n}_{i}" for i, n in enumerate(named)])
                    values.append([row[i] if i < len(row) else None for i in range(width)])
                    chars += sum(map(len, names[-1])) + sum(map(len, row))
                    if len(values) == BATCH_ROWS or chars >= BATCH_CHARS:
                        yield out(names, values)
                        names, values, chars = [], [], 0
            if values:
                yield out(names, values)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger sheets as text columns, each sheet named by its own third row.

    ``path`` may name one sheet or a folder of sheets of any layouts; a column that a sheet lacks is NULL in its rows. A
    sheet is read by one task, since only its own first rows tell titles from data, but as a stream of rows; a spreadsheet
    bounds it at some ten million cells, and sheets are spread over the tasks. The driver sees the distinct layouts. Cells beyond the header are kept as
    ``_blank`` columns, short rows are padded with NULL and rows without any text are dropped.
    """
    rows = listed(spark, path).mapInArrow(_sheet_rows, "names array<string>, values array<string>")
    layouts = [r["names"] for r in rows.select("names").distinct().orderBy(F.size("names"), F.array_join("names", ",")).collect()]
    columns = list(dict.fromkeys(name for names in layouts for name in names))
    if not columns:
        return spark.createDataFrame([], T.StructType([]))
    place = lambda name: F.array_position("names", F.lit(name)).cast("int")
    return rows.select(*(F.get("values", place(name) - 1).alias(name) for name in columns))


def find_column(columns: list[str], keyword: str) -> str | None:
    """First column whose name contains ``keyword``."""
    return next((c for c in columns if keyword in c), None)


def _text(rows: DataFrame, name: str | None) -> Column:
    return F.col(f"`{name}`").cast("string") if name else F.lit(None).cast("string")


def _purchases(rows: DataFrame, headers: dict[str, str], required: tuple[str, ...]) -> DataFrame | None:
    where = {field: find_column(rows.columns, keyword) for field, keyword in headers.items()}
    if any(where[field] is None for field in required):
        return None
    picked = rows.select([_text(rows, where.get(f)).alias(f) for f in headers])
    typed = picked.filter(F.trim("buy_sell") == BUY_LABEL).withColumn("trade_date", multi_format_date("trade_date"))
    text = [f for f in ("code", "company_name", "account_type") if f in headers]
    numbers = [f for f in ("quantity", "unit_price", "fx_rate", "settled") if f in headers]
    return (
        typed.filter(F.col("trade_date").isNotNull())
        .withColumns({f: F.trim(f) for f in text})
        .withColumns({f: number_text(f) for f in numbers})
    )


def _nonzero(col: str) -> Column:
    """Zero counts as missing in amounts."""
    return F.when(F.col(col) != 0, F.col(col))


def _trades(df: DataFrame, product: str, **values: Column) -> DataFrame:
    out = df.withColumns({"product_type": F.lit(product), **values})
    for column, kind in (("code", "string"), ("fx_rate", "double")):
        if column not in out.columns:
            out = out.withColumn(column, F.lit(None).cast(kind))
    return out.select(*TRADE_COLUMNS)


def ledger_domestic(rows: DataFrame) -> DataFrame | None:
    """Domestic purchases; NULL frame (None) when a required column is missing."""
    bought = _purchases(rows, DOMESTIC_HEADERS, ("trade_date", "buy_sell", "quantity"))
    if bought is None:
        return None
    amount = _nonzero("quantity") * _nonzero("unit_price")
    return _trades(bought, "domestic", amount=amount, amount_native=amount, amount_unit=F.lit("jpy"))


def ledger_us(rows: DataFrame) -> DataFrame | None:
    """US purchases. ``amount`` is yen where the rate is known; ``amount_native`` stays in dollars."""
    bought = _purchases(rows, US_HEADERS, ("trade_date", "buy_sell", "quantity"))
    if bought is None:
        return None
    dollars = _nonzero("quantity") * _nonzero("unit_price")
    yen = F.round(dollars * _nonzero("fx_rate"), 0)
    return _trades(bought, "us", amount=F.coalesce(yen, dollars), amount_native=dollars, amount_unit=F.lit("usd"))


def ledger_fund(rows: DataFrame) -> DataFrame | None:
    """Fund purchases. The settled amount is yen; quantity times price is yen per 10,000 units."""
    bought = _purchases(rows, FUND_HEADERS, ("trade_date", "buy_sell"))
    if bought is None:
        return None
    computed = _nonzero("quantity") * _nonzero("unit_price")
    amount = F.coalesce(_nonzero("settled"), computed)
    unit = F.when(_nonzero("settled").isNotNull(), "jpy").otherwise("per_10k")
    return _trades(bought, "fund", amount=amount, amount_native=amount, amount_unit=unit)


def canonical_product_type(col: str = "product_type") -> Column:
    """Either spelling of a product type, or the canonical name itself."""
    value = F.col(col)
    mapped = value
    for spelling, name in PRODUCT_TYPES.items():
        mapped = F.when(value == spelling, name).otherwise(mapped)
    return mapped


def union_ledgers(*ledgers: DataFrame | None) -> DataFrame:
    """All readable ledgers as one table."""
    present = [ledger for ledger in ledgers if ledger is not None]
    out = present[0]
    for ledger in present[1:]:
        out = out.unionByName(ledger, allowMissingColumns=True)
    return out
