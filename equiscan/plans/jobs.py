"""One job per dataset: landed records to a stored table.

Every job is the same short plan — pick and rename columns, coerce types, keep one row per key, write — with
the differences stated in a :class:`Dataset`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiscan import schemas
from equiscan.functions import fill_blank, flatten_struct, lenient_date, pad_code, strict_date, to_integer, to_number
from equiscan.operators.columns import missing_columns, rename_map, unknown_columns
from equiscan.operators.filters import date_slice
from equiscan.operators.ranking import first_per_key
from equiscan.plans import portfolio
from equiscan.sinks import tables
from equiscan.sources.ledger import canonical_product_type
from equiscan.sources.readers import SEQUENCE, BulkLoad


@dataclass(frozen=True)
class Dataset:
    name: str
    aliases: dict[str, str]
    keys: tuple[str, ...] = ()
    short_aliases: dict[str, str] | None = None
    dates: tuple[str, ...] = ("date",)
    lenient_dates: tuple[str, ...] = ()
    integers: tuple[str, ...] = ()
    texts: tuple[str, ...] = ("code",)
    blank_texts: tuple[str, ...] = ()
    padded: bool = True
    unique: tuple[str, ...] = ()
    constants: dict[str, str] = field(default_factory=dict)
    stamped: bool = False
    replace: bool = False
    safe_types: bool = False
    by: str | None = "date"
    #: The key of the series that the rows form; a table may be dealt into buckets of it.
    series: str | None = None

    def alias_map(self, columns: list[str]) -> dict[str, str]:
        """The short spelling applies as soon as its open price is there."""
        return self.short_aliases if self.short_aliases and "O" in columns else self.aliases


DATASETS = {
    d.name: d
    for d in [
        Dataset(
            "equity_master", schemas.EQUITY_MASTER, dates=(), replace=True, by=None,
            texts=tuple(dict.fromkeys(schemas.EQUITY_MASTER.values())),
        ),
        Dataset(
            "daily_bars", schemas.BARS_LONG, ("date", "code"), short_aliases=schemas.BARS_SHORT,
            integers=("volume", "adjustment_volume"), series="code",
        ),
        Dataset(
            "minute_bars", schemas.MINUTE_LONG, ("date", "code", "time"), short_aliases=schemas.MINUTE_SHORT,
            integers=("volume",), texts=("code", "time"), series="code",
        ),
        Dataset(
            "financial_summary", schemas.FINANCIAL_SUMMARY, ("disclosed_date", "code", "document_type"), dates=(),
            lenient_dates=schemas.FINANCIAL_DATES, texts=schemas.FINANCIAL_TEXTS, safe_types=True,
            by="disclosed_date",
        ),
        Dataset(
            "topix", schemas.TOPIX, ("date", "index_code"), texts=("index_code",), padded=False,
            constants={"index_code": "0000"},
        ),
        Dataset(
            "indices", schemas.INDICES, ("date", "index_code"), texts=("index_code",), padded=False,
            unique=("date", "index_code"),
        ),
        Dataset(
            "index_options", schemas.INDEX_OPTIONS, ("date", "code", "em_mrgn_trg_div"),
            lenient_dates=("last_trading_day", "special_quotation_day"),
            texts=(
                "code", "em_mrgn_trg_div", "contract_month", "put_call_division", "central_contract_month_flag",
                "volume_only_auction",
            ),
            blank_texts=("em_mrgn_trg_div",), padded=False, unique=("date", "code", "em_mrgn_trg_div"),
        ),
        Dataset("margin_interest", schemas.MARGIN_INTEREST, ("date", "code"), texts=("code", "issue_type")),
        Dataset(
            "short_selling", schemas.SHORT_SELLING, ("date", "sector33_code"), texts=("sector33_code",), padded=False
        ),
        Dataset(
            "investor_types", schemas.INVESTOR_TYPES, ("published_date", "section"),
            dates=("published_date", "start_date", "end_date"), texts=("section",), padded=False,
            by="published_date",
        ),
        Dataset(
            "earnings_calendar", schemas.EARNINGS_CALENDAR, replace=True, stamped=True, by=None,
            texts=("code", "company_name", "fiscal_year", "fiscal_quarter", "sector_name", "section"),
        ),
        Dataset(
            "short_sale_report", schemas.SHORT_SALE_REPORT, ("disc_date", "code", "ss_name", "fund_name"), dates=(),
            lenient_dates=("disc_date", "calc_date", "prev_rpt_date"), padded=False,
            texts=("code", "ss_name", "ss_addr", "dic_name", "dic_addr", "fund_name", "notes"),
            blank_texts=("code", "ss_name", "ss_addr", "dic_name", "dic_addr", "fund_name", "notes"),
            unique=("disc_date", "code", "ss_name", "fund_name"), by="disc_date",
        ),
        Dataset(
            "daily_margin_interest", schemas.DAILY_MARGIN, ("pub_date", "code", "app_date"), dates=(),
            lenient_dates=("pub_date", "app_date"), padded=False,
            texts=("code", "tse_mrgn_reg_cls", "shrt_out_ratio", "long_out_ratio", *schemas.PUB_REASON.values()),
            blank_texts=("shrt_out_ratio", "long_out_ratio", "tse_mrgn_reg_cls"),
            unique=("pub_date", "code", "app_date"), by="pub_date",
        ),
        Dataset(
            "trading_calendar", schemas.TRADING_CALENDAR, texts=("hol_div",), padded=False, unique=("date",),
            stamped=True, replace=True, by=None,
        ),
    ]
}


def stored_schema(spec: Dataset) -> T.StructType:
    """Types of the stored table. A table with a date key also has its month, the partition column."""
    names = dict.fromkeys([*spec.aliases.values(), *spec.constants])
    if spec.name == "daily_margin_interest":
        names.update(dict.fromkeys(schemas.PUB_REASON.values()))

    def kind(name: str) -> T.DataType:
        if name in spec.dates or name in spec.lenient_dates:
            return T.DateType()
        if name in spec.integers:
            return T.LongType()
        return T.StringType() if name in spec.texts or name in spec.blank_texts else T.DoubleType()

    fields = [T.StructField(n, kind(n)) for n in names]
    if spec.stamped:
        fields.append(T.StructField("_fetched_at", T.TimestampType()))
    if spec.by and not spec.replace:
        fields.append(T.StructField(tables.MONTH, T.StringType()))
    return T.StructType(fields)


def setup(spark: SparkSession, database: str, buckets: int | None = None) -> int:
    """Create the raw tables that are missing; returns how many statements ran.

    With ``buckets`` the price series are dealt into so many by their code, in every month: windows and joins over them then
    need no exchange. A month holds as many files, so there should be enough rows to fill them.
    """
    statements = []
    for spec in DATASETS.values():
        schema = stored_schema(spec)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        layout = f" PARTITIONED BY ({tables.MONTH})" if tables.MONTH in schema.names else ""
        if buckets and spec.series:
            order = ", ".join(dict.fromkeys([spec.series, *spec.keys]))
            layout += f" CLUSTERED BY ({spec.series}) SORTED BY ({order}) INTO {buckets} BUCKETS"
        statements.append(
            f"CREATE TABLE IF NOT EXISTS {table_name(database, spec.name)} ({columns}) USING parquet{layout}"
        )
    return tables.create_if_missing(spark, ";".join(statements))


def setup_namespaces(spark: SparkSession, databases: dict[str, str]) -> int:
    """Create the tables of the other namespaces; ``databases`` maps each namespace to its database."""
    return tables.create_if_missing(spark, schemas.EMPTY_TABLES.format(**databases))


def _coerce(spec: Dataset, name: str, kind: T.DataType) -> Column:
    is_text = isinstance(kind, T.StringType)
    if name in spec.dates:
        return strict_date(name)
    if name in spec.lenient_dates:
        return lenient_date(name)
    if name in spec.integers:
        return to_integer(name, is_text)
    if name in spec.blank_texts:
        return fill_blank(name)
    if name == "code" and spec.padded:
        return pad_code(name)
    if name in spec.texts:
        return F.col(name).cast("string")
    return to_number(name, is_text)


def flatten_reason(landed: DataFrame) -> DataFrame:
    """The nested publication reason as six text columns."""
    if "PubReason" not in landed.columns:
        return landed
    present = landed.schema["PubReason"].dataType.fieldNames()
    members = {m: a for m, a in schemas.PUB_REASON.items() if m in present}
    absent = [F.lit("").alias(a) for m, a in schemas.PUB_REASON.items() if m not in present]
    rest = [c for c in landed.columns if c != "PubReason"]
    return landed.select(*rest, *flatten_struct("PubReason", members), *absent)


def _named(landed: DataFrame, spec: Dataset) -> DataFrame:
    """Landed columns under their stored names, still as they came."""
    aliases = spec.alias_map(landed.columns)
    if spec.name == "daily_margin_interest":
        landed = flatten_reason(landed)
        aliases = {**aliases, **{a: a for a in schemas.PUB_REASON.values()}}
    named = rename_map(landed, {**aliases, SEQUENCE: SEQUENCE})
    for column, value in spec.constants.items():
        named = named.withColumn(column, F.lit(value))
    for column in spec.blank_texts:
        if column in spec.keys and column not in named.columns:
            named = named.withColumn(column, F.lit(""))
    return named


def missing_keys(landed: DataFrame, spec: Dataset) -> list[str]:
    """Key columns that a batch lacks; it cannot be stored then."""
    return missing_columns(_named(landed, spec), spec.keys)


def unknown(landed: DataFrame, spec: Dataset) -> list[str]:
    """Landed columns that have no place in the stored table."""
    known = {**spec.alias_map(landed.columns), SEQUENCE: SEQUENCE}
    if spec.name == "daily_margin_interest":
        known["PubReason"] = "PubReason"
    return unknown_columns(landed, known)


def _typed(landed: DataFrame, spec: Dataset) -> DataFrame:
    named = _named(landed, spec)
    ordered = SEQUENCE in named.columns
    columns = [c for c in named.columns if c != SEQUENCE]
    return named.select(
        *[_coerce(spec, c, named.schema[c].dataType).alias(c) for c in columns],
        (F.col(SEQUENCE) if ordered else F.monotonically_increasing_id()).alias(SEQUENCE),
    )


def normalise(landed: DataFrame | list[DataFrame], spec: Dataset) -> DataFrame | None:
    """Landed records in the shape of the stored table; None when a key column is missing.

    Frames of several spellings are each read by their own, then put together by the stored names; one without a key
    column is left out. The first record of a key counts over all frames.
    """
    frames = landed if isinstance(landed, list) else [landed]
    typed = [_typed(f, spec) for f in frames if not missing_keys(f, spec)]
    if not typed:
        return None
    rows = typed[0]
    for other in typed[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    if spec.unique:
        rows = first_per_key(rows, list(spec.unique), SEQUENCE)
    rows = rows.drop(SEQUENCE)
    return rows.withColumn("_fetched_at", F.current_timestamp()) if spec.stamped else rows


def store(rows: DataFrame, spec: Dataset, table: str) -> int:
    """Write normalised rows the way of their dataset."""
    if spec.replace:
        return tables.overwrite(rows, table)
    unique = bool(spec.unique) and set(spec.unique) <= set(spec.keys)
    return tables.upsert(rows, table, list(spec.keys), match_types=spec.safe_types, date_column=spec.by, keys_unique=unique)


def run(landed: DataFrame | list[DataFrame], spec: Dataset, table: str) -> int:
    """Normalise and store one batch; returns its row count, 0 for a skipped batch."""
    rows = normalise(landed, spec)
    return 0 if rows is None else store(rows, spec, table)


def run_bulk(
    landed: DataFrame | list[DataFrame], spec: Dataset, table: str, start: date | None = None, end: date | None = None
) -> int:
    """First load: all files at once, optionally a date range, replacing the table."""
    rows = normalise(landed, spec)
    if rows is None:
        return 0
    if spec.name == "financial_summary":
        rows = rows.filter(F.col(spec.by).isNotNull())
    return tables.load_files(date_slice(rows, start, end, spec.by), table, spec.by, list(spec.keys))


def backfill(landed: DataFrame, spec: Dataset, table: str, start: date, end: date) -> int:
    """A date range in one read and one upsert; nothing to do when the range is empty.

    A record whose date cannot be read is left out with its day, it does not stop the range.
    """
    if start > end:
        return 0
    lenient = replace(spec, dates=tuple(n for n in spec.dates if n != spec.by), lenient_dates=(*spec.lenient_dates, spec.by))
    rows = normalise(landed, lenient)
    return 0 if rows is None else store(date_slice(rows, start, end, spec.by), spec, table)


def run_holdings(trades: DataFrame, table: str) -> int:
    """Trades may carry either spelling of a product type; the stored positions have one."""
    return tables.overwrite(portfolio.positions(trades.withColumn("product_type", canonical_product_type())), table)


def run_external_prices(
    quotes: DataFrame, tickers: DataFrame, holdings: DataFrame, proxies: DataFrame, as_of: date, table: str
) -> int:
    return tables.overwrite(portfolio.external_prices(quotes, tickers, holdings, proxies, as_of), table)


# The datasets of each run in order, and those whose failure stops the run.
DAILY = [
    "equity_master", "daily_bars", "minute_bars", "financial_summary", "topix", "indices", "short_selling",
    "earnings_calendar", "trading_calendar", "index_options", "short_sale_report", "daily_margin_interest",
]
INIT = [
    "equity_master", "daily_bars", "minute_bars", "financial_summary", "topix", "indices", "margin_interest",
    "short_selling", "investor_types", "earnings_calendar", "trading_calendar", "index_options",
    "short_sale_report", "daily_margin_interest",
]
WEEKLY = ["margin_interest", "investor_types"]
MUST_SUCCEED = {
    "daily": {"equity_master", "daily_bars", "financial_summary", "topix", "indices"},
    "init": {"equity_master", "daily_bars", "minute_bars", "financial_summary", "topix"},
    "weekly": {"margin_interest"},
}
GROUPS = {"daily": DAILY, "init": INIT, "weekly": WEEKLY}
BULK = {"daily_bars", "financial_summary"}


def table_name(database: str, dataset: str) -> str:
    """TOPIX and the other indices share one table."""
    return f"{database}.{'index_bars' if dataset in ('topix', 'indices') else dataset}"


#: One line of a run log for each dataset, and their total.
LOG = (
    "dataset string, rows bigint, status string, cause string, unknown_columns array<string>, skipped_files array<string>, "
    "skipped_days array<date>"
)


def run_group(
    spark: SparkSession,
    group: str,
    landed: dict[str, Callable[[], DataFrame | BulkLoad]],
    database: str,
    only_due: Callable[[DataFrame, Dataset, str], tuple[DataFrame, list[date]]] | None = None,
) -> DataFrame:
    """Run the datasets of a group and return the run log (:data:`LOG`): rows and status (ok, skipped, failed) of each.

    A dataset that may fail counts 0 when it does, with the cause in the log; a required one raises, also when its keys are
    missing. Columns without a place in the table, files left out and days beyond the reach of a run are named. The daily
    run first restores tables that are missing. ``only_due`` (see :mod:`equiscan.streaming.catchup`) picks the rows that a
    dataset still lacks.
    """
    if group == "daily":
        setup(spark, database)
    lines = []
    for name in GROUPS[group]:
        spec, table = DATASETS[name], table_name(database, name)
        rows, status, cause, extra, files, days = 0, "ok", None, [], [], []
        try:
            batch = landed[name]()
            frames = batch.frames if isinstance(batch, BulkLoad) else [batch]
            files = [f"{path}: {why}" for path, why in batch.skipped] if isinstance(batch, BulkLoad) else []
            extra = sorted({c for f in frames for c in unknown(f, spec)})
            gaps = {k for f in frames for k in missing_keys(f, spec)}
            if not frames or all(missing_keys(f, spec) for f in frames):
                raise MissingKeys(f"no file with the key columns {', '.join(sorted(gaps) or spec.keys)}")
            if group == "init" and name in BULK:
                rows = run_bulk(frames, spec, table)
            elif only_due and not spec.replace and spec.by:
                due, days = only_due(normalise(frames, spec), spec, table)
                rows = store(due, spec, table)
            else:
                rows = run(frames, spec, table)
            if gaps:
                cause = f"some files lack {', '.join(sorted(gaps))}"
        except Exception as error:
            if name in MUST_SUCCEED[group]:
                raise
            status = "skipped" if isinstance(error, MissingKeys) else "failed"
            cause = f"{type(error).__name__}: {(str(error).splitlines() or [''])[0][:300]}"
        lines.append((name, rows, status, cause, extra, files, days))
    worst = next((s for s in ("failed", "skipped") if any(line[2] == s for line in lines)), "ok")
    lines.append(("total", sum(line[1] for line in lines), worst, None, [], [], []))
    return spark.createDataFrame(lines, LOG)


class MissingKeys(ValueError):
    """A batch lacks key columns of its dataset."""
