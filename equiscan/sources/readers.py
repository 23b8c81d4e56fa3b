"""Readers for landed API pages, bulk CSV files and stored tables.

Landed records carry ``_seq``, their place in the input (file, then position in it), so that "the first record of a key"
means the same however Spark orders the files.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiscan.operators.filters import date_slice
from equiscan.session import staged
from equiscan.sources import streams

SEQUENCE = "_seq"


def _as_text(kind: T.DataType) -> T.DataType:
    """The same shape with every value as text; mixed values are the text of their JSON."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.VariantType, T.NullType)):
        return T.ArrayType(_as_text(kind.elementType))
    return T.StringType()


def _record_schema(records: DataFrame) -> T.StructType:
    """All fields of the JSON texts in ``records``, values as text."""
    shape = records.agg(F.schema_of_variant_agg(F.try_parse_json("json")).alias("shape")).first()["shape"]
    if not shape or not shape.startswith("OBJECT<"):
        return T.StructType([])
    return _as_text(T.StructType.fromDDL(f"r {shape.replace('OBJECT<', 'STRUCT<')}")["r"].dataType)


def read_pages(spark: SparkSession, path: str, record: T.StructType | None = None) -> DataFrame:
    """API response pages, each a JSON document with a ``data`` array of records, as one table with ``_seq``.

    A file holds one document over any number of lines, or several after each other; it may be packed with gzip. A task
    reads its files block by block and passes on one record after the other, so a file may be larger than a task's memory.
    A file that ends inside a document stops the read. Records are parsed by ``record``; without it the fields of all
    records are collected first, in a pass of its own over the files as they were listed, and the values are text. Nothing
    is staged: the pages may be much smaller than the texts they unpack to.
    """
    files = streams.listed(spark, path)
    if record is None:
        record = _record_schema(files.mapInArrow(streams.page_shapes, streams.PAGE_RECORDS))
    records = files.mapInArrow(streams.page_records, streams.PAGE_RECORDS)
    place = F.struct("file", F.col("document").alias("block"), "place")
    parsed = F.from_json("json", record).alias("r") if len(record) else F.struct(F.lit(None).alias("_")).alias("r")
    return records.select(parsed, place.alias(SEQUENCE)).select(*[F.col(f"r.`{f}`") for f in record.names], SEQUENCE)


@dataclass(frozen=True)
class BulkLoad:
    """``frames``: the rows of the files that share a header, every column as text, with ``_seq``; ``skipped``: path and cause."""

    frames: list[DataFrame]
    skipped: list[tuple[str, str]] = field(default_factory=list)


#: Damaged files that are named in a filter; more of them are joined away.
NAMED_FILES = 200


def read_bulk_csv(spark: SparkSession, paths: str | list[str]) -> BulkLoad:
    """Gzip or plain CSV files, each with a header of its own; types are the job's business.

    Every file is read once, as a stream: its rows go to a staged table, and its last line there says how it ended. The
    rows are put together by groups of equal headers, so no layout is imposed on another. A file that cannot be unpacked
    to its end is left out whole and named with its cause. What reaches the driver is a line for each file.
    """
    rows = staged(streams.listed(spark, paths).mapInArrow(streams.csv_rows, streams.CSV_ROWS), "bulk-rows")
    ends = rows.where("cells IS NULL").select("file", "header", "cause")
    files = ends.orderBy("file").collect()
    skipped = [(f["file"], f["cause"]) for f in files if f["cause"] is not None]
    if len(skipped) > NAMED_FILES:
        rows = rows.join(ends.where("cause IS NOT NULL").select("file"), "file", "left_anti")
    elif skipped:
        rows = rows.where(~F.col("file").isin([path for path, _ in skipped]))
    frames = []
    for header in dict.fromkeys(f["header"] for f in files if f["cause"] is None):
        names: list[str] = []
        for i, name in enumerate(next(csv.reader([header]))):
            names.append(name if name and name not in names else f"_column{i}")
        place = F.struct("file", F.lit(0).cast("long").alias("block"), "place").alias(SEQUENCE)
        cells = [F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(names)]
        frames.append(rows.where((F.col("header") == header) & F.col("cells").isNotNull()).select(*cells, place))
    return BulkLoad(frames, skipped)


def read_slice(df: DataFrame, start: date | None = None, end: date | None = None, column: str = "date") -> DataFrame:
    return date_slice(df, start, end, column)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
