"""Landed files as streams: Spark lists them and packs them into tasks by size, a task opens its files and reads them block
by block, so that memory does not grow with a file. Page files yield the text of one record at a time, CSV files a row.
"""

from __future__ import annotations

import csv
import gzip
import io
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiscan.session import ship_package

#: Characters read at once, and of one batch of results; rows of a batch.
BLOCK_CHARS, BATCH_CHARS, BATCH_ROWS = 1 << 20, 4 << 20, 8_192
#: Sets of fields that a task remembers.
MOST_SHAPES = 10_000
#: Stores that tasks can open by themselves. Files of any other are handed over by Spark, whole, up to 2 GB each.
STREAMED = {"file", "hdfs", "s3", "s3a", "gs", "abfss"}

PAGE_RECORDS = "file string, document long, place long, json string"
CSV_ROWS = "file string, header string, place long, cells array<string>, cause string"

# A JSON string; a record without objects or arrays in it; whatever decides where a value ends.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_FLAT = re.compile(rf'\{{[^"{{}}\[\]]*+(?:{_STRING}[^"{{}}\[\]]*+)*+\}}', re.DOTALL)
_TOKEN = re.compile(rf'{_STRING}|["{{}}\[\]]', re.DOTALL)
# A record, without white space, of strings without escapes.
_PLAIN = r'"[^"\\\x00-\x1f]*+"'
_TEXT_ONLY = re.compile(rf"\{{{_PLAIN}:{_PLAIN}(?:,{_PLAIN}:{_PLAIN})*+\}}")


def listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, content): the files below ``paths``; content is NULL for those that a task opens itself."""
    ship_package(spark)
    wanted = [paths] if isinstance(paths, str) else paths
    schemes = set()
    for path in wanted:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        schemes.add(where.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme())
    content = F.lit(None).cast("binary").alias("content") if schemes <= STREAMED else F.col("content")
    return spark.read.format("binaryFile").load(wanted).select("path", content)


def opened(path: str, content: bytes | None) -> BinaryIO:
    """The bytes of a file as a stream, unpacked if it is a gzip file; damage shows as an error where it is met."""
    scheme, _, rest = path.partition(":")
    if content is not None:
        raw = io.BytesIO(content)
    elif scheme == "file" or not rest:
        raw = open(re.sub("^/+", "/", rest or path), "rb")  # noqa: SIM115
    else:
        from pyarrow import fs

        store, inside = fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", path))
        raw = store.open_input_stream(inside)
    return gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw


def text_of(path: str, content: bytes | None) -> io.TextIOWrapper:
    return io.TextIOWrapper(opened(path, content), encoding="utf-8-sig", errors="replace", newline="")


def _plain_end(text: str, start: int) -> int:
    """:func:`_record_end` at the speed of a search, for an object with nothing nested and no escapes; -1 for any other."""
    end = text.find("}", start)
    if end < 0:
        return -1
    inside = text[start + 1 : end]
    plain = not ("{" in inside or "[" in inside or "]" in inside or "\\" in inside or inside.count('"') % 2)
    return end + 1 if plain else -1


def _record_end(text: str, start: int) -> int:
    """Where the object that begins at ``start`` ends; -1 if it goes on beyond ``text``."""
    if flat := _FLAT.match(text, start):
        return flat.end()
    depth = 0
    for token in _TOKEN.finditer(text, start):
        kind = token.group()
        if kind in "{[":
            depth += 1
        elif kind in "}]":
            depth -= 1
            if not depth:
                return token.end()
        elif kind == '"':  # a string that is not whole yet
            return -1
    return -1


def records_of(text: io.TextIOBase, block: int = BLOCK_CHARS) -> Iterator[tuple[int, int, str]]:
    """(document, place, json) of the objects in the ``data`` array of each JSON document of a stream.

    Documents follow each other with any white space between them. What is held is one block or one record, whichever is
    longer. A stream that ends inside a document is an error.
    """
    held, at, size = "", 0, block
    within: list[str] = []
    name, document, place = "", -1, 0
    while True:
        more = text.read(size)
        held, at = held[at:] + more, 0
        waiting = False
        while token := _TOKEN.search(held, at):
            kind = token.group()
            if kind == '"':
                waiting = True
                at = token.start()
                break
            if kind == "{" and within == ["{", "["] and name == '"data"':
                end = _record_end(held, token.start())
                if end < 0:
                    waiting = True
                    at = token.start()
                    break
                yield document, place, held[token.start() : end]
                place, at = place + 1, end
                while held.startswith(",{", at) and (end := _plain_end(held, at + 1)) > 0:
                    yield document, place, held[at + 1 : end]
                    place, at = place + 1, end
                continue
            at = token.end()
            if kind in "{[":
                if not within:
                    document += 1
                if len(within) == 1:
                    place = 0
                within.append(kind)
            elif kind in "}]":
                if not within or within.pop() != "{["["}]".index(kind)]:
                    raise ValueError(f"unbalanced {kind} in document {document}")
            elif len(within) == 1:
                name = kind  # the last string before an array is its name
        if not waiting:
            at = len(held)
        if not more:
            if within or waiting:
                raise ValueError(f"the file ends inside document {document}")
            return
        # Reading ever more for one long value keeps its repeated scans proportional to its length.
        size = max(block, len(held) - at)


def page_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of :data:`PAGE_RECORDS` from (path, content)."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield from _in_batches(path, _records(path, content.as_py()))


def page_shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """:func:`page_records` without those records that are sure to have the same fields as an earlier one of the task."""
    seen: set[tuple[str, ...]] = set()

    def new(records: Iterator[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
        for row in records:
            names = _text_fields(row[2])
            if names is None:
                yield row
            elif names not in seen:
                if len(seen) < MOST_SHAPES:
                    seen.add(names)
                yield row

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield from _in_batches(path, new(_records(path, content.as_py())))


def _text_fields(record: str) -> tuple[str, ...] | None:
    """The names of a record's fields if all its values are plain strings; None if they are not, or that is not plain to see."""
    return tuple(record.split('"')[1::4]) if len(record) < BLOCK_CHARS and _TEXT_ONLY.fullmatch(record) else None


def _records(path: str, content: bytes | None) -> Iterator[tuple[int, int, str]]:
    with text_of(path, content) as text:
        try:
            yield from records_of(text)
        except (ValueError, OSError, EOFError, zlib.error) as error:
            raise ValueError(f"{path}: {error}") from error


def _in_batches(path: str, records: Iterator[tuple[int, int, str]]) -> Iterator[pa.RecordBatch]:
    rows, chars = [], 0
    for row in records:
        rows.append(row)
        chars += len(row[2])
        if len(rows) == BATCH_ROWS or chars >= BATCH_CHARS:
            yield _batch(path, rows)
            rows, chars = [], 0
    if rows:
        yield _batch(path, rows)


def _batch(path: str, rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    documents, places, texts = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict(
        {"file": [path] * len(rows), "document": pa.array(documents, pa.int64()), "place": pa.array(places, pa.int64()), "json": pa.array(texts, pa.string())}
    )


def csv_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of :data:`CSV_ROWS` from (path, content): the rows of each file, then one without cells that says how it ended.

    Quotes may hold commas and line breaks, an empty cell is NULL unless it is quoted, empty lines count for nothing. A
    file that breaks off has passed on rows before that shows: its last row names the cause.
    """
    csv.field_size_limit(1 << 30)
    kind = pa.list_(pa.string())

    def out(path: str, header: str | None, first: int, cells: list, cause: str | None = None) -> pa.RecordBatch:
        n = len(cells)
        return pa.RecordBatch.from_pydict(
            {
                "file": [path] * n,
                "header": pa.array([header] * n, pa.string()),
                "place": pa.array(range(first, first + n), pa.int64()),
                "cells": pa.array(cells, kind),
                "cause": pa.array([cause] * n, pa.string()),
            }
        )

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            header, cause, first, cells, chars = None, None, 0, [], 0
            try:
                with text_of(path, content.as_py()) as text:
                    header = text.readline().rstrip("\r\n")
                    for row in csv.reader(text, quoting=csv.QUOTE_NOTNULL):
                        if row:
                            cells.append(row)
                            chars += sum(map(len, filter(None, row)))
                            if len(cells) == BATCH_ROWS or chars >= BATCH_CHARS:
                                yield out(path, header, first, cells)
                                first, cells, chars = first + len(cells), [], 0
                cause = None if header else "no header"
            except (OSError, EOFError, zlib.error, csv.Error) as error:
                cause = f"{type(error).__name__}: {error}"
            if cells:
                yield out(path, header, first, cells)
            yield out(path, header, first + len(cells), [None], cause)
