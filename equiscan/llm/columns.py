"""Column expressions that several operators share; all of them are evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words of letters and digits: every other ASCII character.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case, every other character as it is; plain ASCII texts take the quicker function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words_of(text: Column) -> Column:
    """Lower-cased words of letters, digits and characters beyond ASCII; none for null."""
    return F.array_remove(F.split(lower_ascii(text), WORD_BREAK), "")


def row_key(*columns: Column | str) -> Column:
    """A 64-bit key of a row by its content: equal for repeated rows, which have equal results."""
    return F.xxhash64(*columns)
