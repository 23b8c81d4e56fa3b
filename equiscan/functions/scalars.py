"""Null-safe arithmetic, coercion and text helpers.

Spark 4 runs in ANSI mode, so plain casts and divisions raise. The helpers here return NULL
where the data contract says "missing", and raise only where it says "must parse".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a price sheet may wrap around a number (currency signs, separators, unit words).
NUMBER_DECORATION = "[¥$,\\s\\u3000口株]"
# The date spellings a trade ledger uses (y/M/d, y-M-d, M/d/y) and where year, month and day stand in them; the
# last choice takes any other text, and leaves nothing of it.
_LEDGER_DATE = r"(?s)^(?:(\d{4})([/-])(\d{1,2})\2(\d{1,2})|(\d{1,2})/(\d{1,2})/(\d{4})|.*)\z"
_LEDGER_DATE_PARTS = "$1$7-$3$5-$4$6"

_DECIMAL_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def safe_divide(numerator: Column | str, denominator: Column | str) -> Column:
    """NULL on a zero denominator."""
    return F.try_divide(_c(numerator), _c(denominator))


def greatest_strict(*cols: Column | str) -> Column:
    """GREATEST that is NULL as soon as one argument is NULL."""
    columns = [_c(c) for c in cols]
    known = columns[0].isNotNull()
    for column in columns[1:]:
        known = known & column.isNotNull()
    return F.when(known, F.greatest(*columns))


def to_number(col: Column | str, is_text: bool = True) -> Column:
    """Text or number to double; anything unreadable, and NaN, becomes NULL."""
    column = _c(col)
    if is_text:
        return F.when(column.rlike(_DECIMAL_TEXT), column.try_cast("double"))
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


def to_integer(col: Column | str, is_text: bool = True) -> Column:
    """Number truncated to bigint; missing counts as 0."""
    return F.coalesce(to_number(col, is_text).try_cast("bigint"), F.lit(0).cast("bigint"))


def lenient_date(col: Column | str) -> Column:
    """ISO, compact or slashed date; NULL when none of them fits.

    A failed parse throws inside the formatter, so only text of the right shape gets that far.
    """
    column = _c(col)
    text = column.cast("string")
    return F.coalesce(
        column.try_cast("date"),
        F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd")),
        F.when(text.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_date(text, "yyyy/M/d")),
    )


def strict_date(col: Column | str) -> Column:
    """Like :func:`lenient_date`, but text that is present and unreadable fails the job."""
    column = _c(col)
    unreadable = F.raise_error(F.concat(F.lit("unreadable date: "), column.cast("string"))).cast("date")
    return F.coalesce(lenient_date(column), F.when(column.isNotNull(), unreadable))


def multi_format_date(col: Column | str) -> Column:
    """The date of a ledger spelling; NULL for any other text, or a day that no calendar has.

    One expression brings all spellings to the form that a plain cast reads: no formatter, and the text is computed once.
    """
    return F.regexp_replace(F.trim(_c(col)), _LEDGER_DATE, _LEDGER_DATE_PARTS).try_cast("date")


def number_text(col: Column | str) -> Column:
    """'¥1,900' or '5,299口' as a double; blank and '-' are NULL."""
    return to_number(F.regexp_replace(_c(col), NUMBER_DECORATION, ""))


def pad_code(col: Column | str, width: int = 5) -> Column:
    """Left-pad with zeros; a longer code is kept whole (``lpad`` alone would cut it)."""
    text = _c(col).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def local_code(col: Column | str) -> Column:
    """The four-character code of a longer one."""
    return F.substring(_c(col), 1, 4)


def append_market_digit(col: Column | str) -> Column:
    """Four digits get the trailing '0' of the five-character form; other codes pass."""
    column = _c(col)
    return F.when(column.rlike("^[0-9]{4}$"), F.concat(column, F.lit("0"))).otherwise(column)


def basis_code(code: Column | str, name: Column | str) -> Column:
    """Position key: the code, or the name where the code is absent or blank."""
    text = _c(code)
    return F.when(F.trim(text) != "", text).otherwise(_c(name))


def age_in_days(later: Column | str, earlier: Column | str) -> Column:
    return F.date_diff(_c(later), _c(earlier))


def partition_id_date(col: Column | str) -> Column:
    """'20240131' to a date."""
    return F.to_date(_c(col), "yyyyMMdd")


def flatten_struct(struct: str, fields: dict[str, str]) -> list[Column]:
    """Struct members as text columns, '' where the struct or the member is missing."""
    return [
        F.coalesce(F.col(f"{struct}.{member}").cast("string"), F.lit("")).alias(alias)
        for member, alias in fields.items()
    ]


def fill_blank(col: Column | str) -> Column:
    """Missing text as '' — needed where the column is a merge key."""
    return F.coalesce(_c(col).cast("string"), F.lit(""))


def safe_float(col: Column | str, default: float | None = None, is_text: bool = True) -> Column:
    return F.coalesce(to_number(col, is_text), F.lit(default).cast("double"))


def clip(col: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value on either side; NULL stays NULL."""
    column = _c(col)
    bounded = column
    if low is not None:
        bounded = F.greatest(bounded, F.lit(float(low)))
    if high is not None:
        bounded = F.least(bounded, F.lit(float(high)))
    return F.when(column.isNotNull(), bounded)


def bar_gauge(distance_pct: Column | str) -> Column:
    """0–20 % distance as a 0–100 gauge."""
    return clip(distance_pct, 0, 20) / 20 * 100


def blank_to_null(col: Column | str) -> Column:
    """Text placeholders for "nothing" become NULL on export."""
    text = _c(col).cast("string")
    # The placeholders a frame library prints for a missing cell.
    return F.when(~text.isin("", "nan", "None", "NaT", "<NA>"), text)
