"""Scalar column helpers; every one is a native Spark expression."""

from equiscan.functions.scalars import (  # noqa: F401
    age_in_days,
    append_market_digit,
    basis_code,
    bar_gauge,
    blank_to_null,
    clip,
    fill_blank,
    flatten_struct,
    greatest_strict,
    lenient_date,
    local_code,
    multi_format_date,
    number_text,
    pad_code,
    partition_id_date,
    safe_divide,
    safe_float,
    strict_date,
    to_integer,
    to_number,
)
