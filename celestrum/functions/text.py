"""Text helpers as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from celestrum.functions.coords import column


def tokenize(text, delimiters: str = " ") -> Column:
    """Pieces between any of the delimiters, empty ones left out."""
    pattern = "[" + "".join(re.escape(c) for c in delimiters) + "]"
    return F.filter(F.split(_c(text), pattern), lambda p: p != "")


def split_keep_empty(text, delimiters: str = ",") -> Column:
    return F.split(_c(text), "[" + "".join(re.escape(c) for c in delimiters) + "]")


def split_into(text, delimiter: str, n: int) -> Column:
    """At most n pieces; the last holds the rest."""
    return F.split(_c(text), re.escape(delimiter), n)


def split_distinct(text, delimiters: str = ",") -> Column:
    return F.array_sort(F.array_distinct(tokenize(text, delimiters)))


def parse_pairs(text, pair: str = ",", key: str = ":") -> Column:
    """`k:v,k:v` as a map."""
    return F.str_to_map(_c(text), F.lit(re.escape(pair)), F.lit(re.escape(key)))


def leading_int(text, default: int = 0) -> Column:
    """The integer a text begins with, after blanks; the default if it begins with none."""
    return F.coalesce(F.regexp_extract(_c(text), r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(default).cast("bigint"))


def leading_double(text, default: float = 0.0) -> Column:
    return F.coalesce(F.regexp_extract(_c(text), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(default))


def to_hex(number) -> Column:
    return F.lower(F.hex(_c(number)))


def from_hex(text) -> Column:
    return F.conv(_c(text), 16, 10).cast("bigint")


def format_float(number, digits: int = 6) -> Column:
    return F.format_string(f"%.{digits}f", column(number))


def format_time(seconds) -> Column:
    """Seconds of the epoch as `Thu, 01 Jan 1970 00:00:00 GMT`, in UTC sessions."""
    return F.date_format(F.timestamp_seconds(_c(seconds)), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x
