"""Texts of results: numbers, sizes, times, CSV cells, and names in one spelling."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TICKS_PER_SECOND = 10_000_000
#: Ticks (100 ns since the year 1) at 1970-01-01.
UNIX_TICKS = 621_355_968_000_000_000
UNITS = ("B", "KB", "MB", "GB", "TB")


def grouped(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n, 0)


def byte_text(n: Column) -> Column:
    """512 B, 1.5 KB, 2 MB: steps of 1024 up to TB, two decimals at most."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i in range(1, len(UNITS)):
        value = F.round(n.cast("double") / float(1024**i), 2)
        short = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), "0+$", ""), r"\.$", "")
        out = F.when(n >= 1024**i, F.concat(short, F.lit(f" {UNITS[i]}"))).otherwise(out)
    return out


def bytes_of_input(value: Column, fallback: int, none_is_most: bool = False) -> Column:
    """A number field as bytes: NaN is the fallback (or the most), infinities the fallback; cut, at least 0, saturated."""
    most = (1 << 63) - 1
    whole = F.greatest(F.lit(0.0), F.when(value >= 0, F.floor(value)).otherwise(0.0)).cast("long")
    return F.when(F.isnan(value), F.lit(most if none_is_most else fallback)).when(value.isin(float("inf"), float("-inf")), F.lit(fallback)).when(value >= float(most), F.lit(most)).otherwise(whole)


def span_text(ticks: Column) -> Column:
    """[-][d.]hh:mm:ss[.fffffff]"""
    a = F.abs(ticks)
    rest = a % TICKS_PER_SECOND
    seconds = ((a - rest) / TICKS_PER_SECOND).cast("long")
    days = F.floor(seconds / 86400)
    clock = F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600) % 24, F.floor(seconds / 60) % 60, seconds % 60)
    return F.concat(F.when(ticks < 0, "-").otherwise(""), F.when(days > 0, F.concat(days.cast("string"), F.lit("."))).otherwise(""), clock, F.when(rest > 0, F.format_string(".%07d", rest)).otherwise(""))


def span(ticks: int) -> str:
    """span_text() of one number."""
    seconds, rest = divmod(abs(ticks), TICKS_PER_SECOND)
    days, clock = divmod(seconds, 86400)
    out = f"{clock // 3600:02d}:{clock // 60 % 60:02d}:{clock % 60:02d}"
    return f"{'-' if ticks < 0 else ''}{f'{days}.' if days else ''}{out}{f'.{rest:07d}' if rest else ''}"


def number_text(value: Column) -> Column:
    """A number without a needless .0"""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def editor_unit(bytes_: Column) -> Column:
    """The largest unit (a place in UNITS) of which a number of bytes is a whole multiple; 0 for none, NaN and null."""
    out = F.lit(0)
    for i in range(1, len(UNITS)):
        out = F.when((bytes_ > 0) & ~F.isnan(bytes_.cast("double")) & (bytes_ % 1024**i == 0), i).otherwise(out)
    return out


def utc_text(ticks: Column) -> Column:
    """2024-01-02T03:04:05.0000006Z: seven decimals."""
    rest = ticks % TICKS_PER_SECOND
    seconds = ((ticks - rest) / TICKS_PER_SECOND - UNIX_TICKS // TICKS_PER_SECOND).cast("long")
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.format_string(".%07dZ", rest))


def csv_cell(text: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line end; null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def map_json(entries: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


@F.pandas_udf(T.StringType())
def compatible(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition (NFKC), which Spark has no function for."""
    for part in parts:
        yield part.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def search_key(text: Column) -> Column:
    """A title or artist in one spelling: NFKC, small letters, runs of white space and punctuation as one blank.

    Plain ASCII texts, which NFKC leaves as they are, stay in the JVM.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    return spelled(F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(compatible(text)))


def spelled(text: Column) -> Column:
    """search_key() of texts that are in compatibility form already."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[\p{P}\s]+", " "), "^ | $", "")
