"""Column functions for raw post fields: names, literal lists, clocks, keys and guarded arithmetic."""

from __future__ import annotations

import ast
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from crestline.config import Band

#: Cells that stand for nothing.
NULLISH = ("", "[]", "nan", "None")


def stripped(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_topic(c: Column) -> Column:
    """A topic's name: without '.csv', leading '#' and outer white space, in lower case; null gives ''."""
    name = F.regexp_replace(stripped(c), r"(?i)\.csv$", "")
    return F.coalesce(F.lower(stripped(F.regexp_replace(name, "^#+", ""))), F.lit(""))


def _as_json(c: Column) -> Column:
    """A printed Python list as JSON text, as far as patterns can do that."""
    for word, to in (("None", "null"), ("True", "true"), ("False", "false")):
        c = F.regexp_replace(c, rf"([:,\[]\s*){word}\b", f"$1{to}")
    return c


_OPTIONS = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}


def _evaluated(cell) -> list | None:
    try:
        got = ast.literal_eval(cell)
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return None
    return got if isinstance(got, list) else None


@cache
def _python_list():
    """Made at first use: it needs a session."""

    @F.pandas_udf("array<string>")
    def lists(cells: pd.Series) -> pd.Series:
        return cells.map(lambda x: [str(y) for y in got] if x is not None and (got := _evaluated(x)) is not None else None)

    return lists


@cache
def _python_names():
    def names(x):
        got = _evaluated(x) if x is not None else None
        return None if got is None else [str(y["screen_name"]) for y in got if isinstance(y, dict) and y.get("screen_name")]

    @F.pandas_udf("array<string>")
    def lists(cells: pd.Series) -> pd.Series:
        return cells.map(names)

    return lists


def _filled(c: Column) -> Column:
    return F.when(c.isNotNull() & ~stripped(c).isin(*NULLISH), c)


def parse_tags(c: Column, fallback: bool = False) -> Column:
    """Cleaned tags of a printed list of strings; anything else gives an empty list.

    ``fallback`` sends cells that JSON reading refuses through Python's own literal reader.
    """
    cell = _filled(c)
    got = F.from_json(_as_json(cell), "array<string>", _OPTIONS)
    if fallback:
        got = F.coalesce(got, _python_list()(F.when(got.isNull(), cell)))
    tags = F.transform(F.filter(got, lambda x: x.isNotNull()), clean_topic)
    listed = F.when(F.startswith(stripped(c), F.lit("[")), F.filter(tags, lambda t: t != ""))
    return F.coalesce(listed, F.array().cast("array<string>"))


def parse_screen_names(c: Column, fallback: bool = False) -> Column:
    """Lower-cased ``screen_name`` values of a printed list of dictionaries; anything else gives an empty list."""
    cell = _filled(c)
    got = F.from_json(_as_json(cell), "array<struct<screen_name:string>>", _OPTIONS)
    names = F.transform(got, lambda x: x["screen_name"])
    if fallback:
        names = F.coalesce(names, _python_names()(F.when(got.isNull(), cell)))
    cleaned = F.transform(F.filter(names, lambda x: x.isNotNull()), lambda x: F.lower(stripped(x)))
    listed = F.when(F.startswith(stripped(c), F.lit("[")), F.filter(cleaned, lambda x: x != ""))
    return F.coalesce(listed, F.array().cast("array<string>"))


def time_to_seconds(c: Column) -> Column:
    """Seconds of a strict HH:MM:SS clock, else null."""
    part = lambda at: F.substring(c, at, 2).cast("int")
    return F.when(c.rlike(r"^[0-9]{2}:[0-9]{2}:[0-9]{2}$"), part(1) * 3600 + part(4) * 60 + part(7))


def bin_of(date: Column, clock: Column, band: Band) -> Column:
    """The bin of a date and a clock in ``band``, else null."""
    second = time_to_seconds(clock)
    inside = (date == band.date) & second.between(band.start_second, band.end_second)
    if band.drop_dates:
        inside = inside & ~date.isin(*band.drop_dates)
    return F.when(inside, F.floor((second - band.start_second) / band.bin_seconds).cast("int"))


def bin_of_timestamp(ts: Column, start: str, bin_seconds: int) -> Column:
    """The bin of a timestamp on a grid that begins at ``start``."""
    return F.floor((F.unix_seconds(ts.cast("timestamp")) - F.unix_seconds(F.to_timestamp(F.lit(start)))) / bin_seconds).cast("int")


def bin_to_clock(b: Column, band: Band) -> Column:
    """The clock at which a bin begins."""
    second = b * band.bin_seconds + band.start_second
    return F.when(b.isNotNull(), F.format_string("%02d:%02d", F.floor(second / 3600).cast("int"), F.floor(second % 3600 / 60).cast("int")))


def text_key(c: Column) -> Column:
    """Sixteen hexadecimal digits of the text's SHA-1."""
    return F.substring(F.sha1(F.encode(c, "UTF-8")), 1, 16)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def clipped(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
