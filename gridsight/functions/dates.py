"""Dates held as text: one format per column, unparseable values become null."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsight.functions import values as V


class DateFormat(NamedTuple):
    """A layout as a pattern and its rewriting to year-month-day order."""

    name: str
    pattern: str
    iso: str


_CLOCK = r"((?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)?)(?:Z)?"

# Tried in this order; the first wins a tie, so month-first precedes day-first.
FORMATS = (
    DateFormat("year-month-day", r"^\s*(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _CLOCK + r"\s*$",
               "$1-$2-$3$4"),
    DateFormat("month-day-year", r"^\s*(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})" + _CLOCK + r"\s*$",
               "$3-$1-$2$4"),
    DateFormat("day-month-year", r"^\s*(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})" + _CLOCK + r"\s*$",
               "$3-$2-$1$4"),
    DateFormat("yearmonthday", r"^\s*((?:19|20)\d{2})(\d{2})(\d{2})\s*$", "$1-$2-$3"),
    DateFormat("year-month", r"^\s*(\d{4})[-/](\d{1,2})\s*$", "$1-$2-01"),
)
# Month names go through Spark's own pattern parser.
NAMED_MONTHS = ("d MMM yyyy", "d-MMM-yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy")
FORMAT_NAMES = tuple(f.name for f in FORMATS) + NAMED_MONTHS


def parse(text: Column, name: str) -> Column:
    """Timestamp without zone from text in one layout; null where it does not fit."""
    for layout in FORMATS:
        if layout.name == name:
            iso = F.regexp_replace(text, layout.pattern, layout.iso)
            return F.when(text.rlike(layout.pattern), iso.try_cast("timestamp_ntz"))
    # Only text with a word in it reaches the pattern parser.
    return F.when(text.rlike("[A-Za-z]{3}"), F.try_to_timestamp(F.trim(text), F.lit(name))
                  .cast("timestamp_ntz"))


def choose_format(df: DataFrame, name: str) -> str:
    """The layout that parses most values of a text column, in one aggregate."""
    hits = df.agg(*[
        F.count(parse(V.col(name), fmt)).alias(f"f{i}") for i, fmt in enumerate(FORMAT_NAMES)
    ]).first()
    best = max(range(len(FORMAT_NAMES)), key=lambda i: (hits[i], -i))
    return FORMAT_NAMES[best]


def format_of(df: DataFrame, name: str) -> str | None:
    """The layout of a text column; None for columns that need none."""
    return choose_format(df, name) if isinstance(V.dtype_of(df, name), T.StringType) else None


def as_timestamp(df: DataFrame, name: str, fmt: str | None = None) -> Column:
    """A date column as timestamp without zone, whatever its physical type.

    Numbers count as nanoseconds since 1970, as in a bare numeric conversion.
    """
    dtype = V.dtype_of(df, name)
    if isinstance(dtype, V.TEMPORAL):
        return V.col(name).cast("timestamp_ntz")
    if V.is_numeric(dtype):
        micros = F.floor(V.as_number(df, name) / 1000).cast("bigint")
        return F.timestamp_micros(micros).cast("timestamp_ntz")
    if isinstance(dtype, T.StringType):
        return parse(V.col(name), fmt or choose_format(df, name))
    return F.lit(None).cast("timestamp_ntz")
