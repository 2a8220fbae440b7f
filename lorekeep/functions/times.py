"""Timestamps: parsing, rounding, infinity, day arithmetic and day spines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.sources.schemas import INFINITY

# fixed values: words for "never" in expiry fields
_FOREVER = ["infinity", "infinite", "indefinite", "never"]


def never() -> Column:
    return as_timestamp(INFINITY)


def as_timestamp(value: dt.datetime | str) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def parse_timestamp(text: Column) -> Column:
    """ISO timestamp or a word for infinity; empty and malformed text is NULL."""
    word = F.lower(F.trim(text))
    return (
        F.when(word.isin(_FOREVER), never())
        .when(word == "-infinity", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))
        .otherwise(_iso(text))
    )


def _iso(text: Column) -> Column:
    return F.regexp_replace(text, "Z$", "").try_cast("timestamp_ntz")


def format_timestamp(ts: Column) -> Column:
    return F.when(ts >= never(), F.lit("infinity")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def round_to_second(ts: Column) -> Column:
    """Half a second rounds up."""
    return F.when(ts >= as_timestamp("9999-12-31 23:59:59"), ts).otherwise(
        F.date_trunc("second", ts + F.expr("interval 500 milliseconds")).cast("timestamp_ntz")
    )


def days_between(start: Column, end: Column) -> Column:
    """Whole days from ``start`` to ``end``; both must be in this order."""
    return F.timestamp_diff("DAY", start, end)


def day_of(ts: Column) -> Column:
    return ts.cast("date")


def month_of(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "month")


def spine(bounds: DataFrame, first: str, last: str, unit: str, name: str) -> DataFrame:
    """One row per day or month of each row's ``first``..``last``, both included."""
    step = F.expr(f"interval 1 {unit}")
    return bounds.withColumn(name, F.explode(F.sequence(F.col(first), F.col(last), step)))


def month_edges(first: Column, last: Column) -> Column:
    """First days of the months that enclose ``first``..``last``, right edge included."""
    upper = F.add_months(month_of(last), 1)
    return F.sequence(month_of(first), upper, F.expr("interval 1 month"))
