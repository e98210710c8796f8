"""Scalar expressions shared by the operators; all of them are built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def parse_ts(date: Column, time: Column) -> Column:
    return F.to_timestamp(F.concat_ws(" ", date, time), TIMESTAMP_FORMAT)


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end``."""
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def whole_minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes, truncated toward zero."""
    return F.call_function("div", seconds_between(start, end), F.lit(60))


def days_between(start: Column, end: Column) -> Column:
    """Days with their fraction."""
    return seconds_between(start, end) / F.lit(86400.0)


def add_hours(ts: Column, hours: int) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(hours))


def local_now(zone: str = "Australia/Melbourne") -> Column:
    return F.from_utc_timestamp(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), zone)


def cap(ratio: Column) -> Column:
    """min(1, ratio); a null ratio stays null, where a plain ``least`` would give 1."""
    return F.when(ratio.isNotNull(), F.least(F.lit(1.0).cast("double"), ratio))


def null_marker(text: Column) -> Column:
    """The two characters backslash and N stand for NULL in the metadata files."""
    return F.nullif(text, F.lit("\\N"))


def split_csv(text: Column) -> Column:
    """Comma-separated list to array; empty elements are kept."""
    return F.split(text, ",", -1)


def stable_id(name: Column) -> Column:
    """Non-negative id from a name, the same on every run and regardless of case."""
    return F.crc32(F.lower(name).cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF))


def blank(text: Column) -> Column:
    return text.isNull() | (text == "")


def not_blank(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def content_key(*columns: Column) -> Column:
    """128-bit row key made from the natural key; 64 bits would collide at tens of billions of rows."""
    return F.md5(F.concat_ws("\x1f", *[c.cast("string") for c in columns]).cast("binary"))
