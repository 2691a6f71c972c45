"""Timestamps: ISO text and typed high-water-mark literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_seconds(ts: Column) -> Column:
    """ISO-8601 text with offset, cut to whole seconds."""
    return F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd'T'HH:mm:ssxxx")


def mark_text(ts: Column, ts_type: str) -> Column:
    """A timestamp as text that `literal_mark` restores exactly, without Python's local time."""
    if ts_type == "timestamp_ntz":
        return ts.cast("string")
    return F.unix_micros(ts).cast("string")


def literal_mark(text: str, ts_type: str) -> Column:
    """A constant of the column's own type, so that the bound reaches the Parquet scan."""
    if ts_type == "timestamp_ntz":
        return F.lit(text).cast("timestamp_ntz")
    return F.timestamp_micros(F.lit(int(text)))
