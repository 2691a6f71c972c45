"""JSON text of a row and tolerant timestamp parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Message timestamps are ISO-8601 with microseconds; zoned ones carry their offset.
JSON_FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def message_value(columns: Sequence[str]) -> Column:
    """The named columns as one JSON object; NULL fields are left out."""
    return F.to_json(F.struct(*[F.col(c) for c in columns]), JSON_FORMATS)


def parse_timestamp(text: Column, ts_type: str = "timestamp") -> Column:
    """ISO-8601 text to a timestamp; NULL for text that is none. Zoneless text is session time."""
    parsed = F.try_to_timestamp(text)
    return parsed if ts_type == "timestamp" else parsed.cast(ts_type)
