"""Column expressions; all are built-in Spark functions."""

from tidemark.functions.choice import hashed_bits, pick
from tidemark.functions.fingerprint import business_key, hashdiff
from tidemark.functions.messages import message_value, parse_timestamp
from tidemark.functions.times import iso_seconds, literal_mark, mark_text

__all__ = [
    "business_key",
    "hashdiff",
    "hashed_bits",
    "iso_seconds",
    "literal_mark",
    "mark_text",
    "message_value",
    "parse_timestamp",
    "pick",
]
