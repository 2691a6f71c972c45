"""Declared schemas of the message, the layers and the serving rows. They need a running session."""

from __future__ import annotations

from pyspark.sql import types as T

# The fields of a change message, in order.
MESSAGE_FIELDS = ("op", "event_ts", "customer_id", "name", "status", "updated_at", "source")

# With the source's sequence, for producers of our own.
SEQUENCED_FIELDS = (*MESSAGE_FIELDS, "seq")

BRONZE_PARTITIONS = ("rejected", "updated_day")
GOLD_PARTITIONS = ("day",)
SERVING_ORDER = ("day", "customer_status")


def message_schema(key: str = "customer_id", key_type: str = "int") -> T.StructType:
    """Change message. Fields marked not-null are required; `seq` is an optional source sequence."""
    return T.StructType.fromDDL(
        f"op string NOT NULL, event_ts string NOT NULL, {key} {key_type} NOT NULL, name string, status string, "
        "updated_at string NOT NULL, source string, seq bigint"
    )


def bronze_schema(key: str = "customer_id", key_type: str = "int", ts_type: str = "timestamp") -> T.StructType:
    """Typed events plus the quarantine columns; `rejected` and `updated_day` are partition columns."""
    return T.StructType.fromDDL(
        f"op string, event_ts {ts_type}, {key} {key_type}, name string, status string, updated_at {ts_type}, "
        "source string, seq bigint, source_ts timestamp, source_part string, source_pos bigint, ingest_ts timestamp, "
        "reject_id string, reject_reason string, raw string, rejected boolean, updated_day date"
    )


def commit_schema(ts_type: str = "timestamp") -> T.StructType:
    """Watermark log; one row per finished run of a pipeline, with the dimension it left."""
    return T.StructType.fromDDL(
        f"pipeline string, updated_at_gte {ts_type}, written_at timestamp, "
        "version bigint, run bigint, buckets int, batch_id bigint, stream string, "
        "positions map<string,bigint>, read_at timestamp"
    )


def gold_schema() -> T.StructType:
    return T.StructType.fromDDL("day date, customer_status string, cnt bigint")
