"""Raw messages to typed events and rejects, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import message_value, parse_timestamp

CORRUPT = "_corrupt"


def parse_cdc(
    messages: DataFrame,
    schema: T.StructType,
    ts_cols: Sequence[str] = ("event_ts", "updated_at"),
    day_of: str = "updated_at",
    ts_type: str = "timestamp",
) -> DataFrame:
    """Typed events with `reject_reason` (NULL for good rows), from `value` and `source_seq`.

    A message is rejected when it is NULL, is no JSON object of the schema's types, lacks a required
    field or has a required timestamp that is none. Unknown fields are dropped. Works on streams and
    batches alike; `ingest_ts` is constant within a micro-batch.

    `seq` is the message's own sequence, else its position. Positions of two partitions do not compare,
    so a message without a sequence also keeps the source's time in `source_ts`, which is ordered first.

    `source_part` and `source_pos` tell how far a source was read (`operators.positions`): where the
    messages name a part, that and their position, else the message's `source` and its sequence.
    """
    source_ts = F.col("source_ts") if "source_ts" in messages.columns else F.lit(None).cast("timestamp")
    source_part = F.col("source_part") if "source_part" in messages.columns else F.lit(None).cast("string")
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    # A generator is not merged with later filters, so each message is parsed once.
    positions = ["source_seq", source_ts.alias("source_ts"), source_part.alias("source_part")]
    parsed = messages.select(F.col("value").cast("string").alias("raw"), *positions).select(
        "raw", "source_seq", "source_ts", "source_part", F.inline(F.array(F.from_json("raw", with_corrupt, options)))
    )
    flat = parsed.select(
        "raw",
        "source_seq",
        "source_ts",
        "source_part",
        CORRUPT,
        *[F.col(f.name).alias(f"{f.name}_text") if f.name in ts_cols else F.col(f.name) for f in schema.fields],
        *[parse_timestamp(F.col(c), ts_type).alias(c) for c in ts_cols],
    )

    required = [f.name for f in schema.fields if not f.nullable]
    reason = F.when(F.col("raw").isNull(), F.lit("null_message"))
    reason = reason.when(F.col(CORRUPT).isNotNull() | (F.trim("raw") == ""), F.lit("malformed"))
    for name in required:
        text = f"{name}_text" if name in ts_cols else name
        reason = reason.when(F.col(text).isNull(), F.lit(f"missing_{name}"))
    for name in ts_cols:
        if name in required:
            reason = reason.when(F.col(name).isNull(), F.lit(f"bad_{name}"))

    judged = flat.withColumn("reject_reason", reason)
    is_rejected = F.col("reject_reason").isNotNull()
    own = F.col("seq") if "seq" in schema.names else F.lit(None).cast("bigint")
    source = F.col("source") if "source" in schema.names else F.lit(None).cast("string")
    placed = F.col("source_part").isNotNull()
    return judged.select(
        *[F.col(name) for name in schema.names if name != "seq"],
        F.coalesce(own, "source_seq").alias("seq"),
        F.when(own.isNull(), F.col("source_ts")).alias("source_ts"),
        F.when(placed, F.col("source_part")).otherwise(source).alias("source_part"),
        F.when(placed, F.col("source_seq")).otherwise(F.coalesce(own, "source_seq")).alias("source_pos"),
        F.current_timestamp().alias("ingest_ts"),
        F.lit(None).cast("string").alias("reject_id"),
        "reject_reason",
        F.when(is_rejected, F.col("raw")).alias("raw"),
        is_rejected.alias("rejected"),
        F.when(~is_rejected, F.to_date(day_of)).alias("updated_day"),
    )


def accepted(parsed: DataFrame, keep_malformed: bool = False) -> DataFrame:
    """Good events. `keep_malformed` also keeps every rejected message as an all-NULL event."""
    events = [c for c in parsed.columns if c not in ("reject_id", "reject_reason", "raw", "rejected")]
    if not keep_malformed:
        return parsed.where(~F.col("rejected")).select(*events)
    keep = {"ingest_ts", "seq", "source_part", "source_pos"}
    return parsed.select(
        *[F.col(c) if c in keep else F.when(~F.col("rejected"), F.col(c)).alias(c) for c in events]
    )


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("rejected")).select("reject_reason", "raw", "seq", "ingest_ts")


def once_within(parsed: DataFrame, key: str, bound: str) -> DataFrame:
    """A stream of parsed messages without what came before within `bound`, such as "7 days", of its arrival.

    A message is known by key and sequence, one without a sequence and a reject by their text. The state
    holds the messages of that time; the watermark is on arrival, so no row is ever late and dropped. Two
    equal rejects within the bound count as one.
    """
    text = F.coalesce("raw", F.to_json(F.struct(*[c for c in parsed.columns if c not in _OF_DELIVERY])))
    named = ~F.col("rejected") & F.col("seq").isNotNull() & F.col("source_ts").isNull()
    told = F.when(named, F.concat_ws(":", F.col(key).cast("string"), F.col("seq").cast("string"))).otherwise(
        F.concat(F.lit("text:"), F.sha2(text, 256)))
    known = parsed.withColumn("_told", F.coalesce(told, F.lit("null")))
    return known.withWatermark("ingest_ts", bound).dropDuplicatesWithinWatermark(["_told"]).drop("_told")


#: What a second delivery of the same message changes.
_OF_DELIVERY = ("ingest_ts", "source_ts", "source_part", "source_pos", "seq")


def cdc_messages(events: DataFrame, fields: Sequence[str], key: str | None = None) -> DataFrame:
    """Events as message rows: UTF-8 JSON in `value`, and one column's text in `key` where it is named."""
    keyed = [] if key is None else [F.col(key).cast("string").alias("key")]
    return events.select(*keyed, message_value(fields).alias("value"))
