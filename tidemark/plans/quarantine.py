"""Quarantined messages, judged again under another schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.cdc import parse_cdc
from tidemark.schemas import BRONZE_PARTITIONS, bronze_schema
from tidemark.session import scratch_dir
from tidemark.sinks.tables import FILES_PER_DAY, append, by_day
from tidemark.sources.tables import open_rejects, read_layer

#: The part under which replayed messages take their place in the order of arrival.
REPLAYED = "replay"


def rejudged(rejects: DataFrame, schema: T.StructType, ts_type: str = "timestamp") -> DataFrame:
    """Open rejects parsed under `schema`, with their `reject_id`; which of them are sound now is `NOT rejected`.

    They keep their sequence and source time, and get a new place in the order of arrival, so that readers by
    position find them. By the time mark they are late.
    """
    messages = rejects.select(
        F.struct(F.col("raw").alias("text"), "reject_id", "source_ts", "seq").alias("kept"))
    # The id goes through the parser beside the text.
    named = messages.select(
        F.col("kept.text").alias("value"), F.col("kept.seq").alias("source_seq"),
        F.col("kept.source_ts").alias("source_ts"), F.col("kept.reject_id").alias("source_part"))
    parsed = parse_cdc(named, schema, ts_type=ts_type)
    return parsed.withColumns(
        {"reject_id": F.col("source_part"), "source_part": F.lit(REPLAYED),
         "source_pos": F.unix_micros(F.current_timestamp())})


def replay_rejects(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    key: str = "customer_id",
    key_type: str = "int",
    ts_type: str = "timestamp",
    files_per_day: int = FILES_PER_DAY,
) -> int:
    """Moves the rejects of a bronze folder that are sound under `schema` to its events; how many.

    A moved message is an event with the reject's id, which hides the reject from then on: one append both adds
    it and takes it away. So a replay that stops may be run again, and a second one moves nothing. Messages
    without a text stay. One replay at a time is assumed.
    """
    bronze = read_layer(spark, path, bronze_schema(key, key_type, ts_type))
    sound = rejudged(open_rejects(bronze).where("raw IS NOT NULL"), schema, ts_type).where("NOT rejected")
    # Pinned, as the folder that is read grows by it.
    pinned = scratch_dir(spark, "replay")
    sound.write.parquet(pinned)
    moved = spark.read.schema(sound.schema).parquet(pinned)
    count = moved.count()
    if count:
        append(by_day(moved.select(*bronze.columns), files_per_day), path, BRONZE_PARTITIONS)
    return count
