"""Synthetic customer changes, one per input row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import hashed_bits, iso_seconds, pick

# Fixed values of the synthetic events.
STATUSES = ("active", "inactive", "vip")
OPERATIONS = ("I", "U")
NAME_PREFIX = "customer_"
SOURCE = "demo-generator"


def sequence_rows(spark: SparkSession, count: int, start: int = 0) -> DataFrame:
    """A batch of `count` rows."""
    return spark.range(start, start + count).withColumnRenamed("id", "seq")


def rate_rows(spark: SparkSession, rows_per_second: float) -> DataFrame:
    """An endless stream of rows at a steady rate; below one per second Spark's rate source takes one."""
    stream = spark.readStream.format("rate").option("rowsPerSecond", max(1, round(rows_per_second))).load()
    return stream.select(F.col("value").alias("seq"), F.col("timestamp").alias("at"))


def event_clock() -> Column:
    return F.current_timestamp()


def generate_events(
    rows: DataFrame,
    max_id: int = 1000,
    seed: int = 0,
    seq: str = "seq",
    clock: Column | None = None,
    key_type: str = "int",
) -> DataFrame:
    """The seven message fields for each row of `rows`; both times are the clock in whole seconds."""
    if max_id < 1:
        raise ValueError("max_id must be at least 1")
    at = iso_seconds(event_clock() if clock is None else clock)
    position = F.col(seq)
    events = rows.select(
        position.cast("bigint").alias("seq"),
        at.alias("event_ts"),
        (hashed_bits(seed, "id", position) % max_id + 1).cast(key_type).alias("customer_id"),
        pick(STATUSES, hashed_bits(seed, "status", position)).alias("status"),
        pick(OPERATIONS, hashed_bits(seed, "op", position)).alias("op"),
    )
    return events.select(
        "op",
        "event_ts",
        "customer_id",
        F.concat(F.lit(NAME_PREFIX), F.col("customer_id").cast("string")).alias("name"),
        "status",
        F.col("event_ts").alias("updated_at"),
        F.lit(SOURCE).alias("source"),
        "seq",
    )
