"""Message sources. Each gives `value`, and `source_ts` and `source_seq`, the position that breaks ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def kafka_messages(
    spark: SparkSession,
    brokers: str,
    topic: str,
    streaming: bool = True,
    starting: str | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """One topic by name. A stream starts at `latest` on its first run; later its checkpoint decides.

    Pass `maxOffsetsPerTrigger` and `minPartitions` in `options` to size micro-batches and tasks.
    Needs the Kafka connector on the classpath.
    """
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    reader = (
        reader.option("kafka.bootstrap.servers", brokers)
        .option("subscribe", topic)
        .option("startingOffsets", starting or ("latest" if streaming else "earliest"))
    )
    for name, value in (options or {}).items():
        reader = reader.option(name, value)
    return kafka_positions(reader.load())


def kafka_positions(records: DataFrame) -> DataFrame:
    """Offsets order one partition only, so the record's time goes before them; records that name their partition
    are parts of progress by position."""
    named = [F.col(c).cast("string") for c in ("topic", "partition") if c in records.columns]
    return records.select(
        "value",
        F.col("timestamp").alias("source_ts"),
        (F.concat_ws("/", *named) if named else F.lit(None).cast("string")).alias("source_part"),
        F.col("offset").cast("bigint").alias("source_seq"),
    )


def text_messages(
    spark: SparkSession,
    path: str,
    streaming: bool = True,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """One message per line of text files. A file's time orders files; lines of one file have no order."""
    reader = (spark.readStream if streaming else spark.read).format("text")
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path).select(
        "value",
        F.col("_metadata.file_modification_time").alias("source_ts"),
        F.lit(None).cast("bigint").alias("source_seq"),
    )
