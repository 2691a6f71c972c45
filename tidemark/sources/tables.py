"""Batch scans of the layers by path, with their declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schemas import bronze_schema


def read_layer(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_bronze(
    spark: SparkSession,
    path: str,
    rejected: bool = False,
    key: str = "customer_id",
    key_type: str = "int",
    ts_type: str = "timestamp",
) -> DataFrame:
    """Accepted events, or the quarantined messages; `rejected` is a partition, so only one side is read.

    Of the quarantined, those that a replay has moved to the events since are left out (`plans.quarantine`).
    """
    bronze = read_layer(spark, path, bronze_schema(key, key_type, ts_type))
    if rejected:
        return open_rejects(bronze).select("reject_reason", "raw", "ingest_ts")
    return bronze.where("NOT rejected").drop("rejected", "reject_id", "reject_reason", "raw")


def open_rejects(bronze: DataFrame) -> DataFrame:
    """Rejects that were not moved, each with `reject_id`: the file that holds it and its row there.

    A moved message carries that id among the events, where other files have none and are passed over.
    """
    place = F.concat_ws(":", F.col("_metadata.file_name"), F.col("_metadata.row_index").cast("string"))
    rejects = bronze.where("rejected").withColumn("reject_id", place)
    moved = bronze.where("NOT rejected AND reject_id IS NOT NULL").select(F.col("reject_id").alias("_moved"))
    return rejects.join(moved, F.col("reject_id") == F.col("_moved"), "left_anti")
