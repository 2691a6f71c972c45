"""Layer tables on Parquet folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import BRONZE_PARTITIONS

#: Files that one write gives a day at most. Choose it so that a day's share of a write fills them.
FILES_PER_DAY = 8


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def replace(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Full refresh: afterwards the folder holds exactly this result.

    The result is written whole beside the folder and then takes its place by two renames, so a job
    that stops leaves the old rows. A stop between the renames is mended by the next call; until then
    readers find no folder, never a part of one. One writer per folder is assumed.
    """
    path = path.rstrip("/")
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partition_by).parquet(
        f"{path}.next"
    )
    _put_in_place(df.sparkSession, f"{path}.next", path, f"{path}.old")


def _put_in_place(spark: SparkSession, new: str, target: str, old: str) -> None:
    new, target, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (new, target, old))
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        files.delete(old, True)
        if not files.rename(target, old):
            raise OSError(f"cannot set {target} aside")
    files.mkdirs(target.getParent())
    if not files.rename(new, target):
        raise OSError(f"cannot put {new} in the place of {target}")
    files.delete(old, True)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replaces the partitions that occur in the result and leaves all others as they are."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)


def drop_partitions(spark: SparkSession, path: str, names: Sequence[str]) -> None:
    """Removes partition folders such as `day=2026-03-13`; those that aren't there don't matter."""
    for name in names:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def by_day(parsed: DataFrame, files_per_day: int = FILES_PER_DAY) -> DataFrame:
    """Parsed messages laid out so that a write gives each day `files_per_day` files at most.

    The salt is the number of the reading task, so a day that holds most rows is spread evenly and a
    task that runs again deals its rows alike. Works on streams and batches.
    """
    salted = parsed.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(files_per_day)))
    return salted.repartition(*BRONZE_PARTITIONS, "_salt").drop("_salt")


def write_bronze(parsed: DataFrame, path: str, files_per_day: int = FILES_PER_DAY) -> None:
    """Batch append of parsed messages, in the layout that the stream's ingest writes."""
    append(by_day(parsed, files_per_day), path, BRONZE_PARTITIONS)
