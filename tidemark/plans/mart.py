"""The daily mart maintained from what the dimension's runs opened and closed."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.mart import apply_deltas, build_daily, daily_deltas
from tidemark.plans.dimension import DimensionStore
from tidemark.schemas import GOLD_PARTITIONS, gold_schema
from tidemark.session import scratch_dir
from tidemark.sinks.tables import append, drop_partitions, overwrite_partitions, replace

LOG = "version bigint, done boolean"


def maintained_schema() -> T.StructType:
    return T.StructType([*gold_schema().fields, T.StructField("applied", T.LongType())])


def touched_days(spark: SparkSession, path: str, days: Sequence[date]) -> DataFrame:
    """The mart's rows of some days; opens no other day's folder."""
    return spark.read.schema(maintained_schema()).parquet(path).where(F.col("day").isin(list(days)))


def maintain_gold(store: DimensionStore, path: str, status: str = "status") -> list[date]:
    """Brings the mart at `path` up to the store's last version; the days that it rewrote.

    The first call builds it whole. Later ones sum +1 for each version that became current and -1 for each that
    ceased to be, by day and status, and rewrite the days with a sum other than zero; days that fall to zero are
    removed. `path`_log tells the version to come before anything is written and again when it is reached: a call
    that stopped is ended by the next one, and a day that has its deltas already, by `applied`, is not given them
    again. The versions in between must not have been expired.
    """
    spark, log = store.spark, f"{path.rstrip('/')}_log"
    commit = store.last_commit()
    if commit is None:
        return []
    spark.createDataFrame([], LOG).write.mode("ignore").parquet(log)
    seen = spark.read.schema(LOG).parquet(log).agg(
        F.max(F.when(F.col("done"), F.col("version"))).alias("done"), F.max("version").alias("begun")).first()
    done, rewritten = seen.done, []
    # A version that a stopped call was on the way to comes first.
    for version in sorted({v for v in (seen.begun, commit.version) if v is not None and v != done}):
        _note(spark, log, version, False)
        if done is None:
            whole = build_daily(store.current_at(version), store.spec.key, status)
            replace(whole.withColumn("applied", F.lit(version).cast("bigint")), path, GOLD_PARTITIONS)
        else:
            rewritten += _advance(store, path, done, version, status)
        _note(spark, log, version, True)
        done = version
        drop_partitions(spark, path, [f"day={day}" for day in _empty(spark, path, rewritten)])
    return sorted(set(rewritten))


def forget(spark: SparkSession, path: str) -> None:
    """Drops the log, as another build is about to change the folder; the next call builds it whole."""
    folder, name = path.rstrip("/").rsplit("/", 1)
    drop_partitions(spark, folder, [f"{name}_log"])


def _advance(store: DimensionStore, path: str, since: int, version: int, status: str) -> list[date]:
    spark = store.spark
    deltas = _staged(daily_deltas(*store.moved(since, version), status), "mart-deltas")
    days = [row.day for row in deltas.select("day").distinct().orderBy("day").collect()]
    if days:
        rows = _staged(apply_deltas(touched_days(spark, path, days), deltas, version), "mart-days")
        overwrite_partitions(rows.select("customer_status", "cnt", "applied", "day"), path, GOLD_PARTITIONS)
    return days


def _empty(spark: SparkSession, path: str, days: Sequence[date]) -> list[date]:
    if not days:
        return []
    sums = touched_days(spark, path, days).groupBy("day").agg(F.sum("cnt").alias("cnt"))
    return [row.day for row in sums.where("cnt = 0").collect()]


def _staged(df: DataFrame, label: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _note(spark: SparkSession, log: str, version: int, done: bool) -> None:
    append(spark.createDataFrame([(version, done)], LOG), log)
