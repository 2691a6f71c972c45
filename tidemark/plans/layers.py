"""Layer tables and the chain from messages to serving rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.operators.mart import build_daily
from tidemark.operators.positions import PART, POSITION
from tidemark.operators.scd2 import MESSAGE_TIES, Scd2Spec
from tidemark.plans.dimension import DimensionStore
from tidemark.plans.mart import forget
from tidemark.schemas import BRONZE_PARTITIONS, GOLD_PARTITIONS, bronze_schema, gold_schema, message_schema
from tidemark.session import use_utc
from tidemark.settings import Settings
from tidemark.sinks.serving import JdbcTarget, PathTarget, export
from tidemark.sinks.tables import overwrite_partitions, replace
from tidemark.sources.messages import text_messages
from tidemark.sources.tables import read_bronze, read_layer
from tidemark.streaming.ingest import ingest

NAMESPACES = ("bronze", "meta", "silver", "gold")
BRONZE, WATERMARKS, SILVER, GOLD = "bronze.customer_cdc", "meta.watermarks", "silver.dim_customer", "gold.customer_daily"


@dataclass(frozen=True)
class ChainConfig:
    """Where the layers live and how keys and times are typed.

    `prefix` goes before the namespaces' names. With `published`, each silver run that commits shows
    its versions as `silver.dim_customer`; the namespaces must be there (`create_layers`). `late` and
    `by_position` tell the store how to treat late changes and what an increment is.
    """

    settings: Settings
    spec: Scd2Spec = Scd2Spec(tie_break=MESSAGE_TIES)
    key_type: str = "int"
    ts_type: str = "timestamp"
    buckets: int | None = None
    prefix: str = ""
    published: bool = False
    late: str = "ignore"
    by_position: bool = False

    def name(self, table: str) -> str:
        return f"{self.prefix}{table}"

    def store(self, spark: SparkSession) -> DimensionStore:
        return DimensionStore(
            spark,
            self.settings.silver_path,
            self.spec,
            self.settings.pipeline,
            self.key_type,
            self.ts_type,
            self.buckets,
            self.name(SILVER) if self.published else None,
            self.late,
            (PART, POSITION) if self.by_position else None,
        )

    def bronze(self, spark: SparkSession) -> DataFrame:
        path = self.settings.bronze_path
        return read_bronze(spark, path, key=self.spec.key, key_type=self.key_type, ts_type=self.ts_type)


def create_layers(spark: SparkSession, config: ChainConfig) -> None:
    """Namespaces and tables over the layer folders, for use by name from SQL.

    New partitions of bronze and gold are picked up by `refresh_layers`.
    """
    for name in NAMESPACES:
        spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {config.name(name)} LOCATION '{config.settings.path(name)}'")
    bronze = bronze_schema(config.spec.key, config.key_type, config.ts_type)
    _create_table(spark, config.name(BRONZE), bronze, config.settings.bronze_path, BRONZE_PARTITIONS)
    commits = config.store(spark)
    _create_table(spark, config.name(WATERMARKS), commits.commit_schema, commits.commits_path)
    _create_table(spark, config.name(GOLD), gold_schema(), config.settings.gold_path, GOLD_PARTITIONS)


def _create_table(
    spark: SparkSession, name: str, schema: T.StructType, path: str, partitions: Sequence[str] = ()
) -> None:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    layout = f"PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {layout} LOCATION '{path}'")


def refresh_layers(spark: SparkSession, config: ChainConfig) -> None:
    """Makes new and vanished partitions and new commits visible by name."""
    for name in map(config.name, (BRONZE, WATERMARKS, GOLD)):
        if any(column.isPartition for column in spark.catalog.listColumns(name)):
            spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")
        spark.catalog.refreshTable(name)
    config.store(spark).publish(config.name(SILVER))


def ingest_files(spark: SparkSession, config: ChainConfig, messages: str) -> None:
    """Streams the message files that are there into bronze, then stops."""
    query = ingest(
        text_messages(spark, messages),
        config.settings.bronze_path,
        config.settings.bronze_checkpoint,
        schema=message_schema(config.spec.key, config.key_type),
        ts_type=config.ts_type,
        available_now=True,
    )
    query.awaitTermination()


def run_silver(spark: SparkSession, config: ChainConfig, lookback: str | None = None) -> int | None:
    use_utc(spark)
    return config.store(spark).run(config.bronze(spark), day_column="updated_day", lookback=lookback)


def build_gold(dimension: DataFrame, path: str, spec: Scd2Spec, status: str = "status", mode: str = "full") -> None:
    """Writes the mart by day. `full` replaces it; `partitions` replaces only the days in the result,
    which leaves counts of days whose keys have all moved on. A mart kept by `maintain_gold` in that
    folder starts anew after either."""
    mart = build_daily(dimension, spec.key, status)
    if mode in ("full", "partitions"):
        forget(dimension.sparkSession, path)
    if mode == "full":
        replace(mart, path, GOLD_PARTITIONS)
    elif mode == "partitions":
        overwrite_partitions(mart, path, GOLD_PARTITIONS)
    else:
        raise ValueError(f"unknown mart mode {mode!r}")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """The mart's rows. A maintained mart may hold counts of zero until its next call."""
    return read_layer(spark, path, gold_schema()).where("cnt > 0").select("day", "customer_status", "cnt")


def export_gold(spark: SparkSession, path: str, target: JdbcTarget | PathTarget) -> None:
    export(read_gold(spark, path), target)


def run_chain(spark: SparkSession, config: ChainConfig, messages: str, target: JdbcTarget | PathTarget) -> None:
    """Message files -> bronze -> silver -> gold -> serving. Each stage may be run again."""
    use_utc(spark)
    ingest_files(spark, config, messages)
    run_silver(spark, config)
    build_gold(config.store(spark).current(), config.settings.gold_path, config.spec)
    export_gold(spark, config.settings.gold_path, target)
