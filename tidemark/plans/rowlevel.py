"""The same layers as catalog tables, for table formats that support row-level changes.

The format's jar and catalog must be configured (`session.catalog_conf`). Plain Parquet tables
cannot do MERGE; they use `plans.dimension` and `plans.layers`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.mart import build_daily
from tidemark.operators.scd2 import (
    MESSAGE_TIES,
    OPEN_END,
    Scd2Spec,
    changed_keys,
    dimension_columns,
    is_open,
    open_versions,
    stage_changes,
)
from tidemark.operators.watermark import fetch_mark, next_mark, read_increment
from tidemark.schemas import bronze_schema, gold_schema, message_schema
from tidemark.session import scratch_dir
from tidemark.settings import DEFAULT_PIPELINE
from tidemark.streaming.ingest import ingest


@dataclass(frozen=True)
class RowLevelLayers:
    """Names and types of the tables in one catalog."""

    catalog: str
    using: str = "iceberg"
    spec: Scd2Spec = Scd2Spec(tie_break=MESSAGE_TIES)
    pipeline: str = DEFAULT_PIPELINE
    key_type: str = "int"
    ts_type: str = "timestamp"

    @property
    def bronze(self) -> str:
        return f"{self.catalog}.bronze.customer_cdc"

    @property
    def watermarks(self) -> str:
        return f"{self.catalog}.meta.watermarks"

    @property
    def silver(self) -> str:
        return f"{self.catalog}.silver.dim_customer"

    @property
    def gold(self) -> str:
        return f"{self.catalog}.gold.customer_daily"

    def ddl(self) -> list[str]:
        """Namespaces and tables; times are partitioned by day by the format itself."""
        bronze = [f for f in bronze_schema(self.spec.key, self.key_type, self.ts_type) if f.name != "updated_day"]
        types = {"is_current": "boolean", self.spec.key: self.key_type}
        types |= dict.fromkeys(("effective_from", "effective_to", self.spec.order_by), self.ts_type)
        silver = ", ".join(f"{c} {types.get(c, 'string')}" for c in dimension_columns(self.spec))
        gold = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in gold_schema())
        tables = {
            self.bronze: (
                ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bronze),
                "PARTITIONED BY (rejected, days(updated_at))",
            ),
            self.watermarks: (f"pipeline string, updated_at_gte {self.ts_type}, written_at timestamp", ""),
            self.silver: (silver, "PARTITIONED BY (days(effective_from))"),
            self.gold: (gold, "PARTITIONED BY (day)"),
        }
        namespaces = [f"CREATE NAMESPACE IF NOT EXISTS {name.rsplit('.', 1)[0]}" for name in tables]
        creates = [
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {self.using} {layout}".rstrip()
            for name, (columns, layout) in tables.items()
        ]
        return namespaces + creates

    def create(self, spark: SparkSession) -> None:
        for statement in self.ddl():
            spark.sql(statement)

    def ingest(self, messages: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        schema = message_schema(self.spec.key, self.key_type)
        return ingest(messages, self.bronze, checkpoint, schema, self.ts_type, as_table=True, **trigger)

    def run_silver(self, spark: SparkSession, lookback: str | None = None) -> bool:
        """Merges changes at or above the stored mark; False when there are none.

        The merge may be repeated without effect, so a run that stops before the mark is stored is
        simply run again.
        """
        mark = fetch_mark(spark.table(self.watermarks), self.pipeline)
        changes = read_increment(spark.table(self.bronze).where("NOT rejected"), mark, self.spec.order_by, lookback=lookback)
        staged = stage_changes(changes, self.spec)
        path = scratch_dir(spark, "staged")
        staged.write.parquet(path)
        staged = spark.read.schema(staged.schema).parquet(path)
        if staged.isEmpty():
            return False
        merge_into(staged, self.silver, self.spec)
        append_to(next_mark(staged, self.pipeline, self.spec.order_by), self.watermarks)
        return True

    def run_gold(self, spark: SparkSession, status: str = "status", mode: str = "full") -> None:
        mart = build_daily(spark.table(self.silver), self.spec.key, status)
        if mode == "full":
            mart.writeTo(self.gold).overwrite(F.lit(True))
        elif mode == "partitions":
            overwrite_partitions_of(mart, self.gold)
        else:
            raise ValueError(f"unknown mart mode {mode!r}")


def merge_source(staged: DataFrame, current: DataFrame, spec: Scd2Spec) -> DataFrame:
    """Staged versions under their key, plus the changed ones again under a NULL merge key.

    The keyed copy closes the old version or opens a first one; the copy with the NULL key matches
    nothing and so opens the successor. Both land in one commit. `current` holds the open rows; a
    delete is merged as a gap, which the table keeps and readers leave out (`operators.scd2.live`).
    """
    opened = open_versions(staged, spec)
    successors = open_versions(changed_keys(current, staged, spec), spec)
    return opened.withColumn("merge_key", F.col("business_key")).unionByName(
        successors.withColumn("merge_key", F.lit(None).cast("string"))
    )


def merge_into(staged: DataFrame, table: str, spec: Scd2Spec) -> None:
    """One MERGE on a row-level table; `staged` must be pinned, as the merge reads it twice."""
    rows = staged.sparkSession.table(table)
    source = merge_source(staged, rows.where(is_open(rows)), spec).alias("source")
    on_key = F.expr(f"{table}.business_key = source.merge_key AND {table}.effective_to = '{OPEN_END}'")
    newer = F.expr(
        f"NOT ({table}.hashdiff <=> source.hashdiff) AND source.{spec.order_by} >= {table}.{spec.order_by}"
    )
    (
        source.mergeInto(table, on_key)
        .whenMatched(newer)
        .update({"effective_to": F.col("source.effective_from"), "is_current": F.lit(False)})
        .whenNotMatched()
        .insert({c: F.col(f"source.{c}") for c in dimension_columns(spec)})
        .merge()
    )


def append_to(df: DataFrame, table: str) -> None:
    df.writeTo(table).append()


def overwrite_partitions_of(df: DataFrame, table: str) -> None:
    df.writeTo(table).overwritePartitions()
