"""Stored high-water mark: read it, read above it, advance it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import literal_mark, mark_text


def current_mark(log: DataFrame, pipeline: str | None = None, by_pipeline: bool = False) -> DataFrame:
    """Highest `updated_at_gte` of one pipeline, or of each."""
    if by_pipeline:
        return log.groupBy("pipeline").agg(F.max("updated_at_gte").alias("updated_at_gte"))
    return log.where(F.col("pipeline") == pipeline).agg(F.max("updated_at_gte").alias("updated_at_gte"))


def fetch_mark(log: DataFrame, pipeline: str) -> Column | None:
    """The mark as a typed constant, or None when the pipeline has not committed yet."""
    ts_type = log.schema["updated_at_gte"].dataType.simpleString()
    row = current_mark(log, pipeline).select(mark_text(F.col("updated_at_gte"), ts_type)).first()
    return None if row[0] is None else literal_mark(row[0], ts_type)


def read_increment(
    df: DataFrame,
    mark: Column | None,
    order_by: str = "updated_at",
    day_column: str | None = None,
    lookback: str | None = None,
) -> DataFrame:
    """Rows at or above the mark; everything when there is none.

    The bound is inclusive and a constant, so Parquet skips row groups by it; with `day_column` it
    prunes whole day partitions too. `lookback` (such as "2 days") lowers the bound for late rows.
    """
    if mark is None:
        return df
    bound = mark - F.expr(f"INTERVAL {lookback}") if lookback else mark
    if day_column:
        df = df.where(F.col(day_column) >= F.to_date(bound))
    return df.where(F.col(order_by) >= bound)


def next_mark(batch: DataFrame, pipeline: str, order_by: str = "updated_at") -> DataFrame:
    """The log row that advances the pipeline over this batch; no row for an empty batch."""
    return (
        batch.agg(F.max(order_by).alias("updated_at_gte"))
        .where("updated_at_gte IS NOT NULL")
        .select(F.lit(pipeline).alias("pipeline"), "updated_at_gte", F.current_timestamp().alias("written_at"))
    )
