"""Latest change per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str | Column],
    order_by: str,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """One row per key: the last by `order_by`, then by each tie-break column; NULLs lose.

    The rank filter makes Spark keep one row per key and task before the shuffle
    (`WindowGroupLimit`), so a key that holds a third of all rows sends one row per input task.
    """
    order = [F.col(c).desc_nulls_last() for c in (order_by, *tie_break)]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")
