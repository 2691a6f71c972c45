"""Current-by-day mart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_daily(dimension: DataFrame, key: str = "customer_id", status: str = "status") -> DataFrame:
    """Distinct current keys per (day the version opened, status).

    The distinct count is aggregated by (day, status, key) first, so one huge (day, status) group
    is spread over all tasks and only partial counts meet.
    """
    return (
        dimension.where("is_current")
        .groupBy(F.to_date("effective_from").alias("day"), F.col(status).alias("customer_status"))
        .agg(F.count_distinct(key).alias("cnt"))
    )


def daily_deltas(opened: DataFrame, closed: DataFrame, status: str = "status") -> DataFrame:
    """(day, customer_status, delta): what versions that became current, and those that ceased to be, add up to.

    A key has one current version at most, so the distinct keys of a group are its current versions.
    """

    def signed(rows: DataFrame, sign: int) -> DataFrame:
        return rows.select(
            F.to_date("effective_from").alias("day"), F.col(status).alias("customer_status"), F.lit(sign).alias("sign"))

    summed = signed(opened, 1).unionByName(signed(closed, -1)).groupBy("day", "customer_status").agg(
        F.sum("sign").cast("bigint").alias("delta"))
    return summed.where("delta <> 0")


def apply_deltas(days: DataFrame, deltas: DataFrame, version: int) -> DataFrame:
    """Whole days after the deltas: (day, customer_status, cnt, applied), counts of zero included.

    `days` holds all rows of the touched days. A day that `version` has reached already stays as it is, so
    deltas may be applied again.
    """
    reached = days.groupBy("day").agg(F.max("applied").alias("reached"))
    due = deltas.join(reached, ["day"], "left").where(F.coalesce(F.col("reached") < version, F.lit(True)))
    rows = days.select("day", "customer_status", "cnt", "applied").unionByName(
        due.select("day", "customer_status", F.col("delta").alias("cnt"), F.lit(version).cast("bigint").alias("applied")))
    return rows.groupBy("day", "customer_status").agg(
        F.sum("cnt").cast("bigint").alias("cnt"), F.max("applied").alias("applied"))
