"""Time slices of hot keys, so that no task ever holds such a key as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cuts that are compared one by one before the finer ones; both steps stay short for thousands of slices.
COARSE = 64
CUTTABLE = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp")

SLICE = "_slice"


def cut_points(rows: DataFrame, at: str, slices: int) -> DataFrame:
    """One row: `cuts` that deal all rows evenly by `at`, every 64th of them as `coarse`, and their even `share`.

    As a slice holds that even share of all rows, no key has more of them in it, however its times lie.
    """
    parts = [i / slices for i in range(1, slices)] or [0.0]
    cuts = F.percentile_approx(at, F.array(*[F.lit(p) for p in parts]), max(1_000, 100 * slices))
    found = rows.agg(F.array_sort(F.array_distinct(cuts)).alias("cuts"), (F.count(F.lit(1)) / slices).alias("share"))
    return found.select("cuts", F.filter("cuts", lambda _, i: (i + 1) % COARSE == 0).alias("coarse"), "share")


def as_value(cuts: DataFrame) -> Column:
    """The row of `cut_points` as one value, which no join has to carry beside each key."""
    return cuts.select(F.struct("cuts", "coarse", "share")).scalar()


def slice_number(cuts: Column, at: Column) -> Column:
    """How many cuts are not above `at`; it never decreases with `at`, and NULL comes first."""
    below = F.size(F.filter(cuts["coarse"], lambda c: c <= at)) * COARSE
    rest = F.slice(cuts["cuts"], below + 1, COARSE)
    return F.when(at.isNull() | cuts["cuts"].isNull(), 0).otherwise(below + F.size(F.filter(rest, lambda c: c <= at)))


def hot_keys(rows: DataFrame, key: str, hot_rows: int, cuts: Column) -> DataFrame:
    """Keys with more rows than that as `_hot`, counted before the shuffle, and how many slices they take as one.

    `_stride` is 1 for a key with more than an even share of all rows. Others fit into a task as they are and are cut
    once for each `hot_rows` of their rows, so that slices are never many more than rows.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.ceil(F.col("_n") / max(hot_rows, 1))
    few = F.greatest(F.lit(1), F.floor((F.size(cuts["cuts"]) + 1) / wanted))
    stride = F.when(F.col("_n") > cuts["share"], 1).otherwise(few)
    return counts.where(F.col("_n") > hot_rows).select(F.col(key).alias("_hot"), stride.cast("int").alias("_stride"))


def in_slices(rows: DataFrame, key: str, at: str, hot: DataFrame, cuts: Column) -> DataFrame:
    """`rows` with `_slice`, found by the hot keys; the cuts are put beside a row behind the join only."""
    joined = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_cuts", cuts)
    number = F.floor(slice_number(F.col("_cuts"), F.col(at)) / F.col("_stride")).cast("int")
    return joined.select(*rows.columns, F.when(F.col("_hot").isNull(), 0).otherwise(number + 1).alias(SLICE))


def last_slice(cuts: Column) -> Column:
    """The highest slice that rows of a hot key can have."""
    return F.floor(F.size(cuts["cuts"]) / F.col("_stride")).cast("int") + 1


def with_slices(rows: DataFrame, key: str, at: str, hot_rows: int, slices: int | None = None) -> DataFrame:
    """`rows` with `_slice`: 0 for usual keys, from 1 on for keys with more than `hot_rows` rows; dealt by both.

    Rows of one key and one `at` share a slice. There are as many slices as shuffle partitions unless told, and fewer
    for keys that don't hold an even share of all rows. `at` must be a number, a date or a time; by any other type
    nothing is cut. The rows are read three times, each for the columns it needs: give a pinned table.

    A join by shuffle leaves a key's rows in one task, so they are dealt anew behind it, whatever the join was.
    """
    kind = rows.schema[at].dataType.simpleString().split("(")[0].removesuffix("_ntz")
    if kind not in CUTTABLE:
        return rows.withColumn(SLICE, F.lit(0))
    slices = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = as_value(cut_points(rows, at, slices))
    return in_slices(rows, key, at, hot_keys(rows, key, hot_rows, cuts), cuts).repartition(key, SLICE)
