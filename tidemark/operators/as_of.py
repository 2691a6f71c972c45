"""Facts joined to the version that was valid at their time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.slices import SLICE, as_value, cut_points, hot_keys, in_slices, last_slice
from tidemark.session import scratch_dir


def join_as_of(
    facts: DataFrame,
    versions: DataFrame,
    fact_key: str,
    fact_time: str,
    key: str,
    take: Sequence[str],
    start: str = "effective_from",
    end: str = "effective_to",
    hot_rows: int | None = None,
    slices: int | None = None,
) -> DataFrame:
    """All facts, once each, with the columns `take` of the version that holds at their time, or NULLs.

    A version holds from `start` on and before `end`; of versions with one start the one that ends last
    counts, so empty versions never do. Facts and version starts are put in one order by key and time and
    the last version is carried along: one shuffle of both by key and no join of ranges, however many
    versions a key has. `take` must not name a column of the facts.

    With `hot_rows`, keys with more facts than that are cut into time slices, each of which begins with
    the version that the slices before it leave. Facts without key or time get no version.
    """
    fact_names = facts.columns
    # Rows that can't match stay where they are, as they would meet under one NULL key.
    keyless = facts.where(F.col(fact_key).isNull() | F.col(fact_time).isNull())
    facts = facts.where(F.col(fact_key).isNotNull() & F.col(fact_time).isNotNull())
    value = F.struct(*[F.col(c) for c in take], F.col(end).alias("_end"))
    fact_rows = facts.select(
        F.col(fact_key).alias("_key"), F.col(fact_time).alias("_at"), F.struct(*fact_names).alias("_fact"))
    valid = versions.where(F.col(key).isNotNull() & F.col(start).isNotNull() & (F.col(start) < F.col(end)))
    version_rows = valid.select(F.col(key).alias("_key"), F.col(start).alias("_at"), value.alias("_version"))
    within = ["_key"]
    if hot_rows is not None:
        fact_rows, version_rows = _sliced(fact_rows, version_rows, hot_rows, slices)
        within = ["_key", SLICE]
    none = F.lit(None)
    both = fact_rows.withColumn("_version", none.cast(version_rows.schema["_version"].dataType)).unionByName(
        version_rows.withColumn("_fact", none.cast(fact_rows.schema["_fact"].dataType)))
    # At one time versions come first.
    order = [F.col("_at"), F.col("_fact").isNotNull(), F.col("_version._end")]
    in_order = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("_held", F.last("_version", ignorenulls=True).over(in_order)).where("_fact IS NOT NULL")
    holds = F.col("_at") < F.col("_held._end")
    joined = carried.select("_fact.*", *[F.when(holds, F.col(f"_held.{c}")).alias(c) for c in take])
    types = versions.schema
    return joined.unionByName(keyless.select("*", *[none.cast(types[c].dataType).alias(c) for c in take]))


def _sliced(
    facts: DataFrame, versions: DataFrame, hot_rows: int, slices: int | None
) -> tuple[DataFrame, DataFrame]:
    """Both with `_slice`; hot keys' versions are led by a row for each slice: the one valid where it begins.

    The cuts, the hot keys and the versions are used several times and so are written once.
    """
    slices = slices or int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = as_value(_written(cut_points(facts, "_at", slices), "cut-points"))
    # Not compressed, as Spark goes by the files' size when it decides whether to broadcast them.
    hot = _written(hot_keys(facts, "_key", hot_rows, cuts), "hot-facts", compression="none")

    def marked(rows: DataFrame) -> DataFrame:
        return in_slices(rows, "_key", "_at", hot, cuts)

    placed = _written(marked(versions), "placed-versions")
    # The last version that starts in each slice, carried over the slices behind it: a row per slice.
    newest = F.max_by("_version", F.struct("_at", "_version._end"))
    last = placed.where(F.col(SLICE) > 0).groupBy("_key", SLICE).agg(newest.alias("_last"), F.max("_at").alias("_since"))
    every = hot.select(F.col("_hot").alias("_key"), F.explode(F.sequence(F.lit(1), last_slice(cuts))).alias(SLICE))
    before = Window.partitionBy("_key").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    led = every.join(last, ["_key", SLICE], "left").select(
        "_key",
        SLICE,
        F.last("_since", ignorenulls=True).over(before).alias("_at"),
        F.last("_last", ignorenulls=True).over(before).alias("_version"),
    )
    leading = led.where("_version IS NOT NULL").select("_key", "_at", "_version", SLICE)
    return marked(facts), placed.select("_key", "_at", "_version", SLICE).unionByName(leading)


def _written(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
