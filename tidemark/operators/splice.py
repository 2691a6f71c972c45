"""Changes that come late: put between the versions that are there already."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scd2 import Scd2Spec, dimension_columns, open_end

#: Marks a change that altered nothing. It is kept, as a late change may come to lie before it.
REPEATS = "repeats"


def point_columns(spec: Scd2Spec) -> list[str]:
    """What a dimension must keep of every change to take late ones: all that orders it, and its mark."""
    names = dimension_columns(spec)
    return [*names, *[c for c in spec.tie_break if c not in names], REPEATS]


def splice(points: DataFrame, spec: Scd2Spec) -> DataFrame:
    """Versions, gaps and repeats of whole keys from all their changes, in any order and repeated at will.

    `points` has the key, the tracked columns, the time, the tie-break, `business_key` and `hashdiff`: the
    rows that `splice` gave earlier, and new ones. A change inside a version splits it; one that equals
    its predecessor is kept as a repeat; a version whose change moves behind an equal one becomes a
    repeat. So the result depends on the set of changes only. One shuffle by key.
    """
    names = (spec.order_by, *spec.final_order)
    identity = list(dict.fromkeys((spec.key, *names, "hashdiff")))
    forward = Window.partitionBy(spec.key).orderBy(*[F.col(c).asc_nulls_first() for c in names], "hashdiff")
    backward = Window.partitionBy(spec.key).orderBy(*[F.col(c).desc_nulls_last() for c in names], F.desc("hashdiff"))
    later = backward.rowsBetween(Window.unboundedPreceding, -1)
    time = F.col(spec.order_by)
    end = open_end(points.schema[spec.order_by].dataType.simpleString())
    before = F.lag(F.struct("hashdiff")).over(forward)
    following = F.last(F.when(~F.col(REPEATS), time), ignorenulls=True).over(later)
    return (
        points.select(*dict.fromkeys((*identity, "business_key")))
        .repartition(spec.key)
        .dropDuplicates(identity)
        .withColumn("_before", before)
        .withColumn(REPEATS, F.col("_before").isNotNull() & F.col("hashdiff").eqNullSafe(F.col("_before.hashdiff")))
        .withColumn("_following", following)
        .withColumns(
            {
                "effective_from": time,
                "effective_to": F.when(F.col(REPEATS), time).otherwise(F.coalesce("_following", end)),
                "is_current": ~F.col(REPEATS) & F.col("_following").isNull() & F.col("hashdiff").isNotNull(),
            }
        )
        .select(*point_columns(spec))
    )
