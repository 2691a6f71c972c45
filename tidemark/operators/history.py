"""Type-2 history straight from all changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.latest import latest_per_key
from tidemark.operators.scd2 import Scd2Spec, dimension_columns, fingerprint, live, open_end, valid_changes
from tidemark.operators.slices import SLICE, with_slices


def scd2_history(
    changes: DataFrame,
    spec: Scd2Spec,
    bucket: Column | None = None,
    hot_rows: int | None = None,
    prereduce: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """All versions of all keys, equal to merging the batches one after the other.

    `bucket` names the batch of a change and must not decrease in a key's order: time, tie-break,
    tracked columns. Within a batch only the last change of a key counts. Several batches may share
    a time. Without `bucket` every distinct time is its own batch.

    With `hot_rows`, keys with more changes than that are cut into time slices (`with_slices`) and
    no task holds one of them as a whole. What crosses the slices' edges is one summary of each: its
    first and its last version. A batch is never cut, so combine it with `prereduce` where one batch
    holds very many changes of a key. By default one task sorts a key's changes, spilling as needed.

    `prereduce` drops all but the last change of each batch before the shuffle by key. It adds a
    shuffle of what is left, so it pays only where keys change many times per batch.

    Deletes (`Scd2Spec.deletes`) end a version and open none, so gaps are left between versions.
    """
    rows = valid_changes(changes, spec).withColumn("_batch", F.col(spec.order_by) if bucket is None else bucket)
    if prereduce:
        rows = latest_per_key(rows, [spec.key, "_batch"], spec.order_by, spec.final_order)
    if hot_rows is None:
        starts = _starts(rows, spec, [spec.key])
        return _versions(starts, spec, "_next")
    starts = _starts(with_slices(rows, spec.key, "_batch", hot_rows, slices), spec, [spec.key, SLICE])
    at_edge = (F.col(SLICE) > 0) & (F.col("_first") | F.col("_next").isNull())
    inner = _versions(starts.where(~at_edge), spec, "_next")
    return inner.unionByName(_versions(_scanned(starts.where(at_edge), spec), spec, "_next"))


def _order(spec: Scd2Spec) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in (spec.order_by, *spec.final_order)]


def _starts(rows: DataFrame, spec: Scd2Spec, within: list[str]) -> DataFrame:
    """The batches' last changes that differ from the one before, with the time of the next such one.

    One shuffle and one sort serve all three steps. `_first` marks the first change of its group.
    """
    in_order = Window.partitionBy(*within).orderBy(*_order(spec))
    following = F.lead(F.struct("_batch")).over(in_order).alias("_following")
    ends_batch = F.col("_following").isNull() | ~F.col("_following._batch").eqNullSafe(F.col("_batch"))
    last_of_batch = fingerprint(rows.select("*", following).where(ends_batch), spec)
    compared = last_of_batch.select("*", F.lag(F.struct("hashdiff")).over(in_order).alias("_previous"))
    differs = F.col("_previous").isNull() | ~F.col("hashdiff").eqNullSafe(F.col("_previous.hashdiff"))
    kept = [c for c in last_of_batch.columns if c not in ("_batch", "_following")]
    first, successor = F.col("_previous").isNull(), F.lead(spec.order_by).over(in_order)
    return compared.where(differs).select(*kept, first.alias("_first"), successor.alias("_next"))


def _scanned(edges: DataFrame, spec: Scd2Spec) -> DataFrame:
    """First and last versions of slices, once what lies before and behind their slice is known.

    A slice's first version goes if the slice before ended with an equal one; its time of change is
    then that of the slice's second version. The last version ends at the next time of change of any
    later slice. A key has two rows per slice here, whatever its number of changes.
    """
    names = (spec.order_by, *spec.final_order)
    forward = Window.partitionBy(spec.key).orderBy(SLICE, *_order(spec))
    backward = Window.partitionBy(spec.key).orderBy(F.desc(SLICE), *[F.col(c).desc_nulls_last() for c in names])
    later = backward.rowsBetween(Window.unboundedPreceding, -1)
    before = F.lag(F.struct("hashdiff")).over(forward)
    repeated = F.col("_first") & F.col("_before").isNotNull() & F.col("hashdiff").eqNullSafe(F.col("_before.hashdiff"))
    change = F.when(F.col("_first"), F.when(repeated, F.col("_next")).otherwise(F.col(spec.order_by)))
    placed = edges.select("*", before.alias("_before"))
    ended = placed.select("*", F.last(change, ignorenulls=True).over(later).alias("_later")).where(~repeated)
    return ended.withColumn("_next", F.coalesce("_next", "_later"))


def _versions(starts: DataFrame, spec: Scd2Spec, successor: str) -> DataFrame:
    ts_type = starts.schema[spec.order_by].dataType.simpleString()
    end = F.col(successor)
    dated = {
        "effective_from": F.col(spec.order_by),
        "effective_to": F.coalesce(end, open_end(ts_type)),
        "is_current": end.isNull(),
    }
    return live(starts, spec).select(*[dated[c].alias(c) if c in dated else c for c in dimension_columns(spec)])
