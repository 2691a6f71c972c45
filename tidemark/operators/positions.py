"""Progress by source position: the last position of each part that was read, whatever the rows' times are.

A part is what its source writes in order: a partition of a topic with its offsets, or a producer with its sequence.
Within a part, positions rise in the order in which rows reach the table; between parts nothing is assumed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART, POSITION = "source_part", "source_pos"


def _part(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def last_positions(batch: DataFrame, part: str = PART, position: str = POSITION) -> DataFrame:
    """One row: `positions`, a map from each part of the batch to its last position, and `unplaced`, the number
    of rows without one. As large as the number of parts."""
    each = batch.groupBy(_part(part).alias("part")).agg(
        F.max(position).alias("last"), F.count_if(F.col(position).isNull()).alias("unplaced"))
    placed = F.collect_list(F.when(F.col("last").isNotNull(), F.struct("part", "last")))
    return each.agg(
        F.map_from_entries(placed).cast("map<string,bigint>").alias("positions"),
        F.coalesce(F.sum("unplaced"), F.lit(0)).alias("unplaced"))


def merged_positions(old: Mapping[str, int] | None, new: Mapping[str, int] | None) -> dict[str, int]:
    found = dict(old or {})
    for part, position in (new or {}).items():
        found[part] = max(position, found.get(part, position))
    return found


def unseen(seen: Mapping[str, int], part: str = PART, position: str = POSITION) -> Column:
    """Rows behind their part's last position; all rows of a part that isn't in the vector."""
    if not seen:
        return F.lit(True)
    last = F.create_map(*[F.lit(x) for pair in sorted(seen.items()) for x in pair])
    behind = F.col(position) > F.element_at(last, _part(part))
    return F.coalesce(behind, F.lit(True))


def read_unseen(
    df: DataFrame,
    seen: Mapping[str, int],
    part: str = PART,
    position: str = POSITION,
    day_column: str | None = None,
    written_since: dt.datetime | None = None,
) -> DataFrame:
    """Rows of a table that no earlier read has given, also where they are late or lie among old days.

    With `day_column`, a first query finds the days that have such rows, from the positions alone and, with
    `written_since`, from no file older than that; the read then names these day folders and opens no others.
    The files' times only save reading: set them back by more than the writers' clocks may differ.
    """
    if not seen:
        return df
    new = unseen(seen, part, position)
    if day_column is None:
        return df.where(new)
    recent = df if written_since is None else df.where(F.col("_metadata.file_modification_time") >= F.lit(written_since))
    # As many values as there are days.
    days = [row[0] for row in recent.where(new).select(day_column).distinct().collect()]
    known = [day for day in days if day is not None]
    inside = F.col(day_column).isin(known) if known else F.lit(False)
    if len(known) < len(days):
        inside = inside | F.col(day_column).isNull()
    return df.where(inside & new)
