"""Slowly changing dimension, type 2: staging and the one-pass merge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import business_key, hashdiff
from tidemark.operators.latest import latest_per_key

# Fixed value: the end of a version that is still open.
OPEN_END = "9999-12-31 00:00:00"


@dataclass(frozen=True)
class Scd2Spec:
    """Which columns make a dimension.

    `tie_break` orders changes with equal `order_by`; the tracked columns come after it, so two
    changes that still tie are equal in all that the dimension holds.

    `deletes` names the column that tells deletes, which hold one of `delete_values`. A delete has no
    fingerprint. As a row of a dimension it is a gap: it ends the version before it, is never current,
    and reaches up to the change that opens the key again. `live` leaves gaps out.
    """

    key: str = "customer_id"
    tracked: tuple[str, ...] = ("name", "status")
    order_by: str = "updated_at"
    tie_break: tuple[str, ...] = ("ingest_ts", "seq")
    hash_mode: str = "framed"
    deletes: str | None = None
    delete_values: tuple[str, ...] = ("D",)

    @property
    def final_order(self) -> tuple[str, ...]:
        return (*self.tie_break, *self.tracked)

    @property
    def inputs(self) -> tuple[str, ...]:
        told = () if self.deletes is None else (self.deletes,)
        return tuple(dict.fromkeys((self.key, *self.tracked, self.order_by, *self.tie_break, *told)))


#: For changes read from bronze: the source's sequence decides, then when the message came in.
MESSAGE_TIES = ("source_ts", "seq", "ingest_ts")


def dimension_columns(spec: Scd2Spec) -> list[str]:
    return [
        spec.key,
        *spec.tracked,
        "business_key",
        "hashdiff",
        "effective_from",
        "effective_to",
        "is_current",
        spec.order_by,
    ]


def open_end(ts_type: str) -> Column:
    return F.lit(OPEN_END).cast(ts_type)


def _order_type(df: DataFrame, spec: Scd2Spec) -> str:
    return df.schema[spec.order_by].dataType.simpleString()


def valid_changes(changes: DataFrame, spec: Scd2Spec) -> DataFrame:
    """Only the columns the dimension needs, of rows that have a key and a time."""
    return changes.select(*spec.inputs).where(F.col(spec.key).isNotNull() & F.col(spec.order_by).isNotNull())


def fingerprint(df: DataFrame, spec: Scd2Spec) -> DataFrame:
    """Rows with their business key, and their fingerprint unless they are deletes."""
    digest = hashdiff(spec.tracked, spec.hash_mode)
    if spec.deletes is not None:
        told = F.coalesce(F.col(spec.deletes).isin(*spec.delete_values), F.lit(False))
        digest = F.when(~told, digest)
    return df.withColumns({"business_key": business_key(spec.key), "hashdiff": digest})


def live(dimension: DataFrame, spec: Scd2Spec) -> DataFrame:
    """The versions, without the gaps that deletes left."""
    return dimension if spec.deletes is None else dimension.where("hashdiff IS NOT NULL")


def stage_changes(changes: DataFrame, spec: Scd2Spec, with_ties: bool = False) -> DataFrame:
    """Latest change per key with its business key and fingerprint, and its tie-break if asked for."""
    latest = latest_per_key(valid_changes(changes, spec), [spec.key], spec.order_by, spec.final_order)
    ties = [c for c in spec.tie_break if with_ties and c not in (spec.key, *spec.tracked, spec.order_by)]
    return fingerprint(latest, spec).select(spec.key, *spec.tracked, spec.order_by, *ties, "business_key", "hashdiff")


def open_versions(staged: DataFrame, spec: Scd2Spec) -> DataFrame:
    """A first version for every staged row; a gap for a delete."""
    return staged.withColumns(
        {
            "effective_from": F.col(spec.order_by),
            "effective_to": open_end(_order_type(staged, spec)),
            "is_current": F.col("hashdiff").isNotNull(),
        }
    ).select(*dimension_columns(spec))


def is_open(dimension: DataFrame) -> Column:
    """Rows without a successor: current versions, and gaps of keys that are deleted."""
    return F.col("effective_to") == open_end(dimension.schema["effective_to"].dataType.simpleString())


def alters(new_hash: str | Column, old_hash: str | Column, new_time: Column, old_time: Column) -> Column:
    """Whether a change gives a key another version, or deletes it, or opens it again."""
    differs = ~(F.col(new_hash) if isinstance(new_hash, str) else new_hash).eqNullSafe(
        F.col(old_hash) if isinstance(old_hash, str) else old_hash)
    return differs & (new_time >= old_time)


def changed_keys(current: DataFrame, staged: DataFrame, spec: Scd2Spec) -> DataFrame:
    """Staged rows whose key has an open version, or gap, with another fingerprint that is not newer."""
    old = current.select(spec.key, F.col("hashdiff").alias("_hash"), F.col(spec.order_by).alias("_at"))
    altering = alters("hashdiff", "_hash", F.col(spec.order_by), F.col("_at"))
    return staged.join(old, spec.key).where(altering).drop("_hash", "_at")


def new_keys(current: DataFrame, staged: DataFrame, spec: Scd2Spec) -> DataFrame:
    """Staged rows whose key has no current version."""
    return staged.join(current.select(spec.key), spec.key, "left_anti")


def scd2_merge(
    current: DataFrame, staged: DataFrame, spec: Scd2Spec, altered_only: bool = False
) -> DataFrame:
    """All current versions after the batch (`is_current`) and the versions it closed.

    One full join on the key, which is unique on both sides, decides every row: a key in one side
    only is kept or opened, an equal fingerprint keeps the version as it is, another one closes it
    at the change's time and opens its successor. A delete closes it and opens a gap, which the next
    change closes again. A change older than the current version or gap is ignored, so replays and
    late rows alter nothing. `current` holds what is open, gaps included.

    The join uses the key itself, of which the business key is the text: staging has already
    partitioned and sorted the batch by it.

    `altered_only` leaves out the versions that stay as they are.
    """
    names = dimension_columns(spec)
    kept = F.struct(*[F.col(f"old.{c}").alias(c) for c in names])
    closing = {"effective_to": F.col(f"new.{spec.order_by}"), "is_current": F.lit(False)}
    closed = F.struct(*[closing.get(c, F.col(f"old.{c}")).alias(c) for c in names])
    opened = F.struct(*[F.col(f"new.{c}").alias(c) for c in names])

    only_new = F.col(f"old.{spec.key}").isNull()
    changed = alters("new.hashdiff", "old.hashdiff", F.col(f"new.{spec.order_by}"), F.col(f"old.{spec.order_by}"))
    versions = F.when(only_new, F.array(opened)).when(F.coalesce(changed, F.lit(False)), F.array(closed, opened))
    if not altered_only:
        versions = versions.otherwise(F.array(kept))
    old, new = current.select(*names).alias("old"), open_versions(staged, spec).alias("new")
    how = "right_outer" if altered_only else "full_outer"
    joined = old.join(new, F.col(f"old.{spec.key}") == F.col(f"new.{spec.key}"), how)
    return joined.select(F.inline(versions))


def scd2_apply(dimension: DataFrame, staged: DataFrame, spec: Scd2Spec) -> DataFrame:
    """The whole dimension after one batch; versions closed earlier pass through untouched."""
    names = dimension_columns(spec)
    merged = scd2_merge(dimension.where(is_open(dimension)), staged, spec)
    return merged.unionByName(dimension.where(~is_open(dimension)).select(*names))
