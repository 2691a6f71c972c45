"""DataFrame-in, DataFrame-out operators."""

from tidemark.operators.as_of import join_as_of
from tidemark.operators.cdc import accepted, cdc_messages, parse_cdc, rejected
from tidemark.operators.history import scd2_history
from tidemark.operators.latest import latest_per_key
from tidemark.operators.mart import apply_deltas, build_daily, daily_deltas
from tidemark.operators.positions import last_positions, merged_positions, read_unseen
from tidemark.operators.scd2 import (
    OPEN_END,
    Scd2Spec,
    changed_keys,
    dimension_columns,
    live,
    new_keys,
    open_versions,
    scd2_apply,
    scd2_merge,
    stage_changes,
)
from tidemark.operators.splice import splice
from tidemark.operators.watermark import current_mark, fetch_mark, next_mark, read_increment

__all__ = [
    "OPEN_END",
    "Scd2Spec",
    "accepted",
    "apply_deltas",
    "build_daily",
    "cdc_messages",
    "changed_keys",
    "current_mark",
    "daily_deltas",
    "dimension_columns",
    "fetch_mark",
    "join_as_of",
    "last_positions",
    "latest_per_key",
    "live",
    "merged_positions",
    "new_keys",
    "next_mark",
    "open_versions",
    "parse_cdc",
    "read_increment",
    "read_unseen",
    "rejected",
    "scd2_apply",
    "scd2_history",
    "scd2_merge",
    "splice",
    "stage_changes",
]
