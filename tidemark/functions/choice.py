"""Repeatable random choices: a digest of the row's sequence, not a generator's state.

A task that is run again after a lost executor makes the same choices, whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed_bits(seed: int, label: str, seq: Column) -> Column:
    """60 uniform bits as a non-negative bigint."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(label), seq.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def pick(values: Sequence[str], bits: Column) -> Column:
    choices = F.array(*[F.lit(v) for v in values])
    return F.element_at(choices, (bits % len(values) + 1).cast("int"))
