"""Business key and change fingerprint of a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPAT_SEPARATOR = "||"


def business_key(key: str) -> Column:
    return F.col(key).cast("string")


def hashdiff(tracked: Sequence[str], mode: str = "framed") -> Column:
    """SHA-256 hex digest of the tracked attributes.

    `framed` writes each value with its length and NULL as its own mark, so different rows never
    share an input text. `compat` joins the values with a double pipe and skips NULLs, for
    dimensions whose stored digests were made that way.
    """
    if mode == "compat":
        return F.sha2(F.concat_ws(COMPAT_SEPARATOR, *[F.col(c).cast("string") for c in tracked]), 256)
    if mode != "framed":
        raise ValueError(f"unknown hash mode {mode!r}")
    parts = []
    for name in tracked:
        text = F.col(name).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~")))
    return F.sha2(F.concat(*parts), 256)
