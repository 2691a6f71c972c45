"""What several operators share: staged tables, Arrow batches in pieces, whole runs of a sorted partition."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_dir

WORD = r"[^\x20\x09-\x0D]+"
ASCII_LOWER = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ROWS_AT_ONCE = 256


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers of a local session import this package; a cluster ships it with `--py-files`."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join(p for p in (*paths, root) if p)
    return spark


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` as a table in the shared folder and reads it: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of an id written as text, modulo `n`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches in slices of a few rows, so that only a few texts exist as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Re-cuts batches that are sorted by integer `keys` so that rows of equal keys stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        first_differs = held and any(
            held[-1].column(k)[held[-1].num_rows - 1].as_py() != batch.column(k)[0].as_py() for k in keys
        )
        if first_differs:
            yield joined(held)
            held = []
        if last:
            held.append(batch.slice(0, last))
            yield joined(held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """First positions of the runs of equal values."""
    change = np.ones(len(columns[0]), dtype=bool)
    change[1:] = False
    for column in columns:
        change[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(change)
