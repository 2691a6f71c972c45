"""SimHash near copies: 64-bit fingerprints compared in bit planes.

Fingerprints that differ in at most two of their eight bytes' worth of bits agree on at least six whole
bytes. So each distinct fingerprint is dealt to the 28 ways of leaving two bytes out; those that agree on
the other six meet in one group. Such a group holds at most 2^16 distinct fingerprints, whatever the data,
as equal ones are reduced to one row before. Within a group the 16 free bits are stored as bit planes, 64
fingerprints a machine word, and distances grow plane by plane in carry-save counters.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import joined, pieces, run_starts, staged, whole_runs
from tidemark.llm.components import components

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 2
#: Pairs of byte positions that may differ; byte 0 is the lowest.
FREE_BYTES = list(combinations(range(8), 2))
#: Runs up to this size are compared by shifting the planes; larger ones in tiles.
SHIFT_RUN = 32
TILE = 2048
#: Smaller sorted batches are gathered to about this many rows, as each pass costs the same at any size.
GATHER_ROWS = 200_000


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of a whole text; zero without any word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle_words:
        hashes = digest(line, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        count = len(words) - shingle_words + 1
        spans = zip(starts[:count].tolist(), ends[shingle_words - 1 :].tolist(), strict=True)
        hashes = b"".join([digest(line[a:b], SEED) for a, b in spans])
    total, ones = len(hashes) // 8, np.zeros(64, np.int64)
    for at in range(0, total, 8192):
        part = np.frombuffer(hashes, np.uint8, count=8 * min(8192, total - at), offset=8 * at).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        values = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(values.view(np.int64))], names=["id", "fp"]
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per row; `fp` holds the 64 bits as a signed long."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _fingerprints, "id long, fp long"
    )


def _counted(diffs: Iterator[np.ndarray], alive: np.ndarray) -> np.ndarray:
    """Lanes of `alive` whose count of set differences stays within the radius of two.

    `ones` and `twos` are the carry-save counter; a lane is out for good once it reaches three. The loop
    ends as soon as every lane of the block is out.
    """
    ones, twos, alive = np.zeros_like(alive), np.zeros_like(alive), alive.copy()
    for step, diff in enumerate(diffs):
        carry = ones & diff
        ones = ones ^ diff
        alive &= ~(twos & (carry | ones))
        twos = twos | carry
        if step % 4 == 3 and not alive.any():
            break
    return alive


def _planes(free: np.ndarray) -> np.ndarray:
    """Bit planes of 16-bit values, packed 64 values a word; row j holds bit j."""
    size = -(-len(free) // 64) * 64
    padded = np.zeros(size, np.uint16)
    padded[: len(free)] = free
    bits = ((padded[None, :] >> np.arange(16, dtype=np.uint16)[:, None]) & 1).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _lanes(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little").astype(bool)


def _shift_down(planes: np.ndarray, lag: int) -> np.ndarray:
    """Lane i of the result is lane i + lag, for lags under 64."""
    following = np.zeros_like(planes)
    following[..., :-1] = planes[..., 1:]
    return (planes >> np.uint64(lag)) | (following << np.uint64(64 - lag))


def _near_in_short_runs(free: np.ndarray, run: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs within runs of at most SHIFT_RUN rows, all runs of the batch at once, one lag at a time."""
    left, right, rows = [], [], np.arange(len(free))
    for lag in range(1, SHIFT_RUN):
        keep = length[rows] > lag
        rows = rows[keep]
        if len(rows) <= lag:
            break
        planes = _planes(free[rows])
        same = np.zeros(planes.shape[1] * 64, np.uint8)
        same[: len(rows) - lag] = run[rows[lag:]] == run[rows[:-lag]]
        alive = np.packbits(same, bitorder="little").view(np.uint64)
        moved = _shift_down(planes, lag)
        found = np.flatnonzero(_lanes(_counted((planes[j] ^ moved[j] for j in range(16)), alive)))
        left.append(rows[found])
        right.append(rows[found + lag])
    return _together(left), _together(right)


def _near_in_long_run(free: np.ndarray, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of one long run, tile against tile; a tile's planes are built once per query block."""
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    for at in range(0, len(free), TILE):
        planes = _planes(free[at : at + TILE])
        size = min(TILE, len(free) - at)
        valid = np.packbits(np.arange(planes.shape[1] * 64) < size, bitorder="little").view(np.uint64)
        for low in range(0, at + size, 256):
            asked = free[low : min(low + 256, at + size)]
            masks = np.where((asked[:, None] >> np.arange(16, dtype=np.uint16)) & 1, ones, np.uint64(0))
            alive = np.broadcast_to(valid, (len(asked), len(valid)))
            near = _counted((planes[j][None, :] ^ masks[:, j][:, None] for j in range(16)), alive)
            i, j = np.nonzero(_lanes(near))
            keep = i + low < j + at
            yield first + low + i[keep], first + at + j[keep]


def _together(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _links_of(way: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    starts = run_starts(way, key)
    sizes = np.diff(np.append(starts, len(way)))
    in_run = np.repeat(np.arange(len(starts)), sizes)
    keep = sizes[in_run] > 1
    if not keep.any():
        return
    way, key, fp, in_run = way[keep], key[keep], fp[keep], in_run[keep]
    low, high = np.array(FREE_BYTES, np.uint64).T
    shift_low, shift_high = low[way] * np.uint64(8), high[way] * np.uint64(8)
    byte = np.uint64(255)
    free = (((fp >> shift_low) & byte) | (((fp >> shift_high) & byte) << np.uint64(8))).astype(np.uint16)
    starts = run_starts(in_run)
    length = np.diff(np.append(starts, len(in_run)))
    short = (length <= SHIFT_RUN).repeat(length)
    rows = np.flatnonzero(short)
    if len(rows):
        a, b = _near_in_short_runs(free[rows], in_run[rows], length.repeat(length)[rows])
        yield _first_way(way, fp, rows[a], rows[b])
    for at, size in zip(starts[length > SHIFT_RUN], length[length > SHIFT_RUN], strict=True):
        for a, b in _near_in_long_run(free[at : at + size], int(at)):
            yield _first_way(way, fp, a, b)


def _first_way(way: np.ndarray, fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A pair that meets in several groups is kept in the first way that leaves its bytes out."""
    diff = fp[a] ^ fp[b]
    apart = np.zeros(len(diff), np.int64)
    for byte in range(8):
        apart |= (((diff >> np.uint64(8 * byte)) & np.uint64(255)) != 0).astype(np.int64) << byte
    first = np.zeros(256, np.int64)
    for mask in range(256):
        fits = [n for n, (x, y) in enumerate(FREE_BYTES) if mask & ~((1 << x) | (1 << y)) == 0]
        first[mask] = fits[0] if fits else -1
    keep = first[apart] == way[a]
    return fp[a[keep]], fp[b[keep]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def gathered() -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for run in whole_runs(batches, ["way", "key"]):
            held.append(run)
            rows += run.num_rows
            if rows >= GATHER_ROWS:
                yield joined(held)
                held, rows = [], 0
        if held:
            yield joined(held)

    for batch in gathered():
        way, key, fp = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("way", "key", "fp"))
        for a, b in _links_of(way.astype(np.int64), key, fp.view(np.uint64)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
            )


def near_links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column `fp`) within the radius, each once."""
    masks = [~((255 << 8 * x) | (255 << 8 * y)) & 0xFFFFFFFFFFFFFFFF for x, y in FREE_BYTES]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])
    dealt = distinct.select("fp", F.posexplode(keys).alias("way", "key"))
    return dealt.repartition("way", "key").sortWithinPartitions("way", "key").mapInArrow(_links, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, `fingerprint` (16 hex digits) and `component_id`, the smallest id reachable.

    Null and empty texts have the fingerprint zero, linked like any other. Repeated ids give a row each. A
    null id stays null, never names a component, and gets a null component if no row of its component has an
    id. Other columns are ignored; an empty table gives an empty result.
    """
    prints = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct-fingerprints")
    roots = components(near_links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component, with all its columns: the row of the smallest id, nulls last.

    Rows are told apart by a number that they get once they are written, so of rows that share an id, or have none,
    one stays for each component that they belong to. Null and empty texts are one component. An empty table gives
    an empty result; columns may have any names.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = staged(docs.select(F.monotonically_increasing_id().alias("number"), whole.alias("row")), "numbered-rows")
    text = F.col(f"row.`{text_col}`")
    prints = staged(fingerprints(rows.select("number", text.alias("text")), "number", "text"), "fingerprints")
    distinct = staged(prints.select("fp").distinct(), "distinct-fingerprints")
    roots = components(near_links(distinct)).withColumnRenamed("root", "component")
    placed = prints.join(roots, prints.fp == roots.node, "left").select(
        F.col("id").alias("at"), F.coalesce("component", "fp").alias("component"))
    own = rows.select("number", F.col(f"row.`{id_col}`").cast("long").alias("own"))
    ordered = placed.join(own, F.col("at") == F.col("number"))
    first = ordered.groupBy("component").agg(F.min(F.struct(F.col("own").isNull(), "own", "at")).alias("first"))
    winners = first.select(F.col("first.at").alias("winner"))
    kept = rows.join(winners, F.col("number") == F.col("winner"), "left_semi")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
