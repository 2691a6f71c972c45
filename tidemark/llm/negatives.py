"""Hard negatives: for each anchor and each of its positives, the best other-label rows in a window of scores.

Anchors are dealt to groups of a bounded size and all rows to slices; a task holds one group and streams one slice.
The anchors of a group are joined by a minimum spanning tree of their distances. Along an edge, the score of a row x
changes by (child - parent) . x, which is no more than the edge's length times the length of x; so the parent's score
plus or minus that product bounds the child's. Only rows whose bounds overlap a window of the child, and reach the
best ones that it has so far, are scored again; the others keep their bounds for the child's own children.

The same search finds the positives first, with one window that is open at both ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import run_starts, staged

#: Rows that meet a group at a time.
BLOCK = 1024
#: Rows of a slice at most, on average.
SLICE = 1 << 20
#: Doubles hold whole numbers up to here, so sums that stay below are exact.
EXACT = 1 << 53
#: Scores are longs; larger ones are taken as these.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Mining:
    """`every`: ids it divides are anchors. `positives`, `negatives`: how many. `low`, `high`: the window in
    hundredths of the positive's score. `relabelled`: ids it divides have the next of ten labels. `scale`: a component
    is floor(scale * x). `group`: anchors of a tree, which bounds a task's memory and alters no result."""

    every: int = 100
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    relabelled: int = 7
    labels: int = 10
    scale: int = 256
    group: int = 2048


def spanning_tree(vectors: np.ndarray) -> list[tuple[int, int, float]]:
    """(child, parent, distance) of a minimum spanning tree, parents first; the root, 0, is its own parent."""
    count = len(vectors)
    norms = np.einsum("ij,ij->i", vectors, vectors)
    edges = [(0, 0, 0.0)]
    best, parent = np.full(count, np.inf), np.zeros(count, np.int64)
    outside = np.ones(count, bool)
    newest = 0
    for _ in range(count - 1):
        outside[newest] = False
        distance = norms + norms[newest] - 2 * (vectors @ vectors[newest])
        closer = outside & (distance < best)
        best[closer], parent[closer] = distance[closer], newest
        newest = int(np.argmin(np.where(outside, best, np.inf)))
        edge = vectors[newest] - vectors[parent[newest]]
        edges.append((newest, int(parent[newest]), float(np.sqrt(edge @ edge))))
    return edges


class Group:
    """Anchors of one length with their tree, their windows and the best rows found so far."""

    def __init__(self, anchors: list[dict], keep: int) -> None:
        self.anchors, self.keep = anchors, keep
        self.vectors = np.array([a["vec"] for a in anchors], np.float64)
        self.largest = float(np.abs(self.vectors).max(initial=0))
        self.tree = spanning_tree(self.vectors)
        self.labels = np.array([a["label"] for a in anchors])
        self.rows = np.array([a["row"] for a in anchors])
        self.low = [np.array(a["low"], np.float64) for a in anchors]
        self.high = [np.array(a["high"], np.float64) for a in anchors]
        #: By anchor and window: (score, id) of the best rows, sorted.
        self.best = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(a["low"]) for a in anchors]
        #: What a score must reach to matter: the window's lower end, or the last of a full list.
        self.floor = [low.copy() for low in self.low]
        self.asked = self.scored = 0

    def meet(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray, same: bool) -> None:
        """Takes a block of rows into account; `same` for rows of the anchor's label, else for those of others."""
        lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        wide = self.largest * float(np.abs(vectors).max(initial=0)) * vectors.shape[1] >= EXACT
        middle, spread = np.zeros((len(self.anchors), len(ids))), np.zeros((len(self.anchors), len(ids)))
        for child, parent, distance in self.tree:
            fits = (labels == self.labels[child]) == same
            if same:
                fits &= rows != self.rows[child]
            if child != parent:
                middle[child] = middle[parent]
                # The last term covers what rounding may add.
                spread[child] = spread[parent] + distance * lengths * (1 + 1e-9) + 1e-9 * np.abs(middle[parent])
                upper, lower = middle[child] + spread[child], middle[child] - spread[child]
                matters = np.zeros(len(ids), bool)
                for floor, high in zip(self.floor[child], self.high[child], strict=True):
                    matters |= (upper >= floor) & (lower <= high)
                self.asked += int(fits.sum())
                if not wide:
                    fits &= matters
                self.scored += int(fits.sum())
                at = np.flatnonzero(fits)
            else:
                at = np.arange(len(ids))
            if not len(at):
                continue
            exact = self._scores(child, vectors if len(at) == len(ids) else vectors[at], wide)
            if not wide:  # else all that fit are scored
                middle[child, at], spread[child, at] = exact, 0
            keep = fits[at]
            self._take(child, exact[keep], ids[at[keep]])

    def _scores(self, child: int, vectors: np.ndarray, wide: bool) -> np.ndarray:
        """Inner products as whole numbers; as Python's integers where doubles can't hold them."""
        if not wide:
            return (vectors @ self.vectors[child]).astype(np.int64)
        own = [int(x) for x in self.vectors[child]]
        sums = (sum(a * int(x) for a, x in zip(own, row, strict=True)) for row in vectors)
        return np.array([min(max(s, LEAST), MOST) for s in sums], np.int64)

    def _take(self, child: int, scores: np.ndarray, ids: np.ndarray) -> None:
        for window, (floor, high) in enumerate(zip(self.floor[child], self.high[child], strict=True)):
            inside = (scores >= floor) & (scores <= high)
            if not inside.any():
                continue
            old = self.best[child][window]
            every, names = np.concatenate((old[0], scores[inside])), np.concatenate((old[1], ids[inside]))
            order = np.lexsort((names, _descending(every)))[: self.keep]
            self.best[child][window] = every[order], names[order]
            if len(order) == self.keep:
                self.floor[child][window] = every[order[-1]]

    def found(self) -> pa.RecordBatch:
        """(row, window, other, score) of the best rows of all windows."""
        out = [
            (np.full(len(score), self.rows[a]), np.full(len(score), w), other, score)
            for a, windows in enumerate(self.best)
            for w, (score, other) in enumerate(windows)
        ]
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "window", "other", "score"])


def _descending(scores: np.ndarray) -> np.ndarray:
    """Keys that sort scores downwards, the least long included."""
    return ~scores


def best_in_windows(
    anchors: DataFrame, rows: DataFrame, groups: DataFrame | int, keep: int, same: bool
) -> DataFrame:
    """(row, window, other, score): of each anchor and window the `keep` best rows, by score, then by id.

    `anchors`: (grp, row, label, vec, low, high), windows as arrays. `rows`: (id, row, label, vec). Rows meet all
    groups 0 to `groups`, or those that a table (label, grps) names for their label. `same`: rows of the anchor's
    label, itself left out; else those of the other labels.
    """
    width = 2 * rows.sparkSession.sparkContext.defaultParallelism
    if isinstance(groups, int):
        placed = rows.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn(
            "grp", F.col("grp").cast("long"))
        count = groups
    else:
        placed = rows.join(groups.withColumnRenamed("label", "of"), F.col("label") == F.col("of")).withColumn(
            "grp", F.explode("grps"))
        count = groups.agg(F.sum(F.size("grps"))).first()[0] or 1
    # So many slices that all cores have work; a group's results come once from each slice.
    slices = max(1, -(-width // count), -(-rows.count() // SLICE))
    dim = F.size("vec").alias("dim")
    ask = anchors.select(
        "grp", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), dim, F.lit(0).alias("side"),
        F.lit(None).cast("long").alias("id"), "row", "label", "vec", "low", "high")
    told = placed.select(
        "grp", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int").alias("slice"), dim, F.lit(1).alias("side"),
        "id", "row", "label", "vec", F.lit(None).cast("array<double>").alias("low"), F.lit(None).cast("array<double>").alias("high"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, group = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(n).to_numpy() for n in ("grp", "slice", "dim", "side")]
            starts = run_starts(*columns)
            for low, high in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
                here = tuple(int(c[low]) for c in columns[:3])
                if here != key:
                    if group:
                        yield group.found()
                    key, asked, group = here, [], None
                part = batch.slice(low, high - low)
                if columns[3][low] == 0:
                    asked.extend(part.select(["row", "label", "vec", "low", "high"]).to_pylist())
                    continue
                if not asked:
                    continue
                group = group or Group(asked, keep)
                for at in range(0, part.num_rows, BLOCK):
                    block = part.slice(at, BLOCK)
                    vectors = block.column("vec").flatten().to_numpy().reshape(block.num_rows, -1)
                    group.meet(*(block.column(n).to_numpy() for n in ("id", "row", "label")), vectors, same)
        if group:
            yield group.found()

    order = ["grp", "slice", "dim", "side"]
    dealt = ask.unionByName(told).repartition(count * slices, "grp", "slice").sortWithinPartitions(*order)
    found = dealt.mapInArrow(search, "row long, window long, other long, score long")
    rank = F.row_number().over(Window.partitionBy("row", "window").orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= keep)


def _grouped(anchors: DataFrame, spec: Mining, by_label: bool) -> tuple[DataFrame, DataFrame | int]:
    """Anchors with their group, dealt by hash; and the groups, of each label or in all."""
    spread = F.xxhash64("row", F.lit(3))
    if not by_label:
        groups = max(1, -(-anchors.count() // spec.group))
        return anchors.withColumn("grp", F.pmod(spread, F.lit(groups))), groups
    counts = anchors.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / spec.group).alias("n"))
    # A label has fewer than 2^32 groups, so the numbers don't meet.
    first = F.col("label") * (1 << 32)
    groups = staged(
        counts.select("label", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda g: first + g).alias("grps")), "anchor-groups")
    named = anchors.join(groups.withColumnRenamed("label", "of"), F.col("label") == F.col("of"))
    own = F.element_at("grps", (F.pmod(spread, F.size("grps")) + 1).cast("int"))
    return named.withColumn("grp", own).drop("of", "grps"), groups


def prepared(vectors: DataFrame, spec: Mining, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(row, id, label, vec) of the rows that take part, numbered and scaled."""
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * spec.scale) < F.lit(float("inf"))))
    own, number = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    moved = F.coalesce(own % spec.relabelled == 0, F.lit(False))
    picked = vectors.where(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & finite).select(
        own.alias("id"), F.when(moved, F.pmod(number + 1, F.lit(spec.labels))).otherwise(number).alias("label"),
        # Not F.floor, which gives longs and cuts what is beyond them.
        F.transform(vec, lambda x: _floor(x * spec.scale)).alias("vec"))
    return staged(picked.withColumn("row", F.monotonically_increasing_id()), "mining-rows")


def _floor(x: Column) -> Column:
    return F.rint(x) - (F.rint(x) > x).cast("double")


def hard_negatives(
    vectors: DataFrame, spec: Mining = Mining(), id_col: str = "vec_id", vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null id, label or vector, with an empty vector, or with a component that is null or, also once scaled,
    not finite take no part. Only vectors of one length are scored with each other. Repeated ids are rows of their
    own, also as anchors; equal scores and ids are equal rows of the result. Scores beyond a long count as its ends,
    and windows beyond 2^53 have rounded ends. A positive without a row in its window gives no row, an empty table an
    empty result. Other columns are ignored.
    """
    rows = prepared(vectors.where(F.col(id_col).isNotNull() & (F.size(vec_col) > 0)), spec, id_col, vec_col, label_col)
    anchors = rows.where(F.col("id") % spec.every == 0)
    unbounded = anchors.withColumn("low", F.array(F.lit(float("-inf")))).withColumn("high", F.array(F.lit(float("inf"))))
    asked, groups = _grouped(unbounded, spec, True)
    positives = staged(best_in_windows(asked, rows, groups, spec.positives, True), "positives")
    # Windows in the order of the positives' ranks.
    listed = positives.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "score"))).alias("found"))
    # Whole hundredths: the window's ends are whole scores.
    share = lambda score, part: score.cast("decimal(20,0)") * part / F.lit(100).cast("decimal(3,0)")
    low = F.transform("found", lambda p: F.ceil(share(p["score"], spec.low)).cast("double"))
    high = F.transform("found", lambda p: F.floor(share(p["score"], spec.high)).cast("double"))
    windows = listed.select(F.col("row").alias("of"), low.alias("low"), high.alias("high"))
    named, groups = _grouped(anchors.join(windows, F.col("row") == F.col("of")).drop("of"), spec, False)
    negatives = best_in_windows(named, rows, groups, spec.negatives, False)
    ids = anchors.select(F.col("row").alias("of"), F.col("id").alias("anchor_id"))
    pairs = positives.select(
        F.col("row").alias("of"), (F.col("rank") - 1).cast("long").alias("at"), F.col("other").alias("positive_id"),
        F.col("score").alias("positive_score")).join(ids, "of")
    return negatives.join(pairs, (F.col("row") == F.col("of")) & (F.col("window") == F.col("at"))).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


ORACLE_SQL = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, a.label AS own, r.id, r.label, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM r a JOIN r ON a.id % 100 = 0 AND a.id <> r.id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE label <> own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
