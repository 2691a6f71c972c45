"""Near copies among embeddings by NN-descent.

Equal vectors of a label become one node. A first neighbour graph comes from random projections: rows sorted by
sign codes, compared in small blocks, several times over. Then each round joins the neighbours of every node with
one another, vectors in eight bits, and keeps the best; an audit against brute force on a sample says whether another round, with
longer lists and a new first graph of more trees, is needed. It asks for links outside dense components only, of a
bounded sample. If no round meets the recall, the query fails. Pairs near the threshold are compared again in double
precision.

A node whose whole list lies above the threshold is saturated. Components with such a node are dense, and their
lists are enlarged to the whole component, exactly: members within half the threshold's angle of a pivot are all
linked with one another by the triangle inequality and are only counted; the few others are compared with all
members in blocks. So a large group of near copies costs neither all its pairs nor a capped list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import joined, run_starts, staged, whole_runs
from tidemark.llm.components import components

BLOCK = 48
#: Approximate cosines are off by less than this.
SLACK = 0.02


@dataclass(frozen=True)
class Descent:
    """`neighbours`: list length. `trees`: sorted projections for the first graph. `recall`: asked of the audit,
    whose samples begin with `audited` nodes and grow until they hold `least_links` links outside dense components,
    or `most_audited` nodes each.
    `rounds`: with lists twice as long and twice the trees each time, at most."""

    threshold: float = 0.93
    neighbours: int = 12
    trees: int = 6
    iterations: int = 2
    rounds: int = 3
    recall: float = 0.97
    audited: int = 512
    most_audited: int = 4096
    least_links: int = 200
    seed: int = 11


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows have one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _eighths(column: pa.Array) -> np.ndarray:
    """Unit vectors from their eight-bit form."""
    rows = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), -1).astype(np.float32)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def nodes_of(rows: DataFrame) -> DataFrame:
    """Distinct valid vectors: (node, kind, vec, eight, least, copies), `kind` standing for label and length."""
    distinct = rows.where("valid").groupBy("h1", "h2").agg(
        F.first("kind").alias("kind"), F.first("vec").alias("vec"), F.min("id").alias("least"),
        F.count(F.lit(1)).alias("copies"),
    )

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            eight = []
            for v in batch.column("vec").to_pylist():
                x = np.array(v, np.float64)
                eight.append(np.rint(127 * x / np.abs(x).max()).astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(eight, pa.binary())], names=[*batch.schema.names, "eight"])

    numbered = distinct.withColumn("node", F.monotonically_increasing_id())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema) + ", eight binary"
    return staged(numbered.mapInArrow(shrink, schema), "vectors")


def _best(edges: DataFrame, size: int, by: str = "a", other: str = "b") -> DataFrame:
    """The `size` best edges of each `by`; the engine drops the others before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("sim"), other))
    return edges.withColumn("_rank", rank).where(F.col("_rank") <= size).drop("_rank")


def _top_pairs(units: np.ndarray, node: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sims = units @ units.T
    np.fill_diagonal(sims, -2)
    size = min(size, len(node) - 1)
    best = np.argpartition(-sims, size - 1, axis=1)[:, :size]
    rows = np.repeat(np.arange(len(node)), size)
    return node[rows], node[best.reshape(-1)], sims[rows, best.reshape(-1)]


def _edges(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim.astype(np.float32))], names=["a", "b", "sim"]
    )


def first_graph(nodes: DataFrame, spec: Descent) -> DataFrame:
    """(a, b, sim) from blocks of rows that lie together in the order of their random sign codes."""
    trees, seed = spec.trees, spec.seed

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in whole_dims(batches):
            units, size = _eighths(batch.column("eight")), batch.num_rows
            dim = units.shape[1]
            if dim not in planes:
                planes[dim] = np.random.default_rng((seed, dim)).normal(size=(dim, trees * 48)).astype(np.float32)
            signs = (units @ planes[dim] > 0).reshape(size, trees, 48)
            code = signs @ (np.int64(1) << np.arange(47, -1, -1, dtype=np.int64))
            for t in range(trees):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("kind"), pa.array(np.full(size, t), pa.int32()), pa.array(code[:, t], pa.int64()),
                     batch.column("node"), batch.column("eight")], names=["kind", "tree", "code", "node", "eight"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, tree, node = (batch.column(n).to_numpy() for n in ("kind", "tree", "node"))
            starts = run_starts(kind, tree)
            for low, high in zip(starts, np.append(starts[1:], len(node)), strict=True):
                units = _eighths(batch.column("eight").slice(low, high - low))
                out = [
                    _top_pairs(units[at : at + BLOCK], node[low + at : min(high, low + at + BLOCK)], spec.neighbours)
                    # Blocks overlap by half, so that neighbours at a border meet.
                    for at in range(0, max(1, high - low - BLOCK // 2), BLOCK // 2)
                    if high - low - at > 1
                ]
                if out:
                    yield _edges(*(np.concatenate(x) for x in zip(*out, strict=True)))

    coded = nodes.select("kind", "node", "eight").mapInArrow(codes, "kind long, tree int, code long, node long, eight binary")
    order = ["kind", "tree", "code", "node"]
    pairs = coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compare, "a long, b long, sim float")
    return _best(pairs.groupBy("a", "b").agg(F.max("sim").alias("sim")), spec.neighbours)


def whole_dims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of batches whose vectors have one kind, and so one length."""
    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.column("kind").to_numpy()
        order = np.argsort(kind, kind="stable")
        starts = run_starts(kind[order])
        for low, high in zip(starts, np.append(starts[1:], len(kind)), strict=True):
            yield batch.take(pa.array(order[low:high]))


def refined(graph: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """One iteration: neighbours of each node, in both directions, are compared with one another."""
    backward = _best(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"), size)
    around = graph.select("a", "b").unionByName(backward.select("a", "b")).distinct()
    worst = graph.groupBy("a").agg(F.when(F.count(F.lit(1)) >= size, F.min("sim")).otherwise(F.lit(-2.0)).alias("worst"))
    members = nodes.select("node", "eight").join(worst.withColumnRenamed("a", "node"), "node", "left")
    spread = around.join(members, F.col("b") == F.col("node")).select("a", "node", "eight", "worst")

    def join_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(batches, ["a"]):
            centre, node = batch.column("a").to_numpy(), batch.column("node").to_numpy()
            worst = batch.column("worst").fill_null(-2.0).to_numpy(zero_copy_only=False).astype(np.float32)
            starts = run_starts(centre)
            out = []
            for low, high in zip(starts, np.append(starts[1:], len(centre)), strict=True):
                if high - low < 2:
                    continue
                units = _eighths(batch.column("eight").slice(low, high - low))
                sims = units @ units.T
                np.fill_diagonal(sims, -3)
                i, j = np.nonzero(sims > worst[low:high, None] + 1e-6)  # better than the worst that i has
                out.append((node[low + i], node[low + j], sims[i, j]))
            if out:
                a, b, sim = (np.concatenate(x) for x in zip(*out, strict=True))
                order = np.lexsort((b, a))
                first = run_starts(a[order], b[order])
                yield _edges(a[order][first], b[order][first], sim[order][first])

    found = spread.repartition("a").sortWithinPartitions("a").mapInArrow(join_locally, "a long, b long, sim float")
    merged = graph.select("a", "b", "sim").unionByName(found).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    return staged(_best(merged, size), "neighbours")


def _cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision."""
    left, right = left.astype(np.float64), right.astype(np.float64)
    dots = np.einsum("ij,ij->i", left, right)
    return dots / (np.sqrt(np.einsum("ij,ij->i", left, left)) * np.sqrt(np.einsum("ij,ij->i", right, right)))


def exact_links(graph: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Undirected (a, b), a < b, of the graph's pairs whose cosine in double precision reaches the threshold."""
    pairs = graph.where(F.col("sim") >= threshold - SLACK).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("vec").alias(f"v{name}"), F.col("kind").alias(f"k{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where("ka = kb").select(F.col("ka").alias("kind"), "a", "b", "va", "vb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_dims(batches):
            keep = _cosines(_matrix(batch.column("va")), _matrix(batch.column("vb"))) >= threshold
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return staged(both.mapInArrow(verify, "a long, b long"), "vector-links")


def audit(links: DataFrame, roots: DataFrame, graph: DataFrame, nodes: DataFrame, spec: Descent) -> float:
    """Estimated part of all true links that the graph has, without those inside a dense component.

    Those are found exactly later on. Nodes that list a neighbour near the threshold are sampled apart from the
    others, as they hold most links; each sample grows until both together hold `least_links` links, or to
    `most_audited` nodes. So the cost grows with the nodes, and each sample counts for its part of all nodes.
    Where links are so rare that a sample of that size holds few, the estimate is as rough as they are few.
    """
    dense = roots.where("dense").select("node", "root")
    near = graph.where(F.col("sim") >= spec.threshold - 5 * SLACK).select(F.col("a").alias("node")).distinct()
    placed = nodes.select("node", "kind", "vec").join(dense, "node", "left").join(
        near.withColumn("likely", F.lit(True)), "node", "left").select(
        F.xxhash64("node", F.lit(spec.seed)).alias("at"), "node", "kind", "vec", F.coalesce("root", F.lit(-1)).alias("root"),
        F.coalesce("likely", F.lit(False)).alias("likely"))
    placed = staged(placed, "audited-nodes")
    sizes = {r["likely"]: r["n"] for r in placed.groupBy("likely").agg(F.count(F.lit(1)).alias("n")).collect()}
    last, asked, got, every = {}, dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    size = spec.audited
    while sum(every.values()) < spec.least_links and size:
        grown = 0
        for likely in sizes:
            own = placed.where(F.col("likely") == likely)
            own = own if likely not in last else own.where(F.col("at") > last[likely])
            sample = own.orderBy("at").limit(min(size, spec.most_audited - asked[likely])).collect()
            if not sample:
                continue
            found = _audited(sample, links, placed.drop("likely"), spec)
            last[likely], grown = sample[-1]["at"], grown + len(sample)
            asked[likely] += len(sample)
            got[likely], every[likely] = got[likely] + found[0], every[likely] + found[1]
        size = 2 * size if grown else 0
    weight = {s: sizes[s] / asked[s] for s in sizes if asked[s]}
    true = sum(w * every[s] for s, w in weight.items())
    return sum(w * got[s] for s, w in weight.items()) / true if true else 1.0


def _audited(sample: list, links: DataFrame, placed: DataFrame, spec: Descent) -> tuple[int, int]:
    """How many of the sampled nodes' links outside dense components the graph has, and how many there are."""
    by_kind: dict[int, list] = {}
    for r in sample:
        by_kind.setdefault(r["kind"], []).append((r["node"], r["root"], r["vec"]))
    asked = {k: (np.array([v[0] for v in own]), np.array([v[1] for v in own]), np.array([v[2] for v in own], np.float64))
             for k, own in by_kind.items()}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_dims(batches):
            if (kind := whole.column("kind")[0].as_py()) not in asked:
                continue
            ids, own, queries = asked[kind]
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows, node, root = _matrix(batch.column("vec")).astype(np.float64), batch.column("node").to_numpy(), batch.column("root").to_numpy()
                unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
                i, j = np.nonzero(unit(queries) @ unit(rows).T >= spec.threshold)
                keep = (ids[i] != node[j]) & ((own[i] < 0) | (own[i] != root[j]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i][keep]), pa.array(node[j][keep])], names=["q", "n"])

    true = placed.select("kind", "node", "vec", "root").mapInArrow(search, "q long, n long").select(
        F.least("q", "n").alias("a"), F.greatest("q", "n").alias("b")).distinct()
    counted = true.join(links.withColumn("found", F.lit(1)), ["a", "b"], "left").agg(
        F.count(F.lit(1)).alias("all"), F.count("found").alias("got")).first()
    return counted["got"], counted["all"]


def _rooted(links: DataFrame, graph: DataFrame, threshold: float, size: int) -> DataFrame:
    """(node, root, dense) of linked nodes; dense where a node of the component has a full list above the threshold."""
    roots = staged(components(links), "vector-components")
    full = graph.where(F.col("sim") >= threshold - SLACK).groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= size).select(F.col("a").alias("node"))
    dense = roots.join(full, "node").select("root").distinct().withColumn("dense", F.lit(True))
    return roots.join(dense, "root", "left").select("node", "root", F.coalesce("dense", F.lit(False)).alias("dense"))


def dense_links(roots: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, others): for each node of a dense component, how many vectors of it are linked, copies counted."""
    members = nodes.join(roots.where("dense"), "node").select("node", "root", "kind", "vec", "copies")
    pivots = nodes.join(roots.where("dense and node = root"), "node").select("root", F.col("vec").alias("pivot"))
    near = math.sqrt((1 + threshold) / 2) + 1e-9  # the cosine of half the threshold's angle

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_dims(batches):
            core = _cosines(_matrix(batch.column("vec")), _matrix(batch.column("pivot"))) >= near
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("node", "root", "kind", "vec", "copies")), pa.array(core)],
                names=["node", "root", "kind", "vec", "copies", "core"])

    held = nodes.schema["vec"].dataType.simpleString()
    schema = f"node long, root long, kind long, vec {held}, copies long, core boolean"
    # Written, so that the join knows how few they are.
    pivots = staged(pivots, "dense-pivots")
    placed = staged(members.join(pivots, "root").mapInArrow(measure, schema), "dense-members")
    in_core = staged(placed.where("core").groupBy("root").agg(F.sum("copies").alias("in_core")), "dense-cores")
    base = placed.join(in_core, "root", "left").select(
        "node", F.when(F.col("core"), F.col("in_core")).otherwise(F.lit(0)).alias("others"))
    # The members outside the core, in blocks, against all members of their component.
    counts = staged(
        placed.where("not core").groupBy("root").agg(F.ceil(F.count(F.lit(1)) / 256).cast("int").alias("blocks")), "dense-blocks")
    asked = placed.where("not core").join(counts, "root").select(
        "root", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"),
        "node", "kind", "vec", "copies", "core")
    every = placed.join(counts, "root").select(
        "root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"),
        "node", "kind", "vec", "copies", "core")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("root", "block", "side", "node", "copies", "core")}
            starts = run_starts(cols["root"], cols["block"], cols["side"])
            for low, high in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
                at = slice(low, high)
                key = (int(cols["root"][low]), int(cols["block"][low]))
                rows = _matrix(batch.column("vec").slice(low, high - low)).astype(np.float64)
                rows /= np.linalg.norm(rows, axis=1, keepdims=True)
                node, copies, core = cols["node"][at], cols["copies"][at], cols["core"][at]
                if cols["side"][low] == 0:
                    if key not in queries:
                        queries.clear()
                        queries[key] = (rows, node, copies)
                    else:
                        queries[key] = tuple(np.concatenate(x) for x in zip(queries[key], (rows, node, copies), strict=True))
                    continue
                ask, ids, weight = queries[key]
                linked = ask @ rows.T >= threshold
                out = [(ids, linked @ copies)]
                if core.any():  # core members learn of these; others ask for themselves
                    out.append((node[core], linked[:, core].T @ weight))
                for nodes_, others in out:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes_, pa.int64()), pa.array(others, pa.int64())], names=["node", "others"])

    order = ["root", "block", "side"]
    more = asked.unionByName(every).repartition("root", "block").sortWithinPartitions(*order).mapInArrow(
        compare, "node long, others long")
    return base.unionByName(more).groupBy("node").agg(F.sum("others").alias("others"))


def embedding_components(
    vectors: DataFrame, spec: Descent = Descent(), id_col: str = "vec_id", vec_col: str = "embedding",
    label_col: str = "label"
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors of equal, non-null labels and equal lengths link at a cosine of at least the threshold. A null vector
    or label, a zero vector, and one with a null or non-finite component link with nothing. Equal vectors (by a
    128-bit hash) are linked with each other. Repeated ids are vectors of their own; a null id never names a
    component, and is kept only if its component has no id. An empty table gives an empty result. If no round meets
    the recall, a RuntimeError says what was reached.
    """
    # Doubles stay doubles; anything else is held in single precision, which its vectors come in.
    wide = isinstance(vectors.schema[vec_col].dataType, T.ArrayType) and isinstance(
        vectors.schema[vec_col].dataType.elementType, (T.DoubleType, T.LongType, T.DecimalType))
    vec = F.col(vec_col).cast("array<double>" if wide else "array<float>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.coalesce(
        F.col(label_col).isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))
    label = F.col(label_col).cast("long")
    rows = staged(
        vectors.select(
            F.col(id_col).cast("long").alias("id"), valid.alias("valid"), vec.alias("vec"),
            F.when(valid, label * (1 << 20) + F.size(vec)).alias("kind"),
            F.xxhash64(label, vec).alias("h1"), F.xxhash64(vec, label, F.lit(1)).alias("h2")),
        "vector-rows",
    )
    nodes = nodes_of(rows)
    size = spec.neighbours
    # Another tree for each doubling beyond 65,536 nodes.
    trees = spec.trees + max(0, nodes.count().bit_length() - 16)
    graph = staged(first_graph(nodes, replace(spec, trees=trees)), "neighbours")
    for number in range(spec.rounds):
        if number:
            more = replace(spec, neighbours=size, trees=trees << number, seed=spec.seed + number)
            both = graph.select("a", "b", "sim").unionByName(first_graph(nodes, more))
            graph = staged(_best(both.groupBy("a", "b").agg(F.max("sim").alias("sim")), size), "neighbours")
        for _ in range(spec.iterations if not number else 1):
            graph = refined(graph, nodes, size)
        links = exact_links(graph, nodes, spec.threshold)
        roots = staged(_rooted(links, graph, spec.threshold, size), "vector-roots")
        recall = audit(links, roots, graph, nodes, spec)
        if recall >= spec.recall:
            break
        size *= 2
    else:
        raise RuntimeError(f"recall {recall:.3f} of the links outside dense components is under {spec.recall}")
    sparse = roots.where("not dense").select("node", "root")
    each = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = each.join(sparse.select(F.col("node").alias("a")), "a").join(
        nodes.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
    # In a dense component a core node is counted among its own core.
    inner = dense_links(roots, nodes, spec.threshold).withColumn("dense", F.lit(True))
    others = counted.withColumn("dense", F.lit(False)).unionByName(inner)
    known = nodes.select("node", "h1", "h2", "least", "copies").join(others, "node", "left").join(
        roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    n_links = F.coalesce("others", F.lit(0)) + F.when(F.coalesce("dense", F.lit(False)), F.lit(-1)).otherwise(F.col("copies") - 1)
    named = known.join(least, "root").select("h1", "h2", n_links.alias("n_links"), "component_id")
    linked = rows.where("valid").select("id", "h1", "h2").join(named, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.where("not valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
