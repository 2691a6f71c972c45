from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embedding_dedup
from tidemark.llm.embedding_dedup import Descent, embedding_components
from tests.llm.test_simhash import closure

SCHEMA = "vec_id long, embedding array<float>, label int"
THRESHOLD = 0.93


def expected(rows):
    """Links by brute force, in double precision."""
    usable = [
        (n, i, np.array(v, np.float32).astype(np.float64), label) for n, (i, v, label) in enumerate(rows)
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    pairs = []
    for x, (n, _, a, la) in enumerate(usable):
        for m, _, b, lb in usable[x + 1 :]:
            if la == lb and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= THRESHOLD:
                pairs.append((n, m))
    root = closure(pairs, range(len(rows)))
    ids = {}
    for n, (i, _, _) in enumerate(rows):
        ids.setdefault(root[n], []).append(i)
    least = {r: min([i for i in own if i is not None], default=None) for r, own in ids.items()}
    degree = np.zeros(len(rows), int)
    for n, m in pairs:
        degree[n] += 1
        degree[m] += 1
    return [(i, int(degree[n]), least[root[n]], i == least[root[n]]) for n, (i, _, _) in enumerate(rows)]


def compare(spark, rows, spec=Descent()):
    found = embedding_components(spark.createDataFrame(rows, SCHEMA), spec).collect()
    assert sorted([tuple(r) for r in found], key=str) == sorted(expected(rows), key=str)


def vectors(groups, seed, dim=32):
    rng, out = np.random.default_rng(seed), []
    for size, spread in groups:
        centre = rng.normal(size=dim)
        out += [(centre + rng.normal(size=dim) * spread).tolist() for _ in range(size)]
    return out


def test_pairs_groups_and_a_dense_group(spark):
    base = vectors([(1, 0)] * 200 + [(2, 0.1)] * 30 + [(9, 0.1)] * 4 + [(40, 0.1)] + [(150, 0.2), (60, 0.27)], 4)
    base += [base[0]] * 5 + [[2 * x for x in base[1]]] * 3 + [base[-1]] * 20
    rows = [(i * 7 % 100_003, v, i % 2) for i, v in enumerate(base[:260])]
    rows += [(200_000 + i, v, 1) for i, v in enumerate(base[260:])]
    compare(spark, rows)


def test_given_vectors(spark):
    found = embedding_components(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(
        "vec_id", "embedding", "label").collect()]
    truth = {r[0]: r[1] for r in expected(rows)}
    got = {r.vec_id: r.n_links for r in found.collect()}
    assert got.keys() == truth.keys()
    assert all(got[i] <= truth[i] for i in got) and sum(got.values()) >= 0.97 * sum(truth.values())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1),
            (7, [inf, 1.0], 1), (8, [1.0, None], 1), (9, [], 1), (10, [1.0, 0.0], None), (11, [1.0, 0.0], 2),
            (12, [1.0, 0.0, 0.0], 1), (13, [3.0, 0.0, 0.0], 1), (None, [0.0, 1.0], 3), (15, [-1.0, 0.0], 1)]
    found = [tuple(r) for r in embedding_components(spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("x")).withColumn(
        "root", F.lit(1))).collect()]
    want = [(i, n, c, i == c) for i, n, c, _ in expected(rows)]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert embedding_components(spark.createDataFrame([], SCHEMA)).count() == 0


def lost(spark, dense, alone, pairs, spec, likely=()):
    """The audit's recall where a dense group is whole and all pairs outside it are lost."""
    base = vectors([(dense, 0.05)] + [(1, 0)] * alone + [(2, 0.05)] * pairs, 9)
    nodes = spark.createDataFrame([(n, 1, v) for n, v in enumerate(base)], "node long, kind long, vec array<float>")
    roots = spark.createDataFrame([(n, 0, True) for n in range(dense)], "node long, root long, dense boolean")
    graph = spark.createDataFrame([(n, 0, 0.99) for n in likely], "a long, b long, sim float")
    return embedding_dedup.audit(spark.createDataFrame([], "a long, b long"), roots, graph, nodes, spec)


def test_audit_sees_sparse_links_beside_a_dense_group(spark):
    assert lost(spark, 300, 100, 30, Descent()) == 0


def test_audit_grows_until_it_holds_rare_links(spark):
    assert lost(spark, 2, 1500, 2, Descent(audited=16)) == 0


def test_audit_asks_a_bounded_number_of_nodes(spark, monkeypatch):
    """Nodes near the threshold are a sample of their own, so few links are seen there."""
    asked, real = [], embedding_dedup._audited
    monkeypatch.setattr(embedding_dedup, "_audited", lambda sample, *rest: asked.append(len(sample)) or real(sample, *rest))
    spec = Descent(audited=16, most_audited=50)
    assert lost(spark, 2, 1500, 2, spec, likely=range(1502, 1506)) == 0
    assert sum(asked) <= 2 * 50 and 4 in asked


def test_doubles_are_compared_as_doubles(spark):
    """Pairs around the threshold that single precision can't tell apart."""
    rng, rows = np.random.default_rng(2), []
    for n in range(20):
        a, b = (np.linalg.qr(rng.normal(size=(16, 2)))[0].T)
        cosine = 0.93 + (1e-10 if n % 2 else -1e-10)
        rows += [(2 * n, (a * 5).tolist(), n), (2 * n + 1, (3 * (cosine * a + np.sqrt(1 - cosine**2) * b)).tolist(), n)]
    found = embedding_components(spark.createDataFrame(rows, SCHEMA.replace("float", "double"))).collect()
    assert {r.vec_id: r.n_links for r in found} == {i: label % 2 for i, _, label in rows}


def test_too_low_a_recall_fails(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "audit", lambda *_: 0.5)
    rows = [(n, v, 1) for n, v in enumerate(vectors([(2, 0.1)] * 10, 3))]
    with pytest.raises(RuntimeError, match="recall 0.500"):
        embedding_components(spark.createDataFrame(rows, SCHEMA), Descent(rounds=2))
