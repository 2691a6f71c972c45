from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.classifier import CLIP, FEATURES, AttentionModel, Settings, keep_good, passages, score_quality, train

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = score_quality(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and len(held) > 500
    assert sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(9, FEATURES))
    rows[:, -1] = rng.uniform(0.2, 1, 9)
    starts, y, weight = np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    model = AttentionModel.start(5, np.zeros(FEATURES - 1), np.ones(FEATURES - 1), 3)

    def loss():
        z = model.forward(rows, starts)[0]
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum())

    grads = model.gradients(rows, starts, y, weight)
    for name, grad in grads.items():
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        old, step = model.weights[name][at], 1e-6
        model.weights[name][at] = old + step
        up = loss()
        model.weights[name][at] = old - step
        down = loss()
        model.weights[name][at] = old
        assert abs((up - down) / (2 * step) - grad[at]) < 1e-6


def test_passages_cover_whole_texts():
    assert passages(None).shape == passages(" \n").shape == (1, FEATURES)
    assert passages("word " * 64000).shape == (1000, FEATURES)
    assert np.isfinite(passages("  é🙂\x00 a a a #*$ \n!" * 99)).all()
    assert (passages("same words here " * 64)[0] != passages("same words here " * 63 + "# | & " * 64)[-1]).any()


def test_odd_rows(spark):
    good, bad = "the and of is in words here. ", "###$$$ %%% &&& *** "
    rows = [(i, (good if i % 2 else bad) * (3 + i % 5)) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (5, None), (5, 1)], "doc_id long, quality int")
    rows += [(5, good), (None, good * 10), (1000, None), (1001, ""), (1002, bad * 20000), (1003, good * 20000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("y", F.lit(1))
    found = score_quality(docs, labels).collect()
    assert len(found) == len(rows)
    score = {r.doc_id: r.score for r in found}
    assert score[1002] < 0.7 <= score[1003] and 0 <= score[1000] == score[1001] <= 1
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1003 in ids and 1002 not in ids
    assert score_quality(docs.limit(0), labels).count() == 0
    none = score_quality(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and keep_good(docs, labels.limit(0)).count() == len(rows)


def test_scores_equal_plain_attention():
    """One passage and one hidden unit at a time, from fixed weights."""
    rng = np.random.default_rng(6)
    model = AttentionModel.start(4, rng.normal(size=FEATURES - 1), rng.uniform(0.5, 2, FEATURES - 1), 9)
    model.weights["w"] = rng.normal(size=4)
    p = {k: v.tolist() for k, v in model.weights.items()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    texts = ["Some words stand here, and more. " * 40, "", None, "### $$$ 12 " * 100, "one"]
    for text, found in zip(texts, model.score([passages(t) for t in texts]), strict=True):
        hidden, energy = [], []
        for row in passages(text).tolist():
            x = [max(-CLIP, min(CLIP, (v - m) / s)) * row[-1] for v, m, s in zip(row, model.mean, model.scale)]
            h = [math.tanh(sum(a * w[j] for a, w in zip(x, p["W"])) + p["b"][j]) for j in range(4)]
            t = [math.tanh(sum(a * w[j] for a, w in zip(h, p["V"]))) for j in range(4)]
            g = [sigmoid(sum(a * w[j] for a, w in zip(h, p["U"]))) for j in range(4)]
            hidden.append(h)
            energy.append(sum(a * b * c for a, b, c in zip(t, g, p["w"])))
        total = sum(map(math.exp, energy))
        z = [sum(math.exp(e) / total * h[j] for e, h in zip(energy, hidden)) for j in range(4)]
        assert abs(found - sigmoid(sum(a * b for a, b in zip(z, p["c"])) + p["d"][0])) < 1e-6


def test_all_passages_of_a_text_teach(spark, monkeypatch):
    """Long texts are learnt from as a whole, and a repeated id is collected once for each label."""
    seen = []
    monkeypatch.setattr(AttentionModel, "fit", lambda self, bags, y, settings: seen.extend((len(b), int(v)) for b, v in zip(bags, y)))
    long = "the and of words " * 16 * 500
    docs = spark.createDataFrame([(1, long)] * 300 + [(1, "short")] * 3 + [(3, "### $ " * 10), (4, None)], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (3, 0), (4, 0)], "doc_id long, quality int")
    assert train(docs, labels, Settings(sample=10)) is not None
    held = [i for i in (1, 3, 4) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert 1 not in held and len(seen) <= 5 and {n for n, _ in seen} <= {1, 500}
    assert {y for _, y in seen} == {0, 1}
