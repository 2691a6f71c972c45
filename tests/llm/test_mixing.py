from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidemark.llm.mixing import MixSpec, bisected_exponent, mix_documents, mixed_rows, tokens_per_source

SCHEMA = "doc_id long, text string, source string"


def corpus(spark, sizes, words=10):
    rows, n = [], 0
    for source, docs in sizes.items():
        for i in range(docs):
            rows.append((n, "w " * (words + i % 7), source))
            n += 1
    return spark.createDataFrame(rows, SCHEMA)


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w)


def slow_exponent(tokens, spec):
    total = sum(tokens)
    p = [t / total for t in tokens]

    def at(a):
        z = sum(x**a for x in p)
        q = [x**a / z for x in p]
        return entropy(q), max(spec.budget * y / x for x, y in zip(p, q, strict=True))

    target = entropy(p) + spec.entropy * (math.log(len(p)) - entropy(p))
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        e, r = at(mid)
        low, high = (low, mid) if e <= target and r <= max(spec.max_repeat, spec.budget) else (mid, high)
    return high


@pytest.mark.parametrize("spec", [MixSpec(), MixSpec(entropy=0.9, max_repeat=2.0), MixSpec(entropy=0.0), MixSpec(1.0, 99, 2.0)])
def test_exponent_equals_plain_bisection(spark, spec):
    tokens = [5000, 1200, 300, 77, 4]
    sources = spark.createDataFrame([(str(t), t, 1) for t in tokens], "source string, tokens long, docs long")
    assert bisected_exponent(sources, spec) == pytest.approx(slow_exponent(tokens, spec), abs=2e-6)


def test_budget_and_permutations(spark):
    docs = corpus(spark, {"a": 3000, "b": 400, "c": 60}).cache()
    spec = MixSpec(entropy=0.6, max_repeat=8.0, block_docs=64)
    rows = mix_documents(docs, spec).collect()
    per = {r.source: r.tokens for r in tokens_per_source(
        docs.select("source", F.size(F.split(F.trim("text"), " ")).cast("long").alias("n_tokens"))).collect()}
    total, a = sum(per.values()), slow_exponent(list(per.values()), spec)
    z = sum(t**a for t in per.values())
    for source, tokens in per.items():
        wanted = tokens**a / z * spec.budget * total
        own = [r for r in rows if r.source == source]
        assert wanted - 80 <= sum(r.n_tokens for r in own) <= wanted + 1  # at most a few documents short
        passes = int(wanted // tokens)
        assert passes <= 8
        by_epoch = {}
        for r in own:
            by_epoch.setdefault(r.epoch, []).append(r)
        for epoch in range(passes):  # whole passes: each document once
            ids = [r.doc_id for r in by_epoch[epoch]]
            assert len(ids) == len(set(ids)) == {"a": 3000, "b": 400, "c": 60}[source]
        last = [r.doc_id for r in by_epoch.get(passes, [])]
        assert len(last) == len(set(last)) and set(by_epoch) <= set(range(passes + 1))
        order = lambda e: [r.doc_id for r in sorted(by_epoch[e], key=lambda r: (r.block_order, r.doc_order))]  # noqa: B023, E731
        if passes > 1:
            assert order(0) != order(1)


def test_last_pass_follows_the_order(spark):
    docs = corpus(spark, {"a": 500, "b": 40})
    rows = mix_documents(docs, MixSpec(entropy=1.0, max_repeat=50.0, block_docs=32)).collect()
    last = [r for r in rows if r.source == "a"]  # the large source gets less than a pass
    assert 0 < len(last) < 500
    blocks = {}
    for r in last:
        blocks.setdefault(r.block, []).append(r)
    size = {b: 0 for b in blocks}
    assert sum(len(v) for v in blocks.values()) == len(last) and len(size) >= 1


def test_odd_rows(spark):
    rows = [(1, None, "a"), (1, "", "a"), (2, "x y", None), (2, "x y", None), (None, "z " * 50000, "b"), (3, " \n ", "empty")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("rest", F.lit("clash")).withColumn("row", F.lit(1))
    found = mix_documents(docs, MixSpec(entropy=0.0)).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(["1", "1", "2", "2", "None", "3"])
    again = mixed_rows(docs, MixSpec(entropy=0.0))
    assert again.columns == docs.columns and again.count() == 6
    assert mix_documents(docs.limit(0)).count() == 0 and mixed_rows(docs.limit(0)).count() == 0
