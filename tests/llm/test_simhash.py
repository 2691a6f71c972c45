from __future__ import annotations

import random

import xxhash
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.simhash import fingerprint, keep_one_per_component, near_links, simhash_components

SCHEMA = "doc_id long, text string"


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint_equals_the_definition():
    for text in [None, "", " \n\t", "One", "one TWO", "a b c", "a b c d", "É e x y z w", "x " * 20000, "a b " * 9000]:
        assert fingerprint(text) == slow_fingerprint(text)


def test_hash_is_the_one_of_the_engine(spark):
    row = spark.sql("select xxhash64('ab cd ef') h").first()
    assert fingerprint("ab CD ef") == row.h % (1 << 64)


def test_links_equal_brute_force(spark):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(300)}
    for centre in list(values)[:40]:  # groups of near ones, one of them large and dense
        values |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(8)}
    centre = rng.getrandbits(64)
    values |= {centre ^ (rng.getrandbits(8) << 8) for _ in range(200)}
    values |= {centre ^ (1 << rng.randrange(64)) for _ in range(64)}
    values = sorted(values)
    expected = {
        frozenset((a, b)) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 2
    }
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    rows = near_links(spark.createDataFrame(signed, "fp long")).collect()
    found = [frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in rows]
    assert set(found) == expected and len(found) == len(expected)


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (-5, -9), (-9, -5)]
    pairs += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    rng.shuffle(pairs)
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    found = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == closure([p for p in pairs if p[0] != p[1]], nodes)
    assert len(found) == len(nodes)


def test_components_without_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = {r.doc_id: slow_fingerprint(r.text) for r in rows}
    ids = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = closure(pairs, ids)
    found = simhash_components(docs).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == [
        (i, f"{prints[i]:016x}", root[i]) for i in ids
    ]


def test_odd_rows(spark):
    rows = [(3, None), (1, ""), (5, "a b c"), (5, "a b c"), (None, "a b c"), (None, "only here now"), (9, "x " * 50000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit("clash")).withColumn("root", F.lit(None))
    found = sorted(((r.doc_id, r.component_id) for r in simhash_components(docs).collect()), key=str)
    assert found == sorted([(3, 1), (1, 1), (5, 5), (5, 5), (None, 5), (None, None), (9, 9)], key=str)
    kept = keep_one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == [1, 5, 9, None]
    assert simhash_components(docs.limit(0)).count() == 0
    assert keep_one_per_component(docs.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    """Also where unlike texts share an id, rows have none, and columns are named as the operator might name its own."""
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "some quite other words stand here now"
    rows = [(5, a, "r0"), (5, b, "r1"), (3, a, "r2"), (None, b, "r3"), (None, c, "r4"), (None, c, "r5"), (5, b, "r6"), (7, None, "r7")]
    names = ["_winner", "_n", "_row", "row", "number", "at", "first", "component", "fp", "root"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], ["doc_id", "text", "name", *names])
    kept = keep_one_per_component(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("3", a), ("5", b), ("None", c), ("7", None)])
    assert all([r[n] for n in names] == [*range(len(names))] for r in kept.collect())
