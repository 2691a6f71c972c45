from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.oracle_check import differences, oracle_connection
from tidemark.llm.fm_index import ADDED, DROPPED, REPLACED, FmIndex
from tidemark.llm.queries import op11_fm_index
from tidemark.llm.spelling import ORACLE_SQL, Spelling, near_words, spelling_groups

SCHEMA = "doc_id long, text string"


def kind_of(query: str, word: str) -> int | None:
    if len(query) == len(word):
        return REPLACED if sum(a != b for a, b in zip(query, word, strict=True)) == 1 else None
    longer, shorter = sorted((query, word), key=len, reverse=True)
    if len(longer) - len(shorter) > 1 or all(longer[:i] + longer[i + 1 :] != shorter for i in range(len(longer))):
        return None
    return ADDED if len(word) > len(query) else DROPPED


@pytest.mark.parametrize("letters", ["ab", "abcdé", "xyzxyzqÿ"])
def test_index_equals_brute_force(letters):
    rng = random.Random(letters)
    draw = lambda n, longest: {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)}
    for count in (1, 2, 12, 60):
        words = sorted(draw(count, 8), key=lambda w: hash((w, count)))
        index = FmIndex(words)
        queries = {*words, *draw(40, 9), "Q"}
        for kind in (REPLACED, ADDED, DROPPED):
            for size in range(1, 10):
                asked = [q for q in queries if len(q) == size]
                if not asked:
                    continue
                found = []
                for front in (True, False):
                    who, word = index.near(asked, kind, front)
                    pairs = [(asked[a], words[b]) for a, b in zip(who, word, strict=True)]
                    assert len(pairs) == len(set(pairs))
                    half = size // 2
                    assert all(q[:half] == w[:half] if front else w.endswith(q[half:]) for q, w in pairs)
                    found += pairs
                assert set(found) == {(q, w) for q in asked for w in words if kind_of(q, w) == kind}


@pytest.mark.parametrize("symbols", [1 << 18, 400, 60])
def test_near_words_by_shards(spark, symbols):
    """Small shards: letters that many words share are dealt over several."""
    rng = random.Random(5)
    words = sorted({"shared" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(150)}
                   | {"".join(rng.choice("ab") for _ in range(rng.randint(6, 8))) for _ in range(150)})
    rows = [(w, i) for i, w in enumerate(words)]
    found = near_words(spark.createDataFrame(rows, "word string, n long"), Spelling(shard_symbols=symbols)).collect()
    want = [(a, i, b, j) for a, i in rows for b, j in rows if kind_of(a, b) is not None]
    assert sorted(map(tuple, found)) == sorted(want)


def expected(rows, least=6, count=5, ratio=5, spoilt=199):
    import re

    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % spoilt == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= least and n >= count}
    near = {w: [x for x in kept if kind_of(w, x) is not None] for w in kept}
    form = {}
    for word, n in kept.items():
        best = min(near[word], key=lambda x: (-kept[x], x), default=None)
        form[word] = best if best is not None and kept[best] >= ratio * n else None
    out = []
    for word, n in kept.items():
        root = word
        while form[root]:
            root = form[root]
        out.append((word, form[word], root, n, len(near[word]), kept.get(form[word])))
    return sorted(out)


def test_odd_rows(spark):
    chain = [("spelling", 130), ("speling", 26), ("spling", 5), ("spelléng", 5), ("spellins", 26), ("spellinx", 26)]
    rows = [(1, " ".join(f"{w}," for _ in range(n))) for w, n in chain]
    rows += [(None, None), (2, ""), (2, "Straße STRASSE×÷ ÀB Ångström " * 5), (2, "Straße STRASSE×÷ ÀB Ångström " * 5)]
    rows += [(None, "ab_cdefgh日本語letters1letters " * 300), (9, "z" * 5000 + " " + "z" * 4999 + " "), (9, ("z" * 5000 + " ") * 5)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    found = spelling_groups(docs).collect()
    assert sorted(map(tuple, found)) == expected(rows)
    assert found[0].__fields__ == ["word", "form", "root", "n", "n_near", "form_n"]
    by_word = {r.word: r for r in found}
    assert by_word["spling"].form == "speling" and by_word["spling"].root == "spelling"
    assert by_word["spellins"].form is not None and by_word["spelling"].form is None
    assert spelling_groups(docs.limit(0)).count() == 0


def test_given_documents(spark):
    """Against brute force with more deletions than usual, and against the SQL."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.orderBy("doc_id").collect()][:40]
    found = spelling_groups(spark.createDataFrame(rows, SCHEMA), Spelling(spoilt=3, least_count=2, ratio=2))
    assert sorted(map(tuple, found.collect())) == expected(rows, count=2, ratio=2, spoilt=3)
    folder = "/root/testdata/sf0.001"
    assert not differences(op11_fm_index(spark, folder), oracle_connection(folder), ORACLE_SQL)
