from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.quality_rules import FLOORS, STATS, Rules, apply_rules, chi_squared_below, chi_squared_limit, describe, mcd

SCHEMA = "doc_id long, text string, lang string, source string"


def slow_base(text):
    text = text or ""
    for c in "\t\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.replace("\n", " ").split(" ") if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text)], len(repeated)


def slow_dup_lines(text):
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
    return sum(x in lines[:i] for i, x in enumerate(lines))


def test_base_equals_the_definition(spark):
    rng = random.Random(3)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += [None, "", " \n\t ", "a", "a b c d e f g h a b c d e f g h", "x " * 40, "é🙂 #*\n\n é🙂 #*\n\x1c\x85 z", "\ra\r\n\ra\r\n"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(300)]
    for text in texts:
        (n, chars, symbols, dup, repeats), stats = describe(text)
        assert ([n, chars, symbols], repeats) == slow_base(text) and dup == slow_dup_lines(text)
        assert np.isfinite(stats).all()


def test_chi_squared():
    assert chi_squared_limit(0.05, 6) == pytest.approx(12.5916, abs=1e-3)
    assert chi_squared_below(chi_squared_limit(0.25, 6), 6) == pytest.approx(0.75)


def test_estimate_equals_plain_concentration_steps(spark):
    rng, size = np.random.default_rng(5), len(STATS)
    mixing = rng.normal(size=(size, size))
    rows = rng.normal(size=(4000, size)) @ mixing + 3
    rows[:600] += 25  # a cloud of outliers that would draw plain estimates to it
    frame = spark.createDataFrame([("g", *map(float, r)) for r in rows], "key string, " + ", ".join(f"{x} double" for x in STATS))
    found = mcd(frame, Rules(accuracy=10000)).first()
    centre, precision, _ = slow_mcd(rows)
    assert found.centre == pytest.approx(centre.tolist(), abs=0.02)
    assert found.precision == pytest.approx(precision[np.triu_indices(size)].tolist(), rel=0.05, abs=0.02)
    assert np.abs(np.array(found.centre) - 3).max() < 1  # not drawn away


def slow_mcd(rows, part=0.75):
    """Both starts until the determinant settles, the smaller one, reweighted: centre, precision and determinants."""
    size, floor = rows.shape[1], np.diag(np.square(FLOORS))
    scale = part / chi_squared_below(chi_squared_limit(1 - part, size), size + 2)
    middle = np.median(rows, axis=0)
    spread = np.sqrt((1.4826 * np.median(np.abs(rows - middle), axis=0)) ** 2 + np.square(FLOORS))
    z = (rows - middle) / spread
    u = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    ends = []
    for cov in (np.diag(spread**2), size * np.outer(spread, spread) * (u.T @ u / len(u)) + floor):
        centre, old = middle, None
        for _ in range(20):
            d = np.einsum("ij,jk,ik->i", rows - centre, np.linalg.inv(cov), rows - centre)
            near = rows[d <= np.sort(d)[max(int(np.ceil(part * len(d))) - 1, 0)]]
            centre, cov = near.mean(axis=0), scale * np.cov(near.T, bias=True) + floor
            new = np.linalg.slogdet(cov)[1]
            if old is not None and abs(new - old) <= 0.01:
                break
            old = new
        ends.append((new, centre, cov))
    _, centre, cov = min(ends, key=lambda e: e[0])
    d = np.einsum("ij,jk,ik->i", rows - centre, np.linalg.inv(cov), rows - centre)
    near = rows[d <= chi_squared_limit(0.025, size)]
    return near.mean(axis=0), np.linalg.inv(np.cov(near.T, bias=True) + floor), [e[0] for e in ends]


def test_kept_equals_brute_force(spark):
    """Groups of all four kinds, over the given documents, and two with nothing but junk added."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [tuple(r) for r in docs.orderBy("doc_id").collect()]
    langs = sorted({r[2] for r in rows}, key=str)
    # A language with small sources only, a small source beside large ones, and a language of few rows.
    rows = [(i, t, lang, "solo" if lang == langs[0] else s if i % 29 else "tiny") for i, t, lang, s in rows]
    rows += [(100_000 + i, rows[i][1], "rare", "x") for i in range(5)]
    least = 60
    found = {r.doc_id: r for r in apply_rules(spark.createDataFrame(rows, SCHEMA), Rules(least_rows=least, accuracy=10000)).collect()}
    described = {r[0]: describe(r[1]) for r in rows}
    size = Counter((r[2], r[3]) for r in rows)
    every = Counter(r[2] for r in rows)
    few = Counter()
    for (lang, _), n in size.items():
        few[lang] += n * (n < least)

    def key(lang, source):
        if size[lang, source] >= least:
            return lambda r: (r[2], r[3]) == (lang, source)
        if few[lang] >= least:
            return lambda r: r[2] == lang and size[r[2], r[3]] < least
        return (lambda r: r[2] == lang) if every[lang] >= least else (lambda r: True)

    sound = {}
    for doc_id, _, _, _ in rows:
        (n, _, _, _, repeats), _ = described[doc_id]
        sound[doc_id] = n >= 20 and 100 * repeats <= 30 * n
    limit, compared, rejected = chi_squared_limit(Rules().limit, len(STATS)), 0, 0
    for lang, source in size:
        belongs = key(lang, source)
        centre, precision, _ = slow_mcd(np.array([described[r[0]][1] for r in rows if belongs(r) and sound[r[0]]]))
        for r in rows:
            if (r[2], r[3]) != (lang, source):
                continue
            x = np.array(described[r[0]][1]) - centre
            d = float(x @ precision @ x)
            assert found[r[0]].distance == pytest.approx(d, rel=0.1, abs=0.5)
            if abs(d - limit) > 0.1 * limit:
                compared += 1
                rejected += d > limit
                assert found[r[0]].kept == (sound[r[0]] and d <= limit)
    assert compared > 0.9 * len(rows) and rejected > 0


def test_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = apply_rules(docs).join(labels, "doc_id").collect()
    clean = [r for r in rows if r.quality == 1 and not r.base_failed]
    junk = [r for r in rows if r.quality == 0]
    assert sum(not r.kept for r in clean) <= 0.005 * len(clean)
    assert sum(r.kept for r in junk) <= 0.05 * len(junk)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in rows)


def test_odd_rows(spark):
    prose = lambda i: " ".join(f"word{(i * 7 + k * k) % 97} of the," for k in range(40)) + "."
    rows = [(i, prose(i), "en", "a") for i in range(300)] + [(1000, "#$% &*| " * 200, "en", "a"), (1001, None, "en", "a"),
            (1002, "", None, None), (1002, "", None, None), (None, prose(3), None, "b"), (1003, prose(1) * 3000, "en", None),
            (1004, " ".join(f"###{k}$$$ |" for k in range(400)), "en", "a")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash")).withColumn("n_words", F.lit("x"))
    found = apply_rules(docs).collect()
    assert len(found) == len(rows)
    kept = {r.doc_id: r.kept for r in found}
    assert all(kept[i] for i in range(300)) and kept[None] and not kept[1000] and not kept[1001] and not kept[1004]
    assert apply_rules(docs.limit(0)).count() == 0
