from __future__ import annotations

import hashlib
import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from tidemark.llm.secret_scan import battery, random_from, random_tokens, redact_secrets, secret_digests

SCHEMA = "doc_id long, text string"
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    spans = []
    for rank, (kind, pattern, group, least) in enumerate(
        [("assign", ASSIGN, 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]
    ):
        spans += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return sorted(spans)


def shown(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def check(rows, docs):
    found = {}
    for r in secret_digests(docs).collect():
        found.setdefault(r.doc_id, []).append(r)
    for doc_id, text in rows:
        spans = base(text)
        for r in found[doc_id]:
            kinds = [s[3] for s in spans]
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(kinds.count, ("assign", "access", "hex"))), text
            assert r.base_sha256 == hashlib.sha256(shown(spans).encode()).hexdigest()
            assert set(shown(spans).split(",")) <= {*r.spans.split(","), ""}
    assert sum(map(len, found.values())) == len(rows)
    return {i: r[0].spans for i, r in found.items()}


def test_fixed_patterns_equal_a_plain_scan(spark):
    rng = random.Random(6)
    bits = ["password", "TOKEN", "api_key", "apikey", "sEcret", "=", ":", " ", '"', "'", "é🙂", "\n", "abcdef", "0123456789",
            "AKIA", "ABCDEFGH2345", "deadbeef", "x", "key-value_", "token=short", "passwd: "]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(600)]
    check(rows, spark.createDataFrame(rows, SCHEMA))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check([tuple(r) for r in docs.select("doc_id", "text").collect()], docs)


def sample(alphabet, size, seed):
    rng = random.Random(seed)
    return "".join(rng.choice(alphabet) for _ in range(size))


def test_random_tokens_are_told_from_words(spark):
    rng, parts = random.Random(8), "the and ing tion ent re ch er st ou le eau heit keit".split()
    words = ["".join(rng.choice(parts) for _ in range(12)) + str(rng.randrange(100)) for _ in range(400)]
    words += ["some/path/to/a/file/of/the/project", "a-slug-of-an-article-about-things", "0" * 48, "ab" * 30, "=" * 40]
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef",
                 string.ascii_uppercase + "234567"]
    secrets = [sample(a, n, (a, n, s).__repr__()) for a in alphabets for n in (32, 40, 64) for s in range(20)]
    rows = [(t,) for t in words + secrets]
    found = {r.token for r in random_tokens(spark.createDataFrame(rows, "token string")).collect()}
    assert len(found & set(secrets)) >= 0.9 * len(secrets)
    assert len(found & set(words)) <= 0.05 * len(words)


def test_identifiers_are_no_secrets(spark):
    """Camel case, slugs and paths against keys; each list by itself and all together."""
    rng = random.Random(2)
    words = ("User Account Settings By Client Server Request Handler Factory Cache Entry Payment Order Total Index Batch "
             "Config Value Stream Reader Writer Node Table Column Parser Token Event Queue Worker Session State Error").split()
    name = lambda: "".join(rng.choice(words) for _ in range(rng.randint(4, 6))) + str(rng.randrange(100))
    low = lambda sep: sep.join(rng.choice(words).lower() for _ in range(rng.randint(4, 6))) + str(rng.randrange(10))
    lists = [[name() for _ in range(300)], [n[0].lower() + n[1:] for n in (name() for _ in range(300))],
             [low("-") for _ in range(300)], [low("/") for _ in range(300)], [low("_") for _ in range(300)]]
    plain = string.ascii_letters + string.digits
    keys = [sample(plain, n, f"{n} key {s}") for n in (24, 32, 40) for s in range(60)]
    for own in [*lists, sum(lists, []) + keys]:
        found = {r.token for r in random_tokens(spark.createDataFrame([(t,) for t in own], "token string")).collect()}
        names = set(own) - set(keys)
        assert len(found & names) <= 0.05 * len(names)
    assert len(found & set(keys)) >= 0.9 * len(keys)
    alone = {r.token for r in random_tokens(spark.createDataFrame([(t,) for t in keys], "token string")).collect()}
    assert len(alone) >= 0.9 * len(keys)


def test_rule_equals_its_definition(spark):
    """Random p-values and false ones in classes of many sizes, against the rule in plain numbers."""
    rng, rows = random.Random(12), []
    for number, (sound, false) in enumerate([(0, 1), (1, 0), (0, 300), (300, 0), (200, 200), (40, 2000), (3, 9)]):
        values = [min(1.0, 5 * min(rng.random() for _ in range(5))) for _ in range(sound)]
        values += [min(1.0, 10 ** (-rng.expovariate(0.6))) for _ in range(false)]
        rows += [("e", number, min(int(-math.log10(p) * 20), 600)) for p in values]
    found = {r["class"]: r.cut for r in random_from(
        spark.createDataFrame(rows, "encoding string, class int, bin int")).collect()}
    survive = lambda p: (1 - min(p, 1) / 5) ** 5
    for number in {r[1] for r in rows}:
        own = [b for _, c, b in rows if c == number]
        large = sum(b < 6 for b in own)
        estimate = (large + 1) / survive(10 ** (-6 / 20))
        cut = None
        for b in sorted(set(own)):
            edge = 10 ** (-(b + 1) / 20)
            r = sum(x <= b for x in own)
            if edge >= 0.05 and r - estimate * survive(edge) <= 0.05 * r:
                cut = b + 1
        assert found.get(number) == cut
    assert found[3] >= 20 and found.get(2, 0) < 20


def test_battery_statistics(spark):
    token = sample("0123456789abcdef", 50, 4)
    row = battery(spark.createDataFrame([(token,)], "token string")).first()
    values = [int(c, 16) for c in token]
    counts = [values.count(v) for v in range(16)]
    assert row.encoding == "hex" and row.n == 50
    assert row.chi == pytest.approx(sum((c - 50 / 16) ** 2 / (50 / 16) for c in counts))
    high = [v >= 8 for v in values]
    assert row.runs == 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    serial = sum((a - 7.5) * (b - 7.5) for a, b in zip(values, values[1:], strict=False))
    assert row.serial_z == pytest.approx(abs(serial) / ((256 - 1) / 12 * 49**0.5))
    digits = sum(c.isdigit() for c in token)
    chi = (digits - 50 * 10 / 16) ** 2 / (50 * 10 / 16) + (50 - digits - 50 * 6 / 16) ** 2 / (50 * 6 / 16)
    assert row.kind_chi == pytest.approx(chi) and row.freedom == 1
    assert row.p_kinds == pytest.approx(math.erfc((chi / 2) ** 0.5), rel=1e-4)
    alike = sum(a.isdigit() == b.isdigit() for a, b in zip(token, token[1:], strict=False))
    q = [10 / 16, 6 / 16]
    same, thrice = sum(x**2 for x in q), sum(x**3 for x in q)
    spread = 49 * (same - same**2) + 2 * 48 * (thrice - same**2)
    assert row.alike_z == pytest.approx(abs(alike - 49 * same) / spread**0.5)
    assert 0 < row.p_chi <= 1


def test_odd_rows(spark):
    key = sample(string.ascii_letters + string.digits, 44, 11)
    rows = [(1, None), (2, ""), (2, ""), (None, "token = abcdefabcdef0123"), (3, f"é🙂 {key} end"), (3, f"é🙂 {key} end"),
            (4, "a" * 100_000 + " 0123456789abcdef " * 500)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("spans", F.lit("clash")).withColumn("row", F.lit(1))
    spans = check(rows, docs)
    assert spans[3] == "random:3:47"
    assert secret_digests(docs.limit(0)).count() == 0
    clean = redact_secrets(docs)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[1] is None and texts[2] == "" and texts[None] == "[SECRET]" and texts[3] == "é🙂 [SECRET] end"
    assert clean.count() == len(rows) and texts[4].count("[SECRET]") == 500 + 1
    assert redact_secrets(docs.limit(0)).count() == 0


def test_secrets_are_found_beside_names_and_paths(spark):
    plain, url, full = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "-_", string.ascii_letters + string.digits + "+/"
    frames = [("AWS_SECRET_ACCESS_KEY=", full, ""), ("PRIVATE_KEY=", full, "=="), ("https://host/blob?sig=", url, "&x=1"),
              ("client-key=", plain, ";"), ("files/of_the/project/", plain, "/end"), ("some-name_of-", plain, ""),
              ("a/path/to_", url, "="), ("name_of-a+", plain, "/b_c")]
    rows, want = [], {}
    for n, (before, alphabet, after) in enumerate(frames):
        for s in range(10):
            secret = sample(alphabet, 40, f"{n} {s}")
            rows.append((100 * n + s, f"é {before}{secret}{after} end"))
            want[100 * n + s] = (2 + len(before), 42 + len(before), secret)
    docs = spark.createDataFrame(rows, SCHEMA)
    found = check(rows, docs)
    clean = {r.doc_id: r.text for r in redact_secrets(docs).collect()}
    for n, (before, *_) in enumerate(frames):
        hidden = 0
        for i in range(100 * n, 100 * n + 10):
            low, high, secret = want[i]
            spans = [tuple(map(int, s.split(":")[1:])) for s in found[i].split(",") if s]
            if any(a <= low and high <= b for a, b in spans):
                hidden += 1
                assert secret not in clean[i]
        assert hidden >= 8, (before, hidden)
