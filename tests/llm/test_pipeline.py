from __future__ import annotations

import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tidemark.llm.classifier import passages, train  # noqa: E402
from tidemark.llm.mixing import MixSpec  # noqa: E402
from tests.llm.test_mixing import slow_exponent  # noqa: E402
from tests.llm.test_secrets import base  # noqa: E402
from tests.llm.test_simhash import closure, slow_fingerprint  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (before.collect(), docs.collect())
        if name != "tokens":
            assert docs.columns == columns

    came, went = kept["quality"]
    model = train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in came if model.score([passages(r.text)])[0] >= 0.7}
    assert {r.doc_id for r in went} == good and 0 < len(went) < len(came)

    came, went = kept["near_copies"]
    prints = {r.doc_id: slow_fingerprint(r.text) for r in came}
    ids = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert sorted(r.doc_id for r in went) == sorted(set(closure(pairs, ids).values()))

    came, went = kept["secrets"]
    texts = {r.doc_id: r.text for r in went}
    assert texts.keys() == {r.doc_id for r in came}
    for r in came:
        assert not base(texts[r.doc_id].replace("[SECRET]", " "))
        if "[SECRET]" not in texts[r.doc_id]:
            assert texts[r.doc_id] == r.text

    came, went = kept["mix"]
    size = lambda t: len((t or "").encode().split())
    tokens = Counter()
    for r in came:
        tokens[r.source] += size(r.text)
    a, total = slow_exponent(list(tokens.values()), MixSpec()), sum(tokens.values())
    z = sum(t**a for t in tokens.values() if t)
    copies = Counter(r.doc_id for r in went)
    for source, own in tokens.items():
        wanted = own**a / z * total
        got = sum(size(r.text) for r in went if r.source == source)
        longest = max(size(r.text) for r in came if r.source == source)
        assert wanted - longest - 1 <= got <= wanted + 1
        passes = int(wanted // own)
        assert all(passes <= copies[r.doc_id] <= passes + 1 for r in came if r.source == source and size(r.text))

    came, went = kept["tokens"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids)) for r in came)
    assert Counter((r.doc_id, tuple(r.ids)) for r in went) == want


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and re.fullmatch("[0-9a-f]{64}", rows.first().ids_sha256)


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, and columns named as stages might name their own."""
    good, bad = "the and of is in words here and there, as one says. ", "###$$$ %%% &&& *** "
    rows = [(i, (good + f"number {i} stands alone among the others today. ") * (2 + i % 5), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, bad * (3 + i % 5), "en", "s0") for i in range(60)]
    labels = [(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)] + [(None, 1), (3, None)]
    key = "q7Zt0LmXv2RbN9sKc4YdWf8HgJp1Ea5U"
    rows += [(7, rows[7][1], "en", "s1")] * 3 + [(7, good * 9 + "another text", None, None), (None, good * 4, None, None)]
    rows += [(None, None, None, None), (900, "", "en", None), (901, good * 30_000, "en", "s2"), (902, good * 5 + f" password={key} ", "en", "s2")]
    names = ["row", "key", "n", "score", "number", "id", "component"]
    docs = spark.createDataFrame(
        [(*r, None if r[1] is None else len(r[1]), *range(len(names))) for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for name, frame in (("odd", docs), ("empty", docs.limit(0))):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    for stage_name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, f"{tmp_path}/odd")
        assert kept.columns == docs.columns and all([r[n] for n in names] == [*range(len(names))] for r in kept.collect())
        if stage_name in ("quality", "secrets"):  # in its words the long text is a near copy of others
            assert 901 in {r.doc_id for r in kept.collect()}
        if stage_name == "secrets":
            assert not any(key in (r.text or "") for r in kept.collect()) and kept.count() == docs.count()
    found = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    ids = [r.doc_id for r in found]
    assert ids and not any(100 <= i < 160 for i in ids if i is not None)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
