from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import token_counts as module
from tidemark.llm.token_counts import Counter, token_counts
from tests.llm.test_bpe import FILES, ODD

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"


def library(path=PATH):
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def size(own, text):
    return len(own.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    path = public_tokenizers.path(request.param)
    return Counter(path), library(path)


def test_whole_pieces_are_one_token_and_others_are_not(pair):
    own, lib = pair
    codec = own.codec
    assert len(own.whole) > 10_000
    for token, number in codec.merges.vocab.items():
        if codec.end and not token.endswith(codec.end):
            continue
        shown = token.removesuffix(codec.end) if codec.end else token
        data = bytes(codec.byte_of[c] for c in shown) if all(c in codec.byte_of for c in shown) else b""
        piece = data.decode("utf-8", "surrogateescape")
        if not piece or codec._split(data.decode("utf-8", "replace")) != [piece]:
            continue
        assert (piece in own.whole) == (lib.encode(piece, add_special_tokens=False).ids == [number]), token


def test_equals_the_library(pair, monkeypatch):
    own, lib = pair
    rng = random.Random(8)
    texts = [*ODD, "".join(rng.choice("aeinrst") for _ in range(20000)), "".join(map(chr, range(32, 3000)))]
    for remembered in (3, 200_000):
        monkeypatch.setattr(module, "REMEMBERED", remembered)
        for text in texts:
            assert own.count(text) == size(lib, text)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    lib = library()
    rows = [*map(tuple, docs.collect()), (None, "x y"), (3, None), (3, ""), (3, "word " * 2048), (3, "word " * 2049)]
    found = token_counts(spark.createDataFrame(rows, SCHEMA).withColumn("n_tokens", F.lit("clash")), PATH)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), size(lib, t), size(lib, t) > 2048) for i, t in rows]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_pre_tokens_are_looked_up(spark):
    own = Counter(PATH)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text]
    split = [p for t in texts for p in own.codec._split(t)]
    assert sum(p in own.whole for p in split) > len(split) / 3


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0
