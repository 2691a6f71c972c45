from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import token_files
from tidemark.llm.token_files import END_ID, Encoder, open_sequences, read_token_files, token_file_digests, unpacked, write_token_files
from tidemark.session import scratch_dir
from tests.llm.test_bpe import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"


def expected(rows):
    library, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, END_ID]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_equals_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [*map(tuple, docs.collect()), *((100_000 + i, t) for i, t in enumerate(ODD))]
    rows += [(7_000_000, "! !!!! it's  a b \n\n c " * 20000), (7_000_001, None), (7_000_002, "")]
    shuffled = spark.createDataFrame(rows, SCHEMA).orderBy(F.hash("doc_id"))
    found = token_file_digests(shuffled.repartition(8), PATH).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == expected(sorted(rows))


def test_files_hold_equal_sequences_without_copies(spark):
    rows = [(i, "some words here ! " * (i % 40)) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    manifest = write_token_files(docs, PATH, scratch_dir(spark, "files"), length=64).orderBy("part").collect()
    ids = []
    for part in manifest:
        file = open_sequences(part["path"])
        rows_of_file = 0
        for tokens, mask, ends in file:
            assert tokens.shape[1] == 64 and tokens.dtype == np.uint16
            assert not any(a.flags.owndata for a in (tokens, mask, ends))
            ids += tokens[unpacked(mask)].tolist()
            rows_of_file += len(tokens)
        assert rows_of_file == -(-part["n_ids"] // 64)
        tokens, mask, ends = file.sequence(rows_of_file - 1)
        assert len(tokens) == len(unpacked(mask)) == len(unpacked(ends)) == 64
    assert len(ids) == sum(r[2] for r in expected(rows)) and ids.count(END_ID) >= 400


def test_odd_rows(spark):
    rows = [(5, "a b"), (5, "a b"), (None, "x"), (1, None), (1, "")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("clash")).withColumn("part", F.lit(3))
    found = token_file_digests(docs, PATH).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in found), key=str) == sorted(
        [(5, 3), (5, 3), (None, 2), (1, 1), (1, 1)], key=str
    )
    assert sorted(r.start for r in found) == [0, 2, 3, 4, 7]
    assert token_file_digests(docs.limit(0), PATH).count() == 0


def test_each_file_is_read_by_a_task(spark):
    docs = spark.createDataFrame([(i, "some words here ! " * (i % 9)) for i in range(3000)], SCHEMA).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = write_token_files(docs, PATH, scratch_dir(spark, "files"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 4
    read = read_token_files(manifest).withColumn("task", F.spark_partition_id())
    assert read.select("task").distinct().count() == manifest.count() and read.count() == 3000


def test_forgetting_changes_no_ids(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 5)
    own, library = Encoder(PATH), Tokenizer.from_file(PATH)
    texts = [*ODD, *(f"some words {i % 7} here's \n\n é{i}!" for i in range(60))]
    for at in range(0, len(texts), 4):
        for text, data in zip(texts[at : at + 4], own.encode(texts[at : at + 4])):
            assert np.frombuffer(data, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(own.older) < 200
