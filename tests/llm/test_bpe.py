from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.bpe import ByteText, Codec, Digests, Merges, Transducer, encode_decode

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = [
    "", " \n", "<|startoftext|>hi<|endoftext|>", " <|ENDOFTEXT|>x", "Ünḯ İstanbul ΟΔΥΣΣΕΥΣ", "日本語テキスト 12½ ٣",
    "a b c\x1c\x1dd\x85e", "it's we'll I'M don'T '", "🙂👩‍👩‍👧 é", "ſ ﬁ K Å ẞ ß é", "\x00\x01\x7f", "x�y",
    "a" * 5000, "ab" * 3000 + "!!" * 900,
]


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    path = public_tokenizers.path(request.param)
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return Codec(path), library


def test_equals_the_library(pair):
    own, library = pair
    rng = random.Random(3)
    texts = [*ODD, "".join(rng.choice("aeinrst") for _ in range(20000)), "".join(map(chr, range(32, 3000)))]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert "".join(own.decode(ids, block=7)) == library.decode(ids, skip_special_tokens=False)


def test_streaming_equals_whole_pieces(pair):
    own, _ = pair
    rng = random.Random(4)
    for letters in ("ab", "aeinrst", "the "):
        symbols = [own.symbol_ids[ord(rng.choice(letters))] for _ in range(6000)]
        stream = Transducer(own.merges, own.sizes, block=64)
        held, out = 0, []
        for symbol in symbols:
            out += stream.push([symbol])
            held = max(held, len(stream.held))
        out += stream.finish()
        assert out == own.merges.apply(list(symbols))
        assert held <= 64 + own.merges.lookahead


def test_lookahead_is_sufficient_for_small_merge_lists():
    rng = random.Random(9)
    for _ in range(60):
        vocab = {c: i for i, c in enumerate("abc")}
        merges = []
        while len(merges) < 12:
            u, v = rng.choice(list(vocab)), rng.choice(list(vocab))
            if u + v not in vocab and len(u + v) < 9:
                vocab[u + v] = len(vocab)
                merges.append((u, v))
        own, names = Merges(vocab, merges), sorted(vocab, key=vocab.get)
        sizes = [len(n) for n in names]
        for _ in range(40):
            symbols = [rng.randrange(3) for _ in range(150)]
            stream = Transducer(own, sizes, block=1)
            assert [*stream.push(symbols), *stream.finish()] == own.apply(list(symbols))


def test_bytes_to_text_in_parts():
    machine, data = ByteText(), "aé日🙂".encode()
    assert "".join(machine.push(bytes((b,))) for b in data) + machine.push(b"\xf0\x9f", True) == "aé日🙂�"


def test_query_rows(spark):
    path = public_tokenizers.path(FILES[0])
    library = Tokenizer.from_file(path)
    rows = [(1, None), (2, ""), (2, ""), (None, "One two"), (4, "word " * 30000), *enumerate(ODD, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("id", F.lit(2))
    found = [tuple(r) for r in encode_decode(docs, path).collect()]

    def expected(doc_id, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digest = [hashlib.sha256(t.encode()).hexdigest() for t in (" ".join(map(str, ids)), decoded)]
        return (doc_id, len(ids), *digest)

    assert sorted(found, key=str) == sorted([expected(*r) for r in rows], key=str)
    assert encode_decode(docs.limit(0), path).count() == 0
    assert encode_decode(docs, path, with_ids=True).where("size(ids) <> n_tokens").count() == 0


def test_long_texts_stream(pair):
    """Ids and both digests of texts of many blocks, in little memory; the same ids as the library's."""
    import tracemalloc

    own, library = pair
    for text in ("some words, here é 日本 ſ\u0301 it's\n" * 9000, "it's  plain 12 words.\n" * 9000, "ab" * 40_000):
        ids = library.encode(text, add_special_tokens=False).ids
        assert [t for piece in own.stream(text) for t in piece] == ids
        digests = Digests(own)
        for piece in own.stream(text):
            digests.push([*piece])
        decoded = library.decode(ids, skip_special_tokens=False)
        assert digests.finish() == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    if not own.quick:
        return
    peaks = []
    for size in (20_000, 400_000):
        text = "some words, here it's é\n" * size
        tracemalloc.start()
        digests = Digests(own)
        for piece in own.stream(text):
            digests.push([*piece])
        digests.finish()
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0]
