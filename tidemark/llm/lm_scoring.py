"""Language-model scores from a log-frequency Bloom filter.

A task counts words and word pairs of its texts and sends them to segments of the hash space as packed arrays,
sorted and summed beforehand. A segment's task sums what it gets and sets, for an n-gram that occurs c times, the
bits of (n-gram, 1) to (n-gram, 1 + floor(log2 c)). A reader probes level after level until one fails; the last
that holds gives the count up to a factor of two. Pair counts are smoothed with word probabilities (a Dirichlet
prior of `PRIOR` tokens). A pair counts only if both its words are known, and never more than they.

The filter has `BITS_PER_ENTRY` bits per entry at every size and stays in its segments; no process holds all of it. A
task sends the distinct n-grams of a pack of texts to the segments, a few segments to a shard; the shard's task probes
there, and the levels go back to the pack. The exact word counts of the base score aren't broadcast either: the `HOT`
most frequent words are, as a fixed bound; the rest are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, pieces, staged

BITS_PER_ENTRY = 10
#: What a probe can address in one segment.
MOST_BITS = 1 << 32
PROBES = 4
PRIOR = 4096.0
HOT = 1 << 17
#: Tokens that a task counts, or asks for, before it sends them on.
COUNT_AT_ONCE = 1_500_000
#: Characters of training text per segment, so that a segment stays small whatever the input.
SEGMENT_CHARS = 1 << 19
#: Segments probed by one shard, as a power of two, beyond the first 64 shards.
SHARD_POWER = 5
END = b"\n"  # no word holds it
WORDS, PAIRS = 1, 2
BITS, ASKED, TEXTS = 0, 1, 2
CODEC = pa.Codec("zstd", 1)
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class Numbered(dict):
    """Gives each new word the next number."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def digests(known: Iterable[bytes]) -> np.ndarray:
    """128-bit hashes of the words, in the order of their numbers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, known)), "<u8").reshape(-1, 2)


def planes(column: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on: they compress better so."""
    return column.view(np.uint8).reshape(len(column), -1).T.tobytes()


def from_planes(data: bytes | memoryview, width: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(f"<u{width}").ravel()


def squeezed(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted keys, as differences, and the columns beside them, compressed."""
    data = b"".join(map(planes, (np.diff(keys, prepend=np.uint64(0)), *columns)))
    return len(data).to_bytes(8, "little") + CODEC.compress(data, asbytes=True)


def unsqueezed(data: bytes, *widths: int) -> list[np.ndarray]:
    """The keys and columns of `squeezed`, columns of these widths in bytes."""
    whole = memoryview(CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True))
    n, at, out = len(whole) // (8 + sum(widths)), 0, []
    for width in (8, *widths):
        out.append(from_planes(whole[at : at + n * width], width))
        at += n * width
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def word_hash(first: np.ndarray) -> np.ndarray:
    return mixed(first * M1 + np.uint64(WORDS))


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(mixed(left * M1 + np.uint64(PAIRS)) + right * M3)


def level_of(count: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(count.astype(np.float64))).astype(np.int64) + 1


def counts_of_levels(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that share a level; zero for none."""
    low = np.exp2(levels - 1.0)
    return np.where(levels > 0, (3 * low - 1) / 2, 0.0)


def positions(hashes: np.ndarray, level: int, sizes: np.ndarray | np.uint64) -> Iterator[np.ndarray]:
    x = mixed(hashes + np.uint64(level * int(M1) & 0xFFFFFFFFFFFFFFFF))
    step = (x & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    at = x >> np.uint64(32)
    for _ in range(PROBES):
        yield at % sizes
        at = at + step


def _packs(shift: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = Numbered(), [], 0

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate([np.array([known[END]]), *held]).astype(np.int64)
            hashes = digests(known)
            rows: list[tuple[int, int, bytes]] = []

            def pack(kind: int, key: np.ndarray, *columns: np.ndarray) -> None:
                order = np.argsort(key)
                key = key[order]
                segments = (key >> np.uint64(shift)).astype(np.int64)
                cuts = np.flatnonzero(np.append(True, segments[1:] != segments[:-1]))
                columns = [c[order] for c in columns]
                for low, high in zip(cuts, np.append(cuts[1:], len(key)), strict=True):
                    part = [c[low:high] for c in columns]
                    data = squeezed(*part) if kind == PAIRS else b"".join(c.tobytes() for c in part)
                    rows.append((int(segments[low]), kind, data))

            number = np.bincount(tokens[1:], minlength=len(known)).astype("<u4")
            seen = number > 0
            pack(WORDS, word_hash(hashes[:, 0])[seen], hashes[seen, 0], hashes[seen, 1], number[seen])
            pairs, number = np.unique(tokens[:-1] << 32 | tokens[1:], return_counts=True)
            key = pair_hash(hashes[pairs >> 32, 0], hashes[pairs & 0xFFFFFFFF, 0])
            pack(PAIRS, key, key, number.astype("<u4"))
            segment, kind, data = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(segment, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())],
                names=["segment", "kind", "data"],
            )

        for batch in pieces(batches):
            for text in batch.column(0).to_pylist():
                found = words(text)
                found.append(END)
                held.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                size += len(found)
            if size >= COUNT_AT_ONCE:
                yield flush()
                known, held, size = Numbered(), [], 0
        if held:
            yield flush()

    return count


def _unpacked(kind: int, data: bytes) -> list[np.ndarray]:
    if kind == PAIRS:
        return unsqueezed(data, 4)
    n, at, out = len(data) // 20, 0, []
    for width in (8, 8, 4):
        out.append(np.frombuffer(data, f"<u{width}", n, at))
        at += n * width
    return out


def _summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(new)
    return [k[starts] for k in keys], np.add.reduceat(counts[order].astype(np.int64), starts)


def segment_bits(hashes: np.ndarray, counts: np.ndarray, most_bits: int = MOST_BITS) -> bytes:
    """The Bloom filter of one segment: every level up to the count's own, for each n-gram."""
    levels = level_of(counts)
    size = -(-int(levels.sum()) * BITS_PER_ENTRY // 64) * 64
    if size > most_bits:
        raise ValueError(f"a segment of {size} bits is larger than its bound")
    flags = np.zeros(size, np.uint8)
    for level in range(1, int(levels.max()) + 1):
        for at in positions(hashes[levels >= level], level, np.uint64(size)):
            flags[at] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["segment", "h1", "h2", "c", "bits"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    now, held = None, {WORDS: [], PAIRS: []}

    def done() -> Iterator[pa.RecordBatch]:
        hashes, counts = [], []
        if held[WORDS]:
            first, second, number = (np.concatenate(x) for x in zip(*held[WORDS], strict=True))
            (first, second), number = _summed([first, second], number)
            blank = [pa.array([v] * len(first), t) for v, t in ((now, types[0]), (None, types[4]))]
            yield pa.RecordBatch.from_arrays(
                [blank[0], pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array(number), blank[1]],
                names=names)
            hashes.append(word_hash(first))
            counts.append(number)
        if held[PAIRS]:
            key, number = (np.concatenate(x) for x in zip(*held[PAIRS], strict=True))
            (key,), number = _summed([key], number)
            hashes.append(key)
            counts.append(number)
        bits = segment_bits(np.concatenate(hashes), np.concatenate(counts))
        row = [now, None, None, None, bits]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

    for batch in batches:
        for segment, kind, data in zip(*(batch.column(n) for n in ("segment", "kind", "data")), strict=True):
            if now is not None and segment.as_py() != now:
                yield from done()
                held = {WORDS: [], PAIRS: []}
            now = segment.as_py()
            held[kind.as_py()].append(_unpacked(kind.as_py(), data.as_py()))
    if now is not None:
        yield from done()


class Model:
    """Some segments of the filter that lie together, and what smoothing needs."""

    def __init__(self, shift: int, number: np.ndarray, parts: list, kinds: int, mass: float) -> None:
        """`parts` are the segments' bits, `number` which segments they are."""
        number = np.asarray(number, np.int64)
        self.shift, self.low = shift, int(number.min()) if len(number) else 0
        sizes = np.zeros(int(number.max()) - self.low + 1 if len(number) else 1, np.int64)
        sizes[number - self.low] = [len(p) for p in parts]
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.sizes = np.maximum(sizes * 8, 1).astype(np.uint64)
        self.bits = np.zeros(int(sizes.sum()) + 1, np.uint8)
        for i, part in zip(number - self.low, parts, strict=True):
            self.bits[self.starts[i] : self.starts[i] + len(part)] = np.frombuffer(part, np.uint8)
        self.empty = sizes == 0
        self.kinds, self.mass = kinds, mass

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Level of each n-gram by repeated probes: the first that fails ends it."""
        out = np.zeros(len(hashes), np.int64)
        segment = (hashes >> np.uint64(self.shift)).astype(np.int64) - self.low
        rows = np.flatnonzero((segment >= 0) & (segment < len(self.empty)))
        rows = rows[~self.empty[segment[rows]]]
        level = 0
        while len(rows):
            level += 1
            alive = rows
            key, start, size = hashes[rows], self.starts[segment[rows]], self.sizes[segment[rows]]
            hit = np.ones(len(rows), bool)
            for at in positions(key, level, size):
                hit &= (self.bits[start + (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            rows = alive[hit]
            out[rows] = level
            if level >= 62:
                break
        return out

    def log_probabilities(self, levels: np.ndarray, pair_levels: np.ndarray, tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 of each token's probability after the token before it.

        `levels` are those of the distinct words, `pair_levels` those of each token's pair.
        """
        single = counts_of_levels(levels)
        alone = (single + 1) / (self.mass + self.kinds + 1)
        left, right = single[before], single[tokens]
        pair = np.minimum(counts_of_levels(pair_levels), np.minimum(left, right))  # zero if a word is unknown
        return np.log10((pair + PRIOR * alone[tokens]) / (left + PRIOR))


def _staged(df: DataFrame, label: str) -> DataFrame:
    """As `staged`; the files that the write shuffled are dropped when it is done, as nothing reads them again."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return staged(df, label)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def train(training: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame, DataFrame, int]:
    """What smoothing needs, the filter (segment, bits), the word counts (h1, h2, c), and the number of training tokens."""
    texts = training.select(F.col(text_col).cast("string").alias("text"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    power = max(6, min(30, math.ceil(math.log2(max(1, chars / SEGMENT_CHARS)))))
    packs = texts.mapInArrow(_packs(64 - power), "segment long, kind int, data binary")
    built = _staged(
        packs.repartition("segment").sortWithinPartitions("segment").mapInArrow(
            _built, "segment long, h1 long, h2 long, c long, bits binary"),
        "ngram-filter",
    )
    counts = built.where("bits is null").select("h1", "h2", "c")
    # The mass of the words as the filter tells it: the middle of their level's counts.
    level = F.floor(F.log2(F.col("c").cast("double")))
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"),
                      F.sum((3 * F.pow(F.lit(2.0), level) - 1) / 2).alias("mass")).first()
    model = Model(64 - power, [], [], sums["v"], float(sums["mass"] or 0))
    return model, built.where("bits is not null").select("segment", "bits"), counts, sums["n"] or 0


def _distinct(hashes: np.ndarray, tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a pack's words and then of its distinct pairs, their order by hash, and the number of each token's pair."""
    pairs, pair = np.unique(before << 32 | tokens, return_inverse=True)
    keys = np.concatenate((word_hash(hashes), pair_hash(hashes[pairs >> 32], hashes[pairs & 0xFFFFFFFF])))
    return keys, np.argsort(keys), pair


def _texts_before(tokens: np.ndarray) -> np.ndarray:
    """The token before each; a text begins after an end token, whose number is 0."""
    return np.concatenate(([0], tokens[:-1]))


CONTENT = pa.schema([("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("tokens", pa.binary()),
                     ("words", pa.binary())])


def _asked(shard_shift: int):
    """Of each pack of texts (id, text): its n-grams by shard (shard, ASKED, pack, hashes), and its tokens as one row."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_pack = TaskContext.get().partitionId() << 32
        number, known, ids, held = 0, Numbered(), [], []

        def flush() -> pa.RecordBatch:
            pack, tokens = first_pack + number, np.concatenate(held).astype(np.int64)
            hashes = digests(known)
            keys, order, _ = _distinct(hashes[:, 0], tokens, _texts_before(tokens))
            keys = keys[order]
            shards = (keys >> np.uint64(shard_shift)).astype(np.int64)
            cuts = np.flatnonzero(np.append(True, shards[1:] != shards[:-1]))
            data = [squeezed(keys[low:high]) for low, high in zip(cuts, np.append(cuts[1:], len(keys)), strict=True)]
            values = (ids, [len(t) for t in held], planes(tokens.astype("<u4")), b" ".join([*known][1:]))
            row = pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, CONTENT, strict=True)], schema=CONTENT)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, CONTENT, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(row)
            # The texts go along to any shard; a hash of the pack's number says which.
            to = int(shards[cuts[int(mixed(np.array([pack], np.uint64))[0]) % len(cuts)]])
            return pa.RecordBatch.from_arrays(
                [pa.array([*shards[cuts].tolist(), to], pa.int64()), pa.array([ASKED] * len(cuts) + [TEXTS], pa.int32()),
                 pa.array([pack] * (len(cuts) + 1), pa.int64()), pa.array([*data, sink.getvalue().to_pybytes()], pa.binary())],
                names=["shard", "kind", "key", "data"])

        known[END]  # noqa: B018
        size = 0
        for batch in pieces(batches):
            ids += batch.column(0).to_pylist()
            for text in batch.column(1).to_pylist():
                found = words(text)
                found.append(END)
                held.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                size += len(found)
            if size >= COUNT_AT_ONCE:
                yield flush()
                number, known, ids, held, size = number + 1, Numbered(), [], [], 0
                known[END]  # noqa: B018
        if held:
            yield flush()

    return ask


def _answered(shift: int):
    """Levels of what each pack asks of a shard (pack, shard, data); texts pass, as of shard -1."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, parts, model = None, [], [], None
        for batch in batches:
            rows = []
            for shard, kind, key, data in zip(*(batch.column(n) for n in ("shard", "kind", "key", "data")), strict=True):
                if shard.as_py() != now:
                    now, number, parts, model = shard.as_py(), [], [], None
                if kind.as_py() == BITS:
                    number.append(key.as_py())
                    parts.append(data.as_py())
                elif kind.as_py() == ASKED:
                    model = model or Model(shift, number, parts, 0, 0.0)
                    levels = model.levels(unsqueezed(data.as_py())[0])
                    rows.append((key.as_py(), now, levels.astype(np.uint8).tobytes()))
                else:
                    rows.append((key.as_py(), -1, data.as_py()))
            if rows:
                pack, shards, data = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pack, pa.int64()), pa.array(shards, pa.int64()), pa.array(data, pa.binary())],
                    names=["pack", "shard", "data"])

    return answer


def frequent(counts: DataFrame) -> DataFrame:
    """The words at or above the least count that at most `HOT` words reach, by a small histogram of counts."""
    band = F.floor(8 * F.log2(F.col("c").cast("double")))
    rows = counts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("band")).collect()
    taken, least = 0, None
    for r in rows:
        taken += r["n"]
        if taken > HOT:
            break
        least = r["band"]
    return counts.where(band >= least) if least is not None else counts.limit(0)


def score_texts(docs: DataFrame, learns: str = "learns", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_tokens, n_known, train_tokens, base_score, score.

    The boolean column `learns` says which rows teach (null: not). A null or empty text is the end token alone. With
    nothing to learn from no token is known and base scores are zero. Repeated ids give a row each; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    model, parts, counts, total = train(docs.where(F.col(learns)), text_col)
    hot = frequent(counts).toArrow()
    table = np.stack([hot.column(n).to_numpy() for n in ("h1", "h2", "c")], axis=1).astype(np.int64)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    shared = spark.sparkContext.broadcast(table)
    power = 64 - model.shift
    shard_power = max(6, power - SHARD_POWER)

    def rows_of(content: bytes, levels: np.ndarray, common: np.ndarray) -> pa.RecordBatch:
        pack = pa.ipc.open_stream(content).read_next_batch()
        ids, sizes = pack.column("ids").flatten(), pack.column("sizes").flatten().to_numpy()
        tokens = from_planes(pack.column("tokens")[0].as_py(), 4).astype(np.int64)
        hashes = digests([END, *pack.column("words")[0].as_py().split()])
        starts, before = np.concatenate(([0], np.cumsum(sizes)[:-1])), _texts_before(tokens)
        _, order, pair = _distinct(hashes[:, 0], tokens, before)
        if len(levels) != len(order):
            raise ValueError("a pack's texts and the levels that came back differ")
        by_number = np.empty(len(order), np.uint8)
        by_number[order] = levels
        kinds = len(hashes)
        logs = model.log_probabilities(
            by_number[:kinds].astype(np.int64), by_number[kinds:][pair].astype(np.int64), tokens, before)
        scores = np.add.reduceat(logs, starts)
        # Exact counts of the frequent words; the others go on to the join.
        first, second = hashes[:, 0].view(np.int64), hashes[:, 1].view(np.int64)
        at = np.minimum(np.searchsorted(common[:, 0], first), max(0, len(common) - 1))
        is_hot = (common[at, 0] == first) & (common[at, 1] == second) if len(common) else np.zeros(kinds, bool)
        exact = np.where(is_hot, common[at, 2], 0) if len(common) else np.zeros(kinds, np.int64)
        log_hot = np.add.reduceat(np.log10(exact + 1.0)[tokens], starts)
        known_hot = np.add.reduceat(is_hot[tokens].astype(np.int64), starts)
        tail = np.flatnonzero(~is_hot[tokens])
        text_of = np.repeat(np.arange(len(sizes)), sizes)[tail]
        pairs, times = np.unique(text_of << 32 | tokens[tail], return_counts=True)
        offsets = np.searchsorted(pairs >> 32, np.arange(len(sizes) + 1))
        word = pairs & 0xFFFFFFFF
        rest = pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()),
            pa.StructArray.from_arrays(
                [pa.array(first[word]), pa.array(second[word]), pa.array(times, pa.int64())], names=["h1", "h2", "times"]))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes, pa.int64()), pa.array(known_hot), pa.array(log_hot), pa.array(scores), rest],
            names=["id", "n_tokens", "known_hot", "log_hot", "score", "rest"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, now, content, levels = shared.value, None, b"", []
        for batch in batches:
            for pack, shard, data in zip(*(batch.column(n) for n in ("pack", "shard", "data")), strict=True):
                if shard.as_py() >= 0 and pack.as_py() == now:
                    levels.append(np.frombuffer(data.as_py(), np.uint8))
                    continue
                if shard.as_py() >= 0:
                    raise ValueError("a pack came back without its texts")
                if now is not None:
                    yield rows_of(content, np.concatenate(levels), common)
                now, content, levels = pack.as_py(), data.as_py(), []
        if now is not None:
            yield rows_of(content, np.concatenate(levels), common)

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = ("id long, n_tokens long, known_hot long, log_hot double, score double, "
              "rest array<struct<h1:bigint,h2:bigint,times:bigint>>")
    asked = picked.mapInArrow(_asked(64 - shard_power), "shard long, kind int, key long, data binary")
    bits = parts.select(F.shiftright("segment", power - shard_power).alias("shard"), F.lit(BITS).alias("kind"),
                        F.col("segment").alias("key"), F.col("bits").alias("data"))
    answers = bits.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(
        _answered(model.shift), "pack long, shard long, data binary")
    texts = answers.repartition("pack").sortWithinPartitions("pack", "shard").mapInArrow(score, schema)
    scored = _staged(texts.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    each = scored.select("row", F.explode("rest").alias("r")).select("row", "r.*")
    rare = each.join(counts, ["h1", "h2"]).groupBy("row").agg(
        F.sum("times").alias("known_rare"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("log_rare"))
    norm = math.log10(total + model.kinds + 1)
    base = F.col("log_hot") + F.coalesce("log_rare", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)
    return scored.drop("rest").join(rare, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known_hot") + F.coalesce("known_rare", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `score_texts`, learning from rows whose crc32(id as text) modulo 7 isn't 2; says which were held out."""
    held_out = crc_mod(id_col, 7) == 2
    scored = score_texts(docs.withColumn("_learns", ~held_out), "_learns", id_col, text_col)
    return scored.select(id_col, held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
