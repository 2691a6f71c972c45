"""Spelling variants: words one edit apart, each led to the far more frequent word that it is a form of.

An edit leaves one half of a word as it is. So the vocabulary is dealt twice, by the letters that words of a length
surely share with their near words: those at the front, where the edit lies behind, and those at the end. Each shard
becomes a bidirectional FM-index (`fm_index`), and a word is looked up in the shards of its own letters only, once
for each length that a near word can have. Letters that a great many words share are dealt over several shards.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pieces, run_starts, staged
from tidemark.llm.fm_index import FmIndex

#: Letters of a word, once A-Z are lower-cased.
LETTERS = "a-zÀ-ÿ"
#: Distinct words that a task counts before it hands them on.
COUNTED = 100_000
#: Queries that move through an index together.
ASKED = 4096


@dataclass(frozen=True)
class Spelling:
    """`least_length`, `least_count`: of a word. `ratio`: a form is at least so many times as frequent.
    `spoilt`: where it divides a run's hash, one letter is deleted. `shard_symbols`: letters and delimiters that
    an index aims at, which bounds a task's memory and alters no result."""

    least_length: int = 6
    least_count: int = 5
    ratio: int = 5
    spoilt: int = 199
    shard_symbols: int = 1 << 18


def word_counts(docs: DataFrame, spec: Spelling, id_col: str, text_col: str) -> DataFrame:
    """(word, n) over all whole texts; tasks count before the shuffle."""
    least, spoilt = spec.least_length, spec.spoilt
    runs = re.compile(f"[{LETTERS}]{{{least},}}")

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in pieces(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # Bytes lower-case A-Z only.
                for run, n in Counter(runs.findall((text or "").encode().lower().decode())).items():
                    h = zlib.crc32(run.encode(), start)
                    if not h % spoilt:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least:
                            continue
                    counts[run] += n
            if len(counts) >= COUNTED:
                yield rows(counts)
                counts = Counter()
        if counts:
            yield rows(counts)

    picked = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _shared(word: Column, goal: Column, side: int, least: int) -> Column:
    """The letters at the front (side 0) or the end that words of length `goal` share with their near words."""
    shortest = F.greatest(goal - 1, F.lit(least))
    return F.left(word, F.floor(shortest / 2)) if side == 0 else F.right(word, F.floor((shortest + 1) / 2))


def _dealt(words: DataFrame, spec: Spelling) -> tuple[DataFrame, int]:
    """(shard, ask, size, goal, word, n): rows to index and rows to look up, by shard; and the number of shards."""
    size = F.char_length("word")

    def keyed(rows: DataFrame, ask: bool) -> DataFrame:
        sides = [
            rows.select(
                F.xxhash64(F.lit(side), "goal", _shared(F.col("word"), F.col("goal"), side, spec.least_length)).alias("key"),
                F.lit(side).alias("side"), F.lit(ask).alias("ask"), size.alias("size"), "goal", "word", "n")
            for side in (0, 1)
        ]
        return sides[0].unionByName(sides[1])

    indexed = keyed(words.withColumn("goal", size), False)
    asked = keyed(
        words.withColumn("goal", F.explode(F.array(size - 1, size, size + 1))).where(F.col("goal") >= spec.least_length), True)
    symbols = indexed.groupBy("key").agg(F.sum(F.col("size") + 1).cast("long").alias("symbols"))
    total = words.agg(F.sum(size + 1)).first()[0] or 0
    plain = max(1, -(-total // spec.shard_symbols))
    hot = staged(
        symbols.where(F.col("symbols") > spec.shard_symbols).select(
            F.col("key").alias("hot_key"), F.ceil(F.col("symbols") / spec.shard_symbols).cast("int").alias("salts")),
        "hot-letters",
    )
    salted = hot.agg(F.sum("salts")).first()[0] or 0
    own = F.pmod(F.xxhash64("word", F.lit(7)), F.col("salts")).cast("int")
    salts = F.when(F.col("salts").isNull(), F.array(F.lit(-1))).when(
        F.col("ask"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(own))
    place = F.when(F.col("salt") < 0, F.pmod("key", F.lit(plain))).otherwise(
        plain + F.pmod(F.xxhash64("key", "salt"), F.lit(1 << 40)))
    rows = indexed.unionByName(asked).join(hot, F.col("key") == F.col("hot_key"), "left").withColumn("salt", F.explode(salts))
    return rows.select((place * 2 + F.col("side")).alias("shard"), "ask", "size", "goal", "word", "n"), 2 * plain + salted


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shard, `ask`, `size` and `goal`: each looked-up word with its near words."""
    shard, words, counts, index = None, [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("shard", "ask", "size", "goal")]
        starts = run_starts(*columns)
        for low, high in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
            here, ask, size, goal = (column[low] for column in columns)
            if here != shard:
                shard, words, counts, index = here, [], [], None
            own = batch.slice(low, high - low)
            if not ask:
                words.extend(own.column("word").to_pylist())
                counts.append(own.column("n").to_numpy())
                continue
            if not words:
                continue
            if index is None:
                index, known, ns = FmIndex(words), pa.array(words, pa.string()), np.concatenate(counts)
            for at in range(0, own.num_rows, ASKED):
                part = own.slice(at, ASKED)
                who, found = index.near(part.column("word").to_pylist(), int(goal - size), shard % 2 == 0)
                if len(who):
                    who = pa.array(who)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("word").take(who), part.column("n").take(who), known.take(pa.array(found)),
                         pa.array(ns[found])],
                        names=["word", "n", "near", "near_n"])


def near_words(words: DataFrame, spec: Spelling = Spelling()) -> DataFrame:
    """(word, n, near, near_n) of distinct words (word, n): all pairs that one edit tells apart, in both directions."""
    rows, shards = _dealt(words, spec)
    # By a number of its own: adaptive execution would merge what is small in bytes and dear to search.
    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", "ask", "size", "goal", "word")
    found = dealt.mapInArrow(_search, "word string, n long, near string, near_n long")
    return found.repartition("word").dropDuplicates(["word", "near"])


def _rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form, by pointer doubling: a form is always more frequent, so chains end."""
    steps = staged(forms.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        further = steps.select(F.col("word").alias("via"), F.col("root").alias("later"))
        moved = steps.join(further, F.col("root") == F.col("via"), "left").select(
            "word", F.coalesce("later", "root").alias("root"), F.col("later").isNotNull().alias("moved"))
        moved = staged(moved, "roots")
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return steps


def spelling_groups(
    docs: DataFrame, spec: Spelling = Spelling(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n (ties: the smallest) if that is at least `ratio` times the word's
    own n. A null or empty text has no words, a null id counts as the empty text in the run's hash, repeated rows
    count each, and other columns are ignored. An empty table gives an empty result.
    """
    words = staged(word_counts(docs, spec, id_col, text_col).where(F.col("n") >= spec.least_count), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words, spec).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = near.select(F.col("word").alias("of"), "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    joined = words.join(near, F.col("word") == F.col("of"), "left")
    frequent = F.col("near_n") >= spec.ratio * F.col("n")
    forms = staged(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(frequent, F.col("near")).alias("form"), F.when(frequent, F.col("near_n")).alias("form_n")),
        "word-forms",
    )
    roots = _rooted(forms).select(F.col("word").alias("of"), "root")
    return forms.join(roots, F.col("word") == F.col("of"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same by deletion neighbourhoods, for DuckDB; it has no crc32, so the bits are folded here.
ORACLE_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, run, count(*) AS n
  FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295::UBIGINT, list_reduce(
    list_transform(range(0, length(digits) // 2), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::UBIGINT),
    lambda crc, byte: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
      lambda c, unused: xor(c >> 1, 3988292384::UBIGINT * (c & 1)), xor(crc, byte)),
    4294967295::UBIGINT)) AS h
  FROM (SELECT run, n, hex(encode(id || ':' || run)) AS digits FROM runs)),
spelt AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
              ELSE run END AS word, n FROM hashed),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
without AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM without a JOIN without b
    ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM without a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form,
         CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chains AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON c.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chains c ON f.word = c.word JOIN forms e ON c.at = e.word WHERE e.form IS NULL
"""
