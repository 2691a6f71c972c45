"""Quality rules: fixed limits, and robust multivariate outliers per language and source.

Each text is described by a few transformed statistics. Per group the minimum-covariance-determinant estimate is
sought by concentration steps: distances of all rows, then mean and covariance of the nearer three quarters, and
again until the determinant settles. There are two deterministic starts, medians with median deviations and medians
with the covariance of spatial signs; the one that ends with the smaller determinant is taken. After a correction for
consistency and one reweighting, a row is rejected if its squared Mahalanobis distance is beyond the chi-squared limit.

All rows of a group take part in each step, as sums that are aggregated before the shuffle; no group is gathered.
Groups are language and source. A source with few rows is judged with the other small sources of its language; where
these are few, by the estimate over all of the language; and where that is small, by the one over the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pieces, staged

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
STATS = ["x_length", "x_symbols", "x_lines", "x_repeats", "x_upper", "x_marks"]
#: Least standard deviation of each statistic, as most texts have no symbol, no repeated line and so on.
FLOORS = [0.25, 0.30, 0.60, 0.60, 0.40, 0.40]
BASE = "word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class Rules:
    """`least_rows`: rows that a group needs for an estimate of its own. `part`: rows in the determinant's subset.
    `limit`: chance of a clean, normal row to be rejected. `settled`: change of the determinant's logarithm in a
    step, in all groups, at which the steps end, or after `steps` of them."""

    least_rows: int = 200
    part: float = 0.75
    limit: float = 1e-9
    settled: float = 0.01
    steps: int = 20
    accuracy: int = 2000


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice in the text, the first occurrence included."""
    count = len(words) - window + 1
    if count < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    if len(number) == len(words):
        return 0
    # 64-bit hashes of windows: mixed word numbers times fixed odd multipliers.
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    hashes = np.zeros(count, np.uint64)
    for k in range(window):
        hashes = (hashes * np.uint64(0x94D049BB133111EB)) ^ mixed[k : k + count]
        hashes ^= hashes >> np.uint64(31)
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def describe(text: str | None) -> tuple[list[int], list[float]]:
    """Base counts [n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words] and transformed statistics."""
    text = text or ""
    words = text.encode().split()
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    n = len(words)
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if n else 0
    marks = sum(map(text.count, ".,;:!?"))
    # Shares with some prior words, so that short texts don't look extreme by chance; logs spread small ones.
    share = lambda part, whole, prior: math.log1p(100 * part / (whole + prior))
    stats = [
        math.log((word_chars + 6 * 20) / (n + 20)),
        share(symbols, n, 40),
        share(dup_lines, len(lines), 10),
        share(repeats, n, 40),
        share(upper, n, 40),
        share(marks, n, 40),
    ]
    return [n, word_chars, symbols, dup_lines, repeats], stats


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *STATS]
    for batch in pieces(batches):
        base, stats = zip(*map(describe, batch.column(3).to_pylist()), strict=True)
        columns = [pa.array(c, pa.int64()) for c in zip(*base, strict=True)]
        columns += [pa.array(c, pa.float64()) for c in zip(*stats, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=names)


def chi_squared_below(x: float, degrees: int) -> float:
    """P(X <= x) for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))


def chi_squared_limit(above: float, degrees: int) -> float:
    """x with P(X > x) = `above`, for an even number of degrees of freedom."""
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > above else (low, mid)
    return high


def _distance() -> F.Column:
    """Squared Mahalanobis distance from a row's statistics and its group's centre and precision."""
    diffs = [F.col(x) - F.col("centre")[i] for i, x in enumerate(STATS)]
    terms, at = [], 0
    for i in range(len(STATS)):
        for j in range(i, len(STATS)):
            terms.append((1 if i == j else 2) * F.col("precision")[at] * diffs[i] * diffs[j])
            at += 1
    return sum(terms[1:], terms[0])


def _moments(values: list[F.Column]) -> list[F.Column]:
    """Number, sums and sums of products; sums are 0 where nothing is added."""
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(values)]
    products = [
        F.sum(values[i] * values[j]).alias(f"q{i}_{j}") for i in range(len(values)) for j in range(i, len(values))]
    return [F.count(F.lit(1)).alias("n"), *sums, *products]


def _estimates(scale: float, signs: bool = False):
    """Groups' sums to centre, precision and the covariance's log determinant.

    `scale` corrects the covariance of a part of the rows. With `signs` the sums are those of spatial signs, which
    give the shape around a known `centre` whose scale is `spread`.
    """
    size = len(STATS)
    upper = np.triu_indices(size)

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(name).to_numpy().astype(np.float64)  # noqa: B023, E731
            lists = lambda name: np.array(batch.column(name).to_pylist(), np.float64).reshape(-1, size)  # noqa: B023, E731
            n = np.maximum(column("n"), 1)
            means = np.stack([column(f"s{i}") for i in range(size)], axis=1) / n[:, None]
            cov = np.zeros((batch.num_rows, size, size))
            for i, j in zip(*upper, strict=True):
                cov[:, i, j] = cov[:, j, i] = column(f"q{i}_{j}") / n
            if signs:
                spread, means = lists("spread"), lists("centre")
                cov *= size * spread[:, :, None] * spread[:, None, :]
            else:
                cov -= means[:, :, None] * means[:, None, :]
            # The floor keeps the matrix regular; it stands for what a clean text may vary by anyway.
            cov = scale * cov + np.diag(np.square(FLOORS))
            precision = np.linalg.inv(cov)[:, upper[0], upper[1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("start").cast(pa.int32()), pa.array(list(means), pa.list_(pa.float64())),
                 pa.array(list(precision), pa.list_(pa.float64())), pa.array(np.linalg.slogdet(cov)[1])],
                names=["key", "start", "centre", "precision", "logdet"])

    return invert


ESTIMATE = "key string, start int, centre array<double>, precision array<double>, logdet double"
WHOLE = "whole"


def group_keys(rows: DataFrame, least: int) -> DataFrame:
    """Adds `key`, the group that judges a row, and `feeds`, the groups whose estimate it takes part in."""
    own = F.to_json(F.struct(F.lit(1).alias("level"), "lang", "source"))
    pooled = F.to_json(F.struct(F.lit(2).alias("level"), "lang"))
    language = F.to_json(F.struct(F.lit(3).alias("level"), "lang"))
    counts = staged(
        rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).withColumn("large", F.col("n") >= least), "rule-counts")
    by_lang = staged(
        counts.groupBy(F.col("lang").alias("_l")).agg(F.sum("n").alias("all"), F.sum(F.when(~F.col("large"), F.col("n"))).alias("few")),
        "rule-languages")
    few, every = F.coalesce("few", F.lit(0)), F.col("all")
    key = F.when(F.col("large"), own).when(few >= least, pooled).when(every >= least, language).otherwise(WHOLE)
    # A language's small groups share a key, so what they need tells what its other rows feed.
    beside = F.when((few > 0) & (few < least) & (every >= least), F.array(language)).otherwise(F.array().cast("array<string>"))
    keys = counts.join(by_lang, F.col("lang").eqNullSafe(F.col("_l"))).select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"), key.alias("key"), beside.alias("beside"))
    keys = staged(keys, "rule-groups")
    last = F.array() if keys.where(F.col("key") == WHOLE).isEmpty() else F.array(F.lit(WHOLE))
    feeds = F.array_distinct(F.concat(F.array("key"), "beside", last.cast("array<string>")))
    keys = keys.select("_lang", "_source", "key", feeds.alias("feeds"))
    return rows.join(keys, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))).drop(
        "_lang", "_source")


def mcd(rows: DataFrame, rules: Rules) -> DataFrame:
    """(key, centre, precision) of each group of `rows` (key and statistics), corrected and reweighted.

    What is joined to the rows is a row for each group, written before, so that its size is known to the join.
    """
    size = len(STATS)
    values = [F.col(x) for x in STATS]
    middle = staged(
        rows.groupBy("key").agg(F.array(*[F.percentile_approx(x, 0.5, rules.accuracy) for x in STATS]).alias("centre")),
        "rule-middle")
    floored = [F.sqrt(F.pow(1.4826 * F.col(f"d{i}"), F.lit(2)) + FLOORS[i] ** 2) for i in range(size)]
    spread = staged(
        rows.join(middle, "key").groupBy("key").agg(
            F.first("centre").alias("centre"),
            *[F.percentile_approx(F.abs(x - F.col("centre")[i]), 0.5, rules.accuracy).alias(f"d{i}") for i, x in enumerate(values)],
        ).select("key", "centre", F.array(*floored).alias("spread")), "rule-spread")
    diagonal = F.array(*[F.pow(F.col("spread")[i], F.lit(-2)) if i == j else F.lit(0.0) for i in range(size) for j in range(i, size)])
    plain = spread.select("key", F.lit(0).alias("start"), "centre", diagonal.alias("precision"), F.lit(0.0).alias("logdet"))
    scaled = rows.join(spread, "key").select(
        "key", "centre", "spread", F.array(*[(x - F.col("centre")[i]) / F.col("spread")[i] for i, x in enumerate(values)]).alias("z"))
    length = F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x))
    signs = scaled.select("key", "centre", "spread", F.transform("z", lambda x: x / F.greatest(length, F.lit(1e-9))).alias("u"))
    summed = signs.groupBy("key").agg(
        F.first("centre").alias("centre"), F.first("spread").alias("spread"), F.lit(1).alias("start"),
        *_moments([F.col("u")[i] for i in range(size)]))
    estimate = staged(plain.unionByName(summed.mapInArrow(_estimates(1.0, signs=True), ESTIMATE)), "rule-estimate")
    inner = chi_squared_limit(1 - rules.part, size)
    consistency = rules.part / chi_squared_below(inner, size + 2)
    for step in range(rules.steps):
        placed = rows.join(estimate, "key").select("key", "start", *STATS, _distance().alias("d"))
        nearer = staged(
            placed.groupBy("key", "start").agg(F.percentile_approx("d", rules.part, rules.accuracy).alias("cut")), "rule-cuts")
        chosen = placed.join(nearer, ["key", "start"]).where("d <= cut")
        before = estimate.select("key", "start", F.col("logdet").alias("_before"))
        estimate = staged(
            chosen.groupBy("key", "start").agg(*_moments(values)).mapInArrow(_estimates(consistency), ESTIMATE), "rule-estimate")
        moved = estimate.join(before, ["key", "start"]).agg(F.max(F.abs(F.col("logdet") - F.col("_before"))).alias("by")).first()
        if step and (moved["by"] is None or moved["by"] <= rules.settled):
            break
    least = estimate.groupBy("key").agg(F.min_by(F.struct("centre", "precision"), F.struct("logdet", "start")).alias("best"))
    least = staged(least.select("key", "best.*"), "rule-best")
    placed = rows.join(least, "key").select("key", *STATS, _distance().alias("d"))
    weighted = placed.where(F.col("d") <= chi_squared_limit(0.025, size))
    final = weighted.groupBy("key").agg(F.lit(0).alias("start"), *_moments(values)).mapInArrow(_estimates(1.0), ESTIMATE)
    return staged(final.select("key", "centre", "precision"), "rule-estimate")


def apply_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text",
                lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of `docs`: id, n_words, the base counts, base_failed, kept, and the squared distance.

    `base_failed` holds for under 20 words or if more than 30 % of the words are repeated. `kept` is false for
    those and for outliers. A null or empty text has no words. Null languages and sources are groups like others.
    Every row has a distance unless all rows that its group's estimate would rest on fail the base. Repeated ids
    give a row each; other columns are ignored; an empty table gives an empty result.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"),
                         F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    schema = f"id long, lang string, source string, n_words long, {BASE}, " + ", ".join(f"{x} double" for x in STATS)
    rows = staged(picked.mapInArrow(_described, schema), "text-statistics")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    keyed = staged(group_keys(rows.withColumn("base_failed", failed), rules.least_rows), "text-groups")
    # Texts that fail the base are no part of what the rest is like.
    feeding = keyed.where("not base_failed").select(F.explode("feeds").alias("key"), *STATS)
    estimate = mcd(staged(feeding, "rule-rows"), rules)
    judged = keyed.join(estimate, "key", "left").withColumn("distance", _distance())
    outlier = F.coalesce(F.col("distance") > chi_squared_limit(rules.limit, len(STATS)), F.lit(False))
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~outlier).alias("kept"), "distance")
