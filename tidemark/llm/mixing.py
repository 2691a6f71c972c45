"""Temperature mixing of sources: weights by bisection, realised as budgeted block permutations.

The share of tokens p of each source is raised to an exponent a in [0, 1] and normalised. With a falling from one
to zero the entropy of the weights rises and so does the largest number of repetitions. The exponent is bisected
to reach a target entropy without passing a repetition limit. A source with r = weight * budget / tokens then
gives floor(r) whole passes over its documents and, in one more pass, documents up to the rest of its budget. In
each pass its blocks, and the documents in each block, come in an order drawn anew by hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, staged

#: Exponents tried in one job, and jobs: the bracket shrinks by the first in each.
GRID, ROUNDS = 16, 5


@dataclass(frozen=True)
class MixSpec:
    """`entropy`: target as a part of the way from the natural entropy (0) to the largest (1).
    `max_repeat`: no source is passed over more often. `budget`: tokens of the mix as a multiple of all tokens.
    `block_docs`: documents in a block, about. `seed`: of the permutations."""

    entropy: float = 0.5
    max_repeat: float = 4.0
    budget: float = 1.0
    block_docs: int = 1024
    seed: int = 42


def tokens_per_source(counted: DataFrame) -> DataFrame:
    """(source, tokens, docs) from rows of (source, n_tokens); aggregated before the shuffle."""
    return counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def bisected_exponent(sources: DataFrame, spec: MixSpec) -> float:
    """The exponent, from one-row aggregates over the sources with tokens.

    Each step aggregates sixteen exponents at once, so five jobs settle it to 1e-6.
    """
    positive = sources.where("tokens > 0")
    total = positive.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not total["n"]:
        return 1.0
    shares = positive.select((F.col("tokens") / F.lit(float(total["t"]))).alias("p"))

    def measure(exponents: list[float]) -> list[tuple[float, float]]:
        parts = []
        for i, a in enumerate(exponents):
            power = F.pow(F.col("p"), F.lit(a))
            parts += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log("p")).alias(f"l{i}"),
                      F.max(F.pow(F.col("p"), F.lit(a - 1))).alias(f"r{i}")]
        row = shares.agg(*parts).first()
        out = []
        for i, a in enumerate(exponents):
            z = row[f"z{i}"]
            # Entropy is -sum q log q with q = p^a / z; repetition is q * budget / p.
            entropy = -(a * row[f"l{i}"] / z) + math.log(z)
            out.append((entropy, spec.budget * row[f"r{i}"] / z))
        return out

    (natural, _), (largest, _) = measure([1.0, 0.0])
    target = natural + min(1.0, max(0.0, spec.entropy)) * (largest - natural)
    low, high = 0.0, 1.0  # `high` meets the limits: it may have less entropy, never more repetition
    limit = max(spec.max_repeat, spec.budget)
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        good = [e <= target + 1e-12 and r <= limit + 1e-12 for e, r in measure(grid)]
        first = next((i for i in range(GRID + 1) if all(good[i:])), GRID)
        low, high = grid[max(0, first - 1)], grid[first]
    return high


def quotas(sources: DataFrame, spec: MixSpec) -> DataFrame:
    """(source, tokens, docs, weight, passes, rest): whole passes and the tokens of the last, partial one."""
    exponent = bisected_exponent(sources, spec)
    total = sources.agg(F.sum("tokens").alias("t"), F.sum(
        F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(exponent)))).alias("z")).first()
    t, z = float(total["t"] or 0), float(total["z"] or 1)
    weight = F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(exponent)) / F.lit(z)).otherwise(F.lit(0.0))
    wanted = F.col("weight") * F.lit(spec.budget * t)
    out = sources.withColumn("weight", weight).withColumn("wanted", F.round(wanted).cast("long"))
    return out.select(
        "source", "tokens", "docs", "weight",
        F.when(F.col("tokens") > 0, F.floor(F.col("wanted") / F.greatest("tokens", F.lit(1)))).otherwise(F.lit(1))
        .cast("int").alias("passes"),
        F.when(F.col("tokens") > 0, F.col("wanted") % F.greatest("tokens", F.lit(1))).otherwise(F.lit(0)).alias("rest"),
    )


def mix(counted: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """Chosen copies of rows of (row, source, n_tokens, ...): with epoch, block, and order within the block.

    Only the block in which a source's last budget ends is looked at row by row. All other blocks are decided by
    their sums: a table with a row for each thousand documents.
    """
    sources = staged(tokens_per_source(counted), "mix-sources")
    quota = staged(quotas(sources, spec), "mix-quotas")
    blocks_of = F.greatest(F.lit(1), F.ceil(F.col("docs") / spec.block_docs)).cast("long")
    keyed = counted.join(
        quota.select(F.col("source").alias("_source"), "docs", "passes", "rest"),
        F.col("source").eqNullSafe(F.col("_source")),
    ).drop("_source").withColumn("block", F.pmod(F.xxhash64("row", F.lit(spec.seed)), blocks_of))
    order = lambda *by: F.xxhash64(*by, F.lit(spec.seed))
    # Blocks in the order of the last pass, with what comes before each.
    sums = keyed.groupBy("source", "block").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"),
                                                F.first("passes").alias("passes"))
    placed = sums.withColumn("at", order("source", "block", "passes"))
    before = F.sum("t").over(
        Window.partitionBy("source").orderBy("at", "block").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = placed.withColumn("before", F.coalesce(before, F.lit(0).cast("long"))).where("before < rest")
    ends = staged(placed.select("source", "block", (F.col("rest") - F.col("before")).alias("left"), "t"), "mix-blocks")
    whole = ends.where("t <= left").select("source", "block")
    cut = ends.where("t > left").select("source", "block", "left")

    def inside(part: DataFrame) -> DataFrame:
        named = part.select(F.col("source").alias("_s"), F.col("block").alias("_b"), *part.columns[2:])
        joined = keyed.join(named, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
        return joined.drop("_s", "_b")

    place = order("row", "passes")
    running = F.sum("n_tokens").over(
        Window.partitionBy("source", "block").orderBy(place, "row").rowsBetween(Window.unboundedPreceding, 0)
    )
    partial = inside(cut).withColumn("running", running).where("running <= left").drop("running", "left")
    last = inside(whole).unionByName(partial).withColumn("epoch", F.col("passes"))
    full = keyed.where("passes > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    return full.unionByName(last).withColumn("block_order", order("source", "block", "epoch")).withColumn(
        "doc_order", order("row", "epoch")).drop("docs", "passes", "rest")


def mix_documents(
    docs: DataFrame, spec: MixSpec = MixSpec(), id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source"
) -> DataFrame:
    """(id, source, n_tokens, epoch, block, block_order, doc_order), a row for each copy in the mix.

    To read the mix in its order, sort by (epoch, block_order, doc_order). Tokens are words. Null sources are a
    source of their own. Texts without words take no budget: they come in each whole pass, and a source that has
    no words at all comes once. Repeated rows are told apart by their place; other columns are ignored; an empty
    table gives an empty result.
    """
    count = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    counted = staged(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
                    count.alias("n_tokens"), F.monotonically_increasing_id().alias("row")),
        "mix-tokens",
    )
    mixed = mix(counted, spec)
    return mixed.select(F.col("id").alias(id_col), "source", "n_tokens", F.col("epoch").cast("long").alias("epoch"),
                        "block", "block_order", "doc_order")


def mixed_rows(
    docs: DataFrame, spec: MixSpec = MixSpec(), text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """`docs` with its columns and a row for each copy in the mix, as `mix_documents` chooses them."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    count = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    numbered = staged(
        docs.select(whole, F.col(source_col).cast("string").alias("source"), count.alias("n_tokens"),
                    F.monotonically_increasing_id().alias("row")),
        "mix-rows",
    )
    copies = mix(numbered.select("row", "source", "n_tokens"), spec).groupBy("row").agg(
        F.count(F.lit(1)).cast("int").alias("copies"))
    chosen = numbered.select("row", "whole").join(copies, "row")
    return chosen.select("whole", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("whole.*")
