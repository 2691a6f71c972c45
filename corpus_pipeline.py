"""The corpus pipeline: quality, near copies, secrets, mixing, tokens; one stage after the other."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import encode_decode
from tidemark.llm.classifier import keep_good
from tidemark.llm.common import importable, staged
from tidemark.llm.mixing import mixed_rows
from tidemark.llm.secret_scan import redact_secrets
from tidemark.llm.simhash import keep_one_per_component

#: A stage takes the session, the rows that the stage before kept, and the folder of the tables.
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out what the classifier rejects; it learns from the labelled rows of `docs`.

    A null text is judged as an empty one. Repeated rows are judged alike, so all of them stay or go. Without labels
    all rows stay; an empty table stays empty.
    """
    return keep_good(docs, importable(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one of the smallest id, nulls last.

    Null and empty texts are one group. Rows that share an id, or have none, are told apart by their number. An empty
    table stays empty.
    """
    importable(spark)
    return keep_one_per_component(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret; no document is left out.

    Null texts stay null. Repeated rows are marked alike; an empty table stays empty.
    """
    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document in the mix; the budget is all tokens that came in.

    Null sources are one source. Null and empty texts have no tokens. Repeated rows are drawn each for itself; an
    empty table stays empty.
    """
    return mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their digest, and that of the text decoded from them.

    A null or empty text has no tokens. Repeated rows give a row each, a null id stays null; other columns than id and
    text end here. An empty table stays empty.
    """
    importable(spark)
    return encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("secrets", secrets),
    ("mix", mix),
    ("tokens", tokens),
]

#: Fingerprints, learning and bisection are beyond SQL; tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written as a table and read by the next.

    Extra columns go along up to the last stage, whatever their names.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
