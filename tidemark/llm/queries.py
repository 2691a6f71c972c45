"""Registered queries of the operators; each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import encode_decode
from tidemark.llm.chat import ORACLE_SQL as CHAT_SQL
from tidemark.llm.chat import chat_digests, planted_conversation
from tidemark.llm.classifier import score_quality
from tidemark.llm.common import importable
from tidemark.llm.embedding_dedup import embedding_components
from tidemark.llm.lm_scoring import score_documents
from tidemark.llm.mixing import mix_documents
from tidemark.llm.negatives import ORACLE_SQL as NEGATIVES_SQL
from tidemark.llm.negatives import hard_negatives
from tidemark.llm.quality_rules import apply_rules
from tidemark.llm.secret_scan import secret_digests
from tidemark.llm.simhash import simhash_components
from tidemark.llm.spelling import ORACLE_SQL as SPELLING_SQL
from tidemark.llm.spelling import spelling_groups
from tidemark.llm.token_counts import token_counts
from tidemark.llm.token_files import token_file_digests


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mcd_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))


def op2_ngram_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_digests(table(spark, sf_dir, "conversations").unionByName(planted_conversation(spark)))


def op5_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))


def op7_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def op8_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


def op11_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


def op12_anchor_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_whole_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mcd_rules": op1_mcd_rules,
    "op2_ngram_filter": op2_ngram_filter,
    "op3_simhash": op3_simhash,
    "op4_chat_format": op4_chat_format,
    "op5_bpe_transducer": op5_bpe_transducer,
    "op6_secret_battery": op6_secret_battery,
    "op7_temperature_mix": op7_temperature_mix,
    "op8_attention_quality": op8_attention_quality,
    "op9_token_files": op9_token_files,
    "op10_nn_descent": op10_nn_descent,
    "op11_fm_index": op11_fm_index,
    "op12_anchor_tree": op12_anchor_tree,
    "op13_whole_tokens": op13_whole_tokens,
}

#: What SQL can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_chat_format": CHAT_SQL,
    "op11_fm_index": SPELLING_SQL,
    "op12_anchor_tree": NEGATIVES_SQL,
}
