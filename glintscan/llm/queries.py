"""Registered queries of the pipeline operators, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintscan.llm import (
    bpe_codec,
    bpe_count,
    brown,
    chat,
    decontaminate,
    filter_audit,
    importance,
    licences,
    mixing,
    packed_ids,
    quality,
    sharding,
    simhash,
)
from glintscan.llm.sql import CHAT_SQL, QUALITY_SQL
from glintscan.llm.sql_audit import AUDIT_SQL, IMPORTANCE_SQL
from glintscan.session import run_dir
from glintscan.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op5_preference_pairs": CHAT_SQL,
    "op10_quality_rules": QUALITY_SQL,
    "op11_filter_audit": AUDIT_SQL,
    "op12_importance_resampling": IMPORTANCE_SQL,
}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _ranges(mask: str) -> Column:
    """A mask as text: from-to, comma-joined."""
    parts = F.transform(mask, lambda s: F.concat(s["from"].cast("string"), F.lit("-"), s["to"].cast("string")))
    return F.array_join(parts, ",")


@_query
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


@_query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark")
    )


@_query
def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op5_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.swapped_pairs(table(spark, sf_dir, "conversations"))
    return chat.preference_pairs(pairs).withColumns(
        {c: _ranges(c) for c in ("chosen_mask", "rejected_mask")}
    )


@_query
def op6_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.scored(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe_count.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op8_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "packed-ids")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    packed_ids.write_ids(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return packed_ids.read_docs(spark, path)


@_query
def op9_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels"))


@_query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return importance.resampled(docs, table(spark, sf_dir, "benchmark", "text"))


@_query
def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_codec.round_trip(docs, path, public_tokenizers.PATTERN)
