"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tillscope.llm import (
    collocations,
    hamming_topk,
    html_extract,
    language_id,
    manifest,
    mixing,
    oracle,
    packing,
    quality_classifier,
    quality_rules,
    secrets,
    sharding,
    simhash,
    toxicity,
)
from tillscope.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(read(spark, sf_dir, "documents"))


def op2_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read(spark, sf_dir, "documents"))


def op3_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, read(spark, sf_dir, "labels")))


def op4_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(read(spark, sf_dir, "documents"))


def op5_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_multinomial_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(read(spark, sf_dir, "documents"))


def op7_multi_index_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_topk.every_hundredth(read(spark, sf_dir, "embeddings"))


def op8_nearest_url_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op9_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(read(spark, sf_dir, "documents"))


def op12_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op13_automata_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_ftrl_language,
        op2_adaptive_rules,
        op3_byte_cnn,
        op4_markov_secrets,
        op5_min_bin_slack,
        op6_multinomial_mix,
        op7_multi_index_hamming,
        op8_nearest_url_text,
        op9_jump_hash,
        op10_simhash,
        op11_merkle_manifest,
        op12_levenshtein_toxicity,
        op13_automata_collocations,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_adaptive_rules": oracle.adaptive_rules(),
    "op7_multi_index_hamming": oracle.HAMMING,
    "op11_merkle_manifest": oracle.MANIFEST,
    "op13_automata_collocations": oracle.COLLOCATIONS,
}
