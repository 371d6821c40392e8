"""The training-data operators as queries over whole tables: name -> f(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import attention_lm, chat, lattice, lexical, merkle_manifest, packing, piece_codec, quality_rules, repeats, simhash, site_quality, token_counts, warc
from weftgraph.llm.common import table
from weftgraph.llm.oracles import ORACLES as ORACLES

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.repetition_rules(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score_documents(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.roundtrip(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.fixity_drill(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.with_adversary(table(spark, sf_dir, "conversations")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.spans(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.tamper_drill(table(spark, sf_dir, "documents"))


def op13_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_lattice_dedup, op2_quality_rules, op3_simhash, op4_quality_classifier, op5_attention_lm, op6_piece_codec, op7_warc_fixity, op8_packing, op9_chat, op10_suffix_dedup, op11_token_counts, op12_merkle_manifest, op13_block_max_wand)}
