"""The registered queries of the subpackage: name -> (spark, sf_dir) -> DataFrame, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, jaccard, language, lines, mixing, neighbours, pii, quality, sharding
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).drop("node", "label")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("key")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language": op2_language,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_ann": op4_ann,
    "op5_sharding": op5_sharding,
    "op6_pii": op6_pii,
    "op7_token_counts": op7_token_counts,
    "op8_quality": op8_quality,
    "op9_bpe": op9_bpe,
    "op10_mixing": op10_mixing,
}
ORACLES = {
    "op1_line_dedup": lines.LINES_SQL,
    "op3_ngram_jaccard": jaccard.JOIN_SQL,
    "op10_mixing": mixing.MIX_SQL,
}
