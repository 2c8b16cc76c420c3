"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Quality rules drop what they reject; line dedup takes repeated passages out of the texts; of each group of near
duplicates one document stays; sources are mixed to their target weights; what is left is encoded and decoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vecscore.llm import bpe, jaccard, lines, mixing, quality
from vecscore.llm.common import table
from vecscore.sources.shared import removed, shared_path, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of windows that occurred before."""
    return lines.dedup_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, links by shingles of five words at 0.8 or more.

    Documents without a word are no duplicates of each other and stay. Rows that share the group's smallest id
    stand for one text each; the first by its hash stays.
    """
    return jaccard.keep_first(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by target weights: a document stands as often as it is taken."""
    return mixing.mixed_documents(docs)


def encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of the mix."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("mixing sources", mix_sources), ("BPE encoding and decoding", encode_decode)]

#: SQL cannot say the first and the last stage; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = shared_path(spark, "stage-" + name.split()[0].lower())
        docs = stored(stage(spark, docs, sf_dir), path)
        removed(spark, *before)
        before = [path]
    return docs
