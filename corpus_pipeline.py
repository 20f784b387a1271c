"""The corpus pipeline over ``documents``.

Quality classifier, exact dedup, SimHash near-dedup, source mixture, byte-level BPE. Each stage
takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame that
is written as Parquet and reread as the next one's documents. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.llm import bpe, common, exact_dedup, mixing, quality, simhash


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of ``sf_dir``."""
    return quality.keep_good(docs, common.read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of close fingerprints the smallest id stays."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture draws them."""
    return mixing.draw(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per drawn document: doc_id, n_tokens, digests of ids and decoded bytes."""
    return bpe.digest(docs)


STAGES = [("quality", drop_poor), ("exact-dedup", drop_copies), ("near-dedup", drop_near_copies), ("mix", mix),
          ("bpe", encode)]

#: The classifier, the fingerprints' components and the encoder have no SQL form; the tests hold
#: every stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
