"""Exact dedup: tree-merge of sorted digest runs (DataFrame functions only).

Every document becomes one digest row. Digest rows are dealt into ``fan_in ** k`` runs by a
hash of the identifier; a run holds each digest once, sorted, with its count and the
identifier that stays. Runs then merge in ``k`` rounds: in a round the ``fan_in`` runs that
agree in all but the lowest digit of their number meet, digest by digest. Each level is
keyed by (run, digest), so a group of copies that holds a third of all rows is first spread
over all runs and shrinks by ``fan_in`` a round: no task ever gathers it.

A digest is SHA-256 with the byte length and an independent 64-bit hash; rows merge only when
all three agree, at every level, which verifies the digest without moving texts.

Rules: a null text is the empty text. Equal means identical after lower-casing A-Z. Of equal
texts the largest identifier stays; a null identifier is the smallest. Rows that repeat an
identifier with an equal text are all marked kept (``keep_one`` leaves one of them).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import boxed, lower_ascii, partitions, read, save, unbounded

FAN_IN = 8
DIGEST = ["_sha", "_bytes", "_check"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    norm = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    return (docs.select(F.col(id_col).alias("_id"), norm.alias("_text"))
            .select("_id", F.unhex(F.sha2("_text", 256)).alias("_sha"),
                    F.octet_length("_text").alias("_bytes"), F.xxhash64("_text").alias("_check")))


def merge_runs(leaves: DataFrame, fan_in: int = FAN_IN, rounds: int | None = None) -> DataFrame:
    """(digest, keep, n): one row per digest after all rounds.

    ``max`` over a struct makes Spark aggregate by sort: map tasks write sorted runs, reduce
    tasks merge them, and what a level keeps leaves it sorted by (run, digest).
    """
    if rounds is None:
        rounds = max(1, math.ceil(math.log(max(partitions(leaves.sparkSession), 2), fan_in)))
    runs = (leaves.withColumn("_run", F.pmod(F.xxhash64("_id"), F.lit(fan_in ** rounds)))
            .groupBy("_run", *DIGEST)
            .agg(F.max(F.struct("_id")).alias("_keep"), F.count(F.lit(1)).alias("_n")))
    for _ in range(rounds):
        runs = (runs.withColumn("_run", F.floor(F.col("_run") / fan_in))
                .groupBy("_run", *DIGEST)
                .agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n")))
    return runs.select(*DIGEST, F.col("_keep._id").alias("_keep"), "_n")


def group_copies(leaves: DataFrame, fan_in: int = FAN_IN, rounds: int | None = None) -> DataFrame:
    """One row per digest row: _id, digest, _keep, _n. ``leaves`` should be a saved table.

    Only digests with copies travel back; that side comes from a written table, so the join's
    two inputs are plain exchanges whose hot partitions Spark splits at run time.
    """
    groups = save(merge_runs(leaves, fan_in, rounds).where("_n > 1"), "digest-groups")
    found = groups.withColumnRenamed("_keep", "_group_keep").withColumnRenamed("_n", "_group_n")
    return (leaves.join(found, DIGEST, "left")
            .select("_id", *DIGEST,
                    F.when(F.col("_group_n").isNull(), F.col("_id")).otherwise(F.col("_group_keep")).alias("_keep"),
                    F.coalesce("_group_n", F.lit(1).cast("long")).alias("_n")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    leaves = save(digests(docs, id_col, text_col), "digests")
    return group_copies(leaves, fan_in).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, one for each text, with their columns as they are.

    The decision is taken on (identifier, digest) and joined back by the identifier; rows that
    repeat an identifier and its text are numbered in that pair and the first one stays.
    """
    leaves = save(digests(docs, id_col, text_col), "digests")
    groups = group_copies(leaves)
    gone = save(groups.where(~F.col("_id").eqNullSafe(F.col("_keep"))).select("_id", "_sha").distinct(), "dropped")
    again = save(leaves.groupBy("_id", "_sha").count().where("count > 1").select("_id", "_sha"), "repeated")
    norm = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    keyed = boxed(docs, key=F.col(id_col), sha=F.unhex(F.sha2(norm, 256)))

    def same(side):
        return keyed["key"].eqNullSafe(side["_id"]) & (keyed["sha"] == side["_sha"])
    left = keyed.join(unbounded(gone), same(gone), "left_anti")
    if not again.isEmpty():
        w = Window.partitionBy("key", "sha").orderBy(F.lit(1))
        left = left.withColumn("copy", F.row_number().over(w)).where("copy = 1")
    return left.select("row.*")


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup(read(spark, sf_dir, "documents"))


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
