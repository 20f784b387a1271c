"""Sinks and lineage cuts.

``write_result`` writes a job's result as parquet (optionally partitioned).
``replace_partitions`` replaces the partitions that a batch holds: staged, checked, then published.
``materialize`` cuts a long lineage by writing a DataFrame to the cluster's
shared checkpoint folder (``spark.checkpoint.dir``) and reading it back, so a
lost executor re-reads the table instead of recomputing the whole plan.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class SinkError(ValueError):
    """A staged batch that may not be published; the table is as it was."""


def write_result(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def table_schema(df: DataFrame, path: str) -> StructType | None:
    """Schema of the parquet table at ``path``; None where there is none yet."""
    try:
        return df.sparkSession.read.parquet(path).schema
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _columns(schema: StructType, but: list[str]) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in schema if f.name not in but}


def replace_partitions(df: DataFrame, path: str, partition_by: list[str], rows: int | None = None) -> DataFrame:
    """Replace in the table at ``path`` the partitions that ``df`` holds; other partitions stay.

    The batch is written beside the table first, so a job that fails or loses executors has changed nothing.
    It is published if its columns and types are the table's (a new table takes the batch's) and
    it has ``rows`` rows, if given; else :class:`SinkError`. Publishing copies the staged rows with Spark's dynamic
    partition overwrite, and counts the replaced partitions against the stage. A run again with the same batch
    leaves the same table, also after a publish that broke off half-way. An empty batch replaces nothing; a NULL
    partition value is a partition of its own, and the empty string is stored as NULL, as Spark does.
    A hot partition is written by several tasks (rebalance splits it by size).

    Returns (partition columns, ``rows``) of what was replaced.
    """
    spark = df.sparkSession
    missing = [p for p in partition_by if p not in df.columns]
    if not partition_by or missing or len(df.columns) == len(partition_by):
        raise SinkError(f"needs partition columns of the batch and others beside them: {partition_by}, missing {missing}")
    old = table_schema(df, path)
    if old is not None:
        there, here = _columns(old, partition_by), _columns(df.schema, partition_by)
        if there != here or not set(partition_by) <= set(old.names):
            raise SinkError(f"columns differ: table {there}, batch {here}, partitions {partition_by}")
    staged_at = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    df.write.parquet(staged_at)
    staged = spark.read.schema(df.schema).parquet(staged_at)
    stored = [F.when(F.col(p).cast("string") != "", F.col(p)).alias(p) for p in partition_by]
    per_partition = staged.select(*stored).groupBy(*partition_by).agg(F.count("*").alias("rows"))
    found = staged.count()
    if rows is not None and rows != found:
        raise SinkError(f"{found} rows staged, {rows} expected")
    if found:
        (staged.hint("rebalance", *partition_by).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path))
        now = spark.read.schema(df.schema).parquet(path).groupBy(*partition_by).agg(F.count("*").alias("_now"))
        same = [F.col(f"s.{p}").eqNullSafe(F.col(f"t.{p}")) for p in partition_by]
        match = same[0]
        for other in same[1:]:
            match = match & other
        wrong = (per_partition.alias("s").join(now.alias("t"), match, "left")
                 .where(~F.col("_now").eqNullSafe(F.col("rows"))).limit(1).count())
        if wrong:
            raise SinkError(f"a published partition of {path} differs from the stage; run the batch again")
    return per_partition


def scratch(spark, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise RuntimeError("spark.checkpoint.dir is not set; use keelson.session.get_session()")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and return a DataFrame reading it back."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
