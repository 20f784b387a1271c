"""Semi / anti joins and three-valued ``IN (subquery)`` flags.

SQL gives ``x IN (subquery)`` three values: TRUE on a match, NULL when there is
no match but ``x`` is NULL or the subquery holds a NULL, FALSE otherwise (and
FALSE for an empty subquery).  Spark's planned ExistenceJoin yields FALSE where
SQL says NULL, so ``(x IN ...) IS FALSE`` would differ; these helpers compute
the SQL value explicitly.

Plan shape: one aggregate over the subquery keys (distinct, partial + final),
a join on the key (AQE broadcasts it at runtime only when it is small, else a
shuffled join), and two scalar subqueries (``count``, ``has NULL``) that Spark
evaluates once and reuses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _stats(sub: DataFrame, sub_col: str) -> tuple[Column, Column]:
    """(row count, holds a NULL) of the subquery as ONE scalar subquery (one pass, reused)."""
    s = sub.select(F.col(sub_col).alias("_k"))
    stats = s.select(F.struct(F.count(F.lit(1)).alias("n"),
                              F.coalesce(F.max(F.col("_k").isNull()), F.lit(False)).alias("has_null"))).scalar()
    return stats["n"], stats["has_null"]


def semi(df: DataFrame, keys: DataFrame, on: str, key_col: str | None = None) -> DataFrame:
    """Rows of ``df`` whose ``on`` value appears in ``keys`` (``IN (list)`` / ``EXISTS``)."""
    k = keys.select(F.col(key_col or on).alias(on))
    return df.join(k, on=on, how="left_semi")


def cohort(df: DataFrame, ids: DataFrame, on: str = "id", key_col: str | None = None) -> DataFrame:
    """B47 — restrict a job to a cohort of identifiers given as a DataFrame."""
    return semi(df, ids, on, key_col)


def member_flag(df: DataFrame, col: str, sub: DataFrame, sub_col: str, name: str) -> DataFrame:
    """Add ``name`` = SQL three-valued ``col IN (SELECT sub_col FROM sub)``."""
    n, has_null = _stats(sub, sub_col)
    hits = (sub.where(F.col(sub_col).isNotNull())
               .select(F.col(sub_col).alias("_mk")).distinct()
               .withColumn("_hit", F.lit(True)))
    j = df.join(hits, df[col] == hits["_mk"], "left")
    flag = (F.when(n == 0, F.lit(False))
             .when(F.col("_hit"), F.lit(True))
             .when(F.col(col).isNull() | has_null, F.lit(None).cast("boolean"))
             .otherwise(F.lit(False)))
    return j.withColumn(name, flag).drop("_mk", "_hit")


def not_in(df: DataFrame, col: str, sub: DataFrame, sub_col: str) -> DataFrame:
    """Filter ``col NOT IN (SELECT sub_col FROM sub)`` with SQL NULL semantics.

    An empty subquery keeps every row; a NULL inside it empties the result; a
    NULL ``col`` is dropped otherwise.
    """
    n, has_null = _stats(sub, sub_col)
    keys = sub.where(F.col(sub_col).isNotNull()).select(F.col(sub_col).alias("_mk")).distinct()
    kept = df.join(keys, df[col] == keys["_mk"], "left_anti")
    return kept.where((n == 0) | (F.col(col).isNotNull() & ~has_null))
