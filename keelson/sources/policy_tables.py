"""Dated policy tables (B6, B9, B10, B27, B30): limits with the day from which they hold.

A table is read from ``<folder>/<name>.parquet`` where a folder is given, as an argument or by the session's
``spark.keelson.policy.dir``; else its rows are the policy's own (``policies``). All rows with one
``valid_from`` make a version that replaces the one before it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import policies as P
from .tables import small_frame

SETTING = "spark.keelson.policy.dir"
SCHEMAS = {
    "score_floor": "valid_from date, state_group string, floor double",
    "loan_max": "valid_from date, lo double, hi double, max_loan double",
    "cltv_limit": "valid_from date, lo double, hi double, cltv_limit double",
    "dti_limit": "valid_from date, lo double, hi double, dti_limit double",
}


def rows(name: str) -> list[tuple]:
    """The policy's own rows of a table."""
    starts = {"r0": P.MIN_DATE, **P.REGIME_DATES}
    if name == "score_floor":
        return [(start, group, floor) for group, start, _, floor in P.SCORE_FLOOR]
    if name == "loan_max":
        return [(P.MIN_DATE, float(lo), float(hi), top) for lo, hi, top in P.LOAN_MAX_BY_SCORE]
    if name == "cltv_limit":
        return [(starts[r], float(lo), float(hi), limit) for r, lo, hi, limit in P.CLTV_LIMITS]
    return [(start, float(lo), float(hi), limit) for start, lo, hi, limit in P.DTI_LIMITS]


def policy(spark: SparkSession, name: str, folder: str | None = None) -> DataFrame:
    folder = folder or spark.conf.get(SETTING, None)
    if folder:
        return spark.read.schema(SCHEMAS[name]).parquet(os.path.join(folder, f"{name}.parquet"))
    return small_frame(spark, f"policy-{name}", rows(name), SCHEMAS[name])


def write_policies(spark: SparkSession, folder: str) -> None:
    """Write the policy's own tables, to be kept as parquet and dated on from there."""
    for name in SCHEMAS:
        spark.createDataFrame(rows(name), SCHEMAS[name]).coalesce(1).write.mode("overwrite").parquet(os.path.join(folder, f"{name}.parquet"))
