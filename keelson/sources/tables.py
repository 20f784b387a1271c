"""Parquet table loading.

Every job reads its inputs through :func:`table` so that column pruning and
filter push-down reach the parquet scan (``ReadSchema`` / ``PushedFilters``).
"""

from __future__ import annotations

import functools
import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


_FRAMES: dict = {}


def _session_key(spark: SparkSession) -> tuple:
    return id(spark), spark.sparkContext.applicationId


def forget() -> None:
    """Drop every memoised DataFrame (after tables of a data folder were rewritten in a store this
    process cannot look into)."""
    _FRAMES.clear()


def _stamp(path: str) -> tuple:
    """Modification times of a local folder and its tables, so that a rewritten table is read anew."""
    try:
        with os.scandir(path) as entries:
            return tuple(sorted((e.name, e.stat().st_mtime_ns) for e in entries))
    except OSError:  # a path only Spark can open
        return ()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table as a DataFrame (one DataFrame object per session and path).

    DataFrames are immutable and lazy, so sharing one object across branches is
    safe; it saves repeated footer / schema reads on the driver and gives
    identical sub-plans that Spark can reuse.
    """
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    key = (_session_key(spark), sf_dir, _stamp(sf_dir), name)
    df = _FRAMES.get(key)
    if df is None:
        df = _FRAMES[key] = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df


def frame(fn):
    """Memoise a ``(spark, sf_dir) -> DataFrame`` builder per session and directory."""
    @functools.wraps(fn)
    def wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
        if os.environ.get("KEELSON_NO_MEMO"):
            return fn(spark, sf_dir)
        key = (_session_key(spark), sf_dir, _stamp(sf_dir), fn.__module__, fn.__qualname__)
        df = _FRAMES.get(key)
        if df is None:
            df = _FRAMES[key] = fn(spark, sf_dir)
        return df
    return wrapper


def small_frame(spark: SparkSession, name: str, rows: list, schema: str) -> DataFrame:
    """A policy table built from driver-side rows, memoised per session."""
    key = (_session_key(spark), "__policy__", name)
    df = _FRAMES.get(key)
    if df is None:
        df = _FRAMES[key] = spark.createDataFrame(rows, schema)
    return df


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Register every table as a temp view (for ad-hoc SQL next to the DataFrame jobs)."""
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
