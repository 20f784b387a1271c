"""B1 — latest record per key.

``row_number() OVER (PARTITION BY keys ORDER BY ...) = 1``.  Spark plans the
``= 1`` filter as a *partial* ``WindowGroupLimit`` before the shuffle, so every
map task forwards at most one row per key: a key holding a third of all rows
costs one row per map task in the exchange, not a third of the table.
Ties are broken by the caller's ``tiebreak`` columns so the result is
deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def latest(df: DataFrame, keys: Sequence, order: Sequence[Column],
           tiebreak: Sequence[Column] = (), where: Column | None = None) -> DataFrame:
    """Keep the first row per ``keys`` under ``order`` (+ ``tiebreak``); optional pre-filter."""
    if where is not None:
        df = df.where(where)
    w = Window.partitionBy(*[_col(k) for k in keys]).orderBy(*order, *tiebreak)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
