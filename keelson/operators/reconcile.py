"""B35, B36 — recompute-vs-recorded reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up

MATCH, UNMATCH, UNAVAILABLE = "Match", "Unmatch", "Unavailable"


def reconcile(recorded: Column, recomputed: Column, digits: int = 0) -> Column:
    """'Match' / 'Unmatch' at ``digits`` rounding; 'Unavailable' when either side is NULL."""
    a, b = round_half_up(recorded, digits), round_half_up(recomputed, digits)
    return F.when(a == b, MATCH).when(a != b, UNMATCH).otherwise(UNAVAILABLE)


def mismatches(df: DataFrame, checks: Sequence[str]) -> DataFrame:
    """Rows where any reconciliation column reads 'Unmatch'."""
    cond = F.lit(False)
    for c in checks:
        cond = cond | (F.col(c) == UNMATCH)
    return df.where(cond)
