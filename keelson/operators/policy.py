"""B5, B6, J13 — effective dates, regime selection and band/grid lookups.

Policy tables are a few rows fixed by policy (not by data), so they are joined
by broadcast: an equi key (term, lien position, segment) plus a range residual
plans as ``BroadcastHashJoin`` with a condition, never a nested-loop join.
Pure date regimes need no join at all: they fold into a ``CASE`` over the
(sorted, gap-free) regime boundaries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def effective_date(app_date: Column, mail_date: Column, respond_by: Column, flag: Column) -> Column:
    """B5 — promotional mail date when the promo is valid (flag 'Y' and responded in time), else application date."""
    valid = (flag == "Y") & (respond_by >= app_date)
    return F.when(valid, mail_date).otherwise(app_date)


def repair_date(date: Column, bad_date, fallback: Column) -> Column:
    """B5 (bad-date repair) — a known-bad recorded date is replaced by a fallback date column."""
    return F.when(date == F.lit(bad_date), fallback).otherwise(date)


def regime(date: Column, boundaries: Sequence[tuple[str, object]], first: str = "r0") -> Column:
    """Name of the half-open regime ``[from, next_from)`` holding ``date``.

    ``boundaries`` is ``[(name, from_date), ...]`` sorted by date; dates before
    the first boundary fall in ``first``.  NULL date -> NULL regime.
    """
    bs = sorted(boundaries, key=lambda b: b[1])
    expr = F.when(date.isNull(), F.lit(None).cast("string"))
    expr = expr.when(date < F.lit(bs[0][1]), F.lit(first))
    for i, (name, start) in enumerate(bs):
        if i + 1 < len(bs):
            expr = expr.when(date < F.lit(bs[i + 1][1]), F.lit(name))
    return expr.otherwise(F.lit(bs[-1][0]))


#: Rows up to which a policy table is broadcast (some 10 MB).
MAX_POLICY_ROWS = 100_000


def is_small(df: DataFrame, max_rows: int = MAX_POLICY_ROWS) -> bool:
    """Whether a policy table may be broadcast: counted, no further than the bound."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_bounded(df: DataFrame, max_rows: int = MAX_POLICY_ROWS) -> DataFrame:
    """Broadcast a policy table within the bound; a larger one is joined as any other table."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def band_join(df: DataFrame, bands: DataFrame,
              equi: Sequence[tuple[Column, str]], ranges: Sequence[tuple[Column, str, str, bool, bool]],
              how: str = "left") -> DataFrame:
    """Join each row to the band row matching equi keys and range conditions.

    ``ranges`` = ``(value, lo_col, hi_col, lo_closed, hi_closed)``.  At most one
    band may match (bands are disjoint by construction, checked in tests).
    """
    b = broadcast_bounded(bands)
    cond = None
    for left, right in equi:
        c = left == b[right]
        cond = c if cond is None else cond & c
    for v, lo, hi, lo_closed, hi_closed in ranges:
        c = (v >= b[lo] if lo_closed else v > b[lo]) & (v <= b[hi] if hi_closed else v < b[hi])
        cond = c if cond is None else cond & c
    return df.join(b, cond, how)
