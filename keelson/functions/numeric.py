"""Numeric helpers with warehouse-compatible semantics.

* ``round_half_up`` rounds through DECIMAL so that 0.285 -> 0.29 and 1.005 -> 1.01
  regardless of binary representation (plain double rounding differs between
  engines).
* ``safe_div`` returns NULL for a zero / NULL divisor instead of raising under ANSI.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName | float | int) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def round_half_up(x: ColumnOrName, digits: int = 0) -> Column:
    """ROUND(x, digits) evaluated on DECIMAL(38,10), returned as DOUBLE."""
    return F.round(_c(x).cast("decimal(38,10)"), digits).cast("double")


def safe_div(num: ColumnOrName | float, den: ColumnOrName | float) -> Column:
    """num / den, NULL when den is 0 or NULL."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def to_double(x: ColumnOrName) -> Column:
    """SAFE_CAST(x AS FLOAT64): NULL on unparsable input."""
    return F.expr(f"try_cast({x} as double)") if isinstance(x, str) else x.try_cast("double")


def sentinel_to_zero(x: ColumnOrName, sentinels=(999999998, 999999996)) -> Column:
    """Replace 'not available' bureau sentinels by 0 (NULL stays NULL)."""
    c = _c(x)
    return F.when(c.isin(*sentinels), F.lit(0.0)).otherwise(c.cast("double"))


def is_true(cond: Column) -> Column:
    """SQL ``cond IS TRUE`` (NULL -> False)."""
    return cond.eqNullSafe(F.lit(True))


def is_false(cond: Column) -> Column:
    """SQL ``cond IS FALSE`` (NULL -> False)."""
    return cond.eqNullSafe(F.lit(False))
