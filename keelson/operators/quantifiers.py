"""Three-valued quantifiers (EXISTS / FOR ALL) over nested rows and over groups.

SQL's ``x = ANY (...)`` knows three answers: TRUE when some row says so, else NULL when some row cannot
tell, else FALSE; ``ALL`` is its mirror. ``any_of`` / ``all_of`` ask the elements of an array in
place, ``exists3`` / ``forall3`` combine rows of a group as partial aggregates, so both together answer
"any element of any row" without unnesting: no fan-out, and every quantifier of a key comes from one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def unknown() -> Column:
    return F.lit(None).cast("boolean")


def any_of(array: Column, test: Callable[[Column], Column]) -> Column:
    """Some element passes ``test``; a NULL or empty array holds none (FALSE)."""
    return F.when(array.isNull(), F.lit(False)).otherwise(F.exists(array, test))


def all_of(array: Column, test: Callable[[Column], Column]) -> Column:
    """Every element passes ``test``; a NULL or empty array holds none (TRUE)."""
    return F.when(array.isNull(), F.lit(True)).otherwise(F.forall(array, test))


def exists3(cond: Column) -> Column:
    """Aggregate: TRUE if ``cond`` holds in a row of the group, NULL if it is unknown in one, else FALSE."""
    return F.when(F.bool_or(cond), F.lit(True)).when(F.count_if(cond.isNull()) > 0, unknown()).otherwise(F.lit(False))


def forall3(cond: Column) -> Column:
    """Aggregate: FALSE if ``cond`` fails in a row of the group, NULL if it is unknown in one, else TRUE."""
    return F.when(~F.bool_and(cond), F.lit(False)).when(F.count_if(cond.isNull()) > 0, unknown()).otherwise(F.lit(True))


def quantify(df: DataFrame, keys: Sequence[str], any_rows: dict[str, Column] | None = None,
             all_rows: dict[str, Column] | None = None) -> DataFrame:
    """One row per key with each named quantifier, all from one partial + final aggregate."""
    return df.groupBy(*keys).agg(*[exists3(c).alias(n) for n, c in (any_rows or {}).items()],
                                 *[forall3(c).alias(n) for n, c in (all_rows or {}).items()])
