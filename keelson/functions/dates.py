"""Date arithmetic with boundary-counting semantics.

The audited scripts count *calendar boundaries crossed* (DATE_DIFF ... MONTH / YEAR),
which is neither ``months_between`` nor ``timestampdiff``: 31 Jan -> 1 Feb is 1 month.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import _c


def day_diff(later, earlier) -> Column:
    """Whole days later - earlier."""
    return F.datediff(_c(later), _c(earlier))


def month_diff(later, earlier) -> Column:
    """Month boundaries crossed between two dates."""
    a, b = _c(later), _c(earlier)
    return (F.year(a) - F.year(b)) * 12 + (F.month(a) - F.month(b))


def year_diff(later, earlier) -> Column:
    """Year boundaries crossed between two dates."""
    return F.year(_c(later)) - F.year(_c(earlier))


def minute_diff(later, earlier) -> Column:
    """Whole minutes between two timestamps (truncating toward zero)."""
    return F.expr("timestampdiff(MINUTE, {}, {})".format(earlier, later)) \
        if isinstance(later, str) and isinstance(earlier, str) \
        else F.timestamp_diff("MINUTE", _c(earlier), _c(later))


def first_known_date(*cols) -> Column:
    """First non-empty, parsable date among string/date columns (SAFE_CAST semantics)."""
    return F.coalesce(*[F.nullif(_c(c).cast("string"), F.lit("")).try_cast("date") for c in cols])
