"""J13 — range joins without an equi key: pairs of intervals that share a point.

Both sides lie on one axis, which is cut into bins. An interval goes into every bin that it meets, a point into its
own, and bins are an ordinary join key, so the plan is an equi-join with the range as residual instead of a nested
loop. A pair that shares several bins is kept in the first of them only, where the later of both starts lies.

A bin that holds many rows of one side and many of the other would be one task. The side named first is dealt
over salts, as many as its rows in that bin ask for; the other side is copied to each salt of its bins. Counts per
bin are one small aggregate on each run, so the salts follow the data at every size, and bins with few rows have one.

Pairs grow with the product of both sides: n times the points and n times the ranges of a period make n * n pairs. Where
only totals of a range's points are asked for (``totals``), no pair is listed. The axis is cut into cells of about
equally many points; a range meets the points of its first and last cell by binary search, and the cells between them by
their totals, held for each power of two of neighbouring cells. So a range costs two searches and a few totals, however
many points it covers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of the dealt side that share a salt.
ROWS_PER_SALT = 100_000
#: Points of a cell of ``totals``; a value that many points share stays in one cell, as one entry.
POINTS_PER_CELL = 20_000
#: Most cells of an axis: their edges travel with the tasks. Beyond them cells hold more points.
MAX_CELLS = 10_000
EPOCH = "1970-01-01 00:00:00"


def axis(value: Column, kind: str) -> Column:
    """A place on the axis as a whole number: days of dates, seconds of timestamps, numbers rounded down."""
    if kind == "date":
        return F.unix_date(value)
    if kind.startswith("timestamp"):
        return F.unix_seconds(value.cast("timestamp"))
    return F.floor(value).cast("long")


def range_join(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], width: int,
               rows_per_salt: int = ROWS_PER_SALT, per: Sequence[str] | None = None,
               totals: dict[str, tuple[str, str]] | None = None, points_per_cell: int = POINTS_PER_CELL) -> DataFrame:
    """Pairs of ``left`` and ``right`` rows whose closed ranges (first, last column) share a point, as columns of
    both sides; a point is a range of one column twice. ``width`` is the width of a bin in days of dates, seconds of
    timestamps or units of numbers: near the usual length of a range. Rows with a NULL or
    non-finite end, or whose first end is after the last, meet nothing; column names of both sides must differ.

    With ``totals``, a name to (count, min or max; column of ``left``), ``left`` holds points and the pairs are grouped
    by the columns ``per`` of ``right``: one row per group that has a pair, without listing pairs; cells follow the points then, not ``width``."""
    if both := set(left.columns) & set(right.columns):
        raise ValueError(f"columns on both sides: {sorted(both)}")
    if totals is not None:
        return _totals(left, right, left_range, right_range, list(per or ()), totals, rows_per_salt, points_per_cell)
    kind = left.schema[left_range[0]].dataType.simpleString()

    def binned(df: DataFrame, ends: tuple[str, str], row: str, start: str) -> DataFrame:
        a, b = F.col(ends[0]), F.col(ends[1])
        first, last = F.floor(axis(a, kind) / width), F.floor(axis(b, kind) / width)
        known = a <= b
        if kind in ("double", "float"):  # NaN is the greatest number of all
            known = known & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
        return (df.where(known).select(F.struct(*[F.col(f"`{x}`") for x in df.columns]).alias(row), first.alias(start),
                                        F.explode(F.sequence(first, last)).alias("_bin")))

    dealt, copied = binned(left, left_range, "_l", "_l_first"), binned(right, right_range, "_r", "_r_first")
    salts = (dealt.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
             .select("_bin", F.ceil(F.col("_n") / rows_per_salt).alias("_salts")))
    dealt = dealt.join(salts, "_bin").withColumn("_salt", F.pmod(F.xxhash64("_l"), F.col("_salts")))
    copied = copied.join(salts, "_bin").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)))
    pairs = dealt.drop("_salts").join(copied.drop("_salts"), ["_bin", "_salt"])
    l0, l1, r0, r1 = (F.col(f"{side}.`{x}`") for side, ends in (("_l", left_range), ("_r", right_range)) for x in ends)
    return (pairs.where((F.col("_bin") == F.greatest("_l_first", "_r_first")) & (l0 <= r1) & (r0 <= l1))
            .select("_l.*", "_r.*"))


def _whole(value: Column, of: T.DataType) -> Column:
    """``value`` as a whole number of the same order; refused where none is exact."""
    if isinstance(of, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(of, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), value)
    if isinstance(of, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(of, T.IntegralType):
        return value.cast("long")
    raise ValueError(f"no totals over {of.simpleString()}")


def _back(value: Column, of: T.DataType) -> Column:
    """Inverse of :func:`_whole`."""
    if isinstance(of, T.DateType):
        return F.date_from_unix_date(value.cast("int"))
    if isinstance(of, T.TimestampNTZType):
        return F.timestamp_add("MICROSECOND", value, F.lit(EPOCH).cast("timestamp_ntz"))
    if isinstance(of, T.TimestampType):
        return F.timestamp_micros(value)
    return value.cast(of)


def _edges(points: DataFrame, points_per_cell: int) -> np.ndarray:
    """Values that cut the points into cells of about equally many; cell i is from edge i - 1 up to before edge i."""
    cells = min(-(-points.count() // points_per_cell), MAX_CELLS)
    if cells < 2:
        return np.array([], dtype="int64")
    cut = points.agg(F.percentile_approx("_at", [i / cells for i in range(1, cells)], 10 * MAX_CELLS)).first()[0]
    return np.unique(np.array(cut, dtype="int64"))


def _totals(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], per: list[str],
            totals: dict[str, tuple[str, str]], rows_per_salt: int, points_per_cell: int) -> DataFrame:
    if left_range[0] != left_range[1]:
        raise ValueError("totals are of points: name one column twice")
    if unknown := {how for how, _ in totals.values()} - {"count", "min", "max"}:
        raise ValueError(f"no such totals: {sorted(unknown)}")
    fields = left.schema
    axis_type = fields[left_range[0]].dataType
    if any(right.schema[x].dataType != axis_type for x in right_range):
        raise ValueError("points and ranges must be of one type")
    hows = [how for how, _ in totals.values()]
    each = [f"_t{i}" for i in range(len(hows))]
    merge = lambda: [getattr(F, "sum" if how == "count" else how)(t).alias(t) for how, t in zip(hows, each)]

    # NULLs of a column take no part in its total, yet their points are met
    points = left.select(_whole(F.col(left_range[0]), axis_type).alias("_at"),
                         *[(F.col(x).isNotNull().cast("long") if how == "count" else _whole(F.col(x), fields[x].dataType)).alias(t)
                           for t, (how, x) in zip(each, totals.values())]).where("_at is not null")
    edges = _edges(points, points_per_cell)

    @F.pandas_udf("long")
    def cell(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, at.to_numpy(), side="right"))

    points = points.groupBy("_at").agg(*merge()).withColumn("_cell", cell("_at"))
    a, b = (F.col(x) for x in right_range)
    keys = [f"_k{i}" for i in range(len(per))]
    ranges = (right.where(a <= b).select(_whole(a, axis_type).alias("_a"), _whole(b, axis_type).alias("_b"),
                                         *[F.col(f"`{x}`").alias(k) for x, k in zip(per, keys)])
              .withColumns({"_first": cell("_a"), "_last": cell("_b")}))

    # first and last cell: points met by binary search; many ranges of one cell are dealt over salts
    ends = ranges.select("_a", "_b", *keys, F.explode(F.array_distinct(F.array("_first", "_last"))).alias("_cell"))
    salts = (ends.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / rows_per_salt).alias("_salts")))
    ends = ends.join(salts, "_cell").withColumn("_salt", F.pmod(F.xxhash64("_a", "_b", *keys), F.col("_salts"))).drop("_salts")
    copied = (points.join(salts, "_cell").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)))
              .drop("_salts"))
    out_schema = T.StructType([*[T.StructField(k, right.schema[x].dataType) for k, x in zip(keys, per)],
                               *[T.StructField(t, T.LongType()) for t in each]])

    def least_of(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of ``values[lo:hi]`` for each pair of bounds (lo < hi), by minima over powers of two."""
        rows = [values]
        while 2 ** len(rows) <= len(values):
            half = 2 ** (len(rows) - 1)
            rows.append(np.minimum(rows[-1][:-half], rows[-1][half:]))
        out, level = np.empty(len(lo), dtype="int64"), np.frexp(hi - lo)[1] - 1
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(rows[k][lo[at]], rows[k][hi[at] - 2 ** int(k)])
        return out

    def search(points: pa.Table, ranges: pa.Table) -> pa.Table:
        points = points.sort_by("_at")
        at = points["_at"].to_numpy()
        lo = np.searchsorted(at, ranges["_a"].to_numpy(), side="left")
        hi = np.searchsorted(at, ranges["_b"].to_numpy(), side="right")
        met = np.flatnonzero(lo < hi)
        lo, hi, columns = lo[met], hi[met], [ranges[k].take(pa.array(met)) for k in keys]
        for how, t in zip(hows, each):
            known = points[t].is_valid().to_numpy()
            values = points[t].fill_null(0).to_numpy()
            sums = np.concatenate([[0], np.cumsum(values if how == "count" else known, dtype="int64")])
            found = sums[hi] - sums[lo]
            if how == "count":
                columns.append(pa.array(found))
                continue
            sign = 1 if how == "min" else -1  # ~x reverses the order of whole numbers without overflow
            ordered = np.where(known, values if sign == 1 else ~values, np.iinfo("int64").max)
            least = least_of(ordered, lo, hi) if len(lo) else lo
            columns.append(pa.array(least if sign == 1 else ~least, mask=found == 0))
        return pa.table(columns, names=[*keys, *each])

    parts = copied.groupBy("_cell", "_salt").cogroup(ends.groupBy("_cell", "_salt")).applyInArrow(search, out_schema)

    # cells between: totals of blocks of 2 ** _level cells
    levels = max(len(edges), 1).bit_length()
    blocks = (points.groupBy("_cell").agg(*merge())
              .withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
              .groupBy("_level", F.expr("shiftright(_cell, _level)").alias("_block")).agg(*merge()))
    inner = (ranges.where("_last - _first > 1")
             .select(*keys, (F.col("_first") + 1).alias("_from"), F.col("_last").alias("_to"))
             .withColumn("_level", F.explode(F.expr(f"sequence(0, {levels})")))
             .withColumns({"_from": F.expr("shiftright(_from + shiftleft(1L, _level) - 1, _level)"), "_to": F.expr("shiftright(_to, _level)")})
             .where("_from < _to")
             .withColumn("_block", F.explode(F.array_compact(F.array(F.expr("if(_from % 2 = 1, _from, null)"),
                                                                     F.expr("if(_to % 2 = 1, _to - 1, null)"))))))
    whole = inner.join(blocks, ["_level", "_block"]).select(*keys, *each)
    found = parts.unionByName(whole).groupBy(*keys).agg(*merge())
    return found.select(*[F.col(k).alias(x) for k, x in zip(keys, per)],
                        *[(F.col(t) if how == "count" else _back(F.col(t), fields[x].dataType)).alias(name)
                          for t, (name, (how, x)) in zip(each, totals.items())])
