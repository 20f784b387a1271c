"""J13, B40 — an interval index over a table of cells.

A cell covers a closed interval on one axis and a band of whole numbers on another, for a key. The
edges of all cells cut an axis into elementary positions; a value's position is found by a binary search
over the edges, written as a Column, and a cell becomes one row per position it covers. Where cells share a
position the least priority wins. A lookup is then an equi-join on key and positions, whatever the bands
look like, and gaps, overlaps and order of a grid are read off the positions in one sweep.

Position of ``v`` among closed edges e0 < e1 < ...: 2i on edge i, 2i + 1 between edges i and i + 1, -1 before
the first. Whole-number bands [lo, hi] are half-open [lo, hi + 1): position i from edge i to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .policy import broadcast_bounded

#: Edges of an axis: they become a search tree in the plan.
MAX_EDGES = 256


def edges_of(cells: DataFrame, columns: Sequence[Column]) -> list:
    """Distinct edges, ascending; a grid with more than ``MAX_EDGES`` is refused, not cut."""
    each = cells.select(F.explode(F.array(*columns)).alias("e")).where("e IS NOT NULL").distinct()
    found = [r[0] for r in each.limit(MAX_EDGES + 1).collect()]
    if len(found) > MAX_EDGES:
        raise ValueError(f"an axis of the grid has more than {MAX_EDGES} edges")
    return sorted(found)


def position(value: Column, edges: Sequence, closed: bool) -> Column:
    """Elementary position of ``value`` by binary search (NULL for NULL)."""
    def search(lo: int, hi: int) -> Column:  # the answer is known to lie from edge lo - 1 (exclusive) to edge hi (exclusive)
        if lo == hi:
            return F.lit(2 * lo - 1 if closed else lo - 1)
        mid = (lo + hi) // 2
        out = F.when(value < F.lit(edges[mid]), search(lo, mid))
        if closed:
            out = out.when(value == F.lit(edges[mid]), F.lit(2 * mid))
        return out.otherwise(search(mid + 1, hi))
    return F.when(value.isNotNull(), search(0, len(edges)))


class CellIndex:
    """Cells as a DataFrame: key columns, ``lo``/``hi`` (closed), ``from``/``to`` (whole numbers, inclusive),
    ``value`` and ``priority`` (least wins)."""

    def __init__(self, cells: DataFrame, keys: Sequence[str]):
        self.keys = list(keys)
        self.x = edges_of(cells, [F.col("lo"), F.col("hi")])
        self.y = edges_of(cells, [F.col("from").cast("long"), F.col("to").cast("long") + 1])
        at_x, at_y = (lambda v: position(v, self.x, True)), (lambda v: position(v, self.y, False))
        self.covered = (cells.withColumn("x", F.explode(F.sequence(at_x(F.col("lo")), at_x(F.col("hi")))))
                        .withColumn("y", F.explode(F.sequence(at_y(F.col("from").cast("long")), at_y(F.col("to").cast("long") + 1) - 1))))
        self.cells = self.covered.groupBy(*self.keys, "x", "y").agg(
            F.min(F.struct("priority", "value")).alias("_best"), F.count_distinct("value").alias("_values")) \
            .select(*self.keys, "x", "y", F.col("_best.value").alias("value"), "_values")

    def lookup(self, df: DataFrame, keys: Sequence[Column], x: Column, y: Column, name: str) -> DataFrame:
        """``df`` with the value of the cell that holds each row (NULL where none does)."""
        index = broadcast_bounded(self.cells.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)],
                                                    F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("value").alias(name)))
        own = df.withColumns({"_px": position(x, self.x, True), "_py": position(y, self.y, False)})
        on = (F.col("_px") == F.col("_x")) & (F.col("_py") == F.col("_y"))
        for i, k in enumerate(keys):
            on = on & (k == F.col(f"_k{i}"))
        return own.join(index, on, "left").drop("_px", "_py", "_x", "_y", *[f"_k{i}" for i in range(len(self.keys))])

    def faults(self) -> DataFrame:
        """One row per fault: keys, kind, x, y. OVERLAP: cells of different values share more than an edge; GAP: a
        position that no cell holds, though one before and one after it on both axes is held; ORDER: the value
        rises with the second axis."""
        open_part = F.col("x") % 2 == 1
        overlaps = self.cells.where(open_part & (F.col("_values") > 1)).select(*self.keys, F.lit("OVERLAP").alias("kind"), "x", "y")
        row = Window.partitionBy(*self.keys, "x").orderBy("y")
        ahead = self.cells.withColumns({"_y": F.lead("y").over(row), "_v": F.lead("value").over(row)})
        gaps = ahead.where(F.col("_y") > F.col("y") + 1).select(
            *self.keys, F.lit("GAP").alias("kind"), "x", F.explode(F.sequence(F.col("y") + 1, F.col("_y") - 1)).alias("y"))
        column = Window.partitionBy(*self.keys, "y").orderBy("x")
        beside = self.cells.withColumn("_x", F.lead("x").over(column)).where(F.col("_x") > F.col("x") + 1)
        more = beside.withColumn("_m", F.explode(F.sequence(F.col("x") + 1, F.col("_x") - 1))).select(
            *self.keys, F.lit("GAP").alias("kind"), F.col("_m").alias("x"), "y")
        order = ahead.where(F.col("_v") > F.col("value")).select(*self.keys, F.lit("ORDER").alias("kind"), "x", F.col("_y").alias("y"))
        return overlaps.unionByName(gaps).unionByName(more).unionByName(order).distinct()
