"""The interval index against a plain scan of the cells."""

import random

import pytest
from pyspark.sql import functions as F

from keelson.operators import intervals
from keelson.operators.intervals import CellIndex, edges_of, position

CELLS = "k string, lo double, hi double, `from` int, `to` int, value double, priority int"


def test_position_is_a_binary_search(spark):
    edges = [0.0, 0.5, 0.6, 2.0]
    values = [None, -1.0, 0.0, 0.25, 0.5, 0.55, 0.6, 1.0, 2.0, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    got = [(r.c, r.o) for r in df.select(position(F.col("v"), edges, True).alias("c"), position(F.col("v"), edges, False).alias("o")).collect()]
    assert [x for x, _ in got] == [None, -1, 0, 1, 2, 3, 4, 5, 6, 7]
    assert [y for _, y in got] == [None, -1, 0, 0, 1, 1, 2, 2, 3, 3]


def test_lookup_equals_a_scan_of_the_cells(spark):
    rng = random.Random(3)
    cells = []
    for p in range(60):
        lo, hi = sorted(rng.choices([x / 10 for x in range(12)], k=2))
        a, b = sorted(rng.choices(range(600, 640), k=2))
        cells.append((rng.choice("ab"), lo, hi, a, b, float(p), rng.choice([p, 100 - p])))
    points = [(rng.choice("abc"), rng.choice([None, *[x / 20 for x in range(-1, 26)]]), rng.choice([None, *range(598, 643)])) for _ in range(800)]
    index = CellIndex(spark.createDataFrame(cells, CELLS), ["k"])
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, q string, x0 double, y0 int")
    got = {r.i: r.found for r in index.lookup(df, [F.col("q")], F.col("x0"), F.col("y0"), "found").collect()}

    def scan(k, x, y):
        hits = [(c[6], c[5]) for c in cells if None not in (x, y) and c[0] == k and c[1] <= x <= c[2] and c[3] <= y <= c[4]]
        return min(hits)[1] if hits else None
    assert got == {i: scan(*p) for i, p in enumerate(points)}


def test_faults_of_a_sound_grid_and_of_damaged_ones(spark):
    sound = [("a", lo, lo + 0.5, s, s + 9, 9 - lo - s / 10, i) for i, (lo, s) in enumerate((lo, s) for lo in (0.0, 0.5) for s in (0, 10, 20))]
    kinds = lambda rows: sorted((r.kind, r.x, r.y) for r in CellIndex(spark.createDataFrame(rows, CELLS), ["k"]).faults().collect())
    assert kinds(sound) == []
    assert kinds([r for r in sound if r[1:4:2] != (0.0, 10)]) == [("GAP", 0, 1), ("GAP", 1, 1)]
    assert ("OVERLAP", 1, 1) in kinds([*sound, ("a", 0.0, 0.5, 10, 19, 0.0, 50)])
    assert kinds([(*r[:5], 50.0, r[6]) if r[1] == 0.5 and r[3] == 20 else r for r in sound]) == [("ORDER", 3, 2), ("ORDER", 4, 2)]


def test_too_many_edges_are_refused(spark, monkeypatch):
    monkeypatch.setattr(intervals, "MAX_EDGES", 5)
    df = spark.range(9).select(F.col("id").cast("double").alias("lo"))
    with pytest.raises(ValueError, match="more than 5 edges"):
        edges_of(df, [F.col("lo")])
