"""Range joins against every pair; the plan; a hot bin."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from keelson.operators.rangejoin import range_join

DAY = dt.date(2010, 1, 1)


def expected(left, right):
    known = lambda r: None not in r[1:3] and r[1] <= r[2]
    return sorted((a[0], b[0]) for a in left for b in right if known(a) and known(b) and a[1] <= b[2] and b[1] <= a[2])


def pairs(df):
    return sorted((r.i, r.j) for r in df.collect())


@pytest.mark.parametrize("width, rows_per_salt", [(1, 1000), (30, 1000), (30, 7), (100000, 5)])
def test_date_ranges_equal_every_pair(spark, width, rows_per_salt):
    rng = random.Random(width)

    def side(n):
        day = lambda hi: None if rng.random() < 0.03 else DAY + dt.timedelta(rng.randrange(-400, hi))
        rows = [(i, day(400), day(400)) for i in range(n // 3)]
        for i in range(n // 3, n):  # a third starts on one day
            a = DAY if rng.random() < 0.4 else DAY + dt.timedelta(rng.randrange(-300, 300))
            rows.append((i, a, a + dt.timedelta(rng.choice((0, 1, 29, 30, 31, 200)))))
        return rows
    left, right = side(150), side(120)
    a = spark.createDataFrame(left, "i int, a date, b date").repartition(3)
    b = spark.createDataFrame(right, "j int, c date, d date").repartition(2)
    assert pairs(range_join(a, b, ("a", "b"), ("c", "d"), width, rows_per_salt)) == expected(left, right)


def test_points_meet_bands_and_repeated_rows_each_count(spark):
    points = [(1, 619.5, 619.5), (2, 620.0, 620.0), (3, 700.0, 700.0), (3, 700.0, 700.0), (4, -0.5, -0.5), (5, None, None)]
    bands = [(10, 620.0, 700.0), (11, 700.0, 850.0), (12, -1.0, 0.0), (13, 900.0, 800.0)]
    p = spark.createDataFrame([r[:2] for r in points], "i int, score double")
    b = spark.createDataFrame(bands, "j int, lo double, hi double")
    assert pairs(range_join(p, b, ("score", "score"), ("lo", "hi"), 25)) == expected(points, bands)
    assert range_join(p.limit(0), b, ("score", "score"), ("lo", "hi"), 25).count() == 0


def test_timestamps(spark):
    rows = [(1, dt.datetime(2020, 1, 1, 23, 59, 59), dt.datetime(2020, 1, 2)), (2, dt.datetime(1969, 12, 31, 12), dt.datetime(1969, 12, 31, 13))]
    a = spark.createDataFrame(rows, "i int, a timestamp_ntz, b timestamp_ntz")
    b = spark.createDataFrame([(7, dt.datetime(2020, 1, 2), dt.datetime(2020, 1, 3)), (8, dt.datetime(1969, 12, 31, 13, 0, 1), dt.datetime(1970, 1, 1))],
                              "j int, c timestamp_ntz, d timestamp_ntz")
    assert pairs(range_join(a, b, ("a", "b"), ("c", "d"), 3600)) == [(1, 7)]


def test_names_on_both_sides_are_refused(spark):
    df = spark.range(1).select(F.col("id"), F.col("id").alias("x"))
    with pytest.raises(ValueError):
        range_join(df, df, ("id", "x"), ("id", "x"), 1)


def test_a_hot_bin_is_dealt_and_no_nested_loop_is_planned(spark):
    left = spark.range(4000).select(F.col("id").alias("i"), F.lit(5.0).alias("x"))
    right = spark.createDataFrame([(1, 0.0, 9.0), (2, 6.0, 9.0)], "j int, lo double, hi double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = range_join(left, right, ("x", "x"), ("lo", "hi"), 10, rows_per_salt=100)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert out.groupBy("j").count().collect() == [(1, 4000)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


TOTALS = {"n": ("count", "task"), "least": ("min", "task"), "last": ("max", "at")}


@pytest.mark.parametrize("points_per_cell, rows_per_salt", [(3, 10), (40, 7), (100000, 100000)])
def test_totals_equal_those_of_the_pairs(spark, points_per_cell, rows_per_salt):
    """Rooms and points repeat or are NULL, points crowd on one instant, ranges are empty, short, long or reversed."""
    rng = random.Random(points_per_cell)
    start = dt.datetime(2024, 1, 1)
    at = lambda: start + dt.timedelta(microseconds=rng.choice((0, 5_000_000, rng.randrange(10**10))))
    points = [(None if rng.random() < 0.1 else rng.randrange(-50, 50), None if rng.random() < 0.05 else at()) for _ in range(300)]
    ranges = []
    for i in range(200):
        a = at()
        b = a + dt.timedelta(microseconds=rng.choice((-1, 0, 1000, 10**7, 10**9, 10**10)))
        ranges.append((None if i % 17 == 0 else i // 3, None if i % 23 == 0 else a, None if i % 29 == 0 else b))
    left = spark.createDataFrame(points, "task long, at timestamp_ntz").repartition(3)
    right = spark.createDataFrame(ranges, "room int, a timestamp_ntz, b timestamp_ntz").repartition(2)
    met = {}
    for room, a, b in ranges:
        for p in points:
            if None not in (a, b, p[1]) and a <= p[1] <= b:
                met.setdefault(room, []).append(p)
    expect = {}
    for room, ps in met.items():
        tasks = [t for t, _ in ps if t is not None]
        expect[room] = (len(tasks), min(tasks, default=None), max(x for _, x in ps))
    out = range_join(left, right, ("at", "at"), ("a", "b"), 3600, rows_per_salt, ["room"], TOTALS, points_per_cell)
    assert [f.simpleString() for f in out.schema] == ["room:int", "n:bigint", "least:bigint", "last:timestamp_ntz"]
    rows = out.collect()
    assert len(rows) == len(expect) and {r.room: tuple(r)[1:] for r in rows} == expect
    none = range_join(left.limit(0), right, ("at", "at"), ("a", "b"), 3600, per=["room"], totals=TOTALS)
    assert none.count() == 0


def test_totals_list_no_pairs(spark):
    """Every range covers most points: 10 billion pairs, two searches a range."""
    n = 100_000
    left = spark.range(n).select(F.col("id").alias("task"), F.date_from_unix_date(F.col("id").cast("int") % 1000).alias("at"))
    right = spark.range(n).select(F.col("id").alias("room"), F.lit(DAY - dt.timedelta(days=20000)).alias("a"), F.lit(DAY).alias("b"))
    out = range_join(left, right, ("at", "at"), ("a", "b"), 30, per=["room"], totals=TOTALS, points_per_cell=5000)
    assert out.groupBy("n", "least", "last").count().collect() == [(n, 0, dt.date(1972, 9, 26), n)]


def test_totals_refuse_what_they_cannot_hold_exactly(spark):
    left = spark.createDataFrame([(1, 0.5)], "task long, at double")
    right = spark.createDataFrame([(1, 0.0, 1.0)], "room int, a double, b double")
    with pytest.raises(ValueError):
        range_join(left, right, ("at", "at"), ("a", "b"), 1, per=["room"], totals=TOTALS)
    with pytest.raises(ValueError):
        range_join(left, right, ("task", "at"), ("a", "b"), 1, per=["room"], totals=TOTALS)


def test_tasks_of_calls_are_counted_without_pairs(spark):
    from keelson.queries import QUERIES
    plan = QUERIES["q_range_calls"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
