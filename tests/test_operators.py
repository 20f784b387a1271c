"""Unit tests of the operators on tiny literal frames (NULLs, edges, ties, empty arrays)."""

import datetime as dt

from pyspark.sql import functions as F

from keelson.functions.dates import day_diff, first_known_date, minute_diff, month_diff, year_diff
from keelson.functions.numeric import is_false, is_true, round_half_up, safe_div
from keelson.operators.audit import verdict
from keelson.operators.latest import latest
from keelson.operators.membership import member_flag, not_in, semi
from keelson.operators.nested import flatten
from keelson.operators.reconcile import mismatches, reconcile
from keelson.operators.rules import any_true, battery, cascade, first_label, two_way


def test_latest_one_row_per_key_with_tiebreak(spark):
    df = spark.createDataFrame([(1, 10, "a"), (1, 10, "b"), (1, 5, "c"), (2, None, "d"), (2, 1, "e")],
                               "k int, t int, v string")
    out = latest(df, ["k"], [F.col("t").desc()], [F.col("v").desc()])
    rows = sorted((r.k, r.v) for r in out.collect())
    assert rows == [(1, "b"), (2, "e")]


def test_latest_prefilter(spark):
    df = spark.createDataFrame([(1, 10, "a"), (1, 5, "b")], "k int, t int, v string")
    out = latest(df, ["k"], [F.col("t").desc()], where=F.col("v") == "b")
    assert [r.v for r in out.collect()] == ["b"]


def test_flatten_outer_keeps_null_and_empty(spark):
    df = spark.createDataFrame([(1, [{"a": 1}, {"a": 2}]), (2, []), (3, None)], "id int, arr array<struct<a:int>>")
    outer = flatten(df, "arr", "e", outer=True, prefix="e_").orderBy("id", "e_a").collect()
    assert [(r.id, r.e_a) for r in outer] == [(1, 1), (1, 2), (2, None), (3, None)]
    inner = flatten(df, "arr", "e", outer=False, prefix="e_").collect()
    assert sorted(r.id for r in inner) == [1, 1]
    pos = flatten(df, "arr", "e", outer=False, position="p").collect()
    assert sorted(r.p for r in pos) == [0, 1]


def test_member_flag_three_valued(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    with_null = spark.createDataFrame([(1,), (None,)], "s int")
    clean = spark.createDataFrame([(1,)], "s int")
    empty = spark.createDataFrame([], "s int")
    got = {r.k: (r.f, r.g, r.h) for r in
           member_flag(member_flag(member_flag(df, "k", with_null, "s", "f"), "k", clean, "s", "g"),
                       "k", empty, "s", "h").collect()}
    # SQL: 1 IN (1,NULL)=T, 2 IN (1,NULL)=NULL, NULL IN (...)=NULL; clean list: T, F, NULL; empty: F
    assert got[1] == (True, True, False)
    assert got[2] == (None, False, False)
    assert got[None] == (None, None, False)


def test_not_in_null_semantics(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    with_null = spark.createDataFrame([(1,), (None,)], "s int")
    clean = spark.createDataFrame([(1,)], "s int")
    empty = spark.createDataFrame([], "s int")
    assert not_in(df, "k", with_null, "s").count() == 0
    assert [r.k for r in not_in(df, "k", clean, "s").collect()] == [2]
    assert not_in(df, "k", empty, "s").count() == 3


def test_semi_join(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    ids = spark.createDataFrame([(1,), (3,), (3,)], "id int")
    assert sorted(r.id for r in semi(df, ids, "id").collect()) == [1, 3]


def test_cascade_first_true_wins_null_does_not_fire(spark):
    df = spark.createDataFrame([(None, 5), (1, 5), (1, 0), (0, 0)], "a int, b int")
    expr = cascade([("A", F.col("a") > 0), ("B", F.col("b") > 0)], "PASS")
    assert [r.x for r in df.select(expr.alias("x")).collect()] == ["B", "A", "A", "PASS"]


def test_battery_yesno_and_any_true(spark):
    df = spark.createDataFrame([(None,), (1,), (0,)], "a int")
    out = battery(df, [("r", F.col("a") > 0)], style="yesno")
    assert [r.r for r in out.collect()] == ["NO", "YES", "NO"]
    out = df.select(any_true([F.col("a") > 0, F.col("a") < 0]).alias("x"))
    assert [r.x for r in out.collect()] == [False, True, False]


def test_two_way_and_verdict(spark):
    # fires, went through, ended declined, reason named: neither through nor declined gives no label
    df = spark.createDataFrame([(True, True, False, False), (False, False, True, True), (True, False, True, True),
                                (False, False, False, True), (False, False, True, False)],
                               "fires boolean, approved boolean, declined boolean, reason boolean").coalesce(1)
    lab = first_label(two_way("X", F.col("fires"), ~F.col("fires"), F.col("approved"), F.col("declined"), F.col("reason")))
    rows = [r.l for r in df.select(lab.alias("l")).collect()]
    assert rows == ["X1", "X2", "PASS", "PASS", "PASS"]
    df = df.limit(3)
    v = df.select(verdict([lab, F.lit("PASS")]).alias("v")).collect()
    assert [r.v for r in v] == ["should have been declined", "should not have been declined", "correct"]


def test_reconcile_and_rounding(spark):
    df = spark.createDataFrame([(0.285, 0.29), (1.005, 1.0), (None, 1.0), (2.0, 2.0)], "a double, b double")
    out = df.select(reconcile(F.col("a"), F.col("b"), 2).alias("m"), round_half_up(F.col("a"), 2).alias("r"))
    assert [(r.m, r.r) for r in out.collect()] == [("Match", 0.29), ("Unmatch", 1.01), ("Unavailable", None),
                                                   ("Match", 2.0)]
    mm = mismatches(df.select(reconcile(F.col("a"), F.col("b"), 2).alias("m")), ["m"])
    assert mm.count() == 1


def test_safe_div_and_is_true(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (1.0, 4.0)], "a double, b double")
    assert [r.x for r in df.select(safe_div("a", "b").alias("x")).collect()] == [None, None, 0.25]
    out = df.select(is_true(F.col("b") > 0).alias("t"), is_false(F.col("b") > 0).alias("f")).collect()
    assert [(r.t, r.f) for r in out] == [(False, True), (False, False), (True, False)]


def test_date_boundaries(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 31), dt.date(2020, 2, 1), dt.datetime(2020, 1, 1, 0, 0),
                                 dt.datetime(2020, 1, 1, 0, 2, 59))], "a date, b date, s timestamp, e timestamp")
    r = df.select(month_diff("b", "a").alias("m"), year_diff("b", "a").alias("y"), day_diff("b", "a").alias("d"),
                  minute_diff(F.col("e"), F.col("s")).alias("mi")).first()
    assert (r.m, r.y, r.d, r.mi) == (1, 0, 1, 2)


def test_first_known_date(spark):
    df = spark.createDataFrame([("", "bad", "2020-01-02"), (None, "2020-03-04", None)], "a string, b string, c string")
    out = [r.d for r in df.select(first_known_date("a", "b", "c").alias("d")).collect()]
    assert out == [dt.date(2020, 1, 2), dt.date(2020, 3, 4)]


def test_sinks_write_and_materialize(spark, tmp_path):
    from keelson.sources.sinks import materialize, write_result
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, g string")
    out = str(tmp_path / "result")
    write_result(df, out, partition_by=["g"])
    back = spark.read.parquet(out)
    assert sorted((r.id, r.g) for r in back.collect()) == [(1, "a"), (2, "b"), (3, "a")]
    m = materialize(df.where("id > 1"), "probe")
    assert "checkpoint" not in m.columns and sorted(r.id for r in m.collect()) == [2, 3]
    assert spark.conf.get("spark.checkpoint.dir") in m.inputFiles()[0]
