"""As-of joins against a scan of the versions; dated policy tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from keelson.operators.asof import asof_join, in_force
from keelson.plans import heloc as H
from keelson.sources import policy_tables as T

DAY = dt.date(2000, 1, 1)


def test_asof_join_equals_a_scan_of_the_versions(spark):
    rng = random.Random(6)
    day = lambda: None if rng.random() < 0.03 else DAY + dt.timedelta(rng.randrange(900))
    key = lambda: None if rng.random() < 0.03 else "hot" if rng.random() < 0.4 else rng.choice("abcdef")
    facts = [(i, key(), day(), "f") for i in range(700)]
    versions = [(key(), day(), rng.randrange(50), rng.choice("xyz")) for _ in range(120)]
    f = spark.createDataFrame(facts, "i int, k string, d date, _row string").repartition(5)
    v = spark.createDataFrame(versions, "k string, since date, n int, name string").repartition(3)
    got = {r.i: (r.n, r.name) for r in asof_join(f, v, ["k"], "d", "since", ["n", "name"]).collect()}

    def scan(k, d):
        hits = [(s, n, x) for kk, s, n, x in versions if None not in (k, d, kk, s) and kk == k and s <= d]
        return max(hits)[1:] if hits else (None, None)
    assert got == {i: scan(k, d) for i, k, d, _ in facts}


def test_asof_join_of_empty_sides(spark):
    f = spark.createDataFrame([(1, "a", DAY)], "i int, k string, d date")
    v = spark.createDataFrame([], "k string, since date, n int")
    assert [tuple(r) for r in asof_join(f, v, ["k"], "d", "since", ["n"]).collect()] == [(1, "a", DAY, None)]
    assert asof_join(f.limit(0), v, ["k"], "d", "since", ["n"]).count() == 0


def test_policy_in_force(spark):
    rows = [(DAY, 0.0, 5.0, 1.0), (DAY, 5.0, 9.0, 2.0), (dt.date(2001, 1, 1), 0.0, 9.0, 3.0)]
    table = spark.createDataFrame(rows, "valid_from date, lo double, hi double, v double")
    cases = [(dt.date(1999, 12, 31), 1.0, None), (DAY, 1.0, 1.0), (DAY, 5.0, 2.0), (DAY, 9.0, None), (dt.date(2000, 12, 31), 8.0, 2.0),
             (dt.date(2001, 1, 1), 8.0, 3.0), (None, 1.0, None), (DAY, None, None)]
    df = spark.createDataFrame([c[:2] for c in cases], "d date, s double").coalesce(1)
    assert [r.x for r in in_force(df, table, F.col("d"), "v", "x", band=F.col("s")).collect()] == [c[2] for c in cases]


def test_policies_are_read_from_parquet_with_their_dates(spark, tmp_path):
    sf, folder = "/root/testdata/sf0.001", str(tmp_path / "policy")
    T.write_policies(spark, folder)
    cols = ["id", "score_floor", "max_loan", "cltv_limit", "dti_limit"]
    own = sorted(map(repr, H.ratio_checks(spark, sf).select(*cols).collect()))
    assert own == sorted(map(repr, H.ratio_checks(spark, sf, folder).select(*cols).collect()))
    later = spark.createDataFrame([(dt.date(1998, 1, 1), 0.0, 1000.0, 0.11)], T.SCHEMAS["dti_limit"])
    later.write.mode("append").parquet(f"{folder}/dti_limit.parquet")
    dated = H.ratio_checks(spark, sf, folder).where("fico >= 620 and fico < 740").groupBy("dti_limit").agg(
        F.min("eff_date").alias("a"), F.max("eff_date").alias("b")).collect()
    spans = {r.dti_limit: (r.a, r.b) for r in dated}
    assert spans[0.43][1] < dt.date(1998, 1, 1) <= spans[0.11][0] and spans[0.11][1] < dt.date(1999, 1, 1)


def test_gaps_of_a_policy_have_no_value(spark):
    df = spark.createDataFrame([("x",)], "g string")
    table = spark.createDataFrame([(DAY, "y", 1.0)], "valid_from date, state_group string, floor double")
    out = in_force(df, table, F.lit(dt.date(2005, 1, 1)), "floor", "f", keys={"state_group": F.col("g")})
    assert out.first().f is None


@pytest.mark.parametrize("name", sorted(T.SCHEMAS))
def test_versions_list_each_band_once(name):
    rows = T.rows(name)
    keys = [r[:-1] for r in rows]
    assert len(keys) == len(set(keys))
