"""Loan maths, policy tables and bureau normalisation."""

from pyspark.sql import functions as F

from keelson.functions import finance as FN
from keelson.operators.policy import band_join, effective_date, regime
from keelson.sources import policies as P


def test_amortised_payment_discounts_back_to_principal(spark):
    df = spark.createDataFrame([(100000.0, 0.06, 120), (5000.0, 0.0, 60), (5000.0, 0.05, 0)],
                               "p double, r double, n int")
    rows = df.select("p", "r", "n", FN.amortised_payment(F.col("p"), F.col("r"), F.col("n")).alias("pay")).collect()
    p, r, n, pay = rows[0]
    pv = sum(pay / (1 + r / 12) ** k for k in range(1, n + 1))
    assert abs(pv - p) < 1e-6
    assert rows[1].pay is None and rows[2].pay is None


def test_cltv_and_dti_guards(spark):
    df = spark.createDataFrame([(50.0, 0.0, 1000.0, 10000.0, 0), (50.0, 100.0, 1000.0, 0.0, 10)],
                               "owed double, value double, debt double, assets double, term int")
    r = df.select(FN.cltv(F.col("owed"), F.col("value")).alias("c"),
                  FN.dti(F.col("debt"), F.lit(4000.0), F.col("assets"), F.col("term")).alias("d")).collect()
    assert r[0].c is None and r[0].d == 0.25
    assert r[1].c == 0.5 and r[1].d == 0.25


def test_collateral_and_haircut(spark):
    df = spark.createDataFrame([(None, 200000.0, 10.0, 102), (150000.0, 200000.0, 15.0, 102),
                                (150000.0, 200000.0, 25.0, 102), (90000.0, 80000.0, 5.0, 112)],
                               "avm double, stated double, fsd double, land int")
    r = df.select(FN.collateral_value(F.col("avm"), F.col("stated")).alias("v")) \
          .withColumn("h", FN.collateral_haircut(F.col("v"), F.lit(0.0), F.lit(102), F.lit(P.LAND_USE_CUTOFF))).collect()
    assert [x.v for x in r] == [200000.0, 150000.0, 150000.0, 80000.0]
    half = [200000.0, 200000.0 * (1 - 15 / 200), 200000.0 * (1 - 25 / 200), 200000.0]
    strict = [200000.0, 200000.0 * (1 - 15 / 200), 200000.0 * (1 - 25 / 100), 200000.0 * (1 - 5 / 100)]
    before = P.LAND_USE_CUTOFF.replace(year=P.LAND_USE_CUTOFF.year - 1)
    for eff, want in ((before, half), (P.LAND_USE_CUTOFF, strict), (P.REGIME_DATES["r3"], half)):
        h = df.select(FN.collateral_haircut(F.lit(200000.0), F.col("fsd"), F.col("land"), F.lit(eff)).alias("h")).collect()
        assert [x.h for x in h] == want


def test_bureau_normalise_sentinel_unparsable_prefer_hard(spark):
    df = spark.createDataFrame([(1, "Soft Credit", "5", "5"), (1, "Hard Credit", "999999998", "999999998"),
                                (2, "Soft Credit", "N/A", "999999996")], "person int, credit_type string, X string, MTA5830 string")
    out = {r.person: (r.credit_type, r.X, r.MTA5830) for r in FN.bureau_normalise(df, ["X", "MTA5830"]).collect()}
    assert out == {1: ("Hard Credit", 999999998.0, 0.0), 2: ("Soft Credit", None, 0.0)}


def test_effective_date_and_regime(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.date(2000, 1, 10), dt.date(1999, 12, 1), dt.date(2000, 1, 15), "Y"),
                                (dt.date(2000, 1, 10), dt.date(1999, 12, 1), dt.date(2000, 1, 5), "Y"),
                                (dt.date(2000, 1, 10), dt.date(1999, 12, 1), dt.date(2000, 1, 15), "N")],
                               "a date, m date, r date, f string")
    eff = effective_date(F.col("a"), F.col("m"), F.col("r"), F.col("f"))
    out = [r.e for r in df.select(eff.alias("e")).collect()]
    assert out == [dt.date(1999, 12, 1), dt.date(2000, 1, 10), dt.date(2000, 1, 10)]
    b = [("r1", dt.date(2000, 1, 1)), ("r2", dt.date(2000, 1, 10))]
    out = [r.g for r in df.select(regime(F.col("a"), b).alias("g")).collect()]
    assert out == ["r2", "r2", "r2"]  # half-open: the boundary day belongs to the new regime


def test_policy_tables_gap_free_and_disjoint():
    for grp in {g for g, *_ in P.SCORE_FLOOR}:
        rows = sorted((s, e) for g, s, e, _ in P.SCORE_FLOOR if g == grp)
        assert rows[0][0] == P.MIN_DATE and rows[-1][1] == P.MAX_DATE
        assert all(a[1] == b[0] for a, b in zip(rows, rows[1:]))
    for reg in {r for r, *_ in P.CLTV_LIMITS}:
        bands = sorted((lo, hi) for r, lo, hi, _ in P.CLTV_LIMITS if r == reg)
        assert all(a[1] == b[0] for a, b in zip(bands, bands[1:]))
    keys = [(c, g) for c, g, _ in P.LIEN_AGE_LIMITS]
    assert len(keys) == len(set(keys))


def test_band_join_single_match(spark):
    df = spark.createDataFrame([("r0", 650.0), ("r2", 700.0), ("r3", 630.0)], "regime string, fico double")
    lim = spark.createDataFrame(P.CLTV_LIMITS, "l_regime string, l_lo int, l_hi int, v double")
    out = band_join(df, lim, equi=[(F.col("regime"), "l_regime")],
                    ranges=[(F.col("fico"), "l_lo", "l_hi", True, False)])
    got = sorted((r.regime, r.v) for r in out.collect())
    assert got == [("r0", 0.8), ("r2", 0.85), ("r3", None)]
