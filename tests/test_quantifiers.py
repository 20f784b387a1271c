"""Three-valued EXISTS / FOR ALL over arrays and groups, against their definitions."""

from itertools import product

from pyspark.sql import functions as F

from keelson.operators.quantifiers import all_of, any_of, quantify


def exists(values):
    return True if True in values else None if None in values else False


def forall(values):
    return False if False in values else None if None in values else True


def test_arrays(spark):
    rows = [(list(v),) for n in range(4) for v in product((True, False, None), repeat=n)] + [(None,)]
    df = spark.createDataFrame(rows, "v array<boolean>").coalesce(1)
    got = df.select("v", any_of(F.col("v"), lambda x: x).alias("some"), all_of(F.col("v"), lambda x: x).alias("every")).collect()
    assert [(r.some, r.every) for r in got] == [(exists(r.v or []), forall(r.v or [])) for r in got]


def test_groups_and_nested_rows(spark):
    cases = list(product([None, [], [True], [False], [None], [True, None], [False, None]], repeat=2))
    rows = [(k, v) for k, case in enumerate(cases) for v in case]
    df = spark.createDataFrame(rows, "k int, v array<boolean>").repartition(3)
    got = quantify(df, ["k"], any_rows={"some": any_of(F.col("v"), lambda x: x)}, all_rows={"every": all_of(F.col("v"), lambda x: x)})
    assert "partial_" in got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        flat = [x for v in cases[r.k] for x in v or []]
        assert (r.some, r.every) == (exists(flat), forall(flat))
