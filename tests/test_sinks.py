"""Partition replacement: staged, checked, published; idempotent."""

import pytest

from keelson.sources.sinks import SinkError, replace_partitions, table_schema


def rows(spark, path):
    return sorted((tuple(r) for r in spark.read.parquet(path).select("k", "v", "p").collect()), key=repr)


def test_replaces_only_its_partitions_and_may_run_again(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, "d", None)], "k int, v string, p string")
    done = {r.p: r["rows"] for r in replace_partitions(first, path, ["p"], rows=4).collect()}
    assert done == {"x": 2, "y": 1, None: 1}
    batch = spark.createDataFrame([(9, "n", "x"), (8, None, None), (7, "new", "z")], "k int, v string, p string")
    for _ in range(2):
        replace_partitions(batch, path, ["p"])
        assert rows(spark, path) == sorted([(9, "n", "x"), (3, "c", "y"), (8, None, None), (7, "new", "z")], key=repr)
    replace_partitions(batch.limit(0), path, ["p"], rows=0)
    assert len(rows(spark, path)) == 4


def test_empty_text_and_null_are_one_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a", ""), (2, "b", None)], "k int, v string, p string")
    assert [tuple(r) for r in replace_partitions(df, path, ["p"]).collect()] == [(None, 2)]


@pytest.mark.parametrize("schema, data, expected", [
    ("k long, v string, p string", [(1, "a", "x")], None), ("k int, w string, p string", [(1, "a", "x")], None),
    ("k int, v string, p string", [(1, "a", "x")], 2)])
def test_a_wrong_batch_changes_nothing(spark, tmp_path, schema, data, expected):
    path = str(tmp_path / "t")
    replace_partitions(spark.createDataFrame([(5, "o", "x")], "k int, v string, p string"), path, ["p"])
    with pytest.raises(SinkError):
        replace_partitions(spark.createDataFrame(data, schema), path, ["p"], rows=expected)
    assert rows(spark, path) == [(5, "o", "x")]


def test_a_batch_that_fails_while_staging_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    good = spark.createDataFrame([(5, "o", "x")], "k int, v string, p string")
    replace_partitions(good, path, ["p"])
    bad = good.selectExpr("k", "CAST(raise_error('lost') AS string) AS v", "p")
    with pytest.raises(Exception, match="lost"):
        replace_partitions(bad, path, ["p"])
    assert rows(spark, path) == [(5, "o", "x")]


def test_partition_columns_are_needed(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, p string")
    for columns in ([], ["q"], ["k", "p"]):
        with pytest.raises(SinkError):
            replace_partitions(df, str(tmp_path / "t"), columns)
    assert table_schema(df, str(tmp_path / "t")) is None
