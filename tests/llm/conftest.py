import os
import random

import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"
DOC_SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
              "_id bigint, _key string, `row` string, size int, kept string, _score double, ids string")


def edge_documents():
    """Nulls, empty and white texts, repeated rows, ties, copies, overlaps, a very long text."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(2, 7))) for _ in range(400)]

    def text(n):
        return " ".join(rng.choices(words, k=n))

    base, passage = text(120), text(90)
    texts = [None, "", " \t\n ", "One", "two words", base, base, base.upper(), base + " more", passage + " " + text(40),
             text(33) + "\n" + passage, text(20) + passage + text(20), passage + " " + passage, "a " * 900, "ab" * 700,
             "x" * 1500, text(30000), "Ünïcode ÄÖ ß " * 60, "!!! *** ~~~ " * 30, "0 1 2 3", "\x00\x01 zero \x00", passage]
    rows = [(100 + 3 * i, t, "en", f"s{i % 4}" if i % 5 else None, None) for i, t in enumerate(texts)]
    rows += [(None, base, None, None, 1), (None, "null id", "en", "s1", 1), rows[5], rows[5], rows[3],
             (rows[9][0], text(50), "de", "s2", 3), (-7, passage.replace("a", "b", 1), "en", "", 2)]
    return [(*r, r[0], "k", "r", 1, "no", 0.5, "i") for r in rows]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_documents(), DOC_SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture()
def duck():
    return duckdb.connect()


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def same(df, expected, *cols):
    got, want = rows(df, *cols), sorted((tuple(x) for x in expected), key=repr)
    assert len(got) == len(want)
    assert got == want


def table_dir(tmp_path, **frames):
    """A data folder holding ``frames`` as <name>.parquet."""
    for name, df in frames.items():
        df.coalesce(1).write.parquet(os.path.join(str(tmp_path), f"{name}.parquet"))
    return str(tmp_path)
