"""Operators with a DuckDB twin, on given, edge and empty tables; classifier and pipeline."""

import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from keelson.llm import chat_format, mixing, quality, queries, topk, url_filter
from tests.llm import brute
from tests.llm.conftest import SMALL, plain, table_dir
from tools.check_oracle import compare

NAN, INF = float("nan"), float("inf")
CONV = "conv_id bigint, turn bigint, role string, text string, _pair string, _k int"
PAGE = "page_id bigint, url string, html string, host string, weight int"
VEC = "vec_id bigint, embedding array<float>, label int, score string, _v string"


def conversations(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (0, 1, "assistant", "a"), (1, 0, "user", "hi"), (1, 1, "assistant", "b"),
            (2, None, "user", None), (2, 5, None, "x"), (3, 0, "user", "only"), (4, 0, "assistant", ""), (5, 0, "assistant", "é😀"),
            (5, 0, "user", "tie"), (None, 0, "user", "lost"), (7, 0, "system", "s"), (7, 1, "assistant", "1"), (7, 2, "assistant", "2"),
            (7, 3, "user", "u"), (6, 9, "assistant", "long " * 5000)]
    return spark.createDataFrame([(*r, "p", 1) for r in rows], CONV)


def pages(spark):
    urls = [None, "", "no scheme casino", "http://A.Example.COM/en/x", "http://example.com/en/", "https://www.example.com/en/adult",
            "https://www.example.com/de", "http://x.net/es/1", "http://x.net/fr/", "http://net/es/", "http://notnet/es/", "http://com",
            "http://com/", "http://a.com:80/x", "http://a.org/free-bets", "http://a.org/free/free", "http://a.org/freebets",
            "http://a.org/SEX?x#y", "http://a.org/essex", "http://a.org/?win=1#bonus", "://", "http://", "a://b://c.com/d", "http://a.org/ésex",
            "http://a.org/sex\n/x", "http://a.org/" + "z" * 20000 + "-porn", "http://evilexample.com/en/", "http://a.org/spam_farm"]
    return spark.createDataFrame([(i, u, None, "h", 1) for i, u in enumerate(urls + urls[3:5])] + [(None, "http://q.org/xxx", "", "h", 1)], PAGE)


def vectors(spark):
    rows = [(0, [0.5, -0.25, 1.0]), (50, [0.5, -0.25, 1.0]), (100, [0.0, 0.0, 0.0]), (150, [-1.5, 0.01, 0.3]), (200, None), (250, []),
            (300, [1.0, None, 2.0]), (350, [NAN, 0.0, 1.0]), (400, [INF, 0.0, 1.0]), (450, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(i, [((i * 37) % 101) / 50 - 1, ((i * 61) % 97) / 48 - 1, ((i * 17) % 89) / 44 - 1]) for i in range(1, 40)]
    rows += [(41, [0.5, 0.5, 0.5])] * 3 + [(0, [0.5, -0.25, 1.0])]
    return spark.createDataFrame([(i, v, 0, "s", "v") for i, v in rows], VEC)


def twin(spark, duck, folder, name):
    for t in os.listdir(folder):
        duck.execute(f"CREATE OR REPLACE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{t}/*.parquet')"
                     if os.path.isdir(f"{folder}/{t}") else
                     f"CREATE OR REPLACE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{t}')")
    ok, message, _, types = compare(spark, duck, folder, queries.QUERIES[name], queries.ORACLE[name])
    assert ok, message
    assert not types, types


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_twin_on_given_tables(spark, duck, name):
    twin(spark, duck, SMALL, name)


CASES = {"op1_preference_format": ("conversations", conversations), "op9_url_filter": ("pages", pages),
         "op10_exact_topk": ("embeddings", vectors)}


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize("name", sorted(CASES))
def test_twin_on_edge_and_empty_tables(spark, duck, tmp_path, name, empty):
    table, make = CASES[name]
    df = make(spark)
    twin(spark, duck, table_dir(tmp_path, **{table: df.limit(0) if empty else df}), name)


@pytest.mark.parametrize("frame", ["edge", "nothing"])
@pytest.mark.parametrize("name", ["op7_mix_sources", "op8_exact_dedup"])
def test_documents_twin(spark, duck, tmp_path, request, name, frame):
    df = request.getfixturevalue(frame).select("doc_id", "text", "source")
    if name == "op8_exact_dedup":
        df = df.where("doc_id is not null")  # the twin's equality has no null identifiers
    twin(spark, duck, table_dir(tmp_path, documents=df), name)


def test_mix_comes_near_its_targets(spark):
    out = mixing.op7_mix_sources(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source")
    for r in out.join(docs, "doc_id").groupBy("source").agg(
            F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"),
            F.max(F.col("taken") / F.greatest("size", F.lit(1))).alias("times")).collect():
        assert abs(r.taken - r.target) <= 3 * r.most and r.times <= 3


def test_targets_stop_at_the_cap_and_share_the_rest(spark):
    rows = [(f"s{i}", "", 0, size) for i, size in enumerate([1, 10, 100, 1000, 10000])]
    df = spark.createDataFrame([(a, 0, size) for a, _, _, size in rows], "_source string, _no_source int, size long")
    got = {r._source: r.target for r in mixing.targets(df).collect()}
    want = {f"s{i}": 0.0 for i in range(5)}
    weight = dict(zip(sorted(want), [5, 2, 1, 5, 2]))
    caps = {f"s{i}": 3.0 * 10 ** i for i in range(5)}
    open_, rest = set(want), 11111.0
    while True:  # the excess is shared again by weight until none is above
        level = rest / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > caps[s]}
        if not above:
            break
        for s in above:
            want[s] = caps[s]
            rest -= caps[s]
        open_ -= above
    for s in open_:
        want[s] = level * weight[s]
    assert got == pytest.approx(want)


def test_draw_repeats_rows_as_drawn(spark, edge):
    docs = edge.where("doc_id is not null").dropDuplicates(["doc_id"])
    out = mixing.draw(docs)
    assert out.columns == docs.columns
    want = {r["_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == want


def test_draw_counts_rows_that_share_an_identifier_by_themselves(spark):
    from collections import Counter
    rows = [(None if i % 2 else i % 7, "w " * (1 + i % 40) + str(i % 90), f"s{i % 3}" if i % 11 else None, i) for i in range(900)]
    rows += [(1, "the same text", "s0", 1000 + i) for i in range(20)] + [(None, None, "s1", 2000), (None, "", "s1", 2001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").repartition(5)
    want, target = Counter(), {}
    for r in mixing.mix(docs).collect():
        source = None if r["_no_source"] else r["_source"]
        want[r["_id"], source, r["size"]] += r["copies"]
        target[source] = r["target"]
    got, taken, times = Counter(), Counter(), Counter()
    for r in mixing.draw(docs).collect():
        size = len((r["text"] or "").split())
        got[r["doc_id"], r["source"], size] += 1
        taken[r["source"]] += size
        times[r["n"]] += 1
    assert got == +want and max(times.values()) <= 3
    assert all(abs(taken[s] - target[s]) <= 3 * 41 for s in target)


def test_mix_ranks_every_row_once_in_many_cells(spark):
    """One source, one size, null ids and hundreds of equal rows, cells of 16 rows: the copies of a
    source are what its whole line gives, and equal rows come back one by one."""
    rows = [(None, f"w{i} x", "hot") for i in range(300)] + [(7, "same text", "hot")] * 200
    rows += [(i * 64, "a b c", "even") for i in range(150)] + [(1, "", None)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = [r.asDict() for r in mixing.mix(df, cell_rows=16).collect()]
    assert len(got) == len(rows) and sum(r["_id"] == 7 for r in got) == 200
    for name in ("hot", "even"):
        mine = [r for r in got if r["_source"] == name]
        share = mine[0]["target"] / mine[0]["source_size"]
        offset = int(hashlib.md5(name.encode()).hexdigest()[:5], 16) / 1048576
        assert sum(r["copies"] for r in mine) == int(len(mine) * share + offset)
    assert sorted(map(repr, got)) == sorted(repr(r.asDict()) for r in mixing.mix(df.repartition(7), cell_rows=16).collect())


def test_topk_stops_early_and_stays_exact():
    import numpy as np
    rng = np.random.default_rng(0)
    v = np.floor(rng.normal(0, 30, (500, 16))).astype(np.int64)
    v[7] = v[3]
    v[:, 5] *= 1 << 12  # with the larger scale beyond exact floating point
    for scale in (1, 1 << 8):
        w = v * scale
        lists, own = topk.Lists(np.arange(500), w), np.arange(0, 500, 25)
        for bar in (np.iinfo(np.int64).min, None):
            bars = np.full(len(own), bar) if bar else np.sort(w @ w[own].T, axis=0)[-6]  # the 6th best, own row included
            for i, (scores, ids) in zip(own.tolist(), lists.top(own, w[own], 5, bars)):
                full = w @ w[i]
                order = [j for j in np.lexsort((np.arange(500), -full)).tolist() if j != i][:5]
                assert ids.tolist() == order and scores.tolist() == full[order].tolist()


def test_topk_reads_a_part_of_its_lists():
    """A few long rows lead everywhere: once they are met, outsiders cannot qualify."""
    import numpy as np
    rng = np.random.default_rng(1)
    v = np.abs(np.floor(rng.normal(0, 20, (2000, 12)))).astype(np.int64)
    v[:40] *= 20
    q = v[100:140] + 1
    q[:, 3] = 0  # a list no query reads
    lists = topk.Lists(np.arange(2000), v)
    found = lists.top(np.arange(100, 140), q, 5, np.full(40, np.iinfo(np.int64).min))
    for i, (scores, ids) in enumerate(found):
        full = v @ q[i]
        order = [j for j in np.lexsort((np.arange(2000), -full)).tolist() if j != 100 + i][:5]
        assert ids.tolist() == order and scores.tolist() == full[order].tolist()
    assert 0 < lists.entries <= 40 * 11 * 2000 // 4


def test_topk_in_many_cells_equals_brute_force(spark, monkeypatch):
    """Blocks of 7 rows, cells of one query block and two candidate blocks, an id that a third of the rows share."""
    import numpy as np
    monkeypatch.setattr(topk, "CELL_QUERIES", 1)
    monkeypatch.setattr(topk, "CELL_CANDIDATES", 2)
    rng = np.random.default_rng(2)
    data = [(int(i if i % 3 else 1000), [float(x) for x in rng.integers(-8, 9, 4) / 4]) for i in range(120)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    out = topk.top_k(df, df.where("vec_id % 10 = 1"), k=4, block_rows=7)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in out.collect()}
    ints = [(i, np.floor(np.array(v) * 256).astype(np.int64)) for i, v in data]
    want = {}
    for q, v in ints:
        if q % 10 == 1:
            near = sorted((-int(v @ w), i) for i, w in ints if i != q)[:4]
            want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(near)}
    assert got == want


@pytest.mark.parametrize("strict, soft, weights", [((), (), [0, 0, 0]), ([], ["win"], [0, 1, 0]), (("win",), ("win", ""), [0, 2, 0])])
def test_url_vocabularies_may_be_empty(spark, strict, soft, weights):
    df = spark.createDataFrame([(1, "http://a/xxx"), (2, "http://a/win"), (3, None)], "page_id bigint, url string")
    out = url_filter.filter_urls(df, strict=strict, soft=soft).orderBy("page_id").collect()
    assert [r.weight for r in out] == weights
    assert [r.verdict for r in out] == ["block" if w >= 2 else "allow" for w in weights]


def test_url_terms_need_boundaries():
    terms = url_filter.automaton(url_filter.STRICT, url_filter.SOFT, url_filter.THRESHOLD)
    assert url_filter.weight_of("http://a/free-free", terms) == 1
    assert url_filter.weight_of("essex", terms) == 0 and url_filter.weight_of("a-sex", terms) == 2


def test_preference_masks_cover_trained_text(spark):
    chosen, rejected = chat_format.pairs_from_conversations(conversations(spark))
    for r in chat_format.preference_format(chosen, rejected).collect():
        for text, spans in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            for s in spans:
                assert text[s.start:s.end].endswith(chat_format.CLOSE)
                assert text[:s.start].endswith(chat_format.OPEN + "assistant\n")


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = queries.QUERIES["op3_quality"](spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    assert got.count() == 10000 and got.where("score < 0 or score > 1 or score is null").isEmpty()


@pytest.mark.parametrize("frame", ["small", "edge"])
def test_quality_scores_equal_the_rules_applied_in_plain_python(spark, tmp_path, request, frame):
    docs = request.getfixturevalue(frame)
    if frame == "small":
        d = SMALL
    else:
        given = docs.where("doc_id > 0").select("doc_id").distinct().selectExpr(
            "doc_id", "CAST(doc_id % 2 AS int) AS quality", "0 AS toxic")
        d = table_dir(tmp_path, documents=docs, labels=given)
    model = quality.train(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet"))
    assert model["rules"]
    want = sorted(((i, round(brute.quality_score(t, model, quality.STATS), 9)) for i, t in plain(docs)), key=repr)
    got = queries.QUERIES["op3_quality"](spark, d).collect()
    assert sorted(((r.doc_id, round(r.score, 9)) for r in got), key=repr) == want
    for r in got:
        assert r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_quality_statistics_match_plain_counts():
    import numpy as np
    texts = [b"", b"One two two!", "ÉÉ a\nB cc*** |".encode(), b"  "]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = quality.statistics(np.frombuffer(b"".join(texts), np.uint8), off)
    at = {s: i for i, s in enumerate(quality.STATS)}
    for t, row in zip(texts, got):
        w = brute.WORD.findall(t)
        assert row[at["log_words"]] == pytest.approx(np.log1p(len(w)))
        assert row[at["bang_ends"]] == pytest.approx(sum(x.endswith(b"!") for x in w) / max(len(w), 1))
        assert row[at["distinct"]] == pytest.approx(len(set(w)) / max(len(w), 1))
        assert row[at["bare_symbols"]] == pytest.approx(sum(x in (b"|", b"*") for x in w) / max(len(w), 1))


@pytest.mark.parametrize("frame", ["edge", "nothing"])
def test_quality_without_labels_or_documents(spark, tmp_path, request, frame):
    docs = request.getfixturevalue(frame)
    labels = spark.createDataFrame([(103, None, 0), (None, 1, 0), (106, 1, 0), (109, 1, 1), (109, 0, 0)], "doc_id long, quality int, toxic int")
    d = table_dir(tmp_path, documents=docs, labels=labels)
    got = queries.QUERIES["op3_quality"](spark, d)
    assert got.count() == docs.count() and {"doc_id", "held_out", "score", "predicted"} <= set(got.columns)
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_rules_score_as_compiled(spark, small):
    model = {"bias": -0.5, "rules": [(((2, True, 4.0), (3, False, 0.5)), 1.25), (((0, True, 3.0),), -0.75)]}
    docs = small.limit(50)
    import math
    for r in quality.with_statistics(quality.boxed(docs, text=F.col("text")), "text").withColumn("s", quality.score_column(model)).collect():
        z = -0.5 + 1.25 * (r["_stat_word_length"] > 4 and r["_stat_upper"] <= 0.5) - 0.75 * (r["_stat_log_bytes"] > 3)
        assert r["s"] == pytest.approx(1 / (1 + math.exp(-z)))


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    cols = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL).cache()
        before, after = plain(docs), None
        if name != "bpe":
            assert out.columns == cols
            after = plain(out)
        if name == "quality":
            scores = {r.doc_id: r.predicted for r in queries.QUERIES["op3_quality"](spark, SMALL).collect()}
            assert sorted(i for i, _ in after) == sorted(i for i, _ in before if scores[i])
        elif name == "exact-dedup":
            assert sorted(i for i, _ in after) == sorted(i for i, k, *_ in brute.exact_dedup(before) if i == k)
        elif name == "near-dedup":
            assert sorted(i for i, _ in after) == sorted(i for i, _, c in brute.simhash(before) if i == c)
        elif name == "mix":
            copies = {r["_id"]: r["copies"] for r in mixing.mix(docs).collect()}
            assert sorted(i for i, _ in after) == sorted(i for i, _ in before for _ in range(copies[i]))
        else:
            assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, _ in before)
        docs = out
    run = E.queries()["pipeline"](spark, SMALL)
    assert run.columns == docs.columns and sorted(map(repr, run.collect())) == sorted(map(repr, docs.collect()))


@pytest.mark.parametrize("frame", ["edge", "nothing"])
def test_pipeline_survives_edge_tables(spark, tmp_path, request, frame):
    docs = request.getfixturevalue(frame)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = table_dir(tmp_path, documents=docs, labels=labels)
    import corpus_pipeline
    out = corpus_pipeline.run(spark, d)
    assert {"doc_id", "n_tokens"} <= set(out.columns)
