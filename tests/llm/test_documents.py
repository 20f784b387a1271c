"""Operators over documents against brute force: edge cases, given tables, empty tables."""

import pytest

from keelson.llm import bpe, exact_dedup, simhash, substring_dedup, suffix_dedup
from tests.llm import brute
from tests.llm.conftest import SMALL, plain, same, table_dir

FRAMES = ["edge", "small", "nothing"]


@pytest.fixture(params=FRAMES)
def docs(request):
    return request.getfixturevalue(request.param)


@pytest.fixture(scope="module")
def encoding():
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.codec(bpe.load(None)).ranks, special_tokens={})


def folder(tmp_path, df):
    return table_dir(tmp_path, documents=df)


def test_exact_dedup(spark, docs, tmp_path):
    out = exact_dedup.op8_exact_dedup(spark, folder(tmp_path, docs))
    same(out, brute.exact_dedup(plain(docs)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_dedup_runs_and_fan_in_do_not_matter(spark, edge):
    leaves = exact_dedup.digests(edge)
    want = sorted(map(repr, exact_dedup.merge_runs(leaves, 2, 1).collect()))
    assert want == sorted(map(repr, exact_dedup.merge_runs(leaves, 4, 3).collect()))


def test_exact_dedup_stage_keeps_one_row_of_each_text(spark, docs):
    out = exact_dedup.keep_one(docs)
    assert out.columns == docs.columns
    got = [(r["doc_id"], brute.low(r["text"])) for r in out.collect()]
    want = {(k, brute.low(t)) for (_, t), (_, k, *_) in zip(plain(docs), brute.exact_dedup(plain(docs)))}
    assert len(got) == len(want) and set(got) == want


def test_simhash(spark, docs, tmp_path):
    out = simhash.op2_simhash_dedup(spark, folder(tmp_path, docs))
    same(out, brute.simhash(plain(docs)), "doc_id", "fingerprint", "component_id")


def test_simhash_stage_keeps_the_smallest_of_each_group(spark, docs):
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    want = [i for i, _, c in brute.simhash(plain(docs)) if i == c]
    assert sorted(map(repr, [r["doc_id"] for r in out.collect()])) == sorted(map(repr, want))


def test_any_four_positions_contain_a_triple():
    from itertools import combinations
    triples = simhash.covering_triples()
    assert len(triples) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


@pytest.mark.parametrize("block", [3, 4096])
def test_simhash_links_connect_all_close_pairs_also_in_split_lists(spark, block):
    import random
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(4):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                f ^= 1 << b
            fps.add(f)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "_fp bigint")
    links = simhash.links(df, block=block).collect()
    mask = (1 << 64) - 1
    assert all(((r.a ^ r.b) & mask).bit_count() <= 4 * 40 for r in links)
    up = {f: f for f in signed}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f
    for r in links:
        up[root(r.a)] = root(r.b)
    for i, a in enumerate(signed):
        for b in signed[i + 1:]:
            if ((a ^ b) & mask).bit_count() <= 4:
                assert root(a) == root(b)


def test_substring_dedup(spark, docs, tmp_path):
    out = substring_dedup.op4_substring_dedup(spark, folder(tmp_path, docs))
    same(out, brute.substring(plain(docs)), "doc_id", "n_words", "n_removed", "kept_sha256")


def test_substring_dedup_over_many_chunks(spark, edge):
    out = substring_dedup.dedup(edge.repartition(9), chunk_bytes=500, bucket_bytes=1000)
    same(substring_dedup.digest(out), brute.substring(plain(edge)), "doc_id", "n_words", "n_removed", "kept_sha256")


def test_substring_dedup_document_tables_do_not_grow_with_the_buckets():
    import random

    import pyarrow as pa
    rng = random.Random(8)
    texts = [" ".join(f"{rng.getrandbits(30):x}" for _ in range(40)).encode() for _ in range(2000)]
    ids = rng.sample(range(1 << 40), len(texts))
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([0] * len(ids), pa.int32()),
                                        pa.array(texts, pa.binary())], ["_key", "_dup", "_text"])
    windows = 21 * len(texts)

    def sent(buckets):
        out = pa.Table.from_batches(list(substring_dedup.packed_windows([batch], buckets, 20, 8 << 20)))
        return sum(len(x) for x in out.column("_docs").to_pylist())
    assert sent(4000) < 12 * windows


@pytest.mark.parametrize("one, two, again", [(0, 0, 1), (1 << 60, 0, 0), (0, 33, 0), (1 << 60, 33, 0)])
def test_substring_dedup_compares_all_bits_of_both_hashes(monkeypatch, one, two, again):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401

    def windows(data, off, hashes, window):
        second = int(data[0]) - ord("a")  # 0 in the first chunk, 1 in the other
        return (np.array([window]), np.array([0]), np.array([5 + second * one], np.uint64),
                np.array([7 + second * two], np.uint64))
    monkeypatch.setattr(substring_dedup, "chunk_windows", windows)
    batches = [pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([0], pa.int32()), pa.array([t], pa.binary())],
                                          ["_key", "_dup", "_text"]) for i, t in enumerate([b"a", b"b"])]
    sent = pa.Table.from_batches(list(substring_dedup.packed_windows(batches, 11, 20, 1 << 20)))
    rows = sent.filter(pa.compute.equal(sent.column("_bucket"), 7))
    replies = substring_dedup.count_bucket(rows).to_pylist()
    assert sum(r["_docs"] is None for r in replies) == again


def test_suffix_dedup(spark, docs, tmp_path):
    out = suffix_dedup.op6_suffix_dedup(spark, folder(tmp_path, docs))
    same(out, brute.suffix([(i, t) for i, t in plain(docs)]), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("hot", [1, 3])
def test_suffix_dedup_with_hot_cores_over_many_chunks(spark, edge, hot):
    out = suffix_dedup.dedup(edge.repartition(6), chunk_bytes=3000, hot_chunks=hot)
    same(suffix_dedup.digest(out), brute.suffix(plain(edge)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffix_dedup_of_a_text_longer_than_its_place_bits(spark):
    import random

    import numpy as np
    rng = random.Random(9)
    length = (1 << 24) + 600_000
    passages = [rng.randbytes(500).hex() for _ in range(3)]
    long, at = rng.randbytes(length // 2).hex(), [1000, (4 << 20) - 700, length - 2000]
    for p, passage in zip(at, passages):
        long = long[:p] + passage + long[p + len(passage):]
    docs = [(1, long), (2, passages[0]), (3, "ab " + passages[1]), (4, passages[2] + " cd"), (5, rng.randbytes(900).hex())]
    out = suffix_dedup.dedup(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2))
    got = {r["doc_id"]: (r["n_bytes"], np.frombuffer(r["spans"], np.int64).reshape(-1, 2).tolist()) for r in out.collect()}
    assert got == {1: (length, [[p, p + 1000] for p in at]), 2: (1000, [[0, 1000]]), 3: (1003, [[3, 1003]]),
                   4: (1003, [[0, 1000]]), 5: (1800, [])}


def test_suffix_dedup_sends_a_hot_string_once_a_piece():
    import random
    from collections import Counter

    import numpy as np
    import pyarrow as pa
    import zstandard
    rng = random.Random(4)
    text, pieces, copies = rng.randbytes(1000), 30, 50
    data = np.frombuffer(text, np.uint8)
    _, p, near, far, _ = suffix_dedup.halves(data, np.array([0, len(data)]))
    parts = np.stack([p, near, far, np.ones(len(p), np.int64)], 1).tobytes()

    def batch(first):
        n = copies
        return pa.RecordBatch.from_arrays([pa.array(range(first, first + n), pa.int64()), pa.array([0] * n, pa.int32()),
                                           pa.array([text] * n, pa.binary()), pa.array([parts] * n, pa.binary())],
                                          ["_key", "_dup", "_text", "_parts"])
    sent = pa.Table.from_batches(list(suffix_dedup.packed_runs((batch(i * copies) for i in range(pieces)), 1 << 24)))
    load = Counter()
    for row in sent.to_pylist():
        if row["_hits"] is not None:  # others are tables that go back to their piece
            hits = row["_hits"]
            load[row["_bucket"]] += len(zstandard.decompress(hits) if hits[:4] == b"\x28\xb5\x2f\xfd" else hits)
    assert load and max(load.values()) <= pieces * 2 * suffix_dedup.HOT_RANGE * 8


@pytest.mark.parametrize("hot", [1, 64])
def test_suffix_dedup_of_hot_copies_with_variants(spark, hot):
    import random
    rng = random.Random(6)
    base, other = rng.randbytes(450).hex(), rng.randbytes(300).hex()
    texts = [base] * 40 + [base[:k] + "-" + base[k:] for k in range(5, 800, 31)] + [other[:500]]
    texts += [rng.randbytes(k).hex() + base[100 + k:100 + k + 520] for k in range(0, 60, 3)]
    texts += [other + base[:399] + other, base[300:] + base[300:], base * 3, "\0" * 900, "\0" * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    out = suffix_dedup.digest(suffix_dedup.dedup(docs, chunk_bytes=3000, hot_chunks=hot))
    same(out, brute.suffix(plain(docs)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_deep_shallow_sorts_and_gives_common_prefixes():
    import os
    import random

    import numpy as np

    from keelson.llm.suffix_sort import deep_shallow
    rng = random.Random(3)
    for _ in range(40):
        strings = [bytes(rng.choices(b"\0ab", k=rng.randint(0, 60))) for _ in range(rng.randint(1, 30))]
        strings += [b"a" * 40 + bytes(rng.choices(b"ab\0", k=rng.randint(0, 8))) for _ in range(20)]
        size = np.array([len(s) for s in strings])
        order, prefix = deep_shallow(np.frombuffer(b"".join(strings) + b"x", np.uint8), np.cumsum(size) - size, size)
        got = [strings[i] for i in order]
        assert got == sorted(strings)
        assert all(prefix[i] == len(os.path.commonprefix(got[i - 1:i + 1])) for i in range(1, len(got)))


def test_bpe(spark, docs, tmp_path, encoding):
    out = bpe.op5_byte_bpe(spark, folder(tmp_path, docs))
    same(out, brute.bpe(plain(docs), encoding), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def test_bpe_decode_is_the_text(spark, edge):
    got = {(r["doc_id"], bytes(r["decoded"])) for r in bpe.decode(bpe.encode(edge)).collect()}
    assert got == {(i, brute.raw(t)) for i, t in plain(edge)}


def test_bpe_pieces_agree_with_the_pattern(encoding):
    import random
    rng = random.Random(1)
    alphabet = list("ab1 '  \n\t.!sretvlmdé  中١\U0001f600\x1c\x85ñ½Ⅷ'")
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(4000)]
    texts += ["", "'s", "a's 's", "x" * 1000, "*" * 5000, "   ", " \n a\n\nb  \n", "'''ll'll", "\u1c89's \U00011bf1's"]
    coder = bpe.codec(bpe.load(None))
    ids, rows = coder.encode(texts)
    for i, t in enumerate(texts):
        assert ids[rows[i]:rows[i + 1]].tolist() == encoding.encode_ordinary(t), t


def test_registered_queries_cover_all_ten():
    import __spark_entry__ as E
    names = E.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert SMALL


def test_substring_dedup_packs_a_large_batch_in_bounded_memory():
    """What the task holds beside its 25 MB batch, the packed windows it has sent apart."""
    import random
    import tracemalloc

    import pyarrow as pa
    rng = random.Random(4)
    words = [f"{rng.getrandbits(24):x}" for _ in range(50000)]
    texts = [" ".join(rng.choices(words, k=380)).encode() for _ in range(9500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int32()),
                                        pa.array(texts, pa.binary())], ["_key", "_dup", "_text"])
    assert sum(map(len, texts)) > 23 << 20
    del texts, words
    tracemalloc.start()
    sent = sum(b.num_rows for b in substring_dedup.packed_windows([batch], 42, 20, substring_dedup.CHUNK_BYTES))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent and peak < 140 << 20, peak >> 20
