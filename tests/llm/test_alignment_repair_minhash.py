"""MinHash near-dedup, conversation repair and tokenizer alignment against brute force."""

import random

import numpy as np
import pytest

from keelson.llm import alignment, conversation_repair, minhash
from tests.llm import brute
from tests.llm.conftest import SMALL, plain, same, table_dir

FRAMES = ["edge", "small", "nothing"]


@pytest.fixture(params=FRAMES)
def docs(request):
    return request.getfixturevalue(request.param)


# --- MinHash near-dedup ---------------------------------------------------------------------------

MINHASH = ("doc_id", "n_shingles", "component_id", "kept")


def test_minhash(spark, docs, tmp_path):
    out = minhash.op13_minhash_dedup(spark, table_dir(tmp_path, documents=docs))
    same(out, brute.minhash(plain(docs)), *MINHASH)


def near_copies():
    """Stars of near copies round a base, chains, a template with different ends, one line in many texts."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(900)]
    texts = []
    for size in (45, 90, 400):
        base = rng.choices(words, k=size)
        texts.append(base)
        for _ in range(25):
            own = list(base)
            for at in rng.sample(range(size), max(1, size // 60)):
                own[at] = rng.choice(words)
            texts.append(own)
    chain = rng.choices(words, k=120)
    for _ in range(12):
        chain = [*chain[3:], *rng.choices(words, k=3)]
        texts.append(chain)
    line = rng.choices(words, k=14)
    texts += [rng.choices(words, k=rng.randint(5, 60)) + line for _ in range(60)]
    template = rng.choices(words, k=80)
    texts += [template + rng.choices(words, k=12) for _ in range(40)]
    texts += [template[:40] + rng.choices(words, k=1) + template[40:] for _ in range(10)]
    rng.shuffle(texts)
    return [(7 * i % 1009, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block, long", [(7, 256), (2048, 256), (40, 64)])
def test_minhash_keeps_every_link_of_stars_chains_and_templates(spark, block, long):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in minhash.minhash_components(df, block=block, long=long).collect()}
    assert got == {i: c for i, _, c, _ in brute.minhash(rows)}


def test_minhash_needed_holds_for_the_worst_pairs():
    """Sets that differ as much as 85 % allows share at least the needed values of their sketches."""
    rng = np.random.default_rng(5)
    for n in [*range(1, 130), 200, 500, 3000]:
        for _ in range(20):
            both = rng.integers(-(1 << 62), 1 << 62, n)
            extra = rng.integers(-(1 << 62), 1 << 62, n * 15 // 85)
            cut = rng.integers(0, len(extra) + 1)
            a, b = (np.sort(np.concatenate([both, x]))[:minhash.SKETCH] for x in (extra[:cut], extra[cut:]))
            shared = len(np.intersect1d(a, b))
            assert shared >= minhash.needed(np.array([n + cut]))[0]
            assert shared >= minhash.needed(np.array([n + len(extra) - cut]))[0]
            pad = [np.pad(x, (0, minhash.SKETCH - len(x)), constant_values=np.iinfo(np.int64).max)[None] for x in (a, b)]
            s, size = minhash.overlap_estimate(*pad, minhash.SKETCH)
            sizes = np.array([n + cut]), np.array([n + len(extra) - cut])
            assert minhash.let_through(*sizes, s, size, minhash.SKETCH, 85)[0].all()


# --- Conversation structure repair ----------------------------------------------------------------

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, _conv string, _row int"
REPAIR = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def conversations():
    rng = random.Random(4)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "sys", "a"]
    texts = ["Hello.", "Why?", "So it is!", "cut off", " \t", "", None, "ends. \n", "Hello.", "x" * 40000 + "."]
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 2]), rng.choice(roles), rng.choice(texts)))
    rows += [(500, t, "user" if t % 2 else "assistant", f"turn {t}" + "." * (t % 3 > 0)) for t in range(700)]
    rows += [(501, 4, "user", "again and again.")] * 300
    rows += [(None, t, "user", f"no id {t}.") for t in range(6)] + [(502, None, None, None)] * 3
    return [(*r, "c", 1) for r in rows]


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame(conversations(), CONVERSATIONS).repartition(6).cache()


def test_repair_of_odd_conversations(spark, talks, tmp_path):
    out = conversation_repair.op12_conversation_repair(spark, table_dir(tmp_path, conversations=talks))
    same(out, brute.repair([tuple(r)[:4] for r in talks.collect()]), *REPAIR)


def test_repair_of_the_given_table(spark):
    out = conversation_repair.op12_conversation_repair(spark, SMALL)
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    same(out, brute.repair([tuple(r) for r in rows]), *REPAIR)


def test_repair_of_an_empty_table(spark, talks, tmp_path):
    out = conversation_repair.op12_conversation_repair(spark, table_dir(tmp_path, conversations=talks.limit(0)))
    assert out.count() == 0


def test_segments_do_not_change_the_repair(spark, talks):
    rows = conversation_repair.damaged(talks)
    facts = [sorted(map(repr, conversation_repair.repair(rows, size)[0].collect())) for size in (4, 256)]
    assert facts[0] == facts[1]


def test_alignment_of_turns_equals_an_automaton_over_suffixes():
    rng = random.Random(9)
    follow = {"B": {"s": "S", "u": "A"}, "S": {"u": "A"}, "A": {"a": "U"}, "U": {"u": "A"}}

    def automaton(rows):
        best = {"B": (0, ""), "U": (0, "")}
        for i in range(len(rows), -1, -1):
            after, best = best, dict(best) if i == len(rows) else {}
            options = [] if i == len(rows) else [(p, c + 3, "D" + s) for p, (c, s) in after.items()]
            for p, moves in follow.items() if i < len(rows) and rows[i][1] in (0, 3) else ():
                options += [(p, after[q][0] + 2 * (x != rows[i][0]) + (rows[i][1] == 3), "RK"[x == rows[i][0]] + after[q][1])
                            for x, q in moves.items() if q in after and (x == rows[i][0] or x != "s")]
            for p, c, s in options:
                best[p] = min(best.get(p, (c, s)), (c, s))
            for _ in range(6):
                for p, moves in follow.items():
                    for x, q in moves.items():
                        if x != "s" and q in best:
                            best[p] = min(best.get(p, (1 << 40, "")), (best[q][0] + 2, "I" + best[q][1]))
        return best["B"]

    for _ in range(1500):
        n = rng.randint(1, 14)
        rows = [(rng.choice("ssuuaat "), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
        want = automaton(rows)
        whole = conversation_repair.chain([conversation_repair.align(rows, "B", "BU")])
        cuts = sorted(rng.sample(range(1, n), rng.randint(0, min(3, n - 1))))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, n])]
        cut = conversation_repair.chain([conversation_repair.align(x) | conversation_repair.align(x, "SAU", "SAU") for x in parts])
        assert want == (whole[0], whole[2]) == (cut[0], cut[2])


# --- Cross-tokenizer alignment --------------------------------------------------------------------

ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment(spark, docs, tmp_path):
    out = alignment.op11_tokenizer_alignment(spark, table_dir(tmp_path, documents=docs))
    same(out, brute.alignment(plain(docs)), *ALIGNED)


def odd_texts():
    return ["<|endoftext|> and <s> </s> <unk>", " two  spaces ", "tab\tline\nend\n", "日本語のテキスト", "é å ﬁ ①", "▁ mark ▁▁",
            "a" * 3000, "🙂🙃🙂 x", "  ​", "<0x41> <0xFF>", "naïve façade", "\x00 nul \x7f", "x" * 5 + " " * 50]


def test_alignment_of_odd_texts_over_many_chunks(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(odd_texts() * 3)), "doc_id bigint, text string").repartition(3)
    out = alignment.align(df, chunk_bytes=600)
    want = [x[:7] for x in brute.alignment(plain(df))]
    same(out, want, "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def test_row_products_equal_a_dense_product():
    rng = np.random.default_rng(2)
    a, b = (rng.random((17, 23)) < 0.2), (rng.random((23, 9)) < 0.3)

    def csr(m):
        return alignment.CSR(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1], m.shape[1])
    for strip in (1, 5, 1 << 20):
        dense = np.zeros((17, 9), int)
        for r, c, v in alignment.row_products(csr(a), csr(b), strip):
            dense[r, c] += v
        assert (dense == a.astype(int) @ b.astype(int)).all()
    t = csr(a).transposed()
    assert [t.col[i:j].tolist() for i, j in zip(t.ptr, t.ptr[1:])] == [np.flatnonzero(x).tolist() for x in a.T]


def test_links_lists_overlaps_and_shared_groups(spark):
    df = spark.createDataFrame(list(enumerate(odd_texts())), "doc_id bigint, text string")
    rows = alignment.links(df).collect()
    facts = {r.doc_id: r for r in alignment.align(df).collect()}
    for i in facts:
        own = [r for r in rows if r.doc_id == i]
        assert sum(r.shared_bytes > 0 for r in own) == facts[i].n_links
        assert len(own) == facts[i].n_group_links  # tokens that overlap share a group
        assert len({(r.a_token, r.b_token) for r in own}) == len(own)


def test_both_encoders_of_a_byte_level_vocabulary_agree_on_settled_code_points():
    from tokenizers import Tokenizer
    path = alignment.vocabulary_files()[0]
    side, own = alignment.byte_level_side(path), Tokenizer.from_file(path)
    texts = [f"a{c}1{c} {c}{c} {c}" for c in map(chr, np.flatnonzero(alignment.settled_points()).tolist())
             if not 0xD800 <= ord(c) < 0xE000]
    texts += ["it's they'll 'S x'd  ", "  \n\n x", " \u3000\u2003 a", "<|endoftext|>"]
    own.encode_special_tokens = True
    want = [e.ids for e in own.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert side.encode(texts) == want
    assert not alignment.settled("\U0001FAE8") and not alignment.settled("\u0CF3")
