"""Cross-tokenizer alignment by token-byte incidence matrices in CSR.

A text is encoded by two tokenizers, A and B. Row t of a token-byte matrix holds a one in each byte
column of token t. Over texts laid end to end A·Bᵀ, formed by Gustavson's row products (row t of the
product gathers the rows of Bᵀ that row t of A names), has a value wherever two tokens overlap: the
bytes they share. These are the links. Bytes where tokens of both sides end cut the tokens into
groups; a row of a token-group matrix holds a one in its group's column, and the same product of these
gives the links inside groups.

How often each pair of identifiers is linked is counted over the whole corpus in two passes. Pass one
encodes chunks of text: it writes facts per document, the chunk's token ids (packed), and the chunk's
distinct identifier pairs with their counts. Pairs are summed in Spark, each B id's highest count is
found, and every chunk gets the counts of its own pairs back, one row per distinct pair; pass two
rebuilds the links from the packed ids and looks their counts up. No count table is broadcast.

Rules: no special tokens, their strings are plain text. A gets a space before the text, B adds one
itself. Null and empty texts, and texts that either side does not spell byte for byte, have no tokens:
zeros and an empty groups digest. Ids may be null or repeated; every row gives a row.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import buffers, partitions, pieces, read, save, unbounded

CHUNK_BYTES = 4 << 20
PIECE_BYTES = 1 << 18
#: Products of one strip of rows.
STRIP = 1 << 20
SPACE_MARK = "▁"


class CSR(NamedTuple):
    """Rows of ones: row i names columns col[ptr[i]:ptr[i + 1]]."""
    ptr: np.ndarray
    col: np.ndarray
    width: int

    def transposed(self) -> CSR:
        rows = np.repeat(np.arange(len(self.ptr) - 1, dtype=np.int32), np.diff(self.ptr))
        counts = np.bincount(self.col, minlength=self.width)
        return CSR(np.concatenate([[0], np.cumsum(counts)]), rows[np.argsort(self.col, kind="stable")], len(self.ptr) - 1)


def row_products(a: CSR, b: CSR, strip: int = STRIP):
    """(row, column, value) arrays of a·b, strip by strip of rows: each row of ``a`` gathers the rows of
    ``b`` that it names, and equal columns of a row add up."""
    each = np.diff(b.ptr)[a.col]  # entries that each one of a brings
    work = np.concatenate([[0], np.cumsum(each)])[a.ptr]
    for i, j in pieces(work, strip):
        lo, hi = a.ptr[i], a.ptr[j]
        size = each[lo:hi]
        total = int(size.sum())
        if not total:
            continue
        at = np.repeat(b.ptr[a.col[lo:hi]] - (np.cumsum(size) - size), size) + np.arange(total)
        row = np.repeat(np.arange(i, j), np.diff(work[i:j + 1]))
        key = row * b.width + b.col[at]
        if (key[1:] < key[:-1]).any():
            key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        yield key[first] // b.width, key[first] % b.width, np.diff(np.append(first, total))


def byte_matrix(ends: np.ndarray) -> CSR:
    """Token-byte incidence of tokens laid end to end."""
    total = int(ends[-1]) if len(ends) else 0
    return CSR(np.concatenate([[0], ends]), np.arange(total, dtype=np.int32), total)


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(group of each A token, of each B token, number of groups): cut where both sides end."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return np.searchsorted(common, ends_a), np.searchsorted(common, ends_b), len(common)


def group_matrix(group: np.ndarray, n: int) -> CSR:
    return CSR(np.arange(len(group) + 1), group, n)


class Side:
    """One tokenizer: token bytes by id, and the ids of texts."""

    def __init__(self, words: list[bytes], encode):
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        names = list(map(str, range(len(words))))
        self.names = [n + mark for mark in ",|;" for n in names] + names
        self.size = len(words)
        self.encode = encode

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.encode(texts)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.concatenate([np.array(x, np.int64) for x in found]) if found else np.zeros(0, np.int64), counts

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        size = self.length[ids]
        return self.bytes[np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def byte_symbols() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes as."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def settled_points() -> np.ndarray:
    """Which code points of the basic plane have kept their class (letter, number, other) since Unicode 3.2, so
    that every regex engine splits them alike."""
    import unicodedata

    def kind(table, c):
        name = table.category(chr(c))
        return name[0] if name[0] in "LN" else "-" if name != "Cn" else "?"
    return np.array([(k := kind(unicodedata.ucd_3_2_0, c)) != "?" and k == kind(unicodedata, c) for c in range(0x10000)])


def settled(text: str) -> bool:
    if text.isascii():
        return True
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return int(points.max()) < 0x10000 and bool(settled_points()[points].all())


def byte_level_side(path: str) -> Side:
    """A byte-level BPE vocabulary. Where merges are numbered in the order of their token ids the ids are ranks,
    and texts go through the faster encoder by rank; texts with code points that engines may class
    differently, and other vocabularies, go through the vocabulary's own."""
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    symbols = byte_symbols()
    vocabulary = tokenizer.get_vocab()
    words = [b""] * tokenizer.get_vocab_size()
    for word, i in vocabulary.items():
        words[i] = bytes(symbols[c] for c in word) if all(c in symbols for c in word) else word.encode()
    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    ranked = all(vocabulary["".join(m if isinstance(m, list) else m.split(" "))] == 256 + i for i, m in enumerate(merges))
    by_rank = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={
        w: i for i, w in enumerate(words[:256 + len(merges)])}) if ranked else None

    def encode(texts):
        fast = [by_rank is not None and settled(t) for t in texts]
        own = iter(tokenizer.encode_batch_fast([" " + t for t, f in zip(texts, fast) if not f], add_special_tokens=False))
        return [by_rank.encode_ordinary(" " + t) if f else next(own).ids for t, f in zip(texts, fast)]
    return Side(words, encode)


def piece_side(path: str) -> Side:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    words = [bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
             for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))]
    return Side(words, lambda texts: model.encode(texts, num_threads=1))


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return byte_level_side(path_a), piece_side(path_b)


def vocabulary_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Aligned(NamedTuple):
    """Texts of one piece laid end to end; tokens of texts that are not spelled are left out."""
    ids_a: np.ndarray
    ids_b: np.ndarray
    n_a: np.ndarray  # tokens of each text
    n_b: np.ndarray


def encoded(texts: list[str], a: Side, b: Side) -> Aligned:
    some = [t for t in texts if t]
    ids_a, n_a = a.ids(some)
    ids_b, n_b = b.ids(some)
    at_a, at_b = (np.concatenate([[0], np.cumsum(side.length[ids])])[np.concatenate([[0], np.cumsum(n)])].tolist()
                  for side, ids, n in ((a, ids_a, n_a), (b, ids_b, n_b)))
    raw_a, raw_b = a.spelled(ids_a).tobytes(), b.spelled(ids_b).tobytes()
    good = np.zeros(len(some), bool)
    for i, t in enumerate(some):
        want = b" " + t.encode()
        good[i] = raw_a[at_a[i]:at_a[i + 1]] == want and raw_b[at_b[i]:at_b[i + 1]] == want
    ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
    out = np.zeros((2, len(texts)), np.int64)
    out[:, [i for i, t in enumerate(texts) if t]] = np.where(good, n_a, 0), np.where(good, n_b, 0)
    return Aligned(ids_a, ids_b, out[0], out[1])


def overlap_links(x: Aligned, a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, bytes shared) of every overlap, by A token and then B token."""
    left, right = byte_matrix(np.cumsum(a.length[x.ids_a])), byte_matrix(np.cumsum(b.length[x.ids_b]))
    found = list(row_products(left, right.transposed()))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def pair_keys(x: Aligned, a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """(identifier pair of each link, number of the text it is in)."""
    row, col, _ = overlap_links(x, a, b)
    text = np.repeat(np.arange(len(x.n_a)), x.n_a)
    return x.ids_a[row] << 16 | x.ids_b[col], text[row]


def group_facts(x: Aligned, a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(groups, links inside groups, groups written out) of each text."""
    group_a, group_b, n = groups_of(np.cumsum(a.length[x.ids_a]), np.cumsum(b.length[x.ids_b]))
    texts = len(x.n_a)
    text = np.repeat(np.arange(texts), x.n_a)
    of_group = np.zeros(n, np.int64)
    of_group[group_a] = text
    groups = np.bincount(of_group, minlength=texts)
    inside = np.bincount(group_a, minlength=n) * np.bincount(group_b, minlength=n)
    inside = np.bincount(of_group, weights=inside, minlength=texts).astype(np.int64)
    side = np.concatenate([np.zeros(len(group_a), np.int64), np.ones(len(group_b), np.int64)])
    order = np.argsort(np.concatenate([group_a, group_b]) * 2 + side, kind="stable")
    group, side = np.concatenate([group_a, group_b])[order], side[order]
    mark = np.full(len(order), 3)  # the last token of a text
    mark[:-1] = np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0))
    ends = np.cumsum(x.n_a + x.n_b)
    mark[ends[ends > 0] - 1] = 3
    ids = np.concatenate([x.ids_a, x.ids_b])[order]
    name_a, name_b = a.names, b.names
    place = ids + mark * np.where(side == 0, a.size, b.size)
    words = [name_b[i] if s else name_a[i] for i, s in zip(place.tolist(), side.tolist())]
    cut = [0, *ends.tolist()]
    return groups, inside, ["".join(words[i:j]) for i, j in zip(cut[:-1], cut[1:])]


def group_links(x: Aligned, a: Side, b: Side):
    """(A token, B token, 1) of every two tokens of one group, strip by strip."""
    group_a, group_b, n = groups_of(np.cumsum(a.length[x.ids_a]), np.cumsum(b.length[x.ids_b]))
    return row_products(group_matrix(group_a, n), group_matrix(group_b, n).transposed())


def packed_ids(parts: list[Aligned]) -> bytes:
    """Token numbers and ids of a chunk: id bytes by plane, compressed."""
    import zstandard

    head = np.concatenate([np.stack([p.n_a, p.n_b]) for p in parts], axis=1).astype(np.int32)
    body = [np.concatenate([getattr(p, c) for p in parts]).astype(np.uint16) for c in ("ids_a", "ids_b")]
    planes = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 2).T).tobytes() for x in body)
    raw = np.array([head.shape[1], len(body[0]), len(body[1])], np.int64).tobytes() + head.tobytes() + planes
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked_ids(blob: bytes) -> Aligned:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    docs, n_a, n_b = np.frombuffer(raw, np.int64, 3).tolist()
    head = np.frombuffer(raw, np.int32, 2 * docs, 24).reshape(2, docs).astype(np.int64)
    at, ids = 24 + 8 * docs, []
    for n in (n_a, n_b):
        planes = np.frombuffer(raw, np.uint8, 2 * n, at).reshape(2, n)
        ids.append(planes[0].astype(np.int64) | planes[1].astype(np.int64) << 8)
        at += 2 * n
    return Aligned(ids[0], ids[1], head[0], head[1])


def cut_texts(x: Aligned, tokens: int = 1 << 17):
    """(first text, texts [i, j) of ``x``) in runs of about ``tokens`` tokens."""
    at_a, at_b = (np.concatenate([[0], np.cumsum(n)]) for n in (x.n_a, x.n_b))
    for i, j in pieces(at_a + at_b, tokens):
        yield i, Aligned(x.ids_a[at_a[i]:at_a[j]], x.ids_b[at_b[i]:at_b[j]], x.n_a[i:j], x.n_b[i:j])


FACTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_group_links bigint, groups string"


def first_pass(docs: DataFrame, id_col: str, text_col: str, paths: tuple[str, str], written: bool,
               chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows (_chunk, _at, _id, facts, _ids, _pairs, _counts): one per document (_at from 0 on) and one per chunk
    (_at = -1). ``written``: groups as text, else as their SHA-256."""
    from hashlib import sha256

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = f"_chunk bigint, _at int, _id {kind}, {FACTS}, _ids binary, _pairs array<bigint>, _counts array<bigint>"
    names = [c.split()[0] for c in schema.replace("array<bigint>", "x").split(", ")]

    def show(text):
        return text if written or not text else sha256(text.encode()).hexdigest()

    def run(batches):
        a, b = sides(*paths)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            size = np.concatenate([[0], np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))])
            for i, j in pieces(size, chunk_bytes):
                parts, pairs, facts, groups = [], [], [], []
                for p, q in pieces(size[i:j + 1] - size[i], PIECE_BYTES):
                    x = encoded(batch.column(1).slice(i + p, q - p).to_pylist(), a, b)
                    keys, text = pair_keys(x, a, b)
                    n_groups, inside, shown = group_facts(x, a, b)
                    facts.append(np.stack([x.n_a, x.n_b, n_groups, np.bincount(text, minlength=q - p), inside]))
                    groups += map(show, shown)
                    pairs.append(np.unique(keys, return_counts=True))
                    parts.append(x)
                key, back = np.unique(np.concatenate([k for k, _ in pairs]), return_inverse=True)
                count = np.bincount(back, weights=np.concatenate([c for _, c in pairs]), minlength=len(key)).astype(np.int64)
                facts = np.concatenate(facts, axis=1)
                for at in range(0, j - i, 1024):
                    n = min(1024, j - i - at)
                    none = pa.nulls(n, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, number)), pa.array(np.arange(at, at + n, dtype=np.int32)), batch.column(0).slice(i + at, n),
                         *[pa.array(f[at:at + n]) for f in facts], pa.array(groups[at:at + n], pa.string()),
                         pa.nulls(n, pa.binary()), none, none], names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([-1], pa.int32()), pa.nulls(1, batch.column(0).type), *[pa.nulls(1, pa.int64())] * 5,
                     pa.nulls(1, pa.string()), pa.array([packed_ids(parts)], pa.binary()),
                     pa.array([key], pa.list_(pa.int64())), pa.array([count], pa.list_(pa.int64()))], names)
                number += 1
    return texts.mapInArrow(run, schema)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(_pair, count, best), written: links that hold an identifier pair over the corpus, and whether no
    pair with the same B id has more."""
    each = chunks.where("_at = -1").select(F.explode(F.arrays_zip("_pairs", "_counts")).alias("_x"))
    counts = save(each.groupBy(F.col("_x._pairs").alias("_pair")).agg(F.sum("_x._counts").alias("count")), "pair-counts")
    b = F.col("_pair").bitwiseAND(F.lit(0xFFFF).cast("long"))
    top = counts.groupBy(b.alias("_b")).agg(F.max("count").alias("_top"))
    return save(counts.join(unbounded(top), b == F.col("_b")).select(
        "_pair", "count", (F.col("count") == F.col("_top")).alias("best")), "best-pairs")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None,
          written: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_group_links, groups (``a1,a2|b1;a3|b2,b3``, or
    its SHA-256), n_best, count_sum."""
    paths = paths or vocabulary_files()
    spark = docs.sparkSession
    rows = save(first_pass(docs, id_col, text_col, paths, written, chunk_bytes), "aligned")
    counts = pair_counts(rows)
    chunks = rows.where("_at = -1")
    own = chunks.select("_chunk", F.explode("_pairs").alias("_pair"))
    own = own.join(unbounded(counts), "_pair").select("_chunk", F.lit(0).alias("_kind"), "_pair", "count", "best")
    facts = [c.split()[0] for c in FACTS.split(", ")]
    null = {c: F.lit(None).cast(t) for c, t in rows.dtypes}
    described = ["_id", *facts, "_ids"]
    both = own.select("*", *[null[c].alias(c) for c in described]).unionByName(rows.select(
        "_chunk", F.when(F.col("_at") < 0, 1).otherwise(2).alias("_kind"), F.col("_at").cast("long").alias("_pair"),
        F.lit(None).cast("long").alias("count"), F.lit(None).cast("boolean").alias("best"), *described))
    both = both.repartition(partitions(spark), "_chunk").sortWithinPartitions("_chunk", "_kind", "_pair")
    schema = f"_id {dict(rows.dtypes)['_id']}, {FACTS}, n_best bigint, count_sum bigint"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        a, b = sides(*paths)
        pairs, found, at = [], None, 0
        for batch in batches:
            kind = batch.column(1).to_numpy()
            cut = [0, *(np.flatnonzero(kind[1:] != kind[:-1]) + 1).tolist(), batch.num_rows]
            for i, j in zip(cut[:-1], cut[1:]):
                part = batch.slice(i, j - i)
                if i < j and kind[i] == 0:
                    pairs.append([part.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4)])
                elif i < j and kind[i] == 1:
                    # chunks without tokens have no pairs, so several may stand in a row: the last one counts
                    found, at = looked_up(part.column("_ids")[-1].as_py(), pairs, a, b), 0
                    pairs = []
                elif i < j:
                    n = j - i
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("_id", *facts)], pa.array(found[0][at:at + n]),
                                                      pa.array(found[1][at:at + n])], names)
                    at += n
    return both.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def looked_up(blob: bytes, pairs: list, a: Side, b: Side) -> np.ndarray:
    """(best links, sum of counts) of each text of a chunk, from its pairs in ascending order."""
    x = unpacked_ids(blob)
    out = np.zeros((2, len(x.n_a)), np.int64)
    if not pairs:
        return out
    key, count, best = (np.concatenate(c) for c in zip(*pairs))
    for first, part in cut_texts(x):
        keys, text = pair_keys(part, a, b)
        at = np.searchsorted(key, keys)
        n = len(part.n_a)
        out[0, first:first + n] = np.bincount(text, weights=best[at], minlength=n)
        sums = np.zeros(n, np.int64)
        np.add.at(sums, text, count[at])
        out[1, first:first + n] = sums
    return out


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per link: id, a_token, b_token (positions in the text), a_id, b_id, shared_bytes (of an overlap; 0:
    the tokens only share a group)."""
    paths = paths or vocabulary_files()
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = f"`{id_col}` {kind}, a_token bigint, b_token bigint, a_id bigint, b_id bigint, shared_bytes bigint"

    def run(batches):
        a, b = sides(*paths)
        for batch in batches:
            size = np.concatenate([[0], np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))])
            for i, j in pieces(size, PIECE_BYTES):
                x = encoded(batch.column(1).slice(i, j - i).to_pylist(), a, b)
                text = np.repeat(np.arange(j - i), x.n_a)
                at_a, at_b = np.cumsum(x.n_a) - x.n_a, np.cumsum(x.n_b) - x.n_b
                row, col, shared = overlap_links(x, a, b)
                known = row * len(x.ids_b) + col
                for r, c, s in [(row, col, shared), *((r, c, None) for r, c, _ in group_links(x, a, b))]:
                    if s is None:
                        only = ~np.isin(r * len(x.ids_b) + c, known)
                        r, c = r[only], c[only]
                        s = np.zeros(len(r), np.int64)
                    if len(r):
                        t = text[r]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(i + t)), *[pa.array(v) for v in (r - at_a[t], c - at_b[t], x.ids_a[r], x.ids_b[c], s)]],
                            [id_col, "a_token", "b_token", "a_id", "b_id", "shared_bytes"])
    return texts.mapInArrow(run, schema)


def op11_tokenizer_alignment(spark, sf_dir):
    return align(read(spark, sf_dir, "documents"), written=False).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"), "n_group_links")
