"""Chunks of documents and packed arrays, shared by the two passage operators.

A chunk is a run of documents that one task reads together, in order of their identifiers. Facts
about a chunk travel as packed arrays: one row per (chunk, bucket) in place of one row per
position. A chunk is named by its first document, so a recomputed task gives it the same name.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import buffers, pieces, save

NO_ID = -(1 << 63)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_key, _dup, _text): identifier (null: the least number), which of the rows that share it, and
    UTF-8 bytes (null: empty). Rows are only numbered where an identifier repeats, in text order."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_key"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    if rows.groupBy("_key").count().where("count > 1").isEmpty():
        return rows.select("_key", F.lit(0).alias("_dup"), "_text")
    w = Window.partitionBy("_key").orderBy("_text")
    return save(rows.withColumn("_dup", F.row_number().over(w)).select("_key", "_dup", "_text"), "numbered")


def restored(key: str = "_key"):
    return F.when(F.col(key) == NO_ID, F.lit(None)).otherwise(F.col(key))


def chunks_of(batches, limit: int):
    """(keys, dups, bytes, offsets) of each chunk of at most ``limit`` bytes, sorted by (key, dup)."""
    for batch in batches:
        keys, dups = (batch.column(i).to_numpy() for i in (0, 1))
        data, off = buffers(batch.column(2))
        for a, b in pieces(off, limit):
            order = np.lexsort((dups[a:b], keys[a:b]))
            if (order[1:] > order[:-1]).all():
                yield keys[a:b], dups[a:b], data[off[a]:off[b]], off[a:b + 1] - off[a]
            else:
                rows = order + a
                parts = [data[off[i]:off[i + 1]] for i in rows.tolist()]
                size = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                yield keys[rows], dups[rows], np.concatenate(parts), size


def pack(numbers: np.ndarray) -> bytes:
    """Ascending numbers as one-byte steps; longer steps follow in a list of their own."""
    steps = np.diff(numbers, prepend=0)
    wide = steps[steps >= 255].astype(np.uint32)
    return np.uint32(len(wide)).tobytes() + wide.tobytes() + np.minimum(steps, 255).astype(np.uint8).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    steps = np.frombuffer(raw, np.uint8, offset=4 + 4 * n).astype(np.int64)
    steps[steps == 255] = np.frombuffer(raw, np.uint32, n, 4)
    return np.cumsum(steps)


def pack_docs(keys: np.ndarray, dups: np.ndarray, counts: np.ndarray) -> bytes:
    """Keys, numbers and counts of a chunk's documents."""
    table = np.stack([np.diff(keys, prepend=np.int64(0)), dups.astype(np.int64), counts.astype(np.int64)])
    return zlib.compress(np.ascontiguousarray(table.view(np.uint8).reshape(3, -1, 8).transpose(0, 2, 1)).tobytes(), 1)


def unpack_docs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(3, 8, -1).transpose(0, 2, 1)
    table = np.ascontiguousarray(planes).view(np.int64).reshape(3, -1)
    return np.cumsum(table[0]), table[1], table[2]


def spans_of(covered: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true values that stay inside the rows ``offsets`` cuts."""
    edge = np.zeros(len(covered) + 1, bool)
    edge[offsets] = True
    before = np.append(False, covered[:-1]) if len(covered) else covered
    after = np.append(covered[1:], False) if len(covered) else covered
    starts = np.flatnonzero(covered & (~before | edge[:-1]))
    ends = np.flatnonzero(covered & (~after | edge[1:])) + 1
    return starts, ends


def pack_spans(starts: np.ndarray, ends: np.ndarray) -> bytes:
    return np.stack([starts, ends], 1).astype(np.int64).tobytes()


def unpack_spans(raw: bytes | None) -> np.ndarray:
    return np.frombuffer(raw or b"", np.int64).reshape(-1, 2)


def span_rows(keys, dups, sizes, covered) -> list:
    """(key, dup, packed spans) of each document of a chunk that has covered positions."""
    off = np.concatenate([[0], np.cumsum(sizes)])
    starts, ends = spans_of(covered, off)
    of = np.searchsorted(off, starts, "right") - 1
    out = []
    cut = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
    for a, b in zip(cut, [*cut[1:], len(of)]):
        d = of[a]
        out.append((int(keys[d]), int(dups[d]), pack_spans(starts[a:b] - off[d], ends[a:b] - off[d])))
    return out
