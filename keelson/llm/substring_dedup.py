"""Substring dedup over words: Rabin-Karp hashes of every fixed-length window, counted in Spark.

1. A task reads chunks of documents, hashes every window of ``WINDOW`` words by two rolling
   polynomials and keeps the first window of each hash in the chunk (later ones are repeats
   already). Of each it sends 32 bits of hash to a bucket, packed, one row per (chunk, bucket); the
   table of all documents goes once per chunk.
2. A bucket counts these tags over all chunks; windows whose tag occurs again are suspects, and
   go back to their chunk as positions, which hands them to their documents.
3. Documents with suspects meet their texts. Their suspect windows alone go to a bucket with both hashes
   in full; of each hash that occurs again, all windows but the first (by document, then position)
   go back as positions.
4. A chunk merges its repeated windows into maximal removal intervals per document.
5. Documents meet their intervals and keep the other words.

A hash that every document contains sends one entry per chunk, not one per occurrence. Words have 128-bit
hashes; each half has a polynomial of its own. The second one picks the bucket. Tags only choose suspects: windows
compare by all 128 bits of both hashes, so a tag that two hashes share costs a comparison and removes nothing.

Rules: a null text has no words; a text under ``WINDOW`` words has no window and stays whole. Null ids
sort first. Rows that share an id are taken in the order of their texts, one after another.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.chunks import (chunks_of, numbered, pack, pack_docs, restored, span_rows, unpack, unpack_docs,
                                unpack_spans)
from keelson.llm.common import buffers, mix64, partitions, read, save, text_bytes, unbounded

WINDOW = 20
CHUNK_BYTES = 8 << 20
#: Text bytes per bucket: about 2 million windows.
BUCKET_BYTES = 12 << 20
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
HASH = np.dtype("V16")  # both polynomials of a window
PACKED = "_bucket int, _chunk_key bigint, _chunk_dup int, _info boolean, _hashes binary, _at binary, _docs binary"


#: Words whose hashes a task remembers, and bytes of packed windows it gathers before it sends them.
WORDS_KEPT, SEND_BYTES = 1 << 18, 2 << 20


class WordHashes(dict):
    """128-bit hash of a word, remembered for up to ``WORDS_KEPT`` words."""

    def __missing__(self, word: bytes) -> bytes:
        from xxhash import xxh3_128_digest

        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxh3_128_digest(word)
        return h


def rolling(values: np.ndarray, base: int, window: int) -> np.ndarray:
    """Rabin-Karp value (mod 2 ** 64) of every run of ``window`` values."""
    n = len(values)
    if n < window:
        return np.zeros(0, np.uint64)
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    powers *= values
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(powers, out=sums[1:])
    out = sums[window:] - sums[:-window]
    down = powers[:len(out)]  # its memory serves again for the powers of the inverse
    down[:] = pow(base, -1, 1 << 64)
    down[0] = 1
    np.multiply.accumulate(down, out=down)
    out *= down
    return out


def chunk_windows(data: np.ndarray, off: np.ndarray, hashes: WordHashes, window: int):
    """(words of each document, index of the first word of every window, two hashes of every window)."""
    raw, counts = bytearray(), np.zeros(len(off) - 1, np.int64)
    for d, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        words = data[a:b].tobytes().split()
        counts[d] = len(words)
        raw += b"".join(map(hashes.__getitem__, words))
    values = np.frombuffer(raw, np.uint64).reshape(-1, 2)
    inside = np.ones(len(values), bool)  # false for the last words of each document, where no window starts
    ends = np.cumsum(counts)
    for d in np.flatnonzero(counts).tolist():
        inside[max(ends[d] - counts[d], ends[d] - window + 1):ends[d]] = False
    at = np.flatnonzero(inside)
    one = mix64(rolling(mix64(values[:, 0]), BASES[0], window)[at])
    two = mix64(rolling(mix64(values[:, 1]), BASES[1], window)[at])
    return counts, at, one, two


def first_windows(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether no window before has both hashes of this one."""
    order = np.lexsort((two, one))
    again = one[order[1:]] == one[order[:-1]]
    again &= two[order[1:]] == two[order[:-1]]
    first = np.ones(len(order), bool)
    first[order[1:][again]] = False
    return first


def bucketed(two: np.ndarray, buckets: int):
    """(bucket, its entries in ascending order) of each bucket that has any."""
    bucket = (two % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable").astype(np.int32)
    cut = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
    for a, b in zip(cut[:-1], cut[1:]):
        yield int(bucket[order[a]]), order[a:b]


def sent(rows, key, dup):
    """Rows as Arrow batches of about ``SEND_BYTES``."""
    names = [c.split()[0] for c in PACKED.split(", ")]
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(map(len, row[2:]))
        if size >= SEND_BYTES:
            yield packed_batch(held, key, dup, names)
            held, size = [], 0
    if held:
        yield packed_batch(held, key, dup, names)


def described(keys, dups, counts, repeats, buckets):
    """The row that describes a chunk: its documents, and the windows known to be repeats."""
    bucket = int(np.uint64(int(keys[0]) & (1 << 63) - 1) % np.uint64(buckets))
    return bucket, True, b"", pack(repeats), pack_docs(keys, dups, counts)


def packed_tags(batches, buckets: int, window: int, chunk_bytes: int):
    """32 bits of hash of the first window of each hash of a chunk."""
    hashes = WordHashes()
    for keys, dups, data, off in chunks_of(batches, chunk_bytes):
        counts, at, one, two = chunk_windows(data, off, hashes, window)
        first = first_windows(one, two)
        info = described(keys, dups, counts, at[~first], buckets)
        at, two, tags = at[first], two[first], (one[first] >> np.uint64(32)).astype(np.uint32)
        del one, first
        blobs = ((b, False, tags[own].tobytes(), pack(at[own]), b"") for b, own in bucketed(two, buckets))
        yield from sent(chain([info], blobs), keys[0], dups[0])


def count_tags(table: pa.Table) -> pa.Table:
    """The windows of one bucket whose tag occurs again, packed by chunk; chunk descriptions pass through."""
    info, key, dup, at, docs = (table.column(i).to_pylist() for i in (3, 1, 2, 5, 6))
    out = [(key[i], dup[i], docs[i], at[i]) for i in range(len(info)) if info[i]]
    data, off = buffers(table.column(4).combine_chunks())
    tags = data.view(np.uint32)
    order = np.argsort(tags, kind="stable")
    same = tags[order[1:]] == tags[order[:-1]]
    many = np.zeros(len(tags), bool)
    many[order[1:]] = same
    many[order[:-1]] |= same
    for i, (a, b) in enumerate(zip(off[:-1] // 4, off[1:] // 4)):
        if many[a:b].any():
            out.append((key[i], dup[i], None, pack(unpack(at[i])[many[a:b]])))
    return reply_table(out)


SUSPECTS = "_key bigint, _dup int, _settled binary, _suspect binary"


def chunk_suspects(table: pa.Table) -> pa.Table:
    """Of each document of a chunk, the windows that are repeats and those that may be, by position in the document."""
    docs, found = table.column(2).to_pylist(), table.column(3).to_pylist()
    keys, dups, counts = unpack_docs(next(x for x in docs if x is not None))
    start = np.concatenate([[0], np.cumsum(counts)])
    both = []
    for wanted in (True, False):
        at = np.sort(np.concatenate([np.zeros(0, np.int64)] +
                                    [unpack(x) for x, d in zip(found, docs) if (d is not None) == wanted]))
        both.append((at, np.searchsorted(at, start)))
    (known, k), (maybe, m) = both
    rows = [(int(keys[d]), int(dups[d]), pack(known[k[d]:k[d + 1]] - start[d]), pack(maybe[m[d]:m[d + 1]] - start[d]))
            for d in np.flatnonzero((np.diff(k) > 0) | (np.diff(m) > 0)).tolist()]
    cols = list(zip(*rows)) or [[], [], [], []]
    return pa.table({"_key": pa.array(cols[0], pa.int64()), "_dup": pa.array(cols[1], pa.int32()),
                     "_settled": pa.array(cols[2], pa.binary()), "_suspect": pa.array(cols[3], pa.binary())})


def named_windows(keys, dups, counts, marks: dict, column: int) -> np.ndarray:
    """Windows that the marks of a chunk's documents name, by position in the chunk."""
    start = np.cumsum(counts) - counts
    return np.concatenate([np.zeros(0, np.int64)] + [
        unpack(marks[d][column]) + a for d, a in zip(zip(keys.tolist(), dups.tolist()), start.tolist())])


def packed_windows(batches, buckets: int, window: int, chunk_bytes: int):
    """Both hashes of the first window of each hash of a chunk, with the documents of these windows. Where rows
    carry marks (settled, suspect), of the suspect windows alone."""
    hashes = WordHashes()
    for batch in batches:
        marks = {(k, d): m for k, d, *m in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)))} \
            if batch.num_columns > 3 else None
        for keys, dups, data, off in chunks_of([batch], chunk_bytes):
            counts, at, one, two = chunk_windows(data, off, hashes, window)
            repeats = at[:0]
            if marks is not None:
                repeats = named_windows(keys, dups, counts, marks, 0)
                own = np.searchsorted(at, named_windows(keys, dups, counts, marks, 1))
                at, one, two = at[own], one[own], two[own]
            first = first_windows(one, two)
            info = described(keys, dups, counts, np.sort(np.concatenate([repeats, at[~first]])), buckets)
            yield from sent(chain([info], window_blobs(at[first], one[first], two[first], keys, dups, counts, buckets)),
                            keys[0], dups[0])


def window_blobs(at, one, two, keys, dups, counts, buckets: int):
    ends = np.cumsum(counts)
    for bucket, own in bucketed(two, buckets):
        used, n = np.unique(np.searchsorted(ends, at[own], "right"), return_counts=True)
        yield (bucket, False, np.stack([one[own], two[own]], 1).tobytes(), pack(at[own]),
               pack_docs(keys[used], dups[used], n))


def packed_batch(rows, key, dup, names):
    b, info, h, at, docs = zip(*rows)
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(b, pa.int32()), pa.array([key] * n, pa.int64()), pa.array([dup] * n, pa.int32()), pa.array(info),
         pa.array(h, pa.binary()), pa.array(at, pa.binary()), pa.array(docs, pa.binary())], names)


REPLY = "_chunk_key bigint, _chunk_dup int, _docs binary, _again binary"


def count_bucket(table: pa.Table) -> pa.Table:
    """The windows of one bucket that are not the first of their hash, packed by chunk; chunk
    descriptions pass through."""
    info, key, dup, at, docs = (table.column(i).to_pylist() for i in (3, 1, 2, 5, 6))
    out = [(key[i], dup[i], docs[i], at[i]) for i in range(len(info)) if info[i]]
    rows = [i for i in range(len(info)) if not info[i]]
    data, off = buffers(table.column(4).combine_chunks())  # descriptions hold no hashes
    size = np.diff(off)[rows] // HASH.itemsize
    h = data.view(np.uint64).reshape(-1, 2)
    order = np.lexsort(h.T)
    same = h[order[1:], 0] == h[order[:-1], 0]
    same &= h[order[1:], 1] == h[order[:-1], 1]
    value = np.zeros(len(h), np.int32)  # number of each hash among those of the bucket
    value[order] = np.cumsum(np.append(False, ~same), dtype=np.int32)[:len(h)]
    many = np.zeros(len(h), bool)
    many[1:] |= same
    many[:-1] |= same
    pick = np.sort(order[many])  # entries whose hash occurs again, by row
    if len(pick):
        start = np.concatenate([[0], np.cumsum(size)])
        row = np.searchsorted(start, pick, "right") - 1
        place, doc_key, doc_dup = (np.zeros(len(pick), np.int64) for _ in range(3))
        cut = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        for a, b in zip(cut, [*cut[1:], len(pick)]):
            i = rows[row[a]]
            place[a:b] = unpack(at[i])[pick[a:b] - start[row[a]]]
            keys, dups, windows = unpack_docs(docs[i])
            d = np.searchsorted(np.cumsum(windows), pick[a:b] - start[row[a]], "right")
            doc_key[a:b], doc_dup[a:b] = keys[d], dups[d]
        value = value[pick]
        order = np.lexsort((place, doc_dup, doc_key, value))
        later = np.zeros(len(pick), bool)
        later[order[1:]] = value[order[1:]] == value[order[:-1]]
        for a, b in zip(cut, [*cut[1:], len(pick)]):
            if later[a:b].any():
                i = rows[row[a]]
                out.append((key[i], dup[i], None, pack(place[a:b][later[a:b]])))
    return reply_table(out)


def reply_table(out) -> pa.Table:
    cols = list(zip(*out)) or [[], [], [], []]
    return pa.table({"_chunk_key": pa.array(cols[0], pa.int64()), "_chunk_dup": pa.array(cols[1], pa.int32()),
                     "_docs": pa.array(cols[2], pa.binary()), "_again": pa.array(cols[3], pa.binary())})


SPANS = "_key bigint, _dup int, _spans binary"


def span_table(rows) -> pa.Table:
    cols = list(zip(*rows)) or [[], [], []]
    return pa.table({"_key": pa.array(cols[0], pa.int64()), "_dup": pa.array(cols[1], pa.int32()),
                     "_spans": pa.array(cols[2], pa.binary())})


def merge_chunk(table: pa.Table, window: int) -> pa.Table:
    """Removal intervals of the documents of one chunk."""
    docs = next(x for x in table.column(2).to_pylist() if x is not None)
    keys, dups, counts = unpack_docs(docs)
    starts = np.concatenate([unpack(x) for x in table.column(3).to_pylist()])
    turn = np.zeros(int(counts.sum()) + 1, np.int64)
    np.add.at(turn, starts, 1)
    np.add.at(turn, starts + window, -1)
    return span_table(span_rows(keys, dups, counts, np.cumsum(turn[:-1]) > 0))


def removal_spans(rows: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES,
                  bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(_key, _dup, _spans) of numbered documents that lose words."""
    spark = rows.sparkSession
    buckets = max(partitions(spark), text_bytes(rows, "_text") // bucket_bytes)
    tags = rows.mapInArrow(lambda batches: packed_tags(batches, buckets, window, chunk_bytes), PACKED)
    suspects = save(tags.groupBy("_bucket").applyInArrow(count_tags, REPLY)
                    .groupBy("_chunk_key", "_chunk_dup").applyInArrow(chunk_suspects, SUSPECTS), "word-suspects")
    # The merge join sorts by document, so a recomputed task cuts the same chunks.
    marked = rows.join(unbounded(suspects), ["_key", "_dup"]).select("_key", "_dup", "_text", "_settled", "_suspect")
    packed = marked.mapInArrow(lambda batches: packed_windows(batches, buckets, window, chunk_bytes), PACKED)
    replies = packed.groupBy("_bucket").applyInArrow(count_bucket, REPLY)
    return replies.groupBy("_chunk_key", "_chunk_dup").applyInArrow(lambda t: merge_chunk(t, window), SPANS)


def kept(words: list[bytes], spans: np.ndarray) -> tuple[list[bytes], int]:
    out, at, removed = [], 0, 0
    for a, b in spans.tolist():
        out += words[at:a]
        at, removed = b, removed + b - a
    return out + words[at:], removed


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
          chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_removed, spans (packed word intervals), kept (bytes)."""
    rows = numbered(docs, id_col, text_col)
    spans = save(removal_spans(rows, window, chunk_bytes, bucket_bytes), "word-spans")
    joined = rows.join(spans, ["_key", "_dup"], "left").select("_key", "_text", "_spans")

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts, found = part.column(1), part.column(2).to_pylist()
                n, gone, text = [], [], []
                for i, spans in enumerate(found):
                    words = texts[i].as_py().split()
                    keep, removed = kept(words, unpack_spans(spans))
                    n.append(len(words))
                    gone.append(removed)
                    text.append(b" ".join(keep))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), part.column(2),
                     pa.array(text, pa.binary())], ["_key", "n_words", "n_removed", "spans", "kept"])
    out = joined.mapInArrow(run, "_key bigint, n_words bigint, n_removed bigint, spans binary, kept binary")
    return out.select(restored().alias(id_col), "n_words", "n_removed", "spans", "kept")


def op4_substring_dedup(spark, sf_dir):
    return digest(dedup(read(spark, sf_dir, "documents")))


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
