"""Suffix-array dedup over bytes: every byte that a repeated 400-byte string covers is removed.

A suffix array of all positions is not needed: any two equal strings hold the same anchor at the
same place, the lowest (then leftmost) hash of their 32-byte grams. Each string belongs to its
anchor, so only anchors' suffixes, about one in 185, have to be ordered.

1. Tasks find anchors and, for each, the strings that belong to it (``distance`` bytes before the
   anchor, a range). The range is cut in two halves so that all strings of a half share a core of
   over 200 bytes; core hashes are counted over the corpus in packed buckets.
2. Halves whose core occurs again send their bytes (the union of their strings) to a bucket by core.
   Equal byte runs are one entry with a count.
   A core that more than ``HOT_CHUNKS`` chunks hold would gather its differing runs in one bucket:
   its strings travel as digests instead, those of ``HOT_RANGE`` neighbouring distances to the bucket
   of the 385 bytes they share. A piece (some ``CHUNK_BYTES`` of text in one task) sends each digest
   once and keeps its occurrences in a table; the bucket answers which digests other pieces hold too,
   and the piece expands these to all their occurrences. Both ways are exact.
3. A bucket orders the suffixes that start at its anchors, and the reversed prefixes that end there,
   by deep-shallow sorting. Strings at distance d are equal exactly when their suffixes share 400 - d
   bytes and their prefixes d bytes, which both orders tell from neighbours' common prefixes.
4. Covered intervals go back to the documents, which keep the other bytes.

Rules: a null text is empty; texts under 400 bytes have no string and stay whole. Strings never
cross documents. Null ids are documents like any other; rows that share an id are told apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.chunks import (NO_ID, chunks_of, numbered, pack, pack_spans, restored, unpack, unpack_spans)
from keelson.llm.common import buffers, mix64, partitions, pieces, read, save, text_bytes
from keelson.llm.substring_dedup import BASES, rolling
from keelson.llm.suffix_sort import deep_shallow

LENGTH = 400
GRAM = 32
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 12 << 20
PLACE_BITS = 24
STRETCH = 4 << 20  # string starts that are looked at together: places inside fit PLACE_BITS
HOT_CHUNKS = 64
HOT_RANGE = 16
DIGEST = 16
HALF = (LENGTH - GRAM) // 2  # distances 0..HALF share the bytes after the anchor, the others those before


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours: prefix and suffix minima of blocks."""
    n = len(keys)
    rows = -(-n // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = keys
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def halves(data: np.ndarray, off: np.ndarray):
    """(document, anchor, nearest, farthest, core hash) of every half range of a chunk; places count
    from the start of the chunk. A chunk of one long text is taken in stretches that overlap by a
    string less a byte, so each string is seen whole and once."""
    found = []
    for a in range(0, max(len(data), 1), STRETCH):
        b = min(a + STRETCH + LENGTH - 1, len(data))
        doc, p, near, far, core = stretch_halves(data[a:b], np.clip(off - a, 0, b - a))
        found.append((doc, p + a, near, far, core))
    return tuple(np.concatenate(x) for x in zip(*found))


def stretch_halves(data: np.ndarray, off: np.ndarray):
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    if len(data) < LENGTH:
        return none
    codes = mix64(np.arange(256, dtype=np.uint64) + np.uint64(1))[data]
    grams = mix64(rolling(codes, BASES[0], GRAM))
    keys = (grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_least(keys, LENGTH - GRAM + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    start = np.arange(len(anchor))
    doc = np.searchsorted(off, start, "right") - 1
    fits = np.flatnonzero(start + LENGTH <= off[doc + 1])
    anchor, doc = anchor[fits], doc[fits]
    if not len(fits):
        return none
    far = anchor - fits
    half = far > HALF
    cut = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (half[1:] != half[:-1]) | (doc[1:] != doc[:-1])))
    last = np.append(cut[1:], len(fits)) - 1
    p, d, h = anchor[cut], doc[cut], half[cut]
    farthest, nearest = far[cut], far[last]
    after = LENGTH - HALF  # core of a near half: bytes [p, p + LENGTH - HALF)
    before = HALF + 1      # core of a far half: bytes [p - HALF - 1, p + GRAM)
    core = np.where(h, core_hash(codes, p - before, before + GRAM, h), core_hash(codes, p, after, ~h))
    return d, p, nearest, farthest, mix64(core + h)


def core_hash(codes, at, size, pick):
    out = np.zeros(len(at), np.uint64)
    if pick.any():
        out[pick] = rolling(codes, BASES[1], size)[at[pick]]
    return out


PACKED = "_bucket int, _chunk_key bigint, _chunk_dup int, _info binary, _hashes binary, _at binary"
REPLY = "_chunk_key bigint, _chunk_dup int, _info binary, _again binary, _hot binary"
PARTS = "_key bigint, _dup int, _parts binary"


def batch_of(schema: str, rows: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]
    cols = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], [n for n, _ in fields])


def groups_of(values: np.ndarray):
    """(order, cuts): a stable order by value and the bounds of equal runs in it."""
    order = np.argsort(values, kind="stable")
    s = values[order]
    return order, np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)]]) if len(s) else np.zeros(1, int)


def packed_cores(batches, buckets: int, chunk_bytes: int):
    import zstandard

    for keys, dups, data, off in chunks_of(batches, chunk_bytes):
        doc, p, near, far, core = halves(data, off)
        if not len(doc):
            continue
        order, cut = groups_of(core)
        size = np.diff(cut)
        first = order[cut[:-1]]                       # each core once
        local = np.repeat(size > 1, size)
        table = np.stack([keys[doc], dups[doc].astype(np.int64), p - off[doc], near, far])
        twin = np.zeros(len(doc), np.int64)
        twin[order] = np.repeat(first, size)          # the half that stands for this core here
        known = np.zeros(len(doc), np.int64)
        known[order[local]] = 1
        table = np.concatenate([table, twin[None], known[None]])
        info = zstandard.ZstdCompressor(1).compress(table.tobytes())
        rows = [(hash((int(keys[0]), int(dups[0]))) % buckets,
                 int(keys[0]), int(dups[0]), info, b"", pack(np.zeros(0, np.int64)))]
        first = np.sort(first)
        bucket = (core[first] % np.uint64(buckets)).astype(np.int64)
        order, cut = groups_of(bucket)
        for a, b in zip(cut[:-1], cut[1:]):
            own = first[order[a:b]]
            rows.append((int(bucket[order[a]]), int(keys[0]), int(dups[0]), None, core[own].tobytes(), pack(own)))
        yield batch_of(PACKED, rows)


def count_cores(table: pa.Table, hot_chunks: int) -> pa.Table:
    """Cores of a bucket that several, and that many, chunks hold, packed by chunk; descriptions pass
    through."""
    rows = list(zip(*[table.column(i).to_pylist() for i in range(1, 6)]))
    out = [(k, d, info, None, None) for k, d, info, _, _ in rows if info is not None]
    rows = [r for r in rows if r[2] is None]
    h = np.frombuffer(b"".join(r[3] for r in rows), np.uint64)
    order, cut = groups_of(h)
    chunks = np.zeros(len(h), np.int64)
    chunks[order] = np.repeat(np.diff(cut), np.diff(cut))
    at = 0
    for k, d, _, hashes, place in rows:
        own = chunks[at:at + len(hashes) // 8]
        at += len(own)
        if (own > 1).any():
            place = unpack(place)
            out.append((k, d, None, pack(place[own > 1]), pack(place[own > hot_chunks])))
    return pa.Table.from_batches([batch_of(REPLY, out)])


def candidate_parts(table: pa.Table) -> pa.Table:
    """Halves of one chunk whose core occurs again, by document: packed (anchor, nearest, farthest,
    whether the core is hot)."""
    import zstandard

    raw = next(x for x in table.column(2).to_pylist() if x is not None)
    key, dup, p, near, far, twin, known = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.int64).reshape(7, -1)
    again = known.astype(bool)
    mark, hot = np.zeros(len(key), bool), np.zeros(len(key), bool)
    for flags, column in ((mark, 3), (hot, 4)):
        for x in table.column(column).to_pylist():
            if x is not None:
                flags[unpack(x)] = True
    pick = np.flatnonzero(again | mark[twin])
    out = []
    if len(pick):
        change = (key[pick][1:] != key[pick][:-1]) | (dup[pick][1:] != dup[pick][:-1])
        cut = np.flatnonzero(np.append(True, change))
        parts = np.stack([p, near, far, hot[twin].astype(np.int64)], 1)[pick]
        for a, b in zip(cut, [*cut[1:], len(pick)]):
            out.append((int(key[pick[a]]), int(dup[pick[a]]), np.ascontiguousarray(parts[a:b], np.int64).tobytes()))
    return pa.Table.from_batches([batch_of(PARTS, out)])


RUNS = "_bucket int, _piece_key bigint, _piece_dup int, _bytes binary, _sizes binary, _hits binary"


def packed_runs(batches, buckets: int, chunk_bytes: int = CHUNK_BYTES):
    """Bytes of candidate halves by bucket of their core; what is equal travels once per piece. Of hot
    ones, the digests of their strings; what the piece needs to find these again is a row of its own."""
    import zstandard
    from xxhash import xxh64_intdigest

    squeeze = zstandard.ZstdCompressor(1).compress
    for batch in batches:
        keys, dups = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, off = buffers(batch.column(2))
        for a, b in pieces(off, chunk_bytes):
            held: dict[int, tuple] = {}
            hot_runs: dict[tuple, int] = {}
            hot_hits = []
            for i in range(a, b):
                text = data[off[i]:off[i + 1]].tobytes()
                for p, near, far, hot in np.frombuffer(batch.column(3)[i].as_py(), np.int64).reshape(-1, 4).tolist():
                    run = (text[p - far:p - near + LENGTH], near, far)
                    if hot:
                        hot_hits.append((hot_runs.setdefault(run, len(hot_runs)), keys[i], dups[i], p))
                        continue
                    core = text[p - HALF - 1:p + GRAM] if far > HALF else text[p:p + LENGTH - HALF]
                    bucket = xxh64_intdigest(core, int(far > HALF)) % buckets
                    runs, hits = held.setdefault(bucket, ({}, []))
                    hits.append((runs.setdefault(run, len(runs)), keys[i], dups[i], p))
            rows = [(bucket, None, None, squeeze(b"".join(r[0] for r in runs)),
                     np.array([r[1:] for r in runs], np.int64).tobytes(),
                     squeeze(np.array(hits, np.int64).T.tobytes())) for bucket, (runs, hits) in held.items()]
            piece = int(keys[a]), int(dups[a])
            rows += [(bucket, *piece, raw, None, at) for bucket, raw, at in hot_strings(hot_runs, hot_hits, piece, buckets)]
            if rows:
                yield batch_of(RUNS, rows)


def hot_strings(runs: dict, hits: list, piece: tuple, buckets: int):
    """(bucket, digests, their numbers) of the different strings of a piece's hot runs, without their
    occurrences; and (bucket, table of runs, strings and occurrences, None), which goes back to the piece."""
    import hashlib

    import zstandard
    from xxhash import xxh64_intdigest

    if not runs:
        return
    seen: dict[bytes, int] = {}
    sent: dict[int, tuple] = {}
    number = []
    for text, near, far in runs:
        low = -1
        for d in range(near, far + 1):
            digest = hashlib.blake2b(text[far - d:far - d + LENGTH], digest_size=DIGEST).digest()
            if d - d % HOT_RANGE != low:
                low = d - d % HOT_RANGE
                shared = text[far - low:far - low - HOT_RANGE + 1 + LENGTH]
                digests, at = sent.setdefault(xxh64_intdigest(shared, 2 + low) % buckets, ([], []))
            if digest not in seen:
                digests.append(digest)
                at.append(len(seen))
            number.append(seen.setdefault(digest, len(seen)))
    ranges = np.array([r[1:] for r in runs], np.int64).ravel()
    table = np.concatenate([[len(runs), len(number)], ranges, number, np.array(hits, np.int64).T.ravel()])
    yield hash(piece) % buckets, zstandard.ZstdCompressor(1).compress(table.astype(np.int64).tobytes()), None
    for bucket, (digests, at) in sent.items():
        yield bucket, b"".join(digests), pack(np.array(at, np.int64))


COVER = "_key bigint, _dup int, _spans binary"


def repeated_strings(data: np.ndarray, start: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """[run, d - GRAM-free index]: whether the string at distance d of a run equals that of another run.

    The matrix has a column per distance 0..LENGTH - GRAM."""
    n, width = len(start), LENGTH - GRAM + 1
    out = np.zeros((n, width), bool)
    if n < 2:
        return out
    anchor = start + far
    order_r, same_r = deep_shallow(data, anchor, LENGTH - near)
    order_l, same_l = deep_shallow(np.ascontiguousarray(data[::-1]), len(data) - anchor, far)
    class_r, class_l = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d in range(int(near.min()), int(far.max()) + 1):
        own = np.flatnonzero((near <= d) & (d <= far))
        if len(own) < 2:
            continue
        class_r[order_r] = np.cumsum(same_r < LENGTH - d)
        class_l[order_l] = np.cumsum(same_l < d)
        both = class_r[own] * (n + 1) + class_l[own]
        order = np.argsort(both)
        s = both[order]
        twin = s[1:] == s[:-1]
        if twin.any():
            out[own[order[1:][twin]], d] = True
            out[own[order[:-1][twin]], d] = True
    return out


FOUND = "_key bigint, _dup int, _spans binary, _table binary, _again binary"


def order_bucket(table: pa.Table) -> pa.Table:
    """Covered byte intervals, by document, that the runs of one bucket show; by piece, the numbers of
    digests that other pieces hold too. Tables of pieces pass through."""
    rows = list(zip(*[table.column(i).to_pylist() for i in range(1, 6)]))
    out = [(k, d, None, raw, None) for k, d, raw, size, at in rows if size is None and at is None]
    strings = [(k, d, raw, at) for k, d, raw, size, at in rows if size is None and at is not None]
    out += [(k, d, None, None, again) for k, d, again in shared_digests(strings)]
    runs = [(raw, size, found) for _, _, raw, size, found in rows if size is not None]
    out += [(k, d, spans, None, None) for k, d, spans in order_runs(runs)]
    return pa.Table.from_batches([batch_of(FOUND, out)])


def shared_digests(rows: list) -> list:
    """(piece, number of the row among its pieces, packed numbers) of digests that several rows hold."""
    if len(rows) < 2:
        return []
    held = np.frombuffer(b"".join(r[2] for r in rows), f"V{DIGEST}")
    words = held.view(np.uint64).reshape(-1, DIGEST // 8)
    order = np.lexsort(words.T)
    twin = (words[order[1:]] == words[order[:-1]]).all(1)
    shared = np.zeros(len(held), bool)
    shared[order[1:][twin]] = True
    shared[order[:-1][twin]] = True
    out, at = [], 0
    for k, d, raw, place in rows:
        own = shared[at:at + len(raw) // DIGEST]
        at += len(own)
        if own.any():
            out.append((k, d, pack(unpack(place)[own])))
    return out


def order_runs(rows: list) -> list:
    """(document, number, packed intervals) that the byte runs of a bucket cover."""
    import zstandard

    if not rows:
        return []
    open_ = zstandard.ZstdDecompressor().decompress
    texts, ranges, hits, base = [], [], [], 0
    for raw, sizes, found in rows:
        size = np.frombuffer(sizes, np.int64).reshape(-1, 2)
        texts.append(open_(raw))
        ranges.append(size)
        hit = np.frombuffer(open_(found), np.int64).reshape(4, -1).copy()
        hit[0] += base
        base += len(size)
        hits.append(hit)
    data = np.frombuffer(b"".join(texts), np.uint8)
    near, far = np.concatenate(ranges).T
    hits = np.concatenate(hits, 1)
    size = LENGTH + far - near
    start = np.cumsum(size) - size
    # Equal runs become one entry with a count.
    seen: dict[tuple, int] = {}
    entry = np.array([seen.setdefault((data[s:s + k].tobytes(), x, y), len(seen))
                      for s, k, x, y in zip(start.tolist(), size.tolist(), near.tolist(), far.tolist())], np.int64)
    pick = np.unique(entry, return_index=True)[1]
    start, near, far = start[pick], near[pick], far[pick]
    owner = entry[hits[0]]
    many = np.bincount(owner, minlength=len(pick)) > 1
    flags = repeated_strings(data, start, near, far)
    place = np.arange(flags.shape[1])
    flags[many] |= (place >= near[many][:, None]) & (place <= far[many][:, None])
    return covered(flags, owner, *hits[1:])


def covered(flags: np.ndarray, owner: np.ndarray, key: np.ndarray, dup: np.ndarray, p: np.ndarray) -> list:
    """(document, number, packed intervals) that the flagged distances of runs cover at their occurrences."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    run, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    first = np.searchsorted(run, np.arange(len(flags) + 1))
    count = np.diff(first)[owner]
    hit = np.repeat(np.arange(len(owner)), count)
    which = np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count) + first[owner[hit]]
    key, dup, p = key[hit], dup[hit], p[hit]
    a, b = p - high[which], p - low[which] + LENGTH
    order = np.lexsort((a, dup, key))
    key, dup, a, b = key[order], dup[order], a[order], b[order]
    cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (dup[1:] != dup[:-1]))) if len(key) else []
    return [(int(key[i]), int(dup[i]), pack_spans(a[i:j], b[i:j])) for i, j in zip(cut, [*cut[1:], len(key)])]


def expand_piece(table: pa.Table) -> pa.Table:
    """Covered intervals, by document, of the hot runs of one piece: the strings that other pieces hold
    too or that occur in it twice, at all their occurrences."""
    import zstandard

    raw = next(x for x in table.column(3).to_pylist() if x is not None)
    held = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.int64)
    runs, strings = held[:2].tolist()
    near, far = held[2:2 + 2 * runs].reshape(-1, 2).T
    number = held[2 + 2 * runs:2 + 2 * runs + strings]
    owner, *places = held[2 + 2 * runs + strings:].reshape(4, -1)
    width = far - near + 1
    run = np.repeat(np.arange(runs), width)
    distance = np.arange(strings) - np.repeat(np.cumsum(width) - width, width) + near[run]
    again = np.bincount(number, weights=np.bincount(owner, minlength=runs)[run]) > 1
    for x in table.column(4).to_pylist():
        if x is not None:
            again[unpack(x)] = True
    flags = np.zeros((runs, LENGTH - GRAM + 1), bool)
    flags[run, distance] = again[number]
    return pa.Table.from_batches([batch_of(COVER, covered(flags, owner, *places))])


def covered_spans(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES, hot_chunks: int = HOT_CHUNKS) -> DataFrame:
    """(_key, _dup, _spans list) of numbered documents that lose bytes."""
    buckets = max(partitions(rows.sparkSession), text_bytes(rows, "_text") // BUCKET_BYTES)
    cores = rows.mapInArrow(lambda batches: packed_cores(batches, buckets, chunk_bytes), PACKED)
    replies = cores.groupBy("_bucket").applyInArrow(lambda t: count_cores(t, hot_chunks), REPLY)
    parts = save(replies.groupBy("_chunk_key", "_chunk_dup").applyInArrow(candidate_parts, PARTS), "candidates")
    runs = (rows.join(parts, ["_key", "_dup"]).select("_key", "_dup", "_text", "_parts")
            .mapInArrow(lambda batches: packed_runs(batches, buckets, chunk_bytes), RUNS))
    found = save(runs.groupBy("_bucket").applyInArrow(order_bucket, FOUND), "found")
    hot = found.where("_spans is null").groupBy("_key", "_dup").applyInArrow(expand_piece, COVER)
    spans = found.where("_spans is not null").select("_key", "_dup", "_spans").union(hot)
    return save(spans.groupBy("_key", "_dup").agg(F.collect_list("_spans").alias("_spans")), "covered")


def cut_text(text: bytes, found: list[bytes] | None) -> tuple[bytes, np.ndarray]:
    """(remaining bytes, maximal removed intervals)."""
    spans = np.concatenate([unpack_spans(x) for x in found]) if found else np.zeros((0, 2), np.int64)
    if not len(spans):
        return text, spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    cut = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    merged = np.stack([spans[cut, 0], reach[np.append(cut[1:], len(spans)) - 1]], 1)
    out, at = [], 0
    for a, b in merged.tolist():
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]), merged


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES,
          hot_chunks: int = HOT_CHUNKS) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, spans (packed intervals), kept (bytes)."""
    rows = numbered(docs, id_col, text_col)
    joined = rows.join(covered_spans(rows, chunk_bytes, hot_chunks), ["_key", "_dup"], "left").select("_key", "_text", "_spans")

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                out = []
                for key, text, found in zip(*[part.column(i).to_pylist() for i in range(3)]):
                    keep, spans = cut_text(text, found)
                    out.append((key, len(text), len(text) - len(keep), len(spans), spans.tobytes(), keep))
                yield batch_of(KEPT, out)
    return joined.mapInArrow(run, KEPT).select(restored().alias(id_col), "n_bytes", "n_removed", "n_spans", "spans", "kept")


KEPT = "_key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans binary, kept binary"


def op6_suffix_dedup(spark, sf_dir):
    return digest(dedup(read(spark, sf_dir, "documents")))


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
