"""Byte-level BPE encoding and decoding.

Pre-tokenisation finds the pieces of the pattern that public rank files use,
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``, without a
regex. Every code point becomes a symbol (its class, and for white space and apostrophes what
follows); a symbol is a transition function over eight states. The functions under composition
form a small monoid, so a blocked prefix scan over element numbers gives the state before every
character at once, and (state, symbol) tells whether a piece starts there.

The slices between boundaries feed pair merging by rank through a cache. Each token keeps the
offset of its first byte in the text; decoding places vocabulary bytes by those offsets.

Rules: a null text is the empty text and has no tokens. No special tokens: their strings are
ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import pieces, read

L, N, O, SPACE, WHITE = range(5)
#: Code points with the White_Space property. Fixed values.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and numbers that Unicode 16 adds, which older ``unicodedata`` lacks. Fixed values.
NEW_LETTERS = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F,
    0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100,
    0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0,
    0x1CCF9), (0x1E5F1, 0x1E5FA))
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

#: States: nothing open; in letters; in numbers; in others; one space that joins what follows; in
#: white space; one or two characters of a contraction to come.
S_NEW, S_L, S_N, S_O, S_JOIN, S_WHITE, S_ONE, S_TWO = range(8)
#: Symbols: classes; apostrophe before a contraction of one or two letters; white space before
#: white space or the end; a space before something else; other white space before something else.
Y_L, Y_N, Y_O, Y_ONE, Y_TWO, Y_RUN, Y_JOIN, Y_ALONE = range(8)
SYMBOLS = 8
BLOCK = 64
TEXT_LIMIT = 1 << 20
SLICES = 1 << 17
CACHE = 150_000
WIDE = 64
NONE = 1 << 30


def step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a piece starts at this character)."""
    if state in (S_ONE, S_TWO):
        return (S_NEW if state == S_ONE else S_ONE), False
    if symbol in (Y_L, Y_N, Y_O):
        own = (S_L, S_N, S_O)[symbol]
        return own, state not in (own, S_JOIN)
    if symbol in (Y_ONE, Y_TWO):
        if state in (S_O, S_JOIN):
            return S_O, False
        return (S_ONE if symbol == Y_ONE else S_TWO), True
    if symbol == Y_RUN:
        return S_WHITE, state != S_WHITE
    return (S_JOIN if symbol == Y_JOIN else S_NEW), True


@lru_cache(maxsize=1)
def machine():
    """(generator of each symbol, composition table, action, starts). Symbols 8-15 are the same
    at the first character of a text, where nothing is open."""
    functions = []
    starts = np.zeros((8, 2 * SYMBOLS), bool)
    for y in range(2 * SYMBOLS):
        moves = [step(s if y < SYMBOLS else S_NEW, y % SYMBOLS) for s in range(8)]
        functions.append(tuple(m[0] for m in moves))
        starts[:, y] = [m[1] for m in moves]
    number = {tuple(range(8)): 0}
    todo = [tuple(range(8))]
    while todo:
        f = todo.pop()
        for g in functions:
            h = tuple(g[x] for x in f)
            if h not in number:
                number[h] = len(number)
                todo.append(h)
    act = np.array(list(number), np.uint8)
    k = len(act)
    table = np.zeros((k, k), np.uint16)
    for i, f in enumerate(act):
        composed = act[:, f]  # composed[j] = element j after element i
        table[i] = [number[tuple(c)] for c in composed.tolist()]
    return np.array([number[f] for f in functions], np.uint16), table.ravel(), act.ravel(), starts.ravel(), k


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    kind = {"L": L, "N": N}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], O) for c in range(0x110000)), np.uint8, 0x110000)
    for own, ranges in ((L, NEW_LETTERS), (N, NEW_NUMBERS)):
        for a, b in ranges:
            table[a:b + 1] = own
    table[WHITE_SPACE] = WHITE
    table[0x20] = SPACE
    return table


def scan(elements: np.ndarray, table: np.ndarray, k: int) -> np.ndarray:
    """Inclusive prefix composition: blocks in step, then their totals, then both together."""
    n = len(elements)
    if n <= BLOCK:
        out = elements.copy()
        for i in range(1, n):
            out[i] = table[int(out[i - 1]) * k + out[i]]
        return out
    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, np.uint16)  # 0 is the identity
    grid[:n] = elements
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    for j in range(1, BLOCK):
        grid[j] = table[grid[j - 1].astype(np.int32) * k + grid[j]]
    before = np.zeros(rows, np.int32)
    before[1:] = scan(grid[-1], table, k)[:-1]
    return table[before[None, :] * k + grid].T.reshape(-1)[:n]


def symbols(points: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol of each code point, apostrophes that may open a contraction); ``firsts`` are the
    positions where a text begins."""
    n = len(points)
    out = classes()[points]
    white = np.flatnonzero(out >= SPACE)
    last = np.zeros(n, bool)
    last[firsts[1:] - 1] = True
    last[-1] = True
    runs = last[white]
    runs[:-1] |= white[1:] == white[:-1] + 1
    space = out[white] == SPACE
    quotes = np.flatnonzero(points == 0x27)
    found = []
    if len(quotes):
        one = np.where(quotes + 1 < n, points[np.minimum(quotes + 1, n - 1)], 0)
        two = np.where(quotes + 2 < n, points[np.minimum(quotes + 2, n - 1)], 0)
        end1, end2 = last[quotes], last[np.minimum(quotes + 1, n - 1)]
        for c in CONTRACTIONS:
            hit = (one == ord(c[0])) & ~end1
            if len(c) == 2:
                hit &= (two == ord(c[1])) & ~end2
            found.append((quotes[hit], Y_ONE if len(c) == 1 else Y_TWO))
    out[white] = np.where(runs, Y_RUN, np.where(space, Y_JOIN, Y_ALONE))
    for at, y in found:
        out[at] = y
    out[firsts] += SYMBOLS
    return out, np.concatenate([at for at, _ in found]) if found else quotes


def boundaries(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Positions where a piece starts, over texts laid end to end (none of them empty).

    Away from contractions a repeated symbol changes nothing (its function is idempotent there and
    a piece never starts inside such a run of letters, numbers, others or white space), so the scan
    runs over the positions where the symbol changes."""
    gen, table, act, starts, k = machine()
    y, quotes = symbols(points, firsts)
    keep = np.ones(len(y), bool)
    keep[1:] = y[1:] != y[:-1]
    alone = y % SYMBOLS
    keep |= (alone == Y_ALONE) | (alone == Y_JOIN)
    for d in range(4):
        keep[np.minimum(quotes + d, len(y) - 1)] = True
    keep[np.minimum(firsts + 1, len(y) - 1)] = True
    at = np.flatnonzero(keep)
    y = y[at]
    prefix = scan(gen[y], table, k)
    state = np.zeros(len(y), np.int32)
    state[1:] = act[prefix[:-1].astype(np.int32) * 8 + S_NEW]
    return at[starts[state * (2 * SYMBOLS) + y]]


class Merger:
    """Pair merging by rank, many pieces at a time, behind a bounded cache of pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.cache: dict[str, tuple] = {}
        single = [ranks[bytes([b])] for b in range(256)]
        self.single = np.array(single, np.int32)
        pairs = {}
        for word, r in ranks.items():
            for i in range(1, len(word)):
                a, b = ranks.get(word[:i]), ranks.get(word[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[x] for x in self.keys.tolist()], np.int32)
        self.bytes2 = np.full((256, 256), NONE, np.int32)
        for word, r in ranks.items():
            if len(word) == 2:
                self.bytes2[word[0], word[1]] = r

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens; NONE where it is no token (or one side is missing)."""
        key = left.astype(np.int64) << 32 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], NONE)

    def learn(self, found: set[str]) -> None:
        by_size: dict[int, list] = {}
        for piece in found:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.cache[piece] = (whole,)
            elif len(raw) > WIDE:
                self.cache[piece] = tuple(merge(raw, self.ranks))
            else:
                by_size.setdefault(-(-len(raw) // 4) * 4, []).append((piece, raw))
        for width, rows in by_size.items():
            self.merge_rows([p for p, _ in rows], [r for _, r in rows], width)

    def merge_rows(self, names: list[str], rows: list[bytes], width: int) -> None:
        """One matrix row per piece; a round merges the lowest (then leftmost) pair of every row."""
        n = len(rows)
        raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(n, width)
        size = np.fromiter(map(len, rows), np.int64, n)
        place = np.arange(width)
        ids = np.where(place < size[:, None], self.single[raw], -1)
        rank = self.bytes2[raw[:, :-1], raw[:, 1:]]
        rank[place[1:] >= size[:, None]] = NONE
        rank = np.hstack([rank, np.full((n, 1), NONE, np.int32)])  # rank[:, i]: tokens i and i + 1
        live = np.arange(n)
        while len(live):
            best = rank.argmin(1)
            low = rank[np.arange(len(live)), best]
            done = low == NONE
            if done.any():
                for i, row in zip(live[done].tolist(), ids[done].tolist()):
                    self.cache[names[i]] = tuple(row[:row.index(-1)] if -1 in row else row)
                live, ids, rank, best, low = live[~done], ids[~done], rank[~done], best[~done], low[~done]
            i = np.arange(len(live))
            move = place > best[:, None]
            ids = np.where(move, np.hstack([ids[:, 1:], np.full((len(live), 1), -1, ids.dtype)]), ids)
            rank = np.where(move, np.hstack([rank[:, 1:], np.full((len(live), 1), NONE, rank.dtype)]), rank)
            ids[i, best] = low
            right = np.minimum(best + 1, width - 1)
            rank[i, best] = np.where(best + 1 < width, self.rank(low, ids[i, right]), NONE)
            prior = best > 0
            rank[i[prior], best[prior] - 1] = self.rank(ids[i[prior], best[prior] - 1], low[prior])

    def __call__(self, found: list[str]) -> list[tuple]:
        """Token ids of each piece."""
        missing = set(found) - self.cache.keys()
        if missing:
            if len(self.cache) + len(missing) > CACHE:
                self.cache.clear()
                missing = set(found)
            self.learn(missing)
        return list(map(self.cache.__getitem__, found))


def merge(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of lowest rank, leftmost first, until none is in the ranks."""
    n = len(raw)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # part i is raw[i:after[i]]
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i:i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n

    def offer(i):
        j = after[i]
        if j < n and (r := ranks.get(raw[i:after[j]])) is not None:
            heapq.heappush(heap, (r, i, after[j]))

    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or after[j] != end:
            continue
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[raw[i:after[i]]])
        i = after[i]
    return out


class Codec:
    def __init__(self, vocabulary: bytes):
        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in vocabulary.splitlines() if line)}
        self.merge = Merger(self.ranks)
        size = max(self.ranks.values()) + 1
        words = [b""] * size
        for t, r in self.ranks.items():
            words[r] = t
        self.length = np.fromiter(map(len, words), np.int64, size)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(words), np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all texts end to end, token offsets of the texts)."""
        joined = "".join(texts)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(size)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        cut = boundaries(points, (ends - size)[size > 0])
        per_piece, found = np.zeros(len(cut), np.int64), []
        for a in range(0, len(cut), SLICES):
            part = cut[a:a + SLICES].tolist()
            stop = int(cut[a + SLICES]) if a + SLICES < len(cut) else len(joined)
            ids = self.merge([joined[i:j] for i, j in zip(part, [*part[1:], stop])])
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            per_piece[a:a + SLICES] = counts
            found.append(np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum())))
        total = np.concatenate([[0], np.cumsum(per_piece)])
        return np.concatenate(found), total[np.concatenate([[0], np.searchsorted(cut, ends)])]

    def offsets(self, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offset of each token's first byte in its text, byte offsets of the texts)."""
        ends = np.cumsum(self.length[ids])
        at = np.concatenate([[0], ends])
        base = at[rows]
        return (at[:-1] - np.repeat(base[:-1], np.diff(rows))).astype(np.int32), base

    def decode(self, ids: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts end to end, their byte offsets): every token's bytes go to the
        offset that encoding kept."""
        size = self.length[ids]
        ends = np.zeros(len(rows) - 1, np.int64)
        full = np.diff(rows) > 0
        final = rows[1:][full] - 1
        ends[full] = at[final] + size[final]
        base = np.concatenate([[0], np.cumsum(ends)])
        place = np.repeat(base[:-1], np.diff(rows)) + at
        out = np.zeros(base[-1], np.uint8)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(place, size) + inside] = self.bytes[np.repeat(self.start[ids], size) + inside]
        return out, base


@lru_cache(maxsize=2)
def codec(vocabulary: bytes) -> Codec:
    return Codec(vocabulary)


def vocabulary_file(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str | None) -> bytes:
    with open(path or vocabulary_file(), "rb") as f:
        return f.read()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           decoded: bool = False) -> DataFrame:
    """One row per document: id, ids, offsets (and the decoded bytes). ``path`` is the rank file,
    read on the driver; its bytes (under 1 MB) travel with the tasks."""
    ranks = docs.sparkSession.sparkContext.broadcast(load(path))
    out = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = out.schema["_id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids array<int>, offsets array<int>" + ", decoded binary" * decoded

    def run(batches):
        coder = codec(ranks.value)
        for batch in batches:
            texts = batch.column(1)
            size = np.concatenate([[0], np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False))])
            for a, b in pieces(size, TEXT_LIMIT):
                ids, rows = coder.encode(texts.slice(a, b - a).to_pylist())
                at, _ = coder.offsets(ids, rows)
                rows32 = pa.array(rows.astype(np.int32))
                cols = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(rows32, pa.array(ids)),
                        pa.ListArray.from_arrays(rows32, pa.array(at))]
                if decoded:
                    raw, base = coder.decode(ids, at, rows)
                    cols.append(pa.Array.from_buffers(pa.binary(), b - a, [
                        None, pa.py_buffer(base.astype(np.int32)), pa.py_buffer(raw)]))
                yield pa.RecordBatch.from_arrays(cols, [id_col, "ids", "offsets", "decoded"][:len(cols)])
        coder.merge.cache.clear()  # a worker lives on and serves other stages
    return out.mapInArrow(run, schema)


def decode(encoded: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """One row per document: id and the bytes its ids and offsets stand for."""
    ranks = encoded.sparkSession.sparkContext.broadcast(load(path))
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = codec(ranks.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                ids, at = (batch.column(k).slice(a, 256) for k in (1, 2))
                rows = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False))])
                raw, base = coder.decode(ids.flatten().to_numpy(), at.flatten().to_numpy(), rows)
                out = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(base.astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 256), out], [id_col, "decoded"])
    return encoded.select(id_col, "ids", "offsets").mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def op5_byte_bpe(spark, sf_dir):
    return digest(read(spark, sf_dir, "documents"))


def digest(docs: DataFrame) -> DataFrame:
    return encode(docs, decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
