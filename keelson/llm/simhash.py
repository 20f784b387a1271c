"""SimHash near-dedup over a byte-position inverted index with count filtering.

Fingerprints within 4 bits differ in at most 4 of their 8 bytes, so they share at least 4
positional bytes. Lists of single positional bytes would grow with the table (there are only
8 x 256 of them), so a list is keyed by three positional bytes: 20 position triples are enough for
any 4 of the 8 positions to contain one of them. Inside a list the shared positional bytes of each
pair are tallied, pairs that reach the guaranteed minimum stay, and their bit distance is verified.

Equal fingerprints are one entry of the index, so copies cost nothing. A list longer than ``BLOCK``
is split into blocks, and every two blocks meet in a task of their own. A list gives a spanning
forest of its verified links (they serve components), never all of them.

Rules: a null text is the empty text; no words give fingerprint zero, which links like any other; up
to the shingle length of words give one shingle. A null id takes part in its group and is never its
smallest id, unless all are null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import boxed, partitions, read, save, unbounded
from keelson.llm.components import stars

SHINGLE = 4
MAX_BITS = 4
BYTES = 8
SEED = 42
BLOCK = 4096
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a UTF-8 text: A-Z lower-cased, word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z only; ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return int(np.array([xxh64_intdigest(line, SEED)], np.uint64).view(np.int64)[0])
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size)
    starts = (ends - size)[:len(words) - shingle + 1].tolist()
    ends = (ends[shingle - 1:] - 1).tolist()
    tally = np.zeros(64, np.int64)
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        span = zip(starts[at:at + SHINGLES_AT_ONCE], ends[at:at + SHINGLES_AT_ONCE])
        h = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in span], np.uint64)
        tally += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(tally * 2 > len(starts), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(_id, _hash, _fp); the hash of the text tells rows apart that share an identifier."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"),
                        text_hash(text_col).alias("_hash"))

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            fp = np.fromiter((fingerprint(column[i].as_py(), shingle) for i in range(len(column))), np.int64, len(column))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp)], ["_id", "_hash", "_fp"])
    return texts.mapInArrow(run, f"_id {kind}, _hash bigint, _fp bigint")


def text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def covering_triples() -> list[tuple[int, int, int]]:
    """Triples of the 8 positions such that any 4 positions contain one: three groups, triples inside
    a group and two of a group with one of the next."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [t for g in groups for t in combinations(g, 3)]
    for i, g in enumerate(groups):
        out += [(*two, one) for two in combinations(g, 2) for one in groups[(i + 1) % 3]]
    return out


def index_entries(fps: DataFrame) -> DataFrame:
    """(_key, _fp): one entry for each triple of positional bytes of each distinct fingerprint."""
    def byte(p):
        return F.shiftrightunsigned(F.col("_fp"), 8 * p).bitwiseAND(F.lit(255).cast("long"))

    keys = [byte(a) + byte(b) * 256 + byte(c) * 65536 + F.lit(i << 24).cast("long")
            for i, (a, b, c) in enumerate(covering_triples())]
    return fps.select("_fp", F.explode(F.array(*keys)).alias("_key"))


def verified(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs share enough positional bytes and are close enough."""
    x = (a ^ b).view(np.uint64)  # a signed number would be counted by its absolute value
    out = np.zeros(len(x), bool)
    shared = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(1)
    reach = np.flatnonzero(shared >= BYTES - max_bits)
    out[reach] = np.bitwise_count(x[reach]) <= max_bits
    return out


def forest(fp: np.ndarray, side: np.ndarray | None, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the verified links of one list, taken in strips of pairs."""
    parent = list(range(len(fp)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    strip = max(1, (1 << 20) // max(len(fp), 1))
    for a in range(0, len(fp), strip):
        i, j = np.meshgrid(np.arange(a, min(a + strip, len(fp))), np.arange(a, len(fp)), indexing="ij")
        pick = i < j
        if side is not None:
            pick &= side[i] != side[j]
        i, j = i[pick], j[pick]
        hit = np.flatnonzero(verified(fp[i], fp[j], max_bits))
        for x, y in zip(i[hit].tolist(), j[hit].tolist()):
            x, y = root(x), root(y)
            if x != y:
                parent[y] = x
                out.append((x, y))
    # linked roots stand for their trees: an edge between members of the same two trees
    return [(int(fp[x]), int(fp[y])) for x, y in out]


def list_links(batches, max_bits: int):
    """Links of all lists of a sorted partition; columns _key, _i, _j, _side, _fp."""
    def emit(key, fp, side, mixed):
        edges = []
        cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
        size = np.diff(np.append(cut, len(fp)))
        for n in np.unique(size[size > 1]).tolist():
            starts = cut[size == n]
            if n <= 32:  # equal short lists at once
                i, j = np.triu_indices(n, 1)
                a, b = (starts[:, None] + i).ravel(), (starts[:, None] + j).ravel()
                ok = verified(fp[a], fp[b], max_bits) & (~mixed[a] | (side[a] != side[b]))
                edges.append(np.stack([fp[a[ok]], fp[b[ok]]], 1))
            else:
                for s in starts.tolist():
                    own = slice(s, s + n)
                    found = forest(fp[own], side[own] if mixed[s] else None, max_bits)
                    edges.append(np.array(found, np.int64).reshape(-1, 2))
        rows = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["a", "b"])

    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)], 1)
        held.append(rows)
        if (rows[0, :3] == rows[-1, :3]).all():
            continue  # one list so far: wait for its end
        rows = np.concatenate(held)
        end = int(np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(1))[-1]) + 1
        held = [rows[end:]]
        done = rows[:end]
        yield emit(done[:, :3], np.ascontiguousarray(done[:, 4]), done[:, 3], done[:, 1] != done[:, 2])
    if held:
        rows = np.concatenate(held)
        yield emit(rows[:, :3], np.ascontiguousarray(rows[:, 4]), rows[:, 3], rows[:, 1] != rows[:, 2])


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints (column _fp) that connect all that are close."""
    spark = fps.sparkSession
    if not 0 <= max_bits <= 4:
        raise ValueError("the index guarantees a shared triple up to 4 differing bits")
    entries = index_entries(fps)
    zero = F.lit(0).cast("long")
    long_lists = save(entries.groupBy("_key").count().where(F.col("count") > block)
                      .select("_key", F.ceil(F.col("count") / block).alias("_blocks")), "long-lists")
    if long_lists.isEmpty():
        dealt = entries.select("_key", zero.alias("_i"), zero.alias("_j"), zero.alias("_side"), "_fp")
    else:
        side = F.pmod(F.xxhash64("_fp"), F.col("_blocks"))
        dealt = (entries.join(long_lists, "_key", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
                 .withColumn("_side", side)
                 .withColumn("_other", F.explode(F.sequence(zero, F.col("_blocks") - 1)))
                 .select("_key", F.least("_side", "_other").alias("_i"), F.greatest("_side", "_other").alias("_j"),
                         "_side", "_fp"))
    dealt = dealt.repartition(partitions(spark), "_key", "_i", "_j").sortWithinPartitions("_key", "_i", "_j", "_fp")
    return dealt.mapInArrow(lambda batches: list_links(batches, max_bits), "a bigint, b bigint")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: id, _hash, _fp, component_id."""
    prints = save(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = save(prints.groupBy("_fp").agg(F.min("_id").alias("_rep")), "distinct-fingerprints")
    star = stars(links(fps.select("_fp"), max_bits))
    of = fps.join(star, fps["_fp"] == star["node"], "left").select(
        "_fp", "_rep", F.coalesce("least", "_fp").alias("_least"))
    named = of.groupBy("_least").agg(F.min("_rep").alias("component_id"))
    groups = save(of.select("_fp", "_least").join(named, "_least").select("_fp", "component_id"), "fingerprint-groups")
    return prints.join(groups, "_fp").select(F.col("_id").alias(id_col), "_hash", "_fp", "component_id")


def op2_simhash_dedup(spark, sf_dir):
    return simhash_components(read(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each component, with its columns as they are."""
    gone = save(simhash_components(docs, id_col, text_col)
                .where(~F.col(id_col).eqNullSafe(F.col("component_id")))
                .select(F.col(id_col).alias("_gone"), "_hash").distinct(), "near-copies")
    rows = boxed(docs, key=F.col(id_col), hash=text_hash(text_col))
    return rows.join(unbounded(gone), rows["key"].eqNullSafe(gone["_gone"]) & (rows["hash"] == gone["_hash"]), "left_anti").select("row.*")
