"""MinHash near-dedup by bottom-k sketches from one hash function.

A document is its set of distinct word shingles; its sketch holds the ``SKETCH`` smallest hashes of
that set. Two sets with similarity J share at least ``needed`` of them: for sets of up to some 200
shingles that is certain (few elements can differ), beyond it fails with probability below ``LOSS``
for a pair, over the choice of the hash function.

1. Equal sets become one node; the copies cost nothing further.
2. Inverted lists are kept of retained values that two or more nodes hold. A pair must share
   ``needed`` values, so a node only enters the lists of its rarest values: as many as leave fewer
   than ``needed`` out. A node with enough values of its own enters none, however common the rest are.
3. The leader of each list (the node with most shared values) meets every other member: linear in
   the list. Verified links make components.
4. In lists that still span several components all pairs of different components meet, long lists
   in blocks that go to tasks of their own, with sketches of ``LONG`` values; the first list that
   two nodes share answers for them. Only pairs that the union-sketch estimate lets through leave the task; where the sketches are whole sets the estimate is
   exact, and a forest of the links is enough.
5. Every candidate pair is verified by the exact Jaccard of the full shingle sets, compared as
   words, not hashes.

Links of steps 3 and 5 connect all linked documents: pairs inside a component need no check. A list of n
nodes that differ is n * n / 2 estimates in tasks of ``BLOCK`` squared; it emits candidates only.

Rules: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``; fewer words than the shingle length make one
shingle; null, empty and white texts have no set and link with nothing. A null id takes part in its
group and is never its smallest id, unless all are null. Rows that share an id are rows of their own.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import mix64, partitions, read, save, unbounded
from keelson.llm.components import stars

SHINGLE = 3
#: Similarity in percent.
PERCENT = 85
SKETCH = 64
#: Sketch of nodes in lists that leaders left open.
LONG = 256
LOSS = 1e-12
BLOCK = 2048
#: Members that meet their leader in one task.
PARTY = 512


@lru_cache(maxsize=8)
def surely_shared(k: int, percent: int) -> int:
    """Largest t such that a similar pair shares fewer than t of k values with probability under LOSS."""
    p, tail = percent / 100, 0.0
    for t in range(k + 1):
        tail += comb(k, t) * p ** t * (1 - p) ** (k - t)
        if tail > LOSS:
            return t
    return k


def needed(n: np.ndarray, k: int = SKETCH, percent: int = PERCENT) -> np.ndarray:
    """Retained values that a set of n shingles shares with any similar set at least."""
    n = np.asarray(n, np.int64)
    whole = -(-n * percent // 100)  # what the sets themselves share
    differ = n * (100 - percent) // percent  # elements of the union that only one set holds, at most
    part = np.maximum(surely_shared(k, percent), k - differ)
    return np.where(n * 100 <= k * percent, whole, np.minimum(part, whole))


def shingles(text: bytes, width: int = SHINGLE) -> set[bytes]:
    """Distinct shingles of a UTF-8 text."""
    words = text.lower().split()  # bytes: A-Z only; ASCII white space only
    if len(words) <= width:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def hashes(found: set[bytes]) -> np.ndarray:
    """Ascending hashes of a set, as signed numbers."""
    from xxhash import xxh64_intdigest

    return np.sort(np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found)).view(np.int64))


def set_name(h: np.ndarray) -> bytes:
    """16 bytes that name a set: two sums of mixed hashes and the size."""
    u = h.view(np.uint64)
    one, two = mix64(u), mix64(u ^ np.uint64(0x9E3779B97F4A7C15))
    n = np.uint64(len(h))
    return np.array([one.sum(dtype=np.uint64), two.sum(dtype=np.uint64) + n], np.uint64).tobytes()


SETS = "n_shingles bigint, _set binary, _sketch array<bigint>, _text binary"


def sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """(_id, n_shingles, _set, _sketch, _text, _row), written: one row per document; _set is null without shingles."""
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["_id", *[c.split()[0] for c in SETS.split(", ")]]

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                n, name, low, size = [], [], [], [0]
                for text in part.column(1):
                    h = hashes(shingles(text.as_py(), width))
                    n.append(len(h))
                    name.append(set_name(h) if len(h) else None)
                    low.append(h[:k])
                    size.append(size[-1] + len(low[-1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(name, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.concatenate(low))), part.column(1)], names)
    made = texts.mapInArrow(run, f"_id {kind}, {SETS}")
    return save(made.withColumn("_row", F.monotonically_increasing_id()), "shingle-sets")


def rare_entries(nodes: DataFrame, k: int = SKETCH, percent: int = PERCENT) -> DataFrame:
    """(_value, _node, _n, _own): the inverted lists; _own counts the node's values that no other node holds."""
    each = nodes.select("_node", "_n", F.explode("_sketch").alias("_value"))
    often = save(each.groupBy("_value").agg(F.count(F.lit(1)).alias("_often")).where("_often > 1"), "shared-values")
    shared = each.join(unbounded(often), "_value")
    per_node = shared.groupBy("_node", "_n").agg(F.sort_array(F.collect_list(F.struct("_often", "_value"))).alias("_values"))

    def run(batches):
        for batch in batches:
            n, values = batch.column(1).to_numpy(), batch.column(2)
            kept = np.minimum(n, k)
            off = values.offsets.to_numpy().astype(np.int64)
            own = kept - np.diff(off)
            take = np.clip(kept - needed(n, k, percent) + 1 - own, 0, np.diff(off))
            at = np.repeat(off[:-1] - off[0], take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
            value = values.flatten().field("_value").take(pa.array(at))
            row = pa.array(np.repeat(np.arange(len(n)), take))
            yield pa.RecordBatch.from_arrays([value, batch.column(0).take(row), batch.column(1).take(row),
                                              pa.array(own).take(row)], ["_value", "_node", "_n", "_own"])
    return per_node.select("_node", "_n", "_values").mapInArrow(run, "_value bigint, _node bigint, _n bigint, _own bigint")


def fits(a, b, percent: int = PERCENT):
    """Sizes of which sets can be similar."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def leader_pairs(entries: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): each list's leader a and its other members."""
    lead = save(entries.groupBy("_value").agg(F.min(F.struct("_own", F.col("_n").alias("_size"), F.col("_node").alias("a")))
                                              .alias("_lead"), F.count(F.lit(1)).alias("_length"))
                .where("_length > 1").select("_value", "_lead.a", "_lead._size"), "leaders")
    met = entries.join(unbounded(lead), "_value").where((F.col("a") != F.col("_node")) & fits(F.col("_size"), F.col("_n"), percent))
    return met.select("a", F.col("_node").alias("b")).distinct()


def overlap_estimate(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values both sketches hold, size) of the union sketch of each row pair: the k smallest values of
    both. Sketches are ascending; those of fewer than k values end in the largest number."""
    both = np.sort(np.concatenate([x, y], axis=1), axis=1)
    real = both != np.iinfo(np.int64).max
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(~twice & real, axis=1)
    return (twice & (rank <= k)).sum(1), np.minimum(rank[:, -1], k)


def let_through(n1, n2, shared, size, k: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether the union-sketch estimate allows the pair to be similar, whether it says so for sure): an
    exact test where the union sketch is the union, else the sure and the probable bound on what it shares."""
    whole = (n1 <= k) & (n2 <= k) & (size < k)
    union = (n1 + n2) * 100 // (100 + percent)  # of similar sets, at most
    least = np.maximum(surely_shared(k, percent), k - (union * (100 - percent) // 100 + 1))
    exact = shared * 100 >= size * percent
    return np.where(whole, exact, shared >= np.minimum(least, size)), whole & exact


def first_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least value that both rows of ascending lists hold (they share one), so that one list answers for a pair."""
    both = np.sort(np.concatenate([x, y], axis=1), axis=1)
    twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != np.iinfo(np.int64).max)
    return both[np.arange(len(both)), twice.argmax(1)]


def short_lists(rows, starts: np.ndarray, length: int, k: int, percent: int):
    """(pairs, sure) of all lists (or pairs of blocks) of one short length at once."""
    i, j = np.triu_indices(length, 1)
    a, b = (starts[:, None] + i).ravel(), (starts[:, None] + j).ravel()
    n, comp, side, mixed, node, sketch, lists, value = rows
    low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    ok = np.flatnonzero((comp[a] != comp[b]) & (low * 100 >= high * percent) & (~mixed[a] | (side[a] != side[b])))
    a, b, found = a[ok], b[ok], []
    for at in range(0, len(a), 1024):
        x, y = a[at:at + 1024], b[at:at + 1024]
        ok = first_shared(lists[x], lists[y]) == value[x]
        x, y = x[ok], y[ok]
        shared, size = overlap_estimate(sketch[x], sketch[y], k)
        ok, sure = let_through(n[x], n[y], shared, size, k, percent)
        found.append(np.stack([node[x[ok]], node[y[ok]], sure[ok]], 1))
    return found


def long_list(rows, k: int, percent: int):
    """(pairs, sure) of one long list (or two of its blocks): shared values are tallied member by member over
    the values inside the list. Where sketches are whole sets the tally is exact, and one link to each set of
    members linked so far is enough."""
    n, comp, side, mixed, node, sketch, lists, value = rows
    real = sketch != np.iinfo(np.int64).max
    owner = np.repeat(np.arange(len(node)), real.sum(1))
    _, code = np.unique(sketch[real], return_inverse=True)
    holders, start = owner[np.argsort(code, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(code))])
    own = np.concatenate([[0], np.cumsum(real.sum(1))])
    label = np.unique(comp, return_inverse=True)[1]
    whole, found = n <= k, []
    for i in range(len(node)):
        ok = (label != label[i]) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * percent)
        if mixed[i]:
            ok &= side != side[i]
        ok[:i + 1] = False
        if not ok.any():
            continue
        codes = code[own[i]:own[i + 1]].tolist()
        shared = np.bincount(np.concatenate([holders[start[c]:start[c + 1]] for c in codes]), minlength=len(node))
        if whole[i]:
            j = np.flatnonzero(ok & whole & (shared * 100 >= (n + n[i] - shared) * percent))
            if len(j):
                met, first = np.unique(label[j], return_index=True)
                found.append(np.stack([np.full(len(met), node[i]), node[j[first]], np.ones(len(met), np.int64)], 1))
                label[np.isin(label, met)] = label[i]
        j = np.flatnonzero(ok & ~(whole & whole[i]) & (shared >= surely_shared(k, percent)))
        for at in range(0, len(j), 1024):
            part = j[at:at + 1024]
            part = part[first_shared(np.broadcast_to(lists[i], (len(part), lists.shape[1])), lists[part]) == value[i]]
            both, size = overlap_estimate(np.broadcast_to(sketch[i], (len(part), k)), sketch[part], k)
            part = part[let_through(n[i], n[part], both, size, k, percent)[0]]
            found.append(np.stack([np.full(len(part), node[i]), node[part], np.zeros(len(part), np.int64)], 1))
    return found


def padded(lists: pa.ListArray, width: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix that end in the largest number."""
    size = np.diff(lists.offsets.to_numpy())
    out = np.full((len(size), width), np.iinfo(np.int64).max)
    out[np.arange(width) < size[:, None]] = lists.flatten().to_numpy()
    return out


def list_pairs(batches, k: int, percent: int, width: int):
    """Candidate pairs of a sorted partition; columns _value, _i, _j, _node, _n, _comp, _side, _long, _lists."""
    def emit(keys, sketch, lists):
        node, n, comp, side, mixed = keys[:, 3], keys[:, 4], keys[:, 5], keys[:, 6], keys[:, 1] != keys[:, 2]
        cut = np.flatnonzero(np.append(True, (keys[1:, :3] != keys[:-1, :3]).any(1)))
        size = np.diff(np.append(cut, len(keys)))
        rows, found = (n, comp, side, mixed, node, sketch, lists, keys[:, 0]), [np.zeros((0, 3), np.int64)]
        for length in np.unique(size[size > 1]).tolist():
            starts = cut[size == length]
            if length <= 32:
                for a in range(0, len(starts), 4096):
                    found += short_lists(rows, starts[a:a + 4096], length, k, percent)
            else:
                for a in starts.tolist():
                    found += long_list([x[a:a + length] for x in rows], k, percent)
        pairs = np.concatenate(found)
        pairs = np.unique(np.concatenate([np.sort(pairs[:, :2], axis=1), pairs[:, 2:]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2] > 0)], ["a", "b", "sure"])

    held: list[tuple] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            keys = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in range(7)], 1).astype(np.int64)
            held.append((keys, padded(part.column(7), k), padded(part.column(8), width)))
            if (keys[-1, :3] == held[0][0][0, :3]).all():
                continue  # one list so far: wait for its end
            whole = [np.concatenate([h[c] for h in held]) for c in range(3)]
            end = int(np.flatnonzero((whole[0][:, :3] != keys[-1, :3]).any(1))[-1]) + 1
            held = [tuple(x[end:] for x in whole)]
            yield emit(*(x[:end] for x in whole))
    if held:
        yield emit(*(np.concatenate([h[c] for h in held]) for c in range(3)))


def long_sketches(texts: DataFrame, width: int, k: int, bits: int) -> DataFrame:
    """(_node, _long): the k smallest hashes of each set, shortened to their first ``bits`` bits."""
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                low = [hashes(shingles(t.as_py(), width))[:k] >> (64 - bits) for t in part.column(1)]
                off = np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int32)
                values = pa.array(np.concatenate(low), pa.int64())
                values = values.cast(pa.int32()) if bits == 32 else values
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(off), values)], ["_node", "_long"])
    return texts.select("_row", "_text").mapInArrow(run, f"_node bigint, _long array<{'int' if bits == 32 else 'bigint'}>")


def remaining_pairs(entries: DataFrame, texts: DataFrame, comps: DataFrame, width: int = SHINGLE, percent: int = PERCENT,
                    block: int = BLOCK, k: int = LONG, bits: int = 32) -> DataFrame:
    """(a, b, sure): pairs of different components in the lists that still span several. Sketches are longer
    here, whole sets for most documents; ``sure`` pairs of whole sets are similar unless shortened hashes collide."""
    spark = entries.sparkSession
    named = entries.join(unbounded(comps), entries["_node"] == comps["node"], "left").select(
        "_value", "_node", "_n", F.coalesce("least", "_node").alias("_comp"))
    named = save(named, "list-entries")
    open_lists = save(named.groupBy("_value").agg(F.min("_comp").alias("_one"), F.max("_comp").alias("_two"),
                                                  F.count(F.lit(1)).alias("_length"))
                      .where("_one <> _two").select("_value", F.ceil(F.col("_length") / block).alias("_blocks")), "open-lists")
    zero = F.lit(0).cast("long")
    met = save(named.join(unbounded(open_lists), "_value"), "open-entries")
    in_lists = met.groupBy("_node").agg(F.sort_array(F.collect_list("_value")).alias("_lists"))  # at most SKETCH
    own = texts.join(unbounded(in_lists.select(F.col("_node").alias("_row"))), "_row")
    dealt = (met.join(unbounded(long_sketches(own, width, k, bits)), "_node").join(unbounded(in_lists), "_node")
             .withColumn("_side", F.pmod(F.xxhash64("_node"), F.col("_blocks")))
             .withColumn("_other", F.explode(F.sequence(zero, F.col("_blocks") - 1)))
             .select("_value", F.least("_side", "_other").alias("_i"), F.greatest("_side", "_other").alias("_j"),
                     "_node", "_n", "_comp", "_side", "_long", "_lists"))
    dealt = dealt.repartition(partitions(spark), "_value", "_i", "_j").sortWithinPartitions("_value", "_i", "_j", "_node")
    return dealt.mapInArrow(lambda batches: list_pairs(batches, k, percent, SKETCH), "a bigint, b bigint, sure boolean").distinct()


def verified(pairs: DataFrame, texts: DataFrame, width: int = SHINGLE, percent: int = PERCENT, party: int = PARTY) -> DataFrame:
    """The pairs (a, b) of a written table whose full shingle sets are similar. Each a meets its partners in
    parties of some ``party`` members, one text after another."""
    spark = pairs.sparkSession
    rooms = save(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / party).alias("_rooms")), "rooms")
    heads = rooms.join(unbounded(texts), F.col("a") == F.col("_row")).select(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rooms") - 1)).alias("_room"), F.lit(-1).cast("long").alias("b"), "_text")
    guests = (pairs.join(unbounded(rooms), "a").withColumn("_room", F.pmod(F.xxhash64("b"), F.col("_rooms")))
              .join(unbounded(texts), F.col("b") == F.col("_row")).select("a", "_room", "b", "_text"))
    met = heads.unionByName(guests).repartition(partitions(spark), "a", "_room").sortWithinPartitions("a", "_room", "b")

    def run(batches):
        own: set[bytes] = set()
        for batch in batches:
            a, b, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            out = []
            for i, guest in enumerate(b):
                found = shingles(texts[i].as_py(), width)
                if guest < 0:
                    own = found
                    continue
                both = len(own & found)
                if both * 100 >= (len(own) + len(found) - both) * percent:
                    out.append((a[i], guest))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()),
                                                  pa.array([y for _, y in out], pa.int64())], ["a", "b"])
    return met.mapInArrow(run, "a bigint, b bigint")


def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
                       percent: int = PERCENT, k: int = SKETCH, block: int = BLOCK, long: int = LONG) -> DataFrame:
    """One row per document: id, n_shingles, component_id (null where every id of the component is)."""
    rows = sets(docs, id_col, text_col, width, k)
    groups = save(rows.where("_set IS NOT NULL").groupBy("_set").agg(
        F.min("_row").alias("_node"), F.min("_id").alias("_rep")), "distinct-sets")
    nodes = save(rows.select("_row", F.col("n_shingles").alias("_n"), "_sketch").join(
        unbounded(groups.select(F.col("_node").alias("_row"), "_node", "_rep")), "_row").drop("_row"), "nodes")
    entries = save(rare_entries(nodes, k, percent), "rare-values")
    texts = save(rows.select("_row", "_text").join(unbounded(entries.select(F.col("_node").alias("_row")).distinct()), "_row"),
                 "listed-texts")
    found = save(verified(save(leader_pairs(entries, percent), "leader-pairs"), texts, width, percent), "leader-links")
    for bits in (32, 64):
        rest = save(remaining_pairs(entries, texts, stars(found), width, percent, block, long, bits), "candidates")
        more = save(verified(rest.select("a", "b").distinct(), texts, width, percent), "links")
        found = found.unionByName(more)
        if rest.where("sure").join(unbounded(more), ["a", "b"], "left_anti").isEmpty():
            break  # else a link stood for others and was none: shortened hashes collided, so once more with whole ones
    star = stars(found)
    of = save(nodes.select("_node", "_rep").join(unbounded(star), nodes["_node"] == star["node"], "left")
              .select("_node", "_rep", F.coalesce("least", "_node").alias("_least")), "node-components")
    named = save(of.groupBy("_least").agg(F.min("_rep").alias("_smallest")), "smallest-ids")
    least = save(of.join(unbounded(named), "_least").select("_node", "_smallest"), "node-names")
    of_set = save(groups.join(unbounded(least), "_node").select("_set", "_smallest"), "set-names")
    out = rows.select("_id", "n_shingles", "_set").join(unbounded(of_set), "_set", "left")
    return out.select(F.col("_id").alias(id_col), "n_shingles",
                      F.when(F.col("_set").isNull(), F.col("_id")).otherwise(F.col("_smallest")).alias("component_id"))


def op13_minhash_dedup(spark, sf_dir):
    return minhash_components(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, row_number() OVER () AS r,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, r, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) <= 3 THEN [array_to_string(w, ' ')]
             ELSE list_distinct([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]) END AS s FROM w),
n AS (SELECT min(r) AS node, len(s) AS n, s FROM (SELECT r, list_sort(s) AS s FROM d WHERE len(s) > 0) GROUP BY s),
e AS (SELECT node, n, unnest(s) AS g FROM n),
p AS (SELECT a.node AS a, b.node AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
      FROM e a JOIN e b ON a.g = b.g AND a.node < b.node GROUP BY a.node, b.node),
l AS (SELECT a, b FROM p WHERE shared * 100 >= (na + nb - shared) * 85),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(node, place) AS (SELECT node, node FROM n UNION SELECT reach.node, u.b FROM reach JOIN u ON reach.place = u.a),
ids AS (SELECT n.node, min(d.doc_id) AS least FROM n JOIN d ON list_sort(d.s) = n.s GROUP BY n.node),
c AS (SELECT reach.node, min(ids.least) AS component_id FROM reach JOIN ids ON ids.node = reach.place GROUP BY reach.node)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles,
       CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE c.component_id END AS component_id,
       d.doc_id IS NOT DISTINCT FROM (CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE c.component_id END) AS kept
FROM d LEFT JOIN n ON n.s = list_sort(d.s) LEFT JOIN c ON c.node = n.node
"""
