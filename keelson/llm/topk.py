"""Exact top-k inner products without random access (sorted lists with score bounds).

Components are floored to integers. A block of candidates keeps, for each dimension, its rows in
order of the component. A query reads every list from its best end (the largest component where its
own is positive, the smallest where it is negative; a list whose component is zero for it is not
read), to one depth after the other. Each entry read raises the lower bound of its candidate (unread lists
at their last entry); the upper bound puts the unread lists at the entry just read. The entries that a
step reads, and the marks of those still unread, are matrices by candidate and list, so the bounds of many
queries move by matrix products; values not read yet take no part in them. A query stops when few candidates can still reach the k best lower bounds (or
the k best scores of blocks it met before), and their scores are then resolved in full.

Queries are a stated set. Groups of query blocks meet groups of candidate blocks in cells of their own.
A task streams a cell: its queries first, then one candidate block after the other, carrying the k best
so far. A candidate block is thus shipped once for each group of query blocks, and a cell gives at
most k rows per query. Neither side is held whole.

Rules: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows
without an id. Vectors of other lengths are not comparable: candidates count for queries of the same
length. Rows sharing the query's id are the query's own row; otherwise repeated rows count each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import partitions, read, save

SCALE = 256
QUERY_EVERY = 50
K = 5
#: A block: at most so many rows, and about so many bytes of components where vectors are long.
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 21
#: A cell: at most so many query blocks (held by its task) and candidate blocks (streamed).
CELL_QUERIES, CELL_CANDIDATES = 4, 32
#: Queries that read together; the first depth is this part of a list; few enough candidates to resolve.
QUERIES_AT_ONCE, FIRST_DEPTH, RESOLVE = 256, 16, 32
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(_id, _v): vectors that take part, as arrays of bigint."""
    wide = F.col(vector_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & (F.size(wide) > 0) & F.forall(
        wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (rows.where(F.coalesce(usable, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("_id"), F.transform(wide, lambda x: F.floor(x * scale)).alias("_v")))


class Lists:
    """Sorted lists of one block: for each dimension its rows in ascending order of the component.

    ``entries`` counts the list entries that queries have read.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.entries = ids, vectors, 0
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)

    def advance(self, order, values, part, unread, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Read entries [start, stop) of every list, best first: (by how much they raise the lower
        bound, by how much lists still unread may raise it) for each query and candidate."""
        gain = np.zeros(unread.shape, np.int64)
        np.put_along_axis(gain, order[start:stop], values[start:stop] - values[-1], axis=0)
        np.put_along_axis(unread, order[start:stop], 0, axis=0)
        self.entries += (stop - start) * int(np.count_nonzero(part))
        return product(part, gain), product(part * (values[stop - 1] - values[-1]), unread)

    def top(self, own: np.ndarray, queries: np.ndarray, k: int, bar: np.ndarray) -> list:
        """(scores, ids) of the k best candidates of each query, ties to the smaller id. Scores
        below a query's ``bar``, the k-th best of blocks before, may be left out."""
        n = len(self.vectors)
        out: list = [None] * len(queries)
        left, depth, goal = np.arange(len(queries)), 0, max(1, n // FIRST_DEPTH)
        low = np.iinfo(np.int64).min
        sides = [(self.order[::-1], self.sorted[::-1], np.maximum(queries, 0)), (self.order, self.sorted, np.minimum(queries, 0))]
        unread = [np.ones(self.vectors.shape, np.int64) for _ in sides]
        lower = np.repeat(sum(part @ values[-1] for _, values, part in sides)[:, None], n, axis=1)
        while len(left):
            above = np.zeros_like(lower)
            for (order, values, part), mark in zip(sides, unread):
                raised, open_end = self.advance(order, values, part[left], mark, depth, goal)
                lower += raised
                above += open_end
            mine = self.ids[None, :] == own[left][:, None]
            kth = np.partition(np.where(mine, low, lower), n - k, axis=1)[:, n - k] if n >= k else np.full(len(left), low)
            open_ = (lower + above >= np.maximum(kth, bar[left])[:, None]) & ~mine  # ties may still win by id
            done = (open_.sum(1) <= max(4 * k, n // RESOLVE)) | (goal == n)
            for i in np.flatnonzero(done).tolist():
                pick = np.flatnonzero(open_[i])
                out[left[i]] = best(self.vectors[pick] @ queries[left[i]], self.ids[pick], k)
            left, lower, depth, goal = left[~done], lower[~done], goal, min(n, goal * 4)
        return out


def product(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where every sum is exact."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * vectors.shape[1]
    if most < 2.0 ** 53:
        return (queries.astype(float) @ vectors.T.astype(float)).astype(np.int64)
    return queries @ vectors.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def blocks_of(vectors: DataFrame, name: str, rows: int) -> DataFrame:
    """(_dims, _block, _ids, _values): vectors packed into blocks of about ``rows``, or fewer if long.
    Rows are dealt by their place in a saved table, so rows that share an id spread as others do."""
    each = save(vectors.withColumn("_dims", F.size("_v")).withColumn("_n", F.monotonically_increasing_id()), name)
    held = F.greatest(F.least(F.lit(rows), F.floor(F.lit(BLOCK_BYTES) / (F.col("_dims") * 8))), F.lit(1))
    count = each.groupBy("_dims").count().withColumn("_blocks", F.ceil(F.col("count") / held))
    dealt = (each.join(count.select("_dims", "_blocks"), "_dims")
             .withColumn("_block", F.pmod(F.xxhash64("_n"), F.col("_blocks"))))

    def pack(table: pa.Table) -> pa.Table:
        values = table.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ids = table.column("_id").to_numpy().astype(np.int64)
        return pa.table({"_dims": table.column("_dims").slice(0, 1), "_block": table.column("_block").slice(0, 1),
                         "_ids": pa.array([ids.tobytes()], pa.binary()), "_values": pa.array([values.tobytes()], pa.binary())})
    return save(dealt.select("_dims", "_block", "_id", "_v").groupBy("_dims", "_block")
                .applyInArrow(pack, "_dims int, _block bigint, _ids binary, _values binary"), name + "-blocks")


def cells_of(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """(_dims, _q_cell, _c_cell, _side, _block, _ids, _values): the blocks of each cell, queries (side 0)
    first. Candidate groups are smaller where there would be fewer cells than tasks to fill."""
    tasks = 2 * partitions(wanted.sparkSession)
    number = F.max("_block") + 1
    sizes = (wanted.groupBy("_dims").agg(F.ceil(number / CELL_QUERIES).alias("_q_cells"))
             .join(held.groupBy("_dims").agg(number.alias("_c_blocks")), "_dims"))
    each = F.least(F.lit(CELL_CANDIDATES), F.ceil(F.col("_c_blocks") * F.col("_q_cells") / tasks))
    sizes = (sizes.withColumn("_each", F.greatest(each, F.lit(1)))
             .withColumn("_c_cells", F.ceil(F.col("_c_blocks") / F.col("_each"))))
    cell, rest = ["_dims", "_q_cell", "_c_cell"], ["_block", "_ids", "_values"]
    q = (wanted.join(sizes, "_dims").withColumn("_q_cell", F.floor(F.col("_block") / CELL_QUERIES))
         .withColumn("_c_cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c_cells") - 1))))
    c = (held.join(sizes, "_dims").withColumn("_c_cell", F.floor(F.col("_block") / F.col("_each")))
         .withColumn("_q_cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_q_cells") - 1))))
    both = q.select(*cell, F.lit(0).alias("_side"), *rest).unionByName(c.select(*cell, F.lit(1).alias("_side"), *rest))
    return both.repartition(*cell).sortWithinPartitions(*cell, "_side", "_block")


def unpack(ids: bytes, values: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(values, np.int64).reshape(-1, dims)


class Asked:
    """Queries of a cell that read together, with the k best candidates they have met."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.bar = np.full(len(ids), np.iinfo(np.int64).min)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def meet(self, lists: Lists) -> None:
        for i, (scores, ids) in enumerate(lists.top(self.ids, self.vectors, self.k, self.bar)):
            if len(ids):
                old = self.best[i]
                self.best[i] = best(np.concatenate([old[0], scores]), np.concatenate([old[1], ids]), self.k)
                if len(self.best[i][0]) == self.k:
                    self.bar[i] = self.best[i][0][-1]


def found(asked: list[Asked]):
    """Record batches (query_id, score, id) of what queries have found."""
    for part in asked:
        size = [len(ids) for _, ids in part.best]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(part.ids, size)), pa.array(np.concatenate([scores for scores, _ in part.best])),
             pa.array(np.concatenate([ids for _, ids in part.best]))], ["query_id", "score", "id"])


def top_k(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, id, score) of the k best rows for each query, its own row apart."""
    wanted = blocks_of(integer_vectors(queries, id_col, vector_col), "queries", block_rows)
    held = blocks_of(integer_vectors(rows, id_col, vector_col), "candidates", block_rows)

    def run(batches):
        cell, asked = None, []
        for batch in batches:
            for row in batch.to_pylist():
                here = (row["_dims"], row["_q_cell"], row["_c_cell"])
                if here != cell:
                    yield from found(asked)
                    cell, asked = here, []
                ids, values = unpack(row["_ids"], row["_values"], row["_dims"])
                if row["_side"] == 0:
                    asked += [Asked(ids[a:a + QUERIES_AT_ONCE], values[a:a + QUERIES_AT_ONCE], k)
                              for a in range(0, len(ids), QUERIES_AT_ONCE)]
                else:
                    lists = Lists(ids, values)
                    for part in asked:
                        part.meet(lists)
        yield from found(asked)

    spark = rows.sparkSession
    before = spark.conf.get(BATCH, "10000")
    spark.conf.set(BATCH, "4")  # blocks, of some MB each
    try:
        near = save(cells_of(wanted, held).mapInArrow(run, "query_id bigint, score bigint, id bigint"), "near")
    finally:
        spark.conf.set(BATCH, before)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_col), "score")


def op10_exact_topk(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % QUERY_EVERY == 0))


ORACLE = """
WITH u AS (SELECT vec_id, embedding FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q FROM u),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
