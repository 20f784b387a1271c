"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Targets: sources in code-point order (null last) weigh 5, 2, 1, 5, ...; they share the total
size by weight, no target above ``max_repeat`` times its source's size, and the excess is
shared again by weight. That fixed point is found in one pass: ordered by cap / weight the
capped sources are a prefix, and the level every other source gets per unit of weight is the
largest of (total - caps before) / (weights from here on).

Sampling: inside a source every document expects e = target / source size copies. Documents
are laid end to end, each e long, from one pseudo-random offset in [0, 1) that depends on the
source alone; a document is emitted once for each integer inside its stretch. They lie in
order of size (classes of two leading digits, largest first), so the words taken differ from
the target by about one document of the largest size at most.

Rows equal in id, source and text collapse to one with their number before anything is ordered; they take
a stretch of ranks. The prefix sum has three levels: size classes along a source (some hundreds), cells along a
class, rows in a cell. A cell holds some ``CELL_ROWS`` rows of its class, dealt by a hash of the whole row, so
a source with a third of all rows, or one size or identifier in all of them, spreads as others do. Decisions
that grow with the documents are never broadcast. Only the targets go through one task: one sorted window of
a row a source (some 50 bytes, spilled if need be), as a target depends on every other source's size.

Rules: null text has size 0, null source is a source of its own, null ids sort first. Rows that
repeat an id are documents of their own. A source of size 0 has target 0 and takes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import WORD_PATTERN, boxed, read, save, unbounded

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
CELL_ROWS = 4096


def targets(sized: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(_source, _no_source, source_size, target): one row per source."""
    per = sized.groupBy("_source", "_no_source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy("_no_source", "_source")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]),
                     ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", w).withColumn("_cap", F.col("source_size") * max_repeat)
    by_ratio = Window.orderBy(F.col("_cap").cast("double") / F.col("_w"), "_no_source", "_source")
    every = Window.partitionBy()
    per = (per.withColumn("_total", F.sum("source_size").over(every))
           .withColumn("_before", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)),
                                             F.lit(0)))
           .withColumn("_rest", F.sum("_w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
           .withColumn("_level", (F.col("_total") - F.col("_before")).cast("double") / F.col("_rest"))
           .withColumn("_level", F.max("_level").over(every)))
    return per.select("_source", "_no_source", "source_size",
                      F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, max_repeat: int = MAX_REPEAT, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per document: _id, _source, _no_source, size, source_size, target, copies, and _name
    (:func:`row_name`), by which ties are ordered last."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(source_col), F.lit("")).alias("_source"),
        F.col(source_col).isNull().cast("int").alias("_no_source"),
        F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("size"),
        row_name(id_col, text_col, source_col).alias("_name"))
    digits = F.col("size").cast("string")
    counted = save(each.groupBy(*each.columns).agg(F.count("*").alias("_rows"))
                   .withColumn("_class", F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")), "sized")
    source, cell = ["_source", "_no_source"], ["_source", "_no_source", "_class", "_salt"]

    def prefix(col: str, group, *order):
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(col).over(w), F.lit(0))

    classes = (counted.groupBy(*source, "_class").agg(F.sum("_rows").alias("_n"), F.ceil(F.count("*") / cell_rows).alias("_salts"))
               .withColumn("_class_base", prefix("_n", source, F.col("_class").desc())).drop("_n"))
    total = counted.withColumn("size", F.col("size") * F.col("_rows"))
    plan = save(classes.join(targets(total, weights, max_repeat), source), "mix-plan")
    digest = F.conv(F.substring(F.hex("_name"), 1, 7), 16, 10).cast("long")
    dealt = save(counted.join(unbounded(plan), [*source, "_class"])
                 .withColumn("_salt", F.shiftright(digest * F.col("_salts"), 28)), "mix-rows")
    cells = (dealt.groupBy(*cell).agg(F.sum("_rows").alias("_n"))
             .withColumn("_cell_base", prefix("_n", cell[:3], "_salt")).drop("_n"))
    base = (F.col("_class_base") + F.col("_cell_base")
            + prefix("_rows", cell, F.col("size").desc(), "_id", "_name"))
    # equal rows one by one again, in stretches, as a sequence is held whole
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1, F.lit(cell_rows).cast("long")))
    stretch = F.sequence(F.col("_first"), F.least(F.col("_first") + cell_rows, F.col("_rows")) - 1)
    offset = F.conv(F.substring(F.md5("_source"), 1, 5), 16, 10).cast("double") / 1048576.0
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("_base") + F.col("_in") + 1
    copies = F.floor(rank * F.col("_share") + F.col("_offset")) - F.floor((rank - 1) * F.col("_share") + F.col("_offset"))
    return (dealt.join(unbounded(cells), cell).withColumns({"_base": base, "_share": share, "_offset": offset})
            .withColumn("_first", first).withColumn("_in", F.explode(stretch))
            .select("_id", *source, "size", "source_size", "target", "_name",
                    F.least(copies, F.lit(max_repeat).cast("long")).alias("copies")))


def op7_mix_sources(spark, sf_dir):
    return mix(read(spark, sf_dir, "documents")).select(
        F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def row_name(id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
    """Digest of identifier, source and text, nulls told from empty ones."""
    parts = [F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("-")) for c in (id_col, source_col, text_col)]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def draw(docs: DataFrame, id_col: str = "doc_id", max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mixture itself: each document as often as it was drawn, with its columns as they are.

    Rows that share an identifier are told apart by source and text. Those that share all three are
    numbered; their copies are kept as the number of rows drawn once at least, twice at least, and so on."""
    times = [F.sum((F.col("copies") >= n).cast("long")).alias(f"_{n}") for n in range(1, max_repeat + 1)]
    drawn = mix(docs, id_col, max_repeat=max_repeat).groupBy("_name").agg(*times).where("_1 > 0")
    drawn = save(drawn, "drawn")
    rows = boxed(docs, _name=row_name(id_col))
    number = F.row_number().over(Window.partitionBy("_name").orderBy("_name"))
    copies = sum(((F.col("_number") <= F.col(f"_{n}")).cast("long") for n in range(1, max_repeat + 1)), F.lit(0).cast("long"))
    return (rows.join(unbounded(drawn), "_name").withColumn("_number", number).withColumn("_copies", copies)
            .where("_copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("row.*"))


ORACLE = r"""
WITH s AS (SELECT doc_id AS id, coalesce(source, '') AS src, CAST(source IS NULL AS INT) AS nosrc,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  sha256(concat(coalesce(sha256(CAST(doc_id AS VARCHAR)), '-'), coalesce(sha256(source), '-'),
                                coalesce(sha256(text), '-'))) AS name
           FROM documents),
g AS (SELECT *, length(CAST(size AS VARCHAR)) * 100 + CAST(substr(CAST(size AS VARCHAR), 1, 2) AS INT) AS cls FROM s),
k AS (SELECT src, nosrc, cls, CAST(ceil(count(DISTINCT name) / 4096.0) AS BIGINT) AS salts FROM g GROUP BY src, nosrc, cls),
c AS (SELECT g.*, (CAST('0x' || substr(name, 1, 7) AS BIGINT) * salts) >> 28 AS salt FROM g JOIN k USING (src, nosrc, cls)),
p AS (SELECT src, nosrc, CAST(sum(size) AS BIGINT) AS source_size FROM c GROUP BY src, nosrc),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY nosrc, src) - 1) % 3 + 1] AS w, source_size * 3 AS cap FROM p),
l AS (SELECT *, CAST((sum(source_size) OVER ()
                 - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, nosrc, src
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS DOUBLE)
             / sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, nosrc, src
                            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT src, nosrc, source_size, least(CAST(cap AS DOUBLE), max(lev) OVER () * w) AS target FROM l),
r AS (SELECT c.*, t.source_size, t.target,
             row_number() OVER (PARTITION BY c.src, c.nosrc ORDER BY cls DESC, salt, size DESC, id NULLS FIRST, name) AS rk,
             CAST('0x' || substr(md5(c.src), 1, 5) AS BIGINT) / 1048576.0::DOUBLE AS u,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS e
      FROM c JOIN t ON c.src = t.src AND c.nosrc = t.nosrc)
SELECT id AS doc_id, size, source_size, target,
       CAST(least(floor(rk * e + u) - floor((rk - 1) * e + u), 3) AS BIGINT) * size AS taken
FROM r
"""
