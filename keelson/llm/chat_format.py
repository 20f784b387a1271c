"""Chat formatting of preference pairs.

A pair is a chosen and a rejected conversation. Their longest common turn prefix (equal role and
text, turn by turn) is rendered once as the prompt; the turns after it are the two completions.
Each completion carries a mask: the character spans [start, end) that a trainer learns from,
which are the texts of assistant turns with their end mark.

The prefix is found without gathering conversations: turns of the two sides meet by (pair,
position) and the smallest position that differs is a partial minimum per pair.

Rules: turns are ordered by turn number (null last), then role, then text; identical repeated
rows count once; a null role or text is empty; rows without a conversation id belong to none. A
pair with one empty side has an empty prompt and an empty completion there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import read

#: Rendering of a turn: opening, role end, turn end.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def turns(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(_id, _turn, _k, _role, _text): distinct turns; _k numbers those that share a turn number."""
    rows = (conversations.where(F.col(id_col).isNotNull())
            .select(F.col(id_col).alias("_id"), F.col("turn").alias("_turn"),
                    F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"))
            .distinct())
    w = Window.partitionBy("_id", "_turn").orderBy("_role", "_text")
    return rows.withColumn("_k", F.row_number().over(w))


def preference_format(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Both sides as (_pair, _turn, _k, _role, _text); one row per pair: _pair, n_common, prompt,
    chosen, rejected, chosen_mask, rejected_mask (arrays of spans)."""
    def side(df, s):
        return df.select(F.col("_pair").alias(f"_pair{s}"), F.col("_turn").alias(f"_turn{s}"), F.col("_k").alias(f"_k{s}"),
                         F.struct("_role", "_text").alias(s))

    on = (F.col("_pair_a").eqNullSafe(F.col("_pair_b")) & F.col("_turn_a").eqNullSafe(F.col("_turn_b"))
          & (F.col("_k_a") == F.col("_k_b")))
    both = side(chosen, "_a").join(side(rejected, "_b"), on, "full_outer").select(
        *[F.coalesce(f"{c}_a", f"{c}_b").alias(c) for c in ("_pair", "_turn", "_k")], "_a", "_b")
    at = F.struct(F.col("_turn").isNull().alias("late"), F.col("_turn").alias("turn"), F.col("_k").alias("k"))
    both = both.withColumn("_at", at)
    first = F.min(F.when(~F.col("_a").eqNullSafe(F.col("_b")), F.col("_at")))
    # One row per pair is the result itself: its size is that of the two rendered conversations.
    packed = both.groupBy("_pair").agg(
        first.alias("_first"),
        F.sort_array(F.collect_list(F.struct("_at", "_a", "_b"))).alias("_turns"))

    def shared(t):
        return F.col("_first").isNull() | (t["_at"] < F.col("_first"))

    def part(rows, name):
        return F.transform(rows, lambda t: t[name])

    prompt = F.filter("_turns", shared)
    tail = F.filter("_turns", lambda t: ~shared(t))
    out = packed.select("_pair", part(prompt, "_a").alias("_p"),
                        F.filter(part(tail, "_a"), lambda x: x.isNotNull()).alias("_c"),
                        F.filter(part(tail, "_b"), lambda x: x.isNotNull()).alias("_r"))
    return out.select("_pair", F.size("_p").alias("n_common"), rendered("_p").alias("prompt"),
                      rendered("_c").alias("chosen"), rendered("_r").alias("rejected"),
                      mask("_c").alias("chosen_mask"), mask("_r").alias("rejected_mask"))


def turn_text(t):
    return F.concat(F.lit(OPEN), t["_role"], F.lit(MIDDLE), t["_text"], F.lit(CLOSE))


def rendered(rows):
    return F.array_join(F.transform(rows, turn_text), "")


def mask(rows):
    """Spans of trained text: folded along the turns with the offset so far."""
    def step(acc, t):
        start = acc["at"] + F.length(t["_role"]) + len(OPEN) + len(MIDDLE)
        end = start + F.length(t["_text"]) + len(CLOSE)
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(t["_role"] == TRAINED_ROLE,
                                                F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(rows, zero, step, lambda acc: acc["spans"])


def pairs_from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs of a table of single conversations: chosen is the conversation itself;
    rejected is the same up to its last assistant turn, whose reply is that of the neighbour
    conversation (its number with the lowest bit flipped). Without an assistant turn, or without
    such a neighbour, rejected equals chosen up to that turn."""
    chosen = turns(conversations).withColumnRenamed("_id", "_pair")
    at = F.struct(F.col("_turn").isNull().alias("late"), F.col("_turn").alias("turn"), F.col("_k").alias("k"))
    chosen = chosen.withColumn("_at", at)
    last = (chosen.where(F.col("_role") == TRAINED_ROLE).groupBy("_pair")
            .agg(F.max(F.struct("_at", "_text")).alias("_last")))
    own = last.select("_pair", F.col("_last._at").alias("_cut"))
    other = last.select(F.col("_pair").bitwiseXOR(F.lit(1).cast("long")).alias("_pair"),
                        F.col("_last._text").alias("_other"))
    cut = chosen.join(own, "_pair", "left").where(F.col("_cut").isNull() | (F.col("_at") <= F.col("_cut")))
    rejected = (cut.join(other, "_pair", "left")
                .withColumn("_text", F.when((F.col("_at") == F.col("_cut")) & F.col("_other").isNotNull(), F.col("_other"))
                            .otherwise(F.col("_text"))))
    cols = ["_pair", "_turn", "_k", "_role", "_text"]
    return chosen.select(*cols), rejected.select(*cols)


def op1_preference_format(spark, sf_dir):
    chosen, rejected = pairs_from_conversations(read(spark, sf_dir, "conversations"))

    def spans(col):
        return F.array_join(F.transform(col, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return preference_format(chosen, rejected).select(
        F.col("_pair").alias("pair_id"), F.col("n_common").cast("long").alias("n_common"), "prompt", "chosen", "rejected",
        spans("chosen_mask").alias("chosen_mask"), spans("rejected_mask").alias("rejected_mask"))


ORACLE = """
WITH d AS (SELECT DISTINCT conv_id AS pair, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY turn NULLS LAST, role, text) AS k FROM d),
l AS (SELECT pair, max(k) AS k, arg_max(text, k) AS text FROM c WHERE role = 'assistant' GROUP BY pair),
r AS (SELECT c.pair, c.turn, c.role, CASE WHEN c.k = l.k AND o.text IS NOT NULL THEN o.text ELSE c.text END AS text, c.k
      FROM c LEFT JOIN l ON c.pair = l.pair LEFT JOIN l o ON o.pair = xor(c.pair, 1::BIGINT)
      WHERE l.k IS NULL OR c.k <= l.k),
j AS (SELECT coalesce(c.pair, r.pair) AS pair, coalesce(c.k, r.k) AS k, c.role AS crole, c.text AS ctext,
             r.role AS rrole, r.text AS rtext FROM c FULL JOIN r ON c.pair = r.pair AND c.k = r.k),
f AS (SELECT *, coalesce(min(k) FILTER (WHERE crole IS DISTINCT FROM rrole OR ctext IS DISTINCT FROM rtext)
                         OVER (PARTITION BY pair), 1000000000) AS first FROM j),
t AS (SELECT *, '<|im_start|>' || crole || chr(10) || ctext || '<|im_end|>' || chr(10) AS cr,
             '<|im_start|>' || rrole || chr(10) || rtext || '<|im_end|>' || chr(10) AS rr FROM f),
s AS (SELECT *, sum(length(cr)) FILTER (WHERE k >= first) OVER (PARTITION BY pair ORDER BY k) AS cend,
             sum(length(rr)) FILTER (WHERE k >= first) OVER (PARTITION BY pair ORDER BY k) AS rend FROM t)
SELECT pair AS pair_id, count(*) FILTER (WHERE k < first) AS n_common,
       coalesce(string_agg(cr, '' ORDER BY k) FILTER (WHERE k < first), '') AS prompt,
       coalesce(string_agg(cr, '' ORDER BY k) FILTER (WHERE k >= first), '') AS chosen,
       coalesce(string_agg(rr, '' ORDER BY k) FILTER (WHERE k >= first), '') AS rejected,
       coalesce(string_agg(CAST(cend - length(ctext) - 11 AS VARCHAR) || '-' || CAST(cend AS VARCHAR), ',' ORDER BY k)
                FILTER (WHERE k >= first AND crole = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(CAST(rend - length(rtext) - 11 AS VARCHAR) || '-' || CAST(rend AS VARCHAR), ',' ORDER BY k)
                FILTER (WHERE k >= first AND rrole = 'assistant'), '') AS rejected_mask
FROM s GROUP BY pair
"""
