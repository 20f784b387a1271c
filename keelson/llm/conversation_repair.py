r"""Conversation structure repair by Wagner-Fischer target alignment.

A conversation is repaired by the cheapest edits that give role initials of the form
``(s?(ua)+)?``: Keep, Rerole, Delete and Insert of whole turns. A target of length r is a string of
alternating initials; all targets that end alike are suffixes of one string, so one Wagner-Fischer
matrix E[i][r] (rows from i on against the last r initials) holds the alignment to every feasible
length, one column each. A straight alignment gives an incumbent cost; the matrix is filled inside
Ukkonen's band, the cells whose rows and initials differ in number by no more than that cost can pay. Of
all lengths that reach the least cost the backtraced audits are compared, the least one stays.

Long conversations are cut into segments of at most ``SEGMENT`` rows, aligned in tasks of their own
for each way to enter and leave a segment: nothing kept yet (B), after a system turn (S), after a
user turn (A: an assistant is due) or after a full pair (U). A fold over the segments of a
conversation (one small row per segment) picks the cheapest chain, ties by the audit. Equal costs are never
proper prefixes of one another inside a segment (the longer one would have more inserts), so comparing joined
audits is exact. One conversation may thus hold any share of the rows; only the digest of its repaired text
is one task's work, a segment at a time, as a hash runs through the text from front to end.

Rules: a null role or text is one space. Rows are taken by turn (null first), then role, text.
A null id is a conversation of its own. A row's first fault counts: blank (no ``[^\x20\x09-\x0D]``),
duplicate (role and text seen earlier), truncated (last such character not in ``.!?``). The initial is the first
character of the role. A table without rows gives no rows; a conversation without rows (all dropped) gives zeros,
an empty audit and the digest of the empty string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import partitions, read, save, unbounded

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Faults of a row.
SOUND, BLANK, DUPLICATE, CUT = range(4)
SEGMENT = 256
NAMES = {"u": "user", "a": "assistant"}
#: Ways to leave a segment, by the way it was entered; at the end only B and U are whole.
LEAVES = {"B": "BSAU", "S": "SAU", "A": "AU", "U": "UA"}
FAR = 1 << 40


def other(initial: str) -> str:
    return "a" if initial == "u" else "u"


def incumbent(rows: list[tuple[str, int]]) -> int:
    """Cost of a straight alignment: every row that may stay meets the next initial of an alternating
    string, whichever first initial is cheaper, and inserts mend both ends."""
    best = FAR
    for first in "ua":
        due, cost = first, 4 * INSERT
        for initial, fault in rows:
            if fault in (BLANK, DUPLICATE):
                cost += DELETE
            else:
                cost += (initial != due) * REROLE + (fault == CUT) * TRUNCATED
                due = other(due)
        best = min(best, cost)
    return best


class Matrix:
    """E[i][r]: least cost of rows i.. as the last r initials of an alternating string that ends in
    ``last``, within the band that ``limit`` leaves; ``edit`` gives the least letter that reaches it."""

    def __init__(self, rows: list[tuple[str, int]], last: str, limit: int):
        n = len(rows)
        live = [0] * (n + 1)  # rows from i on that may stay
        sure = [0] * (n + 1)  # what the others cost
        for i in range(n - 1, -1, -1):
            gone = rows[i][1] in (BLANK, DUPLICATE)
            live[i], sure[i] = live[i + 1] + (not gone), sure[i + 1] + DELETE * gone
        self.low, self.cost, self.edit = [0] * (n + 1), [None] * (n + 1), [None] * (n + 1)
        after, after_low = [], 0
        for i in range(n, -1, -1):
            rest = limit - sure[i]  # rest < 0: no cell of this row can be on a path
            low = max(0, live[i] - max(rest, -1) // DELETE)
            high = live[i] + max(rest, -1) // INSERT
            cost, edit = [FAR] * max(0, high - low + 1), ["?"] * max(0, high - low + 1)
            initial, fault = rows[i] if i < n else ("", SOUND)
            for r in range(low, high + 1):
                best, how = (0, "") if i == n and r == 0 else (FAR, "?")
                if i < n:
                    at = r - after_low
                    if 0 <= at < len(after):
                        best, how = after[at] + DELETE, "D"
                if r > low and cost[r - 1 - low] + INSERT < best:
                    best, how = cost[r - 1 - low] + INSERT, "I"
                if i < n and r and fault not in (BLANK, DUPLICATE):
                    at = r - 1 - after_low
                    if 0 <= at < len(after):
                        due = last if r % 2 else other(last)
                        own = after[at] + (KEEP if initial == due else REROLE) + (fault == CUT) * TRUNCATED
                        if own < best:
                            best, how = own, "K" if initial == due else "R"
                cost[r - low], edit[r - low] = best, how
            self.low[i], self.cost[i], self.edit[i] = low, cost, edit
            after, after_low = cost, low

    def at(self, i: int, r: int) -> int:
        place = r - self.low[i]
        return self.cost[i][place] if 0 <= place < len(self.cost[i]) else FAR

    def audit(self, i: int, r: int) -> str:
        """The least letters from (i, r) on: at each cell the least edit that keeps the cost."""
        out = []
        while i < len(self.cost) - 1 or r:
            how = self.edit[i][r - self.low[i]]
            out.append(how)
            i += how != "I"
            r -= how != "D"
        return "".join(out)


def least(options: list[tuple[int, str]]) -> tuple[int, str] | None:
    options = [x for x in options if x[0] < FAR]
    return min(options) if options else None


def align(rows: list[tuple[str, int]], enters: str = "B", leaves: str = "BSAU") -> dict[str, tuple[int, str]]:
    """The cheapest edits of ``rows`` (initial, fault) for each way in and out ("BU": from nothing to full
    pairs): cost and least audit over all feasible lengths of the target."""
    n = len(rows)
    out: dict[str, tuple[int, str]] = {}
    gone = (n * DELETE, "D" * n)
    for p in enters:
        for q in LEAVES[p]:
            if q == p and q in "BS" and q in leaves:
                out[p + q] = gone
    if "B" in enters and "S" in leaves:  # all but one system turn go
        found = least([(DELETE * (n - 1) + (f == CUT) * TRUNCATED, "D" * i + "K" + "D" * (n - 1 - i))
                       for i, (c, f) in enumerate(rows) if c == "s" and f in (SOUND, CUT)])
        if found:
            out["BS"] = found
    limit = incumbent(rows) if n else 4 * INSERT
    # an insert or a change at either end mends another way in; a system turn may cost a row
    limit += 2 * INSERT + REROLE + DELETE
    for q in "AU":
        if q not in leaves:
            continue
        matrix = Matrix(rows, "u" if q == "A" else "a", limit)
        lengths = range(matrix.low[0], matrix.low[0] + len(matrix.cost[0]))
        for p in enters:
            first = "a" if p == "A" else "u"
            odd = (first == "u") == (q == "A")
            feasible = [r for r in lengths if r % 2 == odd and (r or p == q)]
            options = [(matrix.at(0, r), r) for r in feasible]
            low = min((c for c, _ in options), default=FAR)
            found = [(low, matrix.audit(0, r)) for c, r in options if c == low < FAR]
            if p == "B":  # a first system turn stays, all before it go
                for i, (c, f) in enumerate(rows):
                    if c != "s" or f not in (SOUND, CUT):
                        continue
                    spent = DELETE * i + (f == CUT) * TRUNCATED
                    # a system turn leads to the same ways out as the turns after it do on their own
                    for r in range(matrix.low[i + 1], matrix.low[i + 1] + len(matrix.cost[i + 1])):
                        if r and r % 2 == odd and spent + matrix.at(i + 1, r) <= min(low, FAR - 1):
                            low = spent + matrix.at(i + 1, r)
                            found.append((low, "D" * i + "K" + matrix.audit(i + 1, r)))
            if found:
                out[p + q] = min(found)
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """(_conv, _turn, _role, _text, _times): rows after damage by crc32(``conv_id:turn``) % 20; _times copies of each."""
    def plain(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(draw == 1, F.lit("")).when(draw == 2, F.translate(plain("text"), ".!?", "")).otherwise(plain("text"))
    role = F.when(draw == 4, F.lit("user")).otherwise(plain("role"))
    times = F.when(draw == 0, F.lit(0)).when(draw == 3, F.lit(2)).otherwise(F.lit(1))
    return conversations.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), role.alias("_role"),
                                text.alias("_text"), times.alias("_times")).where("_times > 0")


def faults(rows: DataFrame) -> DataFrame:
    """Rows of :func:`damaged` in their order, written, with _fault and _row (ascending along each conversation).

    Equal rows are counted task by task, and the first place of a text in its conversation is a partial
    minimum, so no window holds the copies of a text."""
    counted = rows.withColumn("_task", F.spark_partition_id()).groupBy("_conv", "_turn", "_role", "_text", "_task").agg(
        F.sum("_times").alias("_times"))
    counted = save(counted.withColumn("_same", F.unhex(F.sha2(F.concat(
        F.length("_role").cast("string"), F.lit(":"), "_role", "_text"), 256))), "counted-turns")
    place = F.struct(F.col("_turn").isNotNull().alias("known"), F.col("_turn").alias("turn"), F.col("_task").alias("task"))
    first = save(counted.groupBy("_conv", "_same").agg(F.min(place).alias("_first")), "first-places")
    on = counted["_conv"].eqNullSafe(first["_conv"]) & (counted["_same"] == first["_same"])
    each = counted.join(unbounded(first), on).select(
        counted["_conv"], "_turn", "_role", "_text", place.eqNullSafe(F.col("_first")).alias("_lead"),
        F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("_times"))).alias("_copy", "_x"))
    seen = F.rtrim("_text", F.lit(" \t\n\x0b\x0c\r"))  # up to the last visible character
    fault = (F.when(seen == "", F.lit(BLANK)).when(~F.col("_lead") | (F.col("_copy") > 0), F.lit(DUPLICATE))
             .when(~F.substring(seen, -1, 1).isin(".", "!", "?"), F.lit(CUT)).otherwise(F.lit(SOUND)))
    keys = [F.col("_conv").asc_nulls_first(), F.col("_turn").asc_nulls_first(), "_role", "_text", F.col("_fault") == DUPLICATE]
    told = each.select("_conv", "_turn", "_role", "_text", fault.alias("_fault"))
    told = told.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return save(told.withColumn("_row", F.monotonically_increasing_id()), "turns")


def runs(batches, size: int) -> Iterator[list[tuple]]:
    """Rows of a sorted partition, gathered while their first ``size`` columns stay equal."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:size] != held[-1][:size]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


SEGMENTS = ("_conv {kind}, _block bigint, _rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
            "_first string, _last string, _ways array<struct<way:string,cost:bigint,audit:string>>")


def blocks(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    return turns.withColumn("_block", F.floor(F.col("_row") / segment))


def illegal(before: str, after: str) -> bool:
    return before + after not in ("su", "ua", "au")


def segments(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per segment (the rows of a conversation among ``segment`` consecutive ones): its faults and its
    cheapest edits by way in and out. A conversation inside one segment needs the ways B to B and U only."""
    kind = turns.schema["_conv"].dataType.simpleString()
    rows = blocks(turns, segment).select("_block", "_conv", "_row", F.substring("_role", 1, 1).alias("_initial"), "_fault")
    rows = (rows.repartition(partitions(turns.sparkSession), "_block")
            .sortWithinPartitions("_block", F.col("_conv").asc_nulls_first(), "_row"))
    schema = SEGMENTS.format(kind=kind)
    conv_type = pa.int64() if kind == "bigint" else None
    # one number per partition of the written table: where its rows end
    ends = {r[0] for r in turns.groupBy(F.shiftright("_row", 33)).agg(F.max("_row")).select("max(_row)").collect()}

    def run(batches):
        made = []
        for own in runs(batches, 2):
            turns = [(r[3], r[4]) for r in own]
            # a segment that touches neither end of its block or partition is a whole conversation
            part = own[0][2] % segment == 0 or (own[-1][2] + 1) % segment == 0 or own[-1][2] in ends
            ways = align(turns) | align(turns, "SAU", "SAU") if part else align(turns, "B", "BU")
            counts = [sum(f == x for _, f in turns) for x in (BLANK, DUPLICATE, CUT)]
            wrong = sum(illegal(a, b) for (a, _), (b, _) in zip(turns, turns[1:]))
            made.append((own[0][1], own[0][0], len(turns), *counts, wrong, turns[0][0], turns[-1][0],
                         [{"way": w, "cost": c, "audit": a} for w, (c, a) in ways.items()]))
            if len(made) == 2048:
                yield batch_of(made, conv_type)
                made = []
        if made:
            yield batch_of(made, conv_type)
    return rows.mapInArrow(run, schema)


WAYS = pa.list_(pa.struct([("way", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))


def batch_of(rows: list[tuple], conv_type) -> pa.RecordBatch:
    cols = list(zip(*rows))
    types = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string(), WAYS]
    names = [c.split()[0] for c in SEGMENTS.split("array")[0].split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def chain(ways: list[dict[str, tuple[int, str]]]) -> tuple[int, list[str], str]:
    """(cost, ways, audit) of the cheapest chain of segments from B to B or U, ties by the audit."""
    best = {"B": (0, "", None), "U": (0, "", None)}
    for own in reversed(ways):
        best = {p: min((cost + best[q][0], audit + best[q][1], (p + q, audit, best[q][2]))
                       for q in LEAVES[p] if p + q in own and q in best for cost, audit in [own[p + q]])
                for p in LEAVES if any(p + q in own and q in best for q in LEAVES[p])}
    cost, audit, step = best["B"]
    parts = []
    while step:
        parts.append((step[0], step[1]))
        step = step[2]
    return cost, parts, audit


FOLDED = ("_conv {kind}, _block bigint, _way string, _part string, blank bigint, duplicate bigint, truncated bigint, "
          "illegal bigint, cost bigint, audit string")


def fold(parts: DataFrame) -> DataFrame:
    """One row per segment with its way and part of the audit; the first one of a conversation also holds the
    conversation's counts, cost and audit."""
    kind = parts.schema["_conv"].dataType.simpleString()
    conv_type = pa.int64() if kind == "bigint" else None
    rows = (parts.repartition(partitions(parts.sparkSession), "_conv")
            .sortWithinPartitions(F.col("_conv").asc_nulls_first(), "_block"))
    types = [conv_type, pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5, pa.string()]
    names = [c.split()[0] for c in FOLDED.split(", ")]

    def run(batches):
        made = []
        for own in runs(batches, 1):
            cost, steps, audit = chain([{w["way"]: (w["cost"], w["audit"]) for w in r[9]} for r in own])
            counts = [sum(r[c] for r in own) for c in (3, 4, 5, 6)]
            counts[3] += sum(illegal(a[8], b[7]) for a, b in zip(own, own[1:]))
            for i, (r, (way, part)) in enumerate(zip(own, steps)):
                made.append((r[0], r[1], way, part, *((*counts, cost, audit) if i == 0 else [None] * 6)))
            if len(made) >= 2048:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names)
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names)
    return rows.mapInArrow(run, FOLDED.format(kind=kind))


def repaired(rows: list[tuple[str, str]], way: str, audit: str) -> list[tuple[str, str]]:
    """(role, text) of a segment's rows after its edits."""
    due, at, out = ("a" if way[0] == "A" else "u"), 0, []
    for how in audit:
        if how == "D":
            at += 1
            continue
        role, text = rows[at] if how != "I" else ("", "")
        at += how != "I"
        if how == "K" and role[:1] == "s":
            out.append((role, text))
            continue
        out.append((role if how == "K" else NAMES[due], text))
        due = other(due)
    return out


def repaired_lines(turns: DataFrame, folded: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(_conv, _block, _lines): ``role:text`` lines of each segment that keeps any, joined by newlines."""
    kind = turns.schema["_conv"].dataType.simpleString()
    conv_type = pa.int64() if kind == "bigint" else None
    none = F.lit(-1).cast("long")
    heads = folded.select("_block", "_conv", none.alias("_row"), F.col("_way").alias("_role"), F.col("_part").alias("_text"))
    rows = heads.unionByName(blocks(turns, segment).select("_block", "_conv", "_row", "_role", "_text"))
    rows = (rows.repartition(partitions(turns.sparkSession), "_block")
            .sortWithinPartitions("_block", F.col("_conv").asc_nulls_first(), "_row"))

    def run(batches):
        made, size = [], 0
        for own in runs(batches, 2):
            lines = [f"{role}:{text}" for role, text in repaired([r[3:5] for r in own[1:]], own[0][3], own[0][4])]
            if lines:
                made.append((own[0][1], own[0][0], "\n".join(lines)))
                size += len(made[-1][2])
            if size > 1 << 20:
                yield line_batch(made, conv_type)
                made, size = [], 0
        if made:
            yield line_batch(made, conv_type)
    return rows.mapInArrow(run, f"_conv {kind}, _block bigint, _lines string")


def line_batch(rows, conv_type) -> pa.RecordBatch:
    conv, block, lines = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(conv, conv_type), pa.array(block, pa.int64()), pa.array(lines, pa.string())],
                                      ["_conv", "_block", "_lines"])


def digests(lines: DataFrame) -> DataFrame:
    """(_conv, repaired_sha256): a running digest over the segments of each conversation in their order."""
    kind = lines.schema["_conv"].dataType.simpleString()
    conv_type = pa.int64() if kind == "bigint" else None
    rows = (lines.repartition(partitions(lines.sparkSession), "_conv")
            .sortWithinPartitions(F.col("_conv").asc_nulls_first(), "_block"))

    def run(batches):
        last, digest, made = None, None, []
        for batch in batches:
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(2)):
                if digest is None or conv != last:
                    if digest is not None:
                        made.append((last, digest.hexdigest()))
                    last, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(text.as_py().encode())
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in made], conv_type),
                                                  pa.array([y for _, y in made])], ["_conv", "repaired_sha256"])
                made = []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], conv_type), pa.array([digest.hexdigest()])],
                                             ["_conv", "repaired_sha256"])
    return rows.mapInArrow(run, f"_conv {kind}, repaired_sha256 string")


def repair(rows: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Rows (_conv bigint, _turn, _role, _text, _times; nulls only in the first two). Returns one row per conversation
    (_conv, gaps, blank, duplicate, truncated, illegal, cost, audit) and its repaired lines by segment."""
    turns = faults(rows)
    folded = save(fold(segments(turns, segment)), "audits")
    numbers = turns.groupBy("_conv", "_turn").agg(F.lit(1).alias("_one"))
    gaps = numbers.groupBy("_conv").agg(F.coalesce(F.max("_turn") - F.min("_turn") + 1 - F.count("_turn"), F.lit(0)).alias("gaps"))
    own = folded.where("audit IS NOT NULL").select("_conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    facts = own.alias("o").join(gaps.alias("g"), F.col("o._conv").eqNullSafe(F.col("g._conv"))).select("o.*", "g.gaps")
    return facts, repaired_lines(turns, folded, segment)


def op12_conversation_repair(spark, sf_dir):
    conversations = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    facts, lines = repair(damaged(conversations))
    every = conversations.select(F.col("conv_id").alias("_every")).distinct()
    out = (every.join(facts, F.col("_every").eqNullSafe(facts["_conv"]), "left").drop("_conv")
           .join(digests(lines).alias("d"), F.col("_every").eqNullSafe(F.col("d._conv")), "left"))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(F.col("_every").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
