"""B6, J13 — as-of lookups: the last version not after a date.

``asof_join`` is for versions as large as the facts: both lie in one table sorted by key and time, and a
running last value hands each fact the version before it. The sort is split by period as well as by key, so a
hot key is no single task; what a period inherits comes from one row per key and period.

``in_force`` is for policy tables, versions of whole rule tables: a date's version is found by binary search
over the versions' first days, and the rows of that version are met by an equi-join (with a band of scores as
residual, where the table has one).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import edges_of, position
from .policy import is_small


def asof_join(facts: DataFrame, versions: DataFrame, keys: Sequence[str], at: str, valid_from: str, columns: Sequence[str],
              period: str = "month") -> DataFrame:
    """``facts`` with ``columns`` of the last row of ``versions`` of the same ``keys`` whose ``valid_from`` is not after
    ``at``; NULL where none is, and for NULL keys or dates. Of versions of one day the greatest columns win."""
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    own = [f"_k{i}" for i in range(len(keys))]
    known = versions.where(F.col(valid_from).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    version = F.struct(F.col(valid_from).alias("_from"), *[F.col(x) for x in columns])
    known = known.select(*named, F.col(valid_from).alias("_at"), version.alias("_version"))
    known = known.groupBy(*own, "_at").agg(F.max("_version").alias("_version"))
    row = F.struct(*[F.col(f"`{x}`") for x in facts.columns])
    none = F.lit(None).cast(known.schema["_version"].dataType)
    both = facts.select(*named, F.col(at).alias("_at"), row.alias("_row"), F.lit(1).alias("_side"), none.alias("_version")).unionByName(
        known.select(*own, "_at", F.lit(None).cast(facts.select(row.alias("r")).schema["r"].dataType).alias("_row"), F.lit(0).alias("_side"),
                     "_version")).withColumn("_period", F.date_trunc(period, "_at"))
    inside = Window.partitionBy(*own, "_period").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("_inside", F.last("_version", ignorenulls=True).over(inside)).where("_side = 1")
    # one row per key and period: what the periods before it leave
    periods = both.groupBy(*own, "_period").agg(F.max("_version").alias("_last"))
    before = Window.partitionBy(*own).orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    carried = periods.select(*own, "_period", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    out = met.join(carried, [*own, "_period"], "left").withColumn("_found", F.coalesce("_inside", "_carried"))
    return out.select("_row.*", *[F.col(f"_found.{x}").alias(x) for x in columns])


def policy_facts(policy: DataFrame) -> tuple[list, bool]:
    """(first days of the versions, whether the table may be broadcast), asked once per DataFrame."""
    if not hasattr(policy, "_facts"):
        policy._facts = edges_of(policy, [F.col("valid_from")]), is_small(policy)
    return policy._facts


def in_force(df: DataFrame, policy: DataFrame, at: Column, value: str, name: str, keys: dict[str, Column] | None = None,
             band: Column | None = None) -> DataFrame:
    """``df`` with ``name``: the ``value`` of the policy row in force at ``at``.

    ``policy`` holds whole versions: all rows with one ``valid_from`` replace the version before. ``keys`` maps its
    key columns to columns of ``df``; with ``band`` a row holds for ``lo <= band < hi``. NULL before the first
    version, and where the version has no such row."""
    days, small = policy_facts(policy)
    keys = keys or {}
    rows = policy.select(position(F.col("valid_from"), days, False).alias("_v"), F.col(value).alias(name),
                         *[F.col(k).alias(f"_p{i}") for i, k in enumerate(keys)],
                         *([F.col("lo").alias("_lo"), F.col("hi").alias("_hi")] if band is not None else []))
    on = F.col("_at_v") == F.col("_v")
    for i, own in enumerate(keys.values()):
        on = on & (own == F.col(f"_p{i}"))
    if band is not None:
        on = on & (band >= F.col("_lo")) & (band < F.col("_hi"))
    out = df.withColumn("_at_v", position(at, days, False)).join(F.broadcast(rows) if small else rows, on, "left")
    return out.drop("_at_v", "_v", "_lo", "_hi", *[f"_p{i}" for i in range(len(keys))])
