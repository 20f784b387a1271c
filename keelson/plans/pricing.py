"""Offer pricing checks.

``grid_check``   each offer's rate against the rate grid cell for (term, lien
                 position, property type) that holds its CLTV and score: an equi-join
                 on elementary positions of an index built from the table of cells.
``offer_checks`` fixed rate = quoted; variable = margin + index (- autopay
                 discount); usury percentage margin + index + fee.
``fee_buydown``  fee-paying offers against the no-fee base offer of the same
                 (application, term): rate - fee / divisor(term), for rate and APR.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import finance as FN
from ..functions.numeric import round_half_up, safe_div
from ..operators.intervals import CellIndex, position
from ..operators.nested import flatten
from ..operators.policy import broadcast_bounded
from ..operators.reconcile import reconcile
from ..sources import derived as D
from ..sources import policies as P
from ..sources.tables import frame, small_frame, table

c = F.col


@frame
def offers(spark: SparkSession, sf: str) -> DataFrame:
    """Every offer of every decision event (CROSS JOIN UNNEST)."""
    d = D.decisions(spark, sf).select("id", "seq", "part", "supp", "event_ts", "offers")
    return flatten(d, "offers", "o", outer=False, prefix="o_")


@frame
def latest_offers(spark: SparkSession, sf: str) -> DataFrame:
    """Offers of the latest decision of each application (ranked before they are flattened)."""
    from .heloc import latest_decision
    return flatten(latest_decision(spark, sf).select("id", "seq", "part", "offers"), "offers", "o", outer=False, prefix="o_")


GRID_KEYS = ("term", "first_lien", "property_type")


def rate_grid(spark: SparkSession) -> DataFrame:
    """The policy's rate grid as a table of cells."""
    return small_frame(spark, "rate_grid", P.rate_grid_rows(), P.GRID_COLUMNS)


def quoted_offers(spark: SparkSession, sf: str) -> DataFrame:
    """Every offer of every decision with what its cell is found by. Applications and properties are joined at
    the grain of decisions; offers are unnested last, so no exchange holds them."""
    prop = D.prop(spark, sf).select("id", round_half_up(safe_div(c("owed"), c("avm")), 4).alias("cltv"), (c("n_liens") <= 2).alias("first_lien"),
                                    F.when(c("land_use") == 112, "CONDO").otherwise("HOME").alias("property_type"))
    app = D.app(spark, sf).select("id", "score")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_discount", "l_tax")
    rows = li.join(app, li.l_orderkey == app.id).join(prop, "id", "left")
    return D.offer_terms(rows).select("id", c("l_linenumber").alias("seq"), c("l_partkey").alias("part"), "o_term", "o_rate", "first_lien",
                                      "property_type", "cltv", "score")


def grid_check(spark: SparkSession, sf: str, cells: DataFrame | None = None) -> DataFrame:
    """B40 — expected grid rate of every offer of every decision; unmatched offers are reported (Q3).

    ``cells`` is the rate grid, a table with the columns of ``policies.GRID_COLUMNS``. Its bands are its own; an
    empty grid prices nothing.
    """
    index = CellIndex(rate_grid(spark) if cells is None else cells, GRID_KEYS)
    j = index.lookup(quoted_offers(spark, sf), [c("o_term"), c("first_lien"), c("property_type")], c("cltv"), c("score"), "expected_rate")
    check = (F.when(c("expected_rate").isNull(), "NO_GRID_CELL")
              .when(round_half_up(c("o_rate"), 4) == round_half_up(c("expected_rate"), 4), "OK")
              .otherwise("RATE_MISMATCH"))
    return j.select("id", "seq", "part", c("o_term").alias("term"), "first_lien", "property_type", "cltv", "score",
                    c("o_rate").alias("rate"), "expected_rate", check.alias("grid_check"))


def rate_mismatches(spark: SparkSession, sf: str, since: dt.date = P.REGIME_DATES["r1"]) -> DataFrame:
    """B36 — offers whose rate is not their cell's (offers without a cell included), of applications from ``since`` on."""
    app = D.app(spark, sf).select("id", "person", "app_date").where(c("app_date") >= F.lit(since))
    return grid_check(spark, sf).where(c("grid_check") != "OK").join(app, "id").select(
        "id", "person", "app_date", "seq", "part", "term", "rate", "expected_rate", "grid_check")


def grid_faults(spark: SparkSession, sf: str, cells: DataFrame | None = None) -> DataFrame:
    """Q11 — gaps, overlaps and rates that rise with the score, each with the offers that fall there."""
    index = CellIndex(rate_grid(spark) if cells is None else cells, GRID_KEYS)
    o = quoted_offers(spark, sf)
    hits = o.groupBy(c("o_term").alias("term"), "first_lien", "property_type", position(c("cltv"), index.x, True).alias("x"),
                     position(c("score"), index.y, False).alias("y")).agg(F.count(F.lit(1)).alias("offers"))
    return (broadcast_bounded(index.faults()).join(hits, [*GRID_KEYS, "x", "y"], "left")
            .select(*GRID_KEYS, "kind", "x", "y", F.coalesce("offers", F.lit(0)).cast("long").alias("offers")))


def offer_checks(spark: SparkSession, sf: str) -> DataFrame:
    """B41, B43 — expected autopay and non-autopay rates and usury percentage, latest decision only."""
    o = latest_offers(spark, sf)
    auto = FN.offer_rate(c("o_kind"), c("o_rate"), c("o_margin"), c("o_index_rate"), F.lit(P.AUTOPAY_DISCOUNT))
    manual = FN.offer_rate(c("o_kind"), c("o_non_autopay_rate"), c("o_margin"), c("o_index_rate"), F.lit(0.0))
    return o.select(
        "id", "seq", "part", c("o_term").alias("term"), c("o_kind").alias("kind"), c("o_fee").alias("fee"),
        c("o_rate").alias("rate"), round_half_up(auto, 4).alias("expected_rate"),
        reconcile(c("o_rate"), auto, 4).alias("rate_match"),
        c("o_non_autopay_rate").alias("manual_rate"), round_half_up(manual, 4).alias("expected_manual_rate"),
        reconcile(c("o_non_autopay_rate"), manual, 4).alias("manual_rate_match"),
        round_half_up(FN.usury_cap(c("o_margin"), c("o_index_rate"), c("o_fee")), 4).alias("usury_pct"),
    )


def fee_buydown(spark: SparkSession, sf: str) -> DataFrame:
    """B42 — rate and APR that the fee buys down from the no-fee fixed rate of the same term, fixed
    offers of the latest decision. Base and offers lie in one event, so the base comes from the
    event's own array: no join of offers with offers."""
    from .heloc import latest_decision
    d = latest_decision(spark, sf).select("id", "seq", "part", "offers", c("offers").alias("all_offers"))
    o = flatten(d, "offers", "o", outer=False, prefix="o_").where(c("o_kind") == "FIXED")
    base = F.get(F.filter("all_offers", lambda x: (x["term"] == c("o_term")) & (x["kind"] == "FIXED") & (x["fee"] == 0)), 0)["rate"]
    div = broadcast_bounded(small_frame(spark, "buydown", P.BUYDOWN_DIVISORS, "d_term int, rate_div double, apr_div double"))
    o = o.withColumn("base_rate", base)
    o = o.join(div, o.o_term == div.d_term, "left")
    exp_rate = round_half_up(c("base_rate") - c("o_fee") / c("rate_div"), 5)
    exp_apr = round_half_up(c("base_rate") - c("o_fee") / c("apr_div"), 5)
    return o.select(
        "id", "seq", "part", c("o_term").alias("term"), c("o_fee").alias("fee"), "base_rate",
        c("o_rate").alias("rate"), exp_rate.alias("expected_rate"), reconcile(c("o_rate"), exp_rate, 4).alias("rate_match"),
        c("o_apr").alias("apr"), exp_apr.alias("expected_apr"), reconcile(c("o_apr"), exp_apr, 4).alias("apr_match"),
    )
