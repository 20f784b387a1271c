"""Lien waterfall and lien position.

``lien_position``    next lien position and best-matched lien from the nested lien list
                     of the latest decision event (flatten + two "latest" rankings).
``title_first``      first variant of it: open records without payoff beside every nested record of their application.
``title_display``    open-lien display from title records: Ignore / Show, with the
                     first known sale date of three sources (B15) and the per
                     (property, application, document, recording date) latest record.
``tx_display``       open-lien display from the transaction report (nested array).
``tradeline_class``  tradeline exception classes; the reference's two self-joins
                     become per-application aggregates joined once (no pair fan-out).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import day_diff, first_known_date
from ..operators.latest import latest
from ..operators.nested import flatten
from ..sources import derived as D

c = F.col
SALE_GAP_DAYS = 7
# FIXED VALUES: tradeline classes
EXCEPTION1_TYPES = ("89", "47", "6D")
EXCEPTION2_STATUSES = ("05", "10", "67", "69")
MORTGAGE_TYPES = ("26", "19")
TRADELINE_WINDOW_DAYS = 30


def position_columns(offers: Column) -> list[Column]:
    """B16 of one nested lien list, in place: largest position + 1 and the best lien (matched first, then balance,
    then position) as the greatest struct: NULL is the least value there, as it is last in a descending order."""
    def lien(o, pos):
        sign = F.when(o["kind"].isNull() & o["index_rate"].isNull(), -100000).otherwise(100000)
        return F.struct((o["kind"] == "FIXED").alias("matched"), (o["rate"] * sign).alias("balance"), (-pos).alias("order"),
                        F.when(o["fee"] > 0.04, "AMORT").otherwise("REVOLVING").alias("match_type"))

    best = F.array_max(F.transform(offers, lien))
    return [F.when(F.size(offers) > 0, F.size(offers) + 1).alias("next_position"), best["matched"].alias("best_matched"),
            best["match_type"].alias("best_match_type"), best["balance"].alias("best_balance")]


def lien_position(spark: SparkSession, sf: str) -> DataFrame:
    """B16 — next lien position and best lien of each application's latest decision that lists any."""
    from .heloc import latest_decision
    return latest_decision(spark, sf).select("id", *position_columns(c("offers"))).where(c("next_position").isNotNull())


def _with_sale_date(spark: SparkSession, sf: str) -> DataFrame:
    m = D.mortgage_history(spark, sf)
    s = D.property_sale_dates(spark, sf)
    j = m.join(s, "id", "left")
    return j.withColumn("last_sale_date", first_known_date("avm_sale_date", "transfer_sale_date", "market_sale_date"))


def display_label(unsold: Column) -> Column:
    """B44 — Ignore / Show of a title record; ``unsold`` says when a record without a known sale is ignored."""
    orig = F.nullif(c("origination_date"), F.lit("")).try_cast("date")
    rec = F.nullif(c("recording_date"), F.lit("")).try_cast("date")
    ignore = ((day_diff(c("last_sale_date"), orig) > SALE_GAP_DAYS) | (day_diff(c("last_sale_date"), rec) > SALE_GAP_DAYS)
              | unsold | c("origination_date").isNull() | c("recording_date").isNull() | c("amount").isNull())
    return F.when(ignore, "Ignore").otherwise("Show")


def title_first(spark: SparkSession, sf: str) -> DataFrame:
    """B44 (first variant) — open records without payoff, beside document number and first mortgage date of every nested
    record of the application and its mortgage balance; a record without a known sale date is ignored."""
    from .heloc import bureau
    shown = (_with_sale_date(spark, sf).where((c("status_indicator") == "O") & (F.length("payoff_date") < 1))
             .select("id", "property_id", "amount", "status_indicator", "recording_date", "origination_date", "payoff_date",
                     "last_sale_date", display_label(c("last_sale_date").isNull()).alias("display")))
    nested = flatten(D.property_history(spark, sf).select("id", c("financial_history.finance_history_attributes").alias("loans")),
                     "loans", "l", outer=True, prefix="l_")
    nested = nested.select("id", F.concat(F.lit("D"), c("l_lien_position").cast("string")).alias("original_document_number"),
                           c("l_origination_date").try_cast("date").alias("first_mortgage_date"))
    balance = D.app(spark, sf).select("id", "person").join(bureau(spark, sf).select("person", "MTA5020"), "person", "left")
    return (shown.join(nested, "id", "left").join(balance.select("id", c("MTA5020").alias("mortgage_balance")), "id", "left")
            .select("id", "property_id", "amount", "status_indicator", "original_document_number", "recording_date",
                    "origination_date", "payoff_date", "last_sale_date", "first_mortgage_date", "mortgage_balance", "display"))


def title_display(spark: SparkSession, sf: str) -> DataFrame:
    """B44 — per (property, application, document, recording date) latest title record, labelled Ignore / Show."""
    unsold = c("last_sale_date").isNull() & c("payoff_date").isNotNull() & (c("status_indicator") != "O")
    j = _with_sale_date(spark, sf).withColumn("display", display_label(unsold))
    # Q12: order by seconds, then nanos (not their sum).
    ranked = latest(j, ["property_id", "id", "document_number", "recording_date"],
                    [c("updated_seconds").desc(), c("updated_nanos").desc(), c("created_seconds").desc(),
                     c("created_nanos").desc(), F.length("lender").desc()],
                    [c("origination_date").desc_nulls_last(), c("amount").desc_nulls_last(),
                     c("status_indicator").desc(), c("payoff_date").desc()])
    return ranked.select("id", "property_id", "document_number", "recording_date", "origination_date", "status_indicator",
                         "amount", "last_sale_date", "display")


def open_lien_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """B44 (third variant) — open liens without payoff whose dates sit > 7 days from the sale."""
    j = _with_sale_date(spark, sf)
    orig = F.nullif(c("origination_date"), F.lit("")).try_cast("date")
    rec = F.nullif(c("recording_date"), F.lit("")).try_cast("date")
    cond = ((F.length("payoff_date") < 1) & (c("status_indicator") == "O")
            & ((day_diff(c("last_sale_date"), orig) > SALE_GAP_DAYS)
               | (day_diff(c("last_sale_date"), rec) > SALE_GAP_DAYS)))
    return j.where(cond).select("id", "app_date", "origination_date", "recording_date", "amount",
                                "document_number", "last_sale_date")


def tx_display(spark: SparkSession, sf: str) -> DataFrame:
    """B45 — finance transactions of the transaction report, labelled Ignore / Show."""
    m = D.mortgage_history(spark, sf).select("id", "transactions")
    t = flatten(m, "transactions", "t", outer=True, prefix="t_").where(c("t_type_description") == "FINANCE")
    gap = day_diff(c("t_sale_date"), c("t_tx_date"))
    ignore = ((gap > SALE_GAP_DAYS) | c("t_lien_position").isNull()
              | (c("t_tx_date").isNull() & c("t_recording_date").isNull()) | c("t_loan_amount").isNull())
    return t.select("id", c("t_doc_id").alias("doc_id"), c("t_lien_position").alias("lien_position"),
                    c("t_loan_amount").alias("loan_amount"), gap.alias("sale_gap_days"),
                    F.when(ignore, "Ignore").otherwise("Show").alias("display"))


def tradeline_class(spark: SparkSession, sf: str) -> DataFrame:
    """B46 — exception class per mortgage-type tradeline of each application."""
    tl = D.tradelines(spark, sf)
    a = D.app(spark, sf).select("id", "app_date")
    mort = tl.where(c("account_type").isin(*MORTGAGE_TYPES))
    near = (mort.join(a, "id")
                .groupBy("id").agg(
                    F.max(F.when(c("open"), c("open_date"))).alias("last_open_date"),
                    F.min(F.when(~c("open"), F.abs(day_diff(c("app_date"), c("status_date"))))).alias("closest_closed_days")))
    j = mort.join(a, "id").join(near, "id", "left")
    recent = (~c("open")) & ((day_diff(c("app_date"), c("last_open_date")) <= TRADELINE_WINDOW_DAYS)
                             | (c("closest_closed_days") <= TRADELINE_WINDOW_DAYS))
    label = (F.when(c("account_type").isin(*EXCEPTION1_TYPES), "Exception1")
              .when(c("status").isin(*EXCEPTION2_STATUSES), "Exception2")
              .when(recent, "Exception3"))
    return j.select("id", "app_date", "account_type", "status", "open", "open_date", "status_date",
                    "balance", label.alias("display_class"))
