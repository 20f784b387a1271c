"""Refinance decision audit (B8, B13, B20-B23, B31-B35, B37 composed).

``refi_inputs``  latest decision event per application (ranked *before* the
                 offers are flattened, Q7), the offer whose term matches the
                 application (multi-key join on (id, term)), hard-pull bureau
                 attributes of the person.
``refi_checks``  rejection battery, knockout cascade, debts, expenses, income,
                 payments, free cash flow, DTI / FCF decline checks,
                 reconciliations and the verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import finance as FN
from ..functions.numeric import round_half_up, safe_div
from ..operators.audit import approved, failure_verdict
from ..operators.policy import repair_date
from ..operators.reconcile import reconcile
from ..operators.rules import any_true, battery, cascade
from ..sources import derived as D
from ..sources import policies as P
from ..sources.bureau_codes import BUREAU_CODES
from .heloc import latest_decision

c = F.col
TAX_FACTOR = 0.8


def refi_rules() -> list[tuple[str, object]]:
    """B13 — rejection battery (label, condition)."""
    score = c("packet_score")
    return [
        ("CREDIT_SCORE_Rejection", (score < P.REFI_MIN_SCORE) | score.isNull() | (score == 0)
         | score.isin(*[float(x) for x in P.SCORE_CODES])),
        ("MAXIMUM_DTI_Rejection", c("rec_dti") > P.REFI_MAX_DTI),
        ("LOAN_SIZE_Rejection", (c("amount") > P.REFI_LOAN_MAX) | (c("amount") < P.REFI_LOAN_MIN)),
        ("CITIZENSHIP_Rejection", ~c("citizenship").isin("CITIZEN", "PERMANENT_RESIDENT")),
        ("INQ3MONTHS_Rejection", c("IQT9416") > 3),
        ("THIN_FILE_Rejection", (c("ALS8220") < 12) | (c("ALX8220") < 12)),
        ("STUDENT_LOANS_Rejection", (c("STU8151") < 13) | ((c("STU6200") > 30) & (c("STU6200") <= 400))),
        ("NEW_CREDIT_TRADES_RATIO_Rejection", (c("ALL0400") > 15) & (safe_div(c("ALL0337"), c("ALL0400")) > 0.3)),
        ("INSTALLMENT_AND_REVOLVING_PAYMENTS_Rejection", (c("REV2326") + c("ILN2326") + c("MTA2326")) > 0),
        ("BANKRUPTCY_Rejection", (c("ALL9221") <= 84) | (c("ALL9120") > (c("ALL9121") + c("ALL9122")))),
        ("COLLECTIONS_Rejection", (c("COL5064") + c("COL5067") + c("COL5068") + c("COL5069")) > 500),
        ("MAJOR_DEROGATORY_Rejection", c("ALL5361") > 1500),
    ]


REFI_FAILURE_ORDER = ["LOAN_SIZE_Rejection", "CITIZENSHIP_Rejection", "CREDIT_SCORE_Rejection",
                      "MAXIMUM_DTI_Rejection", "INQ3MONTHS_Rejection", "THIN_FILE_Rejection",
                      "STUDENT_LOANS_Rejection", "NEW_CREDIT_TRADES_RATIO_Rejection",
                      "INSTALLMENT_AND_REVOLVING_PAYMENTS_Rejection", "BANKRUPTCY_Rejection",
                      "COLLECTIONS_Rejection", "MAJOR_DEROGATORY_Rejection"]


def refi_inputs(spark: SparkSession, sf: str) -> DataFrame:
    a = D.app(spark, sf)
    ld = latest_decision(spark, sf).select(
        "id",
        c("uw_packet.credit_score").try_cast("double").alias("packet_score"),
        c("uw_packet.revolving_debt.amount").alias("rec_revolving"),
        c("uw_packet.installment_debt.amount").alias("rec_installment"),
        c("uw_packet.monthly_income.amount").alias("verified_income"),
        round_half_up(c("uw_packet.home_amount") / 400, 2).alias("rec_housing"),
        c("uw_packet.transportation_expense.amount").alias("rec_transport"),
        c("uw_packet.bureau_debt.amount").alias("rec_bureau_debt"),
        c("uw_packet.current_student_payment.amount").alias("rec_student_payment"),
        c("uw_packet.pre_loan_cashflow.amount").alias("rec_pre_fcf"),
        c("uw_packet.post_loan_cashflow.amount").alias("rec_post_fcf"),
        F.to_date("event_ts").alias("decision_date"),
        "offers",
    )
    hard = FN.bureau_normalise(D.bureau_raw(spark, sf), BUREAU_CODES, only_type="Hard Credit")
    df = a.join(hard, "person").join(ld, "id", "left")
    # The offer whose term matches the application; of several, the one with the lowest fee: an
    # (id, term) lookup on the row's own array — no second pass over the events.
    own = F.filter(c("offers"), lambda o: o["term"] == c("term_years"))
    chosen = F.array_min(F.transform(own, lambda o: F.struct(o["fee"].alias("fee"), o["rate"].alias("rate"))))
    df = df.withColumn("offer_rate", chosen["rate"]).drop("offers")
    return df.withColumns({
        # Every regime test reads the repaired date: one bulk-overwritten day takes the decision's date.
        "app_date": repair_date(c("app_date"), P.BAD_APP_DATE, c("decision_date")),
        # Recorded totals of the packet (test binding).
        "rec_total_revolving": round_half_up(c("rec_revolving") + c("rec_installment") / 10, 2),
        "rec_mortgage": round_half_up(c("rec_housing") / 2, 2),
        "rec_monthly_debt": c("rec_revolving") + c("rec_installment") + c("rec_housing"),
        "citizenship": F.when(c("segment") == "AUTOMOBILE", "NON_RESIDENT")
                        .when(c("segment") == "MACHINERY", "PERMANENT_RESIDENT").otherwise("CITIZEN"),
        "rec_dti": round_half_up(safe_div(c("rec_installment"), c("verified_income")), 4),
        "is_approved": approved(c("status"), c("decision")),
    })


# Bureau codes read only by the rejection battery (dropped once the labels exist).
RULE_ONLY_CODES = ["IQT9416", "ALS8220", "ALX8220", "STU8151", "STU6200", "ALL0400", "ALL0337", "REV2326",
                   "ILN2326", "MTA2326", "ALL9221", "ALL9120", "ALL9121", "ALL9122", "COL5064", "COL5067",
                   "COL5068", "COL5069", "ALL5361"]
# Bureau codes read by the debt / expense stages.
FINANCE_CODES = ["BCC5830", "BCC5838", "BCX5830", "BAX5030", "BCX5030", "RTR5030", "ILN5820", "ILN5824",
                 "AUA5820", "STU5020", "STU5820", "MTF5820", "MTS5820", "HLC5820", "ALX5830", "MTX5839",
                 "MTJ0416", "AUT5820", "ALL5830", "MTA5830"]
BASE_COLUMNS = ["id", "app_date", "status", "decision", "amount", "income", "term_years", "citizenship",
                "packet_score", "rec_revolving", "rec_installment", "verified_income", "rec_housing", "rec_dti",
                "rec_transport", "rec_bureau_debt", "rec_student_payment", "rec_pre_fcf", "rec_post_fcf",
                "rec_total_revolving", "rec_mortgage", "rec_monthly_debt", "offer_rate", "is_approved"]


def refi_knockouts(spark: SparkSession, sf: str, keep_rules: bool = False) -> DataFrame:
    """Rejection battery, any-true flag and first-failure cascade.

    Only the columns later stages read are carried on: wide rows of ~100
    columns would otherwise exceed the JVM limits of whole-stage codegen.
    """
    df = refi_inputs(spark, sf).select(*BASE_COLUMNS, *RULE_ONLY_CODES, *FINANCE_CODES)
    df = battery(df, refi_rules())
    ok = c("is_approved")
    df = df.withColumns({
        "hard_knock": F.when(any_true([c(n) for n, _ in refi_rules()]), "True").otherwise("False"),
        "hard_knock_failure": cascade([(f"{n}_Failure", F.coalesce(c(n), F.lit(False)) & ok)
                                       for n in REFI_FAILURE_ORDER], "Pass"),
    })
    if keep_rules:
        return df
    return df.drop(*[n for n, _ in refi_rules()], *RULE_ONLY_CODES)


def refi_checks(spark: SparkSession, sf: str) -> DataFrame:
    df = refi_knockouts(spark, sf)
    ok = c("is_approved")
    df = df.withColumns({
        "z": FN.revolving_payment(),
        "t_housing": FN.housing_expense(c("app_date"), c("rec_housing")),
        "t_transport": FN.transportation_expense(),
        "t_other_debt": FN.other_bureau_debt(c("app_date")),
        "calc_income": FN.calc_income(c("verified_income"), c("income")),
        **FN.monthly_debt_parts(c("packet_score"), tier_lo=680, tier_split=740),
    })
    df = df.withColumns({
        "t_monthly_debt": round_half_up(FN.total_monthly_debt(
            c("t_revolving_debt"), c("t_installment_debt"), c("t_mortgage_debt"), c("t_housing"),
            null_as_zero=False), 4),
        "offer_factor": FN.amortisation_factor(c("offer_rate"), c("term_years") * 12),
        "cash_base": FN.cash_before_loan(c("calc_income"), F.lit(TAX_FACTOR), c("t_housing"), c("t_other_debt")),
    })
    df = df.withColumns({
        "pre_payment": FN.student_payment_assumed(F.greatest(c("amount"), c("STU5020"))),
        "post_payment": FN.blended_payment(c("amount"), c("STU5020"), c("offer_factor")),
        "requested_payment": FN.student_payment_assumed(c("amount")),
    })
    # Before the cut-off both cash flows take the payment on the refinanced amount alone.
    old = c("app_date") < F.lit(P.REFI_BUREAU_CUTOFF)
    pre = F.when(old, c("requested_payment")).otherwise(c("pre_payment"))
    post = F.when(old, round_half_up(c("amount") * c("offer_factor"), 3)).otherwise(c("post_payment"))
    df = df.withColumns({
        "pre_fcf": FN.free_cash_flow(c("cash_base"), c("t_transport"), pre, c("app_date")),
        "post_fcf": FN.free_cash_flow(c("cash_base"), c("t_transport"), post, c("app_date")),
        "t_dti": round_half_up(safe_div(c("t_monthly_debt"), c("calc_income")), 4),
    })
    stated_ratio = safe_div(c("t_monthly_debt"), c("income"))
    calc_ratio = safe_div(c("t_monthly_debt"), c("calc_income"))
    df = df.withColumns({
        "dti_failure": (F.when((c("hard_knock") != "True") & (stated_ratio > P.REFI_MAX_DTI) & ok,
                               "Pre_Loan_DTI_Decline_Failure")
                         .when(stated_ratio.isNull(), "Unavailable").otherwise("Pass")),
        "fcf_failure": (F.when((c("hard_knock_failure") == "Pass")
                               & ((calc_ratio <= P.REFI_MAX_DTI) | calc_ratio.isNull())
                               & (c("post_fcf") < P.FCF_FLOOR) & ok, "Post_Loan_FCF_Decline_Failure")
                         .when(c("post_fcf").isNull(), "Unavailable").otherwise("Pass")),
        "card_debt_match": reconcile(c("rec_revolving"), c("z"), 0),
        "housing_match": reconcile(c("rec_housing"), c("t_housing"), 0),
        "dti_match": reconcile(c("rec_dti"), c("t_dti"), 2),
        "installment_match": reconcile(c("rec_installment"), c("t_installment_debt"), 0),
        "transport_match": reconcile(c("rec_transport"), c("t_transport"), 0),
        "bureau_debt_match": reconcile(c("rec_bureau_debt"), c("t_other_debt"), 0),
        "student_payment_match": reconcile(c("rec_student_payment"), c("requested_payment"), 0),
        "total_revolving_match": reconcile(c("rec_total_revolving"), c("t_revolving_debt"), 0),
        "mortgage_match": reconcile(c("rec_mortgage"), c("t_mortgage_debt"), 0),
        "monthly_debt_match": reconcile(c("rec_monthly_debt"), c("t_monthly_debt"), 0),
        "pre_fcf_match": reconcile(c("rec_pre_fcf"), c("pre_fcf"), 0),
        "post_fcf_match": reconcile(c("rec_post_fcf"), c("post_fcf"), 0),
    })
    return df.withColumn("verdict", failure_verdict(
        [c("hard_knock_failure"), c("dti_failure"), c("fcf_failure")],
        c("hard_knock") != "True", c("status"), c("decision")))


MATCH_COLUMNS = ["card_debt_match", "housing_match", "dti_match", "installment_match", "transport_match",
                 "bureau_debt_match", "student_payment_match", "pre_fcf_match", "post_fcf_match", "total_revolving_match",
                 "mortgage_match", "monthly_debt_match"]
AUDIT_COLUMNS = ["id", "app_date", "status", "decision", "packet_score", "hard_knock", "hard_knock_failure",
                 "dti_failure", "fcf_failure", "t_monthly_debt", "pre_fcf", "post_fcf", *MATCH_COLUMNS, "verdict"]


def refi_audit(spark: SparkSession, sf: str) -> DataFrame:
    return refi_checks(spark, sf).where(c("verdict") != "Pass").select(*AUDIT_COLUMNS)
