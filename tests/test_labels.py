"""Labels that must occur on the test data, and literal rows for the corrected rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from keelson import queries as Q
from keelson.functions import finance as FN
from keelson.operators.rules import version_difference
from keelson.plans import heloc as H
from keelson.plans import pricing as PR
from keelson.sources import policies as P

SF = "/root/testdata/sf0.01"

#: query -> {column: labels that must occur}
LABELS = {
    "q_cascade_credit": {"credit_check": [f"{label}_Knockout_Failure{side}" for side in "12" for label in (
        "Loan_Size", "FICO", "Delinquent_30mdy_6mo", "Non_Medical_Collections", "Worst_Trade_Status_12mo", "Inquiries_Num_6mo",
        "Bankruptcy", "Undischarged_Bankruptcy", "Foreclosure", "Alert_Subcode", "Fraud_Shield")]},
    "q_property_rules": {"property_check": [f"{label}_Knockout_Failure{side}" for side in "12" for label in (
        "AVM", "Land_Use_Code", "Acres", "Lien_Position", "Last_Sale_Date", "Foreclosure")]},
    "q_title_history": {x: [True, False, None] for x in ("foreclosure_open", "foreclosure_settled")},
    "q_two_way": {"cltv_check": ["CLTV_Decline_Failure1", "CLTV_Decline_Failure2", "PASS"],
                  "dti_check": ["DTI_Decline_Failure1", "DTI_Decline_Failure2", "PASS"]},
    "q_verdict": {"verdict": ["correct", "should have been declined", "should not have been declined"]},
    "q_lien_decline": {"lien_check": ["PASS", "Involuntary_Lien_Knockout_Failure(DT returns)1",
                                      "Involuntary_Lien_Knockout_Failure(DT returns)2"]},
    "q_offer_rate": {"rate_match": ["Match", "Unmatch", "Unavailable"]},
    "q_fee_buydown": {"rate_match": ["Match", "Unmatch", "Unavailable"], "apr_match": ["Match", "Unmatch", "Unavailable"]},
    "q_grid_faults": {"kind": ["OVERLAP", "GAP", "ORDER"]},
    "q_grid_check": {"grid_check": ["OK", "RATE_MISMATCH", "NO_GRID_CELL"]},
}


@pytest.mark.parametrize("name", sorted(LABELS))
def test_labels_occur(spark, name):
    df = Q.QUERIES[name](spark, SF)
    for column, wanted in LABELS[name].items():
        assert set(wanted) <= {r[0] for r in df.select(column).distinct().collect()}


def test_conditional_counts_are_not_vacuous(spark):
    assert Q.QUERIES["q_cond_count"](spark, SF).where("clicks > 0").count() > 0
    assert Q.QUERIES["q_ratio_of_sums"](spark, SF).where("purchase_share > 0").count() > 0


BASE = {"fico": 700.0, "amount": 60000.0, "eff_date": dt.date(2000, 1, 1), "state_group": "standard", "MTA2126": 0.0, "COL3211": 0.0,
        "ALM6270": 0.0, "IQT9425": 0.0, "IQM9415": 0.0, "IQA9415": 0.0, "IQF9415": 0.0, "ALL9220": 999999998.0, "ALL9120": 0.0,
        "ALL9121": 0.0, "ALL9122": 0.0, "MTF8169": 999999998.0, "facta_hit": None, "fraud_hit": None, "is_approved": True,
        "is_declined": False, "decline_codes": None, "rec_installment": 10.0, "rec_revolving": 10.0, "income": 1000.0,
        "foreclosure_settled_credit": True, "score_floor": 640.0, "max_loan": 100000.0}
SCHEMA = ("fico double, amount double, eff_date date, state_group string, MTA2126 double, COL3211 double, ALM6270 double, "
          "IQT9425 double, IQM9415 double, IQA9415 double, IQF9415 double, ALL9220 double, ALL9120 double, ALL9121 double, "
          "ALL9122 double, MTF8169 double, facta_hit boolean, fraud_hit boolean, is_approved boolean, is_declined boolean, "
          "decline_codes array<string>, rec_installment double, rec_revolving double, income double, foreclosure_settled_credit boolean, score_floor double, max_loan double")
GONE = {"is_approved": False, "is_declined": True}
CASES = [
    ({}, "PASS"),  # a "not available" sentinel is long ago, not just now
    ({"amount": 14999.0}, "Loan_Size_Knockout_Failure1"),
    ({**GONE, "decline_codes": ["CLTV", "DTI"]}, "Loan_Size_Knockout_Failure2"),  # the second reason counts
    ({**GONE, "decline_codes": ["DTI"], "income": 20.0}, "PASS"),                  # recorded ratio 1
    ({"fico": 639.0, "amount": 20000.0}, "FICO_Knockout_Failure1"),
    ({**GONE, "decline_codes": ["CREDITSCORE"]}, "FICO_Knockout_Failure2"),
    ({"is_approved": False, "decline_codes": ["CREDITSCORE"]}, "PASS"),            # neither through nor declined
    ({**GONE, "decline_codes": ["INQ3MONTHS"], "IQF9415": 3.0}, "PASS"),
    ({"ALL9220": 60.0}, "Bankruptcy_Knockout_Failure1"),
    ({"ALL9220": 60.0, "eff_date": dt.date(1996, 1, 1)}, "PASS"),
    ({"ALL9120": 2.0, "ALL9121": 1.0}, "Undischarged_Bankruptcy_Knockout_Failure1"),
    ({**GONE, "decline_codes": ["FORECLOSURE"]}, "Foreclosure_Knockout_Failure2"),
    ({**GONE, "decline_codes": ["FORECLOSURE"], "foreclosure_settled_credit": False}, "PASS"),  # an open one on the title
    ({**GONE, "decline_codes": ["FORECLOSURE"], "foreclosure_settled_credit": None}, "PASS"),
    ({"facta_hit": True}, "Alert_Subcode_Knockout_Failure1"),
    ({**GONE, "decline_codes": ["FRAUD"], "fraud_hit": False}, "Fraud_Shield_Knockout_Failure2"),
    ({**GONE, "decline_codes": ["FRAUD"]}, "PASS"),                                # no alert of the type
]


def test_credit_rules_on_literal_rows(spark):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    rows = [tuple((BASE | change)[n] for n in names) for change, _ in CASES]
    df = H.with_credit(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    assert [r.credit_check for r in df.collect()] == [label for _, label in CASES]


PROPERTY = {"prequal_avm": 1.0, "avm": 1.0, "land_use": 102, "acres": 1.0, "app_date": dt.date(2000, 1, 1), "last_sale": dt.date(1999, 1, 1),
            "eff_date": dt.date(2000, 1, 1), "next_position": 2, "best_matched": True, "best_match_type": "REVOLVING", "best_balance": 5.0,
            "n_liens": 1, "MTA5020": 0.0, "MTF8169": 100.0, "foreclosure_open": False, "foreclosure_settled": True,
            "foreclosure_reason_flag": False, "is_approved": True, "is_declined": False, "decline_codes": None}
PROPERTY_SCHEMA = ("prequal_avm double, avm double, land_use int, acres double, app_date date, last_sale date, eff_date date, next_position int, "
                   "best_matched boolean, best_match_type string, best_balance double, n_liens int, MTA5020 double, MTF8169 double, "
                   "foreclosure_open boolean, foreclosure_settled boolean, foreclosure_reason_flag boolean, is_approved boolean, "
                   "is_declined boolean, decline_codes array<string>")
OLD = {"eff_date": dt.date(1996, 1, 1)}
LIEN, FORECLOSED = {**GONE, "decline_codes": ["LIEN_POSITION"]}, {**GONE, "decline_codes": ["FORECLOSURE"]}
PROPERTY_CASES = [
    ({}, "PASS"),
    ({"next_position": 4}, "Lien_Position_Knockout_Failure1"),
    ({"next_position": 4, **OLD}, "PASS"),                                    # the rule starts with its regime
    ({"next_position": 4, "best_matched": False, "best_match_type": "AMORT"}, "Lien_Position_Knockout_Failure1"),
    ({"next_position": 4, "best_matched": False}, "PASS"),                    # unmatched: mortgages count, not the position
    ({"n_liens": 3, "best_matched": False}, "Lien_Position_Knockout_Failure1"),
    ({"n_liens": 3}, "PASS"),
    ({"n_liens": 3, "best_matched": None}, "PASS"),
    ({"best_balance": -1.0, **OLD}, "Lien_Position_Knockout_Failure1"),       # at any date
    ({"MTA5020": -1.0, **OLD}, "Lien_Position_Knockout_Failure1"),
    (LIEN, "Lien_Position_Knockout_Failure2"),
    ({**LIEN, "n_liens": 2, "best_matched": False}, "Lien_Position_Knockout_Failure2"),
    ({**LIEN, **OLD}, "PASS"),
    ({"foreclosure_open": True}, "Foreclosure_Knockout_Failure1"),
    ({"foreclosure_open": None}, "PASS"),
    ({"foreclosure_open": True, "foreclosure_reason_flag": True}, "PASS"),    # a decision named it
    (FORECLOSED, "Foreclosure_Knockout_Failure2"),
    ({**FORECLOSED, "MTF8169": 60.0}, "PASS"),
    ({**FORECLOSED, "foreclosure_settled": None}, "PASS"),
]


def test_property_rules_on_literal_rows(spark):
    names = [x.split()[0] for x in PROPERTY_SCHEMA.split(", ")]
    rows = [tuple((PROPERTY | change)[n] for n in names) for change, _ in PROPERTY_CASES]
    df = H.with_property(spark.createDataFrame(rows, PROPERTY_SCHEMA).coalesce(1))
    assert [r.property_check for r in df.collect()] == [label for _, label in PROPERTY_CASES]


def test_versions_of_rules_name_missing_inputs(spark):
    df = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(ValueError, match="foreclosure_open_any_amount"):
        H.PROPERTY_RULES["march"].label(df)


def test_versions_of_rules_differ_where_a_rule_changed(spark):
    names = [x.split()[0] for x in PROPERTY_SCHEMA.split(", ")]
    rows = [tuple((PROPERTY | x)[n] for n in names) for x in ({}, {"next_position": 4}, {"prequal_avm": 0.0, "avm": 0.0})]
    df = spark.createDataFrame(rows, PROPERTY_SCHEMA).coalesce(1).withColumns(
        {"recorded_position_high": F.lit(True), "foreclosure_open_any_amount": F.lit(False), "id": F.monotonically_increasing_id()})
    df = df.withColumn("last_sale", F.lit(dt.date(1990, 1, 1)))
    out = version_difference(df, ["id"], H.PROPERTY_RULES["may"], H.PROPERTY_RULES["june"]).collect()
    assert [(r.id, r.only_old, r.only_new) for r in out] == [(0, "Lien_Position", ""), (2, "Lien_Position", "AVM")]


def test_offer_rate_without_index_or_kind(spark):
    df = spark.createDataFrame([("FIXED", 0.05, 0.02, None), ("VARIABLE", 0.05, 0.02, None), ("VARIABLE", 0.05, 0.02, 0.01),
                                (None, 0.05, 0.02, 0.01)], "k string, r double, m double, i double").coalesce(1)
    got = df.select(FN.offer_rate(F.col("k"), F.col("r"), F.col("m"), F.col("i"), F.lit(0.0025)).alias("x"),
                    FN.usury_cap(F.col("m"), F.col("i"), F.lit(0.01)).alias("u")).collect()
    assert [None if r.x is None else round(r.x, 6) for r in got] == [0.05, 0.0175, 0.0275, None]
    assert [round(r.u, 6) for r in got] == [0.03, 0.03, 0.04, 0.04]


def test_grid_is_a_parameter(spark):
    cells = [(t, f, "CONDO", 0.0, 5.0, 0, 900, 0.5, 0) for t in (5, 10, 15, 20, 30) for f in (True, False)]
    out = PR.grid_check(spark, "/root/testdata/sf0.001", spark.createDataFrame(cells, P.GRID_COLUMNS))
    priced = out.where("grid_check <> 'NO_GRID_CELL'")
    assert {(r[0], r[1]) for r in priced.select("expected_rate", "property_type").distinct().collect()} == {(0.5, "CONDO")}
    none = PR.grid_check(spark, "/root/testdata/sf0.001", spark.createDataFrame([], P.GRID_COLUMNS))
    assert {r[0] for r in none.select("grid_check").distinct().collect()} == {"NO_GRID_CELL"}


def test_every_numbered_label_is_normalised():
    for canon in ("Bank Account", "Sign promissory Note", "Additional Signer", "Notary", "ID Upload"):
        raws = dict(P.SUBTASK_ALIASES)[f"Call applicant -- {canon}"]
        assert [f"Call applicant {i} -- {canon}" for i in range(1, 5)] == list(raws[1:])


def test_title_display_variants_differ_where_no_sale_is_known(spark):
    from keelson.plans.liens import display_label
    rows = [("sale 8 days after the loan", "2020-01-09", "2020-01-01", "2020-01-09", 1.0, "O"),
            ("sale 8 days after the record", "2020-01-09", "2020-01-05", "2020-01-01", 1.0, "O"),
            ("7 days", "2020-01-08", "2020-01-01", "2020-01-01", 1.0, "O"),
            ("no sale, open", None, "2020-01-01", "2020-01-01", 1.0, "O"),
            ("no sale, closed", None, "2020-01-01", "2020-01-01", 1.0, "C"),
            ("no amount", "2020-01-01", "2020-01-01", "2020-01-01", None, "O"),
            ("no origination", "2020-01-01", None, "2020-01-01", 1.0, "O"),
            ("no record", "2020-01-01", "2020-01-01", None, 1.0, "O"),
            ("empty dates", "2020-01-01", "", "", 1.0, "O")]
    df = spark.createDataFrame(rows, "name string, sale string, origination_date string, recording_date string, amount double, "
                                     "status_indicator string").withColumn("last_sale_date", F.col("sale").cast("date"))
    no_sale = F.col("last_sale_date").isNull()
    got = {r.name: (r.first, r.second) for r in df.select(
        "name", display_label(no_sale).alias("first"),
        display_label(no_sale & (F.col("status_indicator") != "O")).alias("second")).collect()}
    assert [k for k, v in got.items() if v == ("Show", "Show")] == ["7 days", "empty dates"]
    assert [k for k, v in got.items() if v[0] != v[1]] == ["no sale, open"]
