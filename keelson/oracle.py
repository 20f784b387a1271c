"""DuckDB oracle SQL, one statement per registered query (same output column names)."""

from __future__ import annotations

from .sources.derived_sql import rhu, with_ctes as W

ORACLE: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    ORACLE[name] = text


LATEST_DECISION = ("latest_decision", """
    SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_ts DESC, seq DESC, part DESC,
                                   supp DESC, price DESC) AS rn
      FROM decisions) WHERE rn = 1""")

# --- scans, projection, predicates -----------------------------------------
sql("q_scan_project", W("app") + "SELECT * FROM app")

sql("q_filter_predicates", W("app") + """
SELECT id, amount, state, status, segment, amount > 200000 AS is_large,
       length(flag) < 1 AS empty_flag,
       CASE WHEN state IN ('NATION_1', NULL) THEN 'in' ELSE 'out' END AS in_with_null
FROM app
WHERE amount BETWEEN 50000 AND 250000
  AND app_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
  AND status NOT IN ('CANCELLED')
  AND (segment LIKE '%BUILD%' OR segment LIKE 'AUTO%' OR segment LIKE '%TURE')
  AND segment NOT LIKE '%MACH%'
  AND hard_score IS NOT NULL AND score != 700""")

sql("q_case_ladder", W("app") + """
SELECT id,
       CASE WHEN score >= 760 THEN 'A' WHEN score >= 680 THEN 'B' WHEN score >= 620 THEN 'C' ELSE 'D' END AS tier,
       CASE WHEN flag = 'Y' THEN 'promo' END AS promo,
       CASE (hard_score >= 700) WHEN FALSE THEN 'low' WHEN TRUE THEN 'high' END AS score_band,
       (hard_score >= 700) IS TRUE AS hi_is_true,
       (hard_score >= 700) IS FALSE AS hi_is_false
FROM app""")

sql("q_distinct", W("app") + "SELECT DISTINCT state, status, decision FROM app")

sql("q_struct_paths", W("decisions") + """
SELECT id, seq, part, uw_packet.credit_score AS credit_score,
       uw_packet.revolving_debt.amount AS revolving_debt,
       uw_packet.monthly_income.amount AS monthly_income
FROM decisions""")

# --- joins -------------------------------------------------------------------
sql("q_inner_join", W("app", "prop") + "SELECT a.id, amount, avm, land_use FROM app a JOIN prop p ON a.id = p.id")
sql("q_left_join", W("app", "prop") + "SELECT a.id, status, avm, land_use FROM app a LEFT JOIN prop p ON a.id = p.id")
sql("q_right_join_filtered", W("app", "prop") + """
SELECT a.id, land_use, status FROM prop p RIGHT JOIN app a ON a.id = p.id WHERE land_use IS NOT NULL""")
sql("q_multikey_join", W("decisions") + """
SELECT d.id, d.seq, d.price, c.dup_count
FROM decisions d JOIN (SELECT id, seq, count(*) AS dup_count FROM decisions GROUP BY id, seq) c
  ON d.id = c.id AND d.seq = c.seq""")
sql("q_self_join", W("app") + """
SELECT l.person, l.id AS latest_id, f.id AS first_id, CAST(date_diff('day', f.app_date, l.app_date) AS INTEGER) AS span_days
FROM (SELECT * FROM (SELECT person, id, app_date, row_number() OVER (PARTITION BY person ORDER BY app_date DESC, id DESC) r FROM app) WHERE r = 1) l
JOIN (SELECT * FROM (SELECT person, id, app_date, row_number() OVER (PARTITION BY person ORDER BY app_date ASC, id ASC) r FROM app) WHERE r = 1) f
  ON l.person = f.person""")
sql("q_lookup_join", W("app") + """
SELECT id, state, r_name AS region FROM app JOIN nation ON state = n_name JOIN region ON n_regionkey = r_regionkey""")

# --- membership --------------------------------------------------------------
sql("q_semi_cohort", W("app") + """
SELECT id, person, status FROM app WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
sql("q_anti_null_aware", W("app", "liens") + """
SELECT id, person FROM app WHERE person NOT IN (SELECT person FROM liens WHERE category = 'FEDERAL TAX LIEN')""")
sql("q_member_flag", W("app", "liens") + """
SELECT id, in_release, in_release IS FALSE AS release_is_false, in_mechanics, in_mechanics IS FALSE AS mechanics_is_false
FROM (SELECT id,
        person IN (SELECT CASE WHEN category IS NULL THEN NULL ELSE person END FROM liens
                   WHERE description = 'RELEASE' OR category IS NULL) AS in_release,
        person IN (SELECT person FROM liens WHERE category = 'MECHANICS LIEN') AS in_mechanics
      FROM app)""")

# --- flatten -----------------------------------------------------------------
sql("q_flatten_outer", W("decisions") + """
SELECT id, seq, part, o.term AS o_term, o.rate AS o_rate, o.kind AS o_kind
FROM decisions d LEFT JOIN LATERAL (SELECT unnest(d.offers) AS o) u ON TRUE""")
sql("q_flatten_inner", W("chat") + """
SELECT chat_id, e.type AS e_type, e.responder_id AS e_responder_id, CAST(length(e.text) AS INTEGER) AS chars
FROM (SELECT chat_id, unnest(events) AS e FROM chat)""")
sql("q_flatten_chained", W("chat") + """
SELECT chat_id, rl_responder_id, unnest(rl_latency) AS latency
FROM (SELECT chat_id, rl.responder_id AS rl_responder_id, rl.latency AS rl_latency
      FROM (SELECT chat_id, unnest(response_latency) AS rl FROM chat))""")
sql("q_flatten_cross", W("decisions", extra=[LATEST_DECISION]) + """
SELECT id, o.term AS o_term, o.rate AS o_rate, r.code AS r_code
FROM latest_decision d
LEFT JOIN LATERAL (SELECT unnest(d.offers) AS o) u ON TRUE
LEFT JOIN LATERAL (SELECT unnest(d.decline_reasons) AS r) v ON TRUE""")

# --- latest record -----------------------------------------------------------
sql("q_latest_single", W("decisions", extra=[LATEST_DECISION]) +
    "SELECT id, event_ts, seq, part, supp, price FROM latest_decision")
sql("q_latest_multi", W("app") + """
SELECT person, status, id, amount, term_years FROM (
  SELECT *, row_number() OVER (PARTITION BY person, status
                               ORDER BY amount * term_years DESC, length(segment) DESC, id DESC) AS r
  FROM app) WHERE r = 1""")
sql("q_latest_priority", W("bureau_raw") + """
SELECT person, credit_type, MTA2126 FROM (
  SELECT person, credit_type, MTA2126, row_number() OVER (PARTITION BY person ORDER BY credit_type ASC) AS r
  FROM bureau_raw) WHERE r = 1""")

# --- aggregation -------------------------------------------------------------
sql("q_group_agg", W("tasks") + f"""
SELECT completed_by, task_type, count(*) AS n, count(value) AS n_value,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS sum_value,
       {rhu('avg(CAST(value AS DECIMAL(18,2)))', 4)} AS avg_value
FROM tasks GROUP BY completed_by, task_type""")
sql("q_cond_count", W("tasks") + """
SELECT completed_by,
       CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks,
       CAST(sum(CASE WHEN event_type != 'click' THEN 1 ELSE 0 END) AS BIGINT) AS non_clicks,
       CAST(count_if(value > 100) AS BIGINT) AS big_values
FROM tasks GROUP BY completed_by""")
sql("q_ratio_of_sums", W("tasks") + f"""
SELECT completed_by,
       {rhu("sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END) / nullif(sum(CAST(value AS DECIMAL(18,2))), 0)", 6)} AS purchase_share,
       {rhu('count(task_type) * avg(CAST(value AS DECIMAL(18,2)))', 2)} AS score_obtained,
       {rhu("avg(date_sub('minute', TIMESTAMP '2024-01-01 00:00:00', ts))", 3)} AS avg_minutes
FROM tasks GROUP BY completed_by""")
sql("q_sink_partitions", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 "
    "ELSE o_totalprice END AS o_totalprice FROM orders")
sql("q_sort_final", W("app") + "SELECT id, app_date, state, amount FROM app ORDER BY app_date DESC, state ASC, id ASC")


# =============================================================================
# home-equity audit (plans.heloc) — staged CTEs shared by several queries
# =============================================================================
from .sources import policies as P  # noqa: E402
from .sources.bureau_codes import BUREAU_CODES  # noqa: E402


def _d(x) -> str:
    return f"DATE '{x.isoformat()}'"


def _f(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _in(vals) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in vals)


BUREAU_NORM = ("bureau", "SELECT * EXCLUDE (rn) FROM (SELECT person, credit_type, " + ", ".join(
    (f"CASE WHEN TRY_CAST({c} AS DOUBLE) IN (999999998.0, 999999996.0) THEN 0.0 ELSE TRY_CAST({c} AS DOUBLE) END AS {c}"
     if c == "MTA5830" else f"TRY_CAST({c} AS DOUBLE) AS {c}") for c in BUREAU_CODES) + ", row_number() OVER (PARTITION BY person ORDER BY credit_type ASC) AS rn "
    "FROM bureau_raw) WHERE rn = 1")

LD = ("ld", """
    SELECT id, uw_packet.home_amount AS stated_value,
           uw_packet.installment_debt.amount AS rec_installment,
           uw_packet.revolving_debt.amount AS rec_revolving,
           list_transform(decline_reasons, lambda r: r.code) AS decline_codes
    FROM latest_decision""")

ALERTS = ("alert_summary", f"""
    SELECT id, max(CASE WHEN type = 'FACTA_HIT' THEN CAST(subcode AS INT) IN ({_in(P.ALERT_SUBCODES)}) END) AS facta_hit,
           max(CASE WHEN type = 'FRAUD_HIT' THEN CAST(subcode AS INT) IN ({_in(P.FRAUD_SHIELD_SUBCODES)}) END) AS fraud_hit
    FROM (SELECT *, row_number() OVER (PARTITION BY id, subcode ORDER BY alert_ts DESC, seq DESC, part DESC) AS r
          FROM alerts WHERE type IN ('FACTA_HIT', 'FRAUD_HIT') AND subcode IS NOT NULL)
    WHERE r = 1 GROUP BY id""")


def _lien_ctes() -> list[tuple[str, str]]:
    age = "date_diff('month', document_date, app_date)"
    clauses = [f"(category IN ({_in(cats)}) AND {age} > {months}" + (f" AND state_code IN ({_in(states)})" if states else "")
               + ") IS TRUE" for cats, states, months in P.LIEN_AGE_LIMITS]
    return [("lien_summary", f"""SELECT id, max(involuntary_on_property OR hoa_on_property) AS lien_exists,
               max(category IS NOT NULL AND (NOT exc1 OR NOT exc2 OR NOT dated)) AS lien_fails_any,
               max(category IS NOT NULL AND document_date IS NOT NULL AND NOT exc1 AND NOT exc2) AS lien_fails_all,
               max(category IS NULL) AS lien_no_record, count(*) AS lien_items
             FROM (SELECT a.id, l.*,
                 ((coalesce(a.hard_score, a.soft_score) >= 680 AND category = 'NOTICE' AND description = 'NOTICE'
                   AND is_pace = false) IS TRUE) AS exc1,
                 ({' OR '.join(clauses)}) AS exc2,
                 ((category IN ({_in(P.LIEN_CATEGORIES)}) AND document_date IS NOT NULL) IS TRUE) AS dated
               FROM app a JOIN liens l ON a.person = l.person) GROUP BY id""")]


def _score_floor() -> str:
    arms = " ".join(f"WHEN state_group = '{g}' AND eff_date >= {_d(s)} AND eff_date < {_d(e)} THEN {_f(v)}"
                    for g, s, e, v in P.SCORE_FLOOR)
    return f"CASE {arms} END"


def _max_loan() -> str:
    arms = " ".join(f"WHEN fico >= {lo} AND fico < {hi} THEN {_f(m)}" for lo, hi, m in P.LOAN_MAX_BY_SCORE)
    return f"CASE {arms} END"


def _two_way_case(rules: list[tuple[str, str, str, str]]) -> str:
    """CASE over (label, fires, clear and reason test, reason code), each direction in turn."""
    arms = [f"WHEN ({fires}) AND decision != 'DECLINE' AND status NOT IN ('DECLINED', 'CANCELLED') THEN '{label}1' "
            f"WHEN ({clear}) AND decision = 'DECLINE' AND status IN ('DECLINED', 'CANCELLED') "
            f"AND list_contains(decline_codes, '{code}') THEN '{label}2'" for label, fires, clear, code in rules]
    return f"CASE {' '.join(arms)} ELSE 'PASS' END"


def _credit_rules_sql() -> list[tuple[str, str, str, str]]:
    cut = _d(P.BANKRUPTCY_CUTOFF)
    few = "(IQT9425 - (IQM9415 + IQA9415) < 6 AND IQF9415 <= 2)"
    return [
        ("Loan_Size_Knockout_Failure", f"amount < 15000 OR amount > {_max_loan()}",
         f"""((fico >= 620 AND fico < 680 AND amount BETWEEN 15000 AND 50000)
              OR (fico >= 680 AND fico < 760 AND amount BETWEEN 50000 AND 100000)
              OR (fico >= 760 AND fico < 100000 AND amount BETWEEN 100000 AND 150000))
             AND {rhu('(rec_installment + rec_revolving) / nullif(income, 0)', 4)} < 0.43""", "DTI"),
        ("FICO_Knockout_Failure", f"fico < {_score_floor()} OR fico > 850 OR fico IN (9000, 9001, 9002, 9003)",
         f"fico >= {_score_floor()} AND fico <= 850 AND fico NOT IN (9000, 9001, 9002, 9003)", "CREDITSCORE"),
        ("Delinquent_30mdy_6mo_Knockout_Failure", "MTA2126 > 0", "MTA2126 <= 0", "MORT_TRADES_DELQ"),
        ("Non_Medical_Collections_Knockout_Failure", "COL3211 > 0", "COL3211 <= 0", "COLLECTION"),
        ("Worst_Trade_Status_12mo_Knockout_Failure", "ALM6270 >= 60", "ALM6270 < 60", "DELQ60_12"),
        ("Inquiries_Num_6mo_Knockout_Failure", "IQT9425 - (IQM9415 + IQA9415) >= 6", few, "INQ3MONTHS"),
        ("Finance_Inquiries_Knockout_Failure", "IQF9415 > 2", few, "INQ3MONTHS"),
        ("Bankruptcy_Knockout_Failure", f"(ALL9220 <= 60 AND eff_date >= {cut}) OR (ALL9220 <= 24 AND eff_date < {cut})",
         f"""(ALL9220 > 60 AND (ALL9120 < 1 OR ALL9120 <= ALL9121 + ALL9122) AND eff_date >= {cut})
             OR (ALL9220 > 24 AND eff_date < {cut})""", "BANKRUPTCY"),
        ("Undischarged_Bankruptcy_Knockout_Failure", f"ALL9120 >= 1 AND ALL9120 > ALL9121 + ALL9122 AND eff_date >= {cut}",
         f"ALL9120 < 1 OR (ALL9120 <= ALL9121 + ALL9122 AND ALL9220 > 60 AND eff_date >= {cut})", "BANKRUPTCY"),
        ("Foreclosure_Knockout_Failure", "MTF8169 <= 60", "MTF8169 > 60 AND foreclosure_settled_credit", "FORECLOSURE"),
        ("Alert_Subcode_Knockout_Failure", "facta_hit IS TRUE", "facta_hit IS FALSE", "FACTA_HIT"),
        ("Fraud_Shield_Knockout_Failure", "fraud_hit IS TRUE", "fraud_hit IS FALSE", "FRAUD"),
    ]


def _credit_case() -> str:
    return _two_way_case(_credit_rules_sql())


def _property_rules_sql() -> list[tuple[str, str, str, str]]:
    cut = _d(P.LAND_USE_CUTOFF)
    before, since = _in(P.LAND_USE_BEFORE), _in(P.LAND_USE_FROM)
    new = f"best_balance >= 0 AND eff_date >= {_d(P.LIEN_POSITION_CUTOFF)}"
    own = "(best_matched IS TRUE OR (best_matched IS FALSE AND best_match_type = 'AMORT'))"
    counted = "(best_matched IS FALSE AND best_match_type != 'AMORT')"
    return [
        ("AVM_Knockout_Failure", "coalesce(prequal_avm, 0.0) = 0 AND coalesce(avm, 0.0) = 0",
         "coalesce(prequal_avm, 0.0) != 0 AND coalesce(avm, 0.0) != 0", "NOAVMRETURNED"),
        ("Land_Use_Code_Knockout_Failure",
         f"(land_use NOT IN ({before}) AND eff_date < {cut}) OR (land_use NOT IN ({since}) AND eff_date >= {cut})",
         f"(land_use IN ({before}) AND eff_date < {cut}) OR (land_use IN ({since}) AND eff_date >= {cut})", "LANDUSE"),
        ("Acres_Knockout_Failure", "acres > 20", "acres <= 20", "PROPERTY_ACRES"),
        ("Lien_Position_Knockout_Failure",
         f"({own} AND {new} AND next_position > 3) OR ({counted} AND {new} AND n_liens > 2) OR best_balance < 0 OR MTA5020 < 0",
         f"({own} AND {new} AND next_position <= 3) OR ({counted} AND {new} AND n_liens <= 2)", "LIEN_POSITION"),
        ("Last_Sale_Date_Knockout_Failure", "date_diff('day', last_sale, app_date) <= 90",
         "date_diff('day', last_sale, app_date) > 90", "LAST_SALE_DATE"),
        ("Foreclosure_Knockout_Failure", "foreclosure_open AND foreclosure_reason_flag IS FALSE",
         "MTF8169 > 60 AND foreclosure_settled", "FORECLOSURE"),
    ]


def _property_case() -> str:
    return _two_way_case(_property_rules_sql())


def _history_ctes() -> list[tuple[str, str]]:
    """Loans unnested: EXISTS is the maximum of a test, FOR ALL its minimum, unknown where no row decides."""
    sale = "TRY_CAST(last_sale_date AS DATE)"
    taken, recorded, paid = (f"TRY_CAST(f.{x} AS DATE)" for x in ("origination_date", "recording_date", "payoff_date"))
    open_any = (f"(f.status IN ('F', 'U') AND {paid} IS NULL AND f.recording_date IS NOT NULL AND f.origination_date IS NOT NULL "
                f"AND {taken} >= {sale} AND {recorded} >= {sale})")

    def settled(word):
        return (f"(f.status NOT IN ('F', 'U') OR (f.status IN ('F', 'U') AND ({paid} IS NOT NULL "
                f"OR (f.recording_date IS NULL {word} f.origination_date IS NULL) OR {taken} < {sale} OR {recorded} < {sale} "
                f"OR f.amount IS NULL)))")

    def some(test, name):
        return f"CASE WHEN max({test}) THEN true WHEN count(*) > count({test}) THEN NULL ELSE false END AS {name}"

    def every(test, name):
        return f"CASE WHEN NOT min({test}) THEN false WHEN count(*) > count({test}) THEN NULL ELSE true END AS {name}"

    return [
        ("loans", "SELECT id, last_sale_date, unnest(financial_history.finance_history_attributes) AS f FROM property_history"),
        ("title", "SELECT id, " + ", ".join([
            some(f"({open_any} AND f.amount IS NOT NULL)", "foreclosure_open"), some(open_any, "foreclosure_open_any_amount"),
            some("(f.lien_position > 2)", "recorded_position_high"), every(settled("OR"), "foreclosure_settled"),
            every(settled("AND"), "foreclosure_settled_credit")]) + ", true AS has_history FROM loans GROUP BY id"),
        ("items", LIEN_ITEMS), ("top", LIEN_TOP), ("best", LIEN_BEST),
    ]


LIEN_ITEMS = """SELECT id, lien_position, o.kind = 'FIXED' AS matched,
                   CASE WHEN o.fee > 0.04 THEN 'AMORT' ELSE 'REVOLVING' END AS match_type,
                   CASE WHEN o.kind IS NULL AND o.index_rate IS NULL THEN o.rate * -100000 ELSE o.rate * 100000 END AS balance
                 FROM (SELECT id, unnest(offers) AS o, CAST(unnest(range(1, len(offers) + 1)) AS INTEGER) AS lien_position
                       FROM latest_decision)"""
LIEN_TOP = """SELECT id, lien_position + 1 AS next_position FROM (
                 SELECT *, row_number() OVER (PARTITION BY id ORDER BY lien_position DESC) AS r FROM items) WHERE r = 1"""
LIEN_BEST = """SELECT id, matched AS best_matched, match_type AS best_match_type, balance AS best_balance FROM (
                 SELECT *, row_number() OVER (PARTITION BY id ORDER BY matched DESC NULLS LAST, balance DESC NULLS LAST, lien_position ASC) AS r
                 FROM items) WHERE r = 1"""


def _lien_case(fails: str) -> str:
    label = "Involuntary_Lien_Knockout_Failure"
    live = "decision != 'DECLINE' AND status NOT IN ('DECLINED', 'CANCELLED') AND lien_reason_flag IS FALSE"
    gone = "decision = 'DECLINE' AND status IN ('DECLINED', 'CANCELLED') AND lien_reason_flag IS TRUE"
    return f"""CASE WHEN lien_exists AND {fails} AND {live} THEN '{label}(DT returns)1'
        WHEN lien_exists AND lien_no_record AND {live} THEN '{label}(DT no returns)1'
        WHEN (lien_exists IS NOT TRUE OR ({fails} IS NOT TRUE AND lien_no_record IS NOT TRUE)) AND {gone} THEN '{label}(DT returns)2'
        ELSE 'PASS' END"""


def _z() -> str:
    return "(((((BCC5830 - BCC5838) / 0.04) * 0.025) + BCC5838) - (BCC5830 - BCX5830))"


def debt_parts_sql(score: str, lo: int, split: int) -> str:
    t1 = f"(BCC5830 <= BCX5830 AND {score} BETWEEN {lo} AND {split - 1})"
    t2 = f"(BCC5830 <= BCX5830 AND {score} >= {split})"
    rev = (f"CASE WHEN {t1} THEN {rhu(_z() + ' + (BAX5030 - BCX5030) * 0.025 + RTR5030 * 0.025', 4)} "
           f"WHEN {t2} THEN {rhu(_z() + ' + RTR5030 * 0.025', 4)} END")
    inst = (f"CASE WHEN {t1} THEN {rhu('ILN5820 - ILN5824', 4)} "
            f"WHEN {t2} THEN {rhu('AUA5820 + STU5020 * 0.0035 + (ILN5820 - (STU5820 + AUA5820)) - ILN5824', 4)} END")
    mort = f"CASE WHEN {t1} OR {t2} THEN {rhu('MTF5820 + MTS5820 + HLC5820', 4)} END"
    return f"{rev} AS t_revolving_debt, {inst} AS t_installment_debt, {mort} AS t_mortgage_debt"


def heloc_ctes() -> str:
    r = P.REGIME_DATES
    limits = ", ".join(f"('{g}', {lo}, {hi}, {_f(v)})" for g, lo, hi, v in P.CLTV_LIMITS)
    strict = _in(P.STRICT_STATES)
    a12 = _f(P.ASSET_RATE / 12)
    base = _f(1 + P.ASSET_RATE / 12)
    extra = [LATEST_DECISION, BUREAU_NORM, LD, ALERTS] + _lien_ctes() + _history_ctes() + [
        ("foreclosure_ids", "SELECT id FROM (SELECT id, unnest(decline_reasons) AS r FROM decisions) WHERE r.code = 'FORECLOSURE'"),
        ("reason_ids", "SELECT id FROM (SELECT id, unnest(decline_reasons) AS r FROM decisions) WHERE r.code = 'INV_TAXLIEN'"),
        ("inputs", f"""SELECT a.*, b.* EXCLUDE (person), p.* EXCLUDE (id), ld.* EXCLUDE (id), al.* EXCLUDE (id), ls.* EXCLUDE (id),
               a.id IN (SELECT id FROM reason_ids) AS lien_reason_flag,
               a.id IN (SELECT id FROM foreclosure_ids) AS foreclosure_reason_flag, lt.* EXCLUDE (id), lb.* EXCLUDE (id),
               CASE WHEN has_history THEN th.foreclosure_open ELSE false END AS foreclosure_open,
               CASE WHEN has_history THEN th.foreclosure_open_any_amount ELSE false END AS foreclosure_open_any_amount,
               CASE WHEN has_history THEN th.recorded_position_high ELSE false END AS recorded_position_high,
               CASE WHEN has_history THEN th.foreclosure_settled ELSE true END AS foreclosure_settled,
               CASE WHEN has_history THEN th.foreclosure_settled_credit ELSE true END AS foreclosure_settled_credit,
               coalesce(a.hard_score, a.soft_score) AS fico,
               CASE WHEN a.flag = 'Y' AND a.respond_by >= a.app_date THEN a.mail_date ELSE a.app_date END AS eff_date,
               CASE WHEN a.state IN ({strict}) THEN 'strict' ELSE 'standard' END AS state_group,
               (a.decision != 'DECLINE' AND a.status NOT IN ('DECLINED', 'CANCELLED')) AS is_approved,
               (a.decision = 'DECLINE' AND a.status IN ('DECLINED', 'CANCELLED')) AS is_declined
             FROM app a LEFT JOIN bureau b ON a.person = b.person LEFT JOIN prop p ON a.id = p.id
             LEFT JOIN ld ON a.id = ld.id LEFT JOIN alert_summary al ON a.id = al.id LEFT JOIN lien_summary ls ON a.id = ls.id
             LEFT JOIN title th ON a.id = th.id LEFT JOIN top lt ON a.id = lt.id LEFT JOIN best lb ON a.id = lb.id"""),
        ("chk1", f"""SELECT *, {_credit_case()} AS credit_check, {_property_case()} AS property_check,
               {_lien_case('lien_fails_all')} AS lien_check, {_lien_case('lien_fails_any')} AS lien_check_any, {debt_parts_sql('fico', 620, 740)} FROM inputs"""),
        ("chk2", f"""SELECT *,
               CASE WHEN BCC5830 > BCX5830 THEN ALX5830 - ILN5824
                    ELSE coalesce(t_revolving_debt, 0.0) + coalesce(t_installment_debt, 0.0) + coalesce(t_mortgage_debt, 0.0) END AS t_monthly_debt,
               CASE WHEN avm IS NULL OR avm >= stated_value THEN {rhu('stated_value', 4)} ELSE {rhu('avm', 4)} END AS t_collateral,
               CASE WHEN age <= {P.RETIREMENT_AGE} THEN {rhu('amount * 0.2', 2)} * {P.RETIREMENT_FACTOR} + {rhu('amount * 0.1', 2)} + 5000.0
                    ELSE {rhu('amount * 0.2', 2)} + {rhu('amount * 0.1', 2)} + 5000.0 END AS t_assets
             FROM chk1"""),
        ("chk3", f"""SELECT *,
               CASE WHEN t_collateral < {_f(P.HAIRCUT_LOW_VALUE)} THEN t_collateral * {P.HAIRCUT_LOW_FACTOR}
                    WHEN eff_date >= {_d(P.LAND_USE_CUTOFF)} AND eff_date < {_d(r['r3'])} AND land_use != 112 AND fsd <= 13 THEN t_collateral
                    WHEN eff_date >= {_d(P.LAND_USE_CUTOFF)} AND eff_date < {_d(r['r3'])} AND land_use != 112 AND fsd <= 20 THEN t_collateral * (1 - fsd / 200)
                    WHEN eff_date >= {_d(P.LAND_USE_CUTOFF)} AND eff_date < {_d(r['r3'])} AND land_use IS NOT NULL THEN t_collateral * (1 - fsd / 100)
                    WHEN eff_date >= {_d(P.LAND_USE_CUTOFF)} AND eff_date < {_d(r['r3'])} THEN NULL
                    WHEN eff_date IS NOT NULL AND fsd <= 13 THEN t_collateral
                    WHEN eff_date IS NOT NULL THEN t_collateral * (1 - fsd / 200) END AS t_adj_collateral,
               CASE WHEN coalesce(income, 0.0) != 0 AND coalesce(term_years, 0) != 0
                      THEN {rhu(f't_monthly_debt / nullif(income + (t_assets * {a12}) / nullif(1 - pow({base}, -term_years * 12), 0), 0)', 4)}
                    WHEN coalesce(income, 0.0) != 0 AND coalesce(term_years, 0) = 0
                      THEN {rhu('t_monthly_debt / nullif(income, 0)', 4)} END AS t_dti
             FROM chk2"""),
        ("chk4", f"""SELECT *,
               CASE WHEN coalesce(t_collateral, 0.0) != 0 THEN {rhu('owed / nullif(t_collateral, 0)', 4)} END AS t_cltv,
               CASE WHEN coalesce(t_adj_collateral, 0.0) != 0 THEN {rhu('owed / nullif(t_adj_collateral, 0)', 4)} END AS t_adj_cltv,
               CASE WHEN eff_date < {_d(r['r1'])} THEN 'r0' WHEN eff_date < {_d(r['r2'])} THEN 'r1'
                    WHEN eff_date < {_d(r['r3'])} THEN 'r2' WHEN eff_date IS NOT NULL THEN 'r3' END AS regime
             FROM chk3"""),
        ("cltv_limits", f"SELECT * FROM (VALUES {limits}) t(l_regime, l_lo, l_hi, cltv_limit)"),
        ("chk5", f"""SELECT c.*, l.cltv_limit,
               CASE WHEN fico BETWEEN 620 AND 739 AND eff_date < {_d(r['r3'])} THEN {_f(0.43)}
                    WHEN fico BETWEEN 620 AND 739 THEN {_f(0.45)} WHEN fico >= 740 THEN {_f(0.50)} END AS dti_limit
             FROM chk4 c LEFT JOIN cltv_limits l ON c.regime = l.l_regime AND c.fico >= l.l_lo AND c.fico < l.l_hi"""),
        ("checks", f"""SELECT *,
               coalesce(CASE WHEN (((owed = 0) AND (t_cltv > {P.CLTV_ZERO_OWED} OR t_adj_cltv > {P.CLTV_ZERO_OWED}))
                                   OR ((owed > 0) AND (t_cltv > cltv_limit OR t_adj_cltv > cltv_limit))) AND is_approved
                                 THEN 'CLTV_Decline_Failure1'
                             WHEN (((owed = 0) AND t_cltv <= {P.CLTV_ZERO_OWED} AND t_adj_cltv <= {P.CLTV_ZERO_OWED})
                                   OR ((owed > 0) AND t_cltv <= cltv_limit AND t_adj_cltv <= cltv_limit))
                                  AND is_declined AND list_contains(decline_codes, 'CLTV') THEN 'CLTV_Decline_Failure2' END, 'PASS') AS cltv_check,
               coalesce(CASE WHEN t_dti > dti_limit AND is_approved THEN 'DTI_Decline_Failure1'
                             WHEN t_dti <= dti_limit AND is_declined AND list_contains(decline_codes, 'DTI') THEN 'DTI_Decline_Failure2' END,
                        'PASS') AS dti_check,
               {rhu('owed / nullif(stated_value, 0)', 4)} AS rec_cltv,
               {rhu('(rec_installment + rec_revolving) / nullif(income, 0)', 4)} AS rec_dti
             FROM chk5"""),
        ("audit", f"""SELECT *,
               CASE WHEN {rhu('rec_cltv', 3)} = {rhu('t_cltv', 3)} THEN 'Match'
                    WHEN {rhu('rec_cltv', 3)} != {rhu('t_cltv', 3)} THEN 'Unmatch' ELSE 'Unavailable' END AS cltv_match,
               CASE WHEN {rhu('rec_dti', 3)} = {rhu('t_dti', 3)} THEN 'Match'
                    WHEN {rhu('rec_dti', 3)} != {rhu('t_dti', 3)} THEN 'Unmatch' ELSE 'Unavailable' END AS dti_match,
               CASE WHEN ends_with(credit_check, '1') OR ends_with(property_check, '1') OR ends_with(lien_check, '1')
                         OR ends_with(cltv_check, '1') OR ends_with(dti_check, '1') THEN 'should have been declined'
                    WHEN ends_with(credit_check, '2') OR ends_with(property_check, '2') OR ends_with(lien_check, '2')
                         OR ends_with(cltv_check, '2') OR ends_with(dti_check, '2') THEN 'should not have been declined'
                    ELSE 'correct' END AS verdict
             FROM checks"""),
    ]
    return W("app", "prop", "bureau_raw", "decisions", "liens", "alerts", "property_history", extra=extra)


AUDIT_COLS = ("id, app_date, status, decision, fico, credit_check, property_check, lien_check, cltv_check, "
              "dti_check, t_cltv, t_adj_cltv, t_dti, cltv_match, dti_match, verdict")
sql("q_heloc_audit", heloc_ctes() + f"SELECT {AUDIT_COLS} FROM audit WHERE verdict != 'correct'")

# --- heloc stages ------------------------------------------------------------
_H = heloc_ctes()
sql("q_bureau_normalise", _H + "SELECT * FROM bureau")
sql("q_score_resolve", W("app") + "SELECT id, hard_score, soft_score, coalesce(hard_score, soft_score) AS fico FROM app")
sql("q_effective_date", _H + "SELECT id, app_date, flag, eff_date, regime FROM chk4")
sql("q_policy_lookup", _H + f"""SELECT id, fico, regime, cltv_limit, dti_limit, {_score_floor()} AS score_floor,
    {_max_loan()} AS max_loan FROM chk5""")
sql("q_asof_lien", W("app", "liens", extra=[
    ("v", """SELECT person, document_date, max({'lien_id': lien_id, 'category': category}) AS x FROM liens
             WHERE document_date IS NOT NULL GROUP BY person, document_date""")]) + """
SELECT a.id, a.person, a.app_date, v.x.lien_id AS lien_id, v.x.category AS category
FROM app a ASOF LEFT JOIN v ON a.person = v.person AND a.app_date >= v.document_date""")
sql("q_range_calls", W("tasks", "calls") + """
SELECT room, count(task_id) AS tasks, min(task_id) AS first_task, max(ts) AS last_done_at
FROM calls JOIN tasks ON ts BETWEEN call_started AND call_ended GROUP BY room""")
sql("q_cascade_credit", _H + "SELECT id, fico, credit_check FROM chk1")
sql("q_property_rules", _H + "SELECT id, land_use, acres, property_check FROM chk1")
sql("q_title_history", _H + """SELECT id, foreclosure_open, foreclosure_open_any_amount, recorded_position_high, foreclosure_settled,
    foreclosure_settled_credit, lien_reason_flag, foreclosure_reason_flag FROM inputs""")


def _rule_versions() -> str:
    cut, day = _d(P.LAND_USE_CUTOFF), _d(P.AUDIT_DATE)
    before, since = _in(P.LAND_USE_BEFORE), _in(P.LAND_USE_FROM)

    def early(old):
        return [("AVM", "prequal_avm IS NULL AND avm IS NULL"),
                ("Land_Use_Code", f"({old} AND land_use NOT IN ({before})) OR (NOT ({old}) AND land_use NOT IN ({since}))"),
                ("Acres", "acres > 20"),
                ("Lien_Position", f"recorded_position_high AND app_date >= {_d(P.RECORDED_POSITION_CUTOFF)}"),
                ("Last_Sale_Date", f"date_diff('day', last_sale, {day}) <= 90"), ("Foreclosure", "foreclosure_open_any_amount")]
    live, gone = "decision != 'DECLINE' AND status NOT IN ('DECLINED', 'CANCELLED')", "decision = 'DECLINE' AND status IN ('DECLINED', 'CANCELLED')"
    march = " ".join(f"WHEN {t} THEN '{n}_Knockout'" for n, t in early(f"app_date < {cut}") if n != "Lien_Position")
    may = [(n, f"({t}) AND {live}") for n, t in early(f"app_date <= {cut}")]
    june = [(label.removesuffix("_Knockout_Failure"), f"({fires}) AND {live}", f"({clear}) AND {gone} AND list_contains(decline_codes, '{code}')")
            for label, fires, clear, code in _property_rules_sql()]

    def names(tests):
        return "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in tests) + "], lambda x: x IS NOT NULL)"
    new = names([x for n, missed, wrong in june for x in ((n, missed), (f"{n} clear", wrong))])

    def less(x, y):
        return f"array_to_string(list_sort(list_filter({x}, lambda v: NOT list_contains({y}, v))), ',')"
    return f"""SELECT id, march_check, old_check, new_check, only_old, only_new FROM (
        SELECT id, march_check, old_check, new_check, {less('o', 'n')} AS only_old, {less('n', 'o')} AS only_new FROM (
            SELECT id, CASE {march} ELSE 'PASS' END AS march_check,
                   CASE {' '.join(f"WHEN {t} THEN '{n}_Knockout_Failure'" for n, t in may)} ELSE 'PASS' END AS old_check,
                   {_property_case()} AS new_check, {names(may)} AS o, {new} AS n FROM inputs))
        WHERE only_old != '' OR only_new != ''"""


sql("q_rule_versions", _H + _rule_versions())
sql("q_lien_exceptions", _H + "SELECT * FROM lien_summary")
sql("q_lien_decline", _H + "SELECT id, lien_exists, lien_fails_any, lien_fails_all, lien_no_record, lien_reason_flag, lien_check_any, lien_check FROM chk1")
sql("q_debt_parts", _H + f"SELECT id, {rhu(_z(), 4)} AS z, t_revolving_debt, t_installment_debt, t_mortgage_debt FROM chk1")
sql("q_total_debt", _H + f"""SELECT id,
    {rhu('CASE WHEN BCC5830 > BCX5830 THEN ALX5830 - ILN5824 ELSE coalesce(t_revolving_debt, 0.0) + coalesce(t_installment_debt, 0.0) + coalesce(t_mortgage_debt, 0.0) END', 4)} AS debt_zero_filled,
    {rhu('CASE WHEN BCC5830 > BCX5830 THEN ALX5830 - ILN5824 ELSE t_revolving_debt + t_installment_debt + t_mortgage_debt END', 4)} AS debt_null_propagating
  FROM chk1""")
sql("q_collateral", _H + f"SELECT id, {rhu('t_collateral', 4)} AS t_collateral, {rhu('t_adj_collateral', 4)} AS t_adj_collateral FROM chk3")
sql("q_cltv", _H + "SELECT id, owed, t_cltv, t_adj_cltv FROM chk4")
sql("q_cltv_check", _H + "SELECT id, regime, cltv_limit, cltv_check FROM checks")
sql("q_assets_dti", _H + f"SELECT id, {rhu('t_assets', 2)} AS t_assets, {rhu('t_monthly_debt', 4)} AS t_monthly_debt, t_dti FROM chk3")
sql("q_dti_check", _H + "SELECT id, dti_limit, dti_check FROM checks")
sql("q_reconcile", _H + "SELECT id, cltv_match, dti_match FROM audit")
sql("q_mismatches", _H + "SELECT id, cltv_match, dti_match FROM audit WHERE cltv_match = 'Unmatch' OR dti_match = 'Unmatch'")
sql("q_verdict", _H + "SELECT id, verdict FROM audit")
sql("q_two_way", _H + "SELECT id, is_approved, is_declined, array_to_string(decline_codes, ',') AS decline_codes, cltv_check, dti_check FROM checks")


# =============================================================================
# refinance audit (plans.refi)
# =============================================================================
def _factor(r: str, n: str) -> str:
    return f"(CASE WHEN ({r}) != 0 AND ({n}) != 0 THEN (({r}) / 12) / nullif(1 - pow(1 + ({r}) / 12, -({n})), 0) END)"


def _student_assumed(p: str) -> str:
    from .functions.finance import STUDENT_FACTOR
    return rhu(f"({p}) * {_f(STUDENT_FACTOR)}", 3)


def _blended(refi: str, bal: str, factor: str) -> str:
    full = rhu(f"({refi}) * {factor}", 3)
    part = f"({rhu(f'({bal}) * {factor}', 3)} + {_student_assumed(bal)} * (1 - ({refi}) / nullif({bal}, 0)))"
    return (f"CASE WHEN {factor} IS NOT NULL AND ({refi}) >= ({bal}) THEN {full} "
            f"WHEN {factor} IS NOT NULL AND ({refi}) < ({bal}) THEN {part} END")


def _fcf(pay: str) -> str:
    after = f"cash_base - {pay}"
    cut = _d(P.REFI_BUREAU_CUTOFF)
    return (f"CASE WHEN app_date >= {cut} THEN {rhu(after, 3)} "
            f"WHEN app_date < {cut} THEN {rhu(f'{after} - t_transport', 3)} END")


REFI_RULES_SQL = [
    ("CREDIT_SCORE_Rejection", f"(packet_score < {P.REFI_MIN_SCORE} OR packet_score IS NULL OR packet_score = 0 "
                               f"OR packet_score IN ({', '.join(f'{x}.0' for x in P.SCORE_CODES)}))"),
    ("MAXIMUM_DTI_Rejection", f"rec_dti > {P.REFI_MAX_DTI}"),
    ("LOAN_SIZE_Rejection", f"(amount > {_f(P.REFI_LOAN_MAX)} OR amount < {_f(P.REFI_LOAN_MIN)})"),
    ("CITIZENSHIP_Rejection", "citizenship NOT IN ('CITIZEN', 'PERMANENT_RESIDENT')"),
    ("INQ3MONTHS_Rejection", "IQT9416 > 3"),
    ("THIN_FILE_Rejection", "(ALS8220 < 12 OR ALX8220 < 12)"),
    ("STUDENT_LOANS_Rejection", "(STU8151 < 13 OR (STU6200 > 30 AND STU6200 <= 400))"),
    ("NEW_CREDIT_TRADES_RATIO_Rejection", "(ALL0400 > 15 AND ALL0337 / nullif(ALL0400, 0) > 0.3)"),
    ("INSTALLMENT_AND_REVOLVING_PAYMENTS_Rejection", "(REV2326 + ILN2326 + MTA2326) > 0"),
    ("BANKRUPTCY_Rejection", "(ALL9221 <= 84 OR ALL9120 > (ALL9121 + ALL9122))"),
    ("COLLECTIONS_Rejection", "(COL5064 + COL5067 + COL5068 + COL5069) > 500"),
    ("MAJOR_DEROGATORY_Rejection", "ALL5361 > 1500"),
]
REFI_ORDER = ["LOAN_SIZE_Rejection", "CITIZENSHIP_Rejection", "CREDIT_SCORE_Rejection", "MAXIMUM_DTI_Rejection",
              "INQ3MONTHS_Rejection", "THIN_FILE_Rejection", "STUDENT_LOANS_Rejection",
              "NEW_CREDIT_TRADES_RATIO_Rejection", "INSTALLMENT_AND_REVOLVING_PAYMENTS_Rejection",
              "BANKRUPTCY_Rejection", "COLLECTIONS_Rejection", "MAJOR_DEROGATORY_Rejection"]


def refi_ctes() -> str:
    norm = ", ".join(
        f"CASE WHEN TRY_CAST({c} AS DOUBLE) IN (999999998.0, 999999996.0) THEN 0.0 ELSE TRY_CAST({c} AS DOUBLE) END AS {c}"
        if c == "MTA5830" else f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in BUREAU_CODES)
    hc, bc = _d(P.REFI_HOUSING_CUTOFF), _d(P.REFI_BUREAU_CUTOFF)
    extra = [LATEST_DECISION,
             ("rld", f"""SELECT id, TRY_CAST(uw_packet.credit_score AS DOUBLE) AS packet_score,
                  uw_packet.revolving_debt.amount AS rec_revolving, uw_packet.installment_debt.amount AS rec_installment,
                  uw_packet.monthly_income.amount AS verified_income, {rhu('uw_packet.home_amount / 400', 2)} AS rec_housing,
                  uw_packet.transportation_expense.amount AS rec_transport, uw_packet.bureau_debt.amount AS rec_bureau_debt,
                  uw_packet.current_student_payment.amount AS rec_student_payment,
                  uw_packet.pre_loan_cashflow.amount AS rec_pre_fcf, uw_packet.post_loan_cashflow.amount AS rec_post_fcf, CAST(event_ts AS DATE) AS decision_date,
                  offers FROM latest_decision"""),
             ("roffers", "SELECT id, o.term AS term_years, min_by(o.rate, o.fee) AS offer_rate FROM (SELECT id, unnest(offers) AS o FROM rld) GROUP BY id, o.term"),
             ("hard", f"SELECT person, credit_type, {norm} FROM bureau_raw WHERE credit_type = 'Hard Credit'"),
             ("rin", f"""SELECT a.* REPLACE (CASE WHEN a.app_date = {_d(P.BAD_APP_DATE)} THEN r.decision_date ELSE a.app_date END AS app_date),
                  h.* EXCLUDE (person), r.* EXCLUDE (id, offers), o.offer_rate,
                  {rhu('r.rec_revolving + r.rec_installment / 10', 2)} AS rec_total_revolving,
                  {rhu('r.rec_housing / 2', 2)} AS rec_mortgage,
                  r.rec_revolving + r.rec_installment + r.rec_housing AS rec_monthly_debt,
                  CASE WHEN a.segment = 'AUTOMOBILE' THEN 'NON_RESIDENT' WHEN a.segment = 'MACHINERY' THEN 'PERMANENT_RESIDENT'
                       ELSE 'CITIZEN' END AS citizenship,
                  {rhu('r.rec_installment / nullif(r.verified_income, 0)', 4)} AS rec_dti,
                  (a.decision != 'DECLINE' AND a.status NOT IN ('DECLINED', 'CANCELLED')) AS is_approved
                FROM app a JOIN hard h ON a.person = h.person LEFT JOIN rld r ON a.id = r.id
                LEFT JOIN roffers o ON a.id = o.id AND a.term_years = o.term_years"""),
             ("rb", "SELECT *, " + ", ".join(f"{cond} AS {n}" for n, cond in REFI_RULES_SQL) + " FROM rin"),
             ("rc", f"""SELECT *,
                  CASE WHEN {' OR '.join(f'{n} IS TRUE' for n, _ in REFI_RULES_SQL)} THEN 'True' ELSE 'False' END AS hard_knock,
                  CASE {' '.join(f"WHEN coalesce({n}, false) AND is_approved THEN '{n}_Failure'" for n in REFI_ORDER)}
                       ELSE 'Pass' END AS hard_knock_failure,
                  {_z()} AS z,
                  CASE WHEN MTX5839 > 0 AND NOT (app_date < {hc}) THEN MTX5839
                       WHEN MTX5839 > 0 AND MTJ0416 > 0 AND app_date < {hc} THEN MTX5839 * 0.5
                       WHEN MTX5839 > 0 AND MTJ0416 <= 0 AND app_date < {hc} THEN MTX5839
                       ELSE rec_housing END AS t_housing,
                  CASE WHEN AUT5820 > 0 THEN AUT5820 + 200 ELSE 350.0 END AS t_transport,
                  CASE WHEN app_date >= {bc} THEN ALL5830 - MTA5830 - STU5820
                       WHEN app_date >= {hc} THEN ALL5830 - MTA5830 - AUT5820 - STU5820
                       ELSE ALL5830 - MTX5839 - AUT5820 END AS t_other_debt,
                  CASE WHEN verified_income > income OR verified_income = 0 THEN income ELSE verified_income END AS calc_income,
                  {debt_parts_sql('packet_score', 680, 740)}
                FROM rb"""),
             ("rc2", f"""SELECT *,
                  {rhu('CASE WHEN BCC5830 > BCX5830 THEN ALX5830 - ILN5824 ELSE t_revolving_debt + t_installment_debt + t_mortgage_debt + t_housing END', 4)} AS t_monthly_debt,
                  {_factor('offer_rate', 'term_years * 12')} AS offer_factor,
                  calc_income * CAST(0.8 AS DOUBLE) - t_housing - t_other_debt AS cash_base
                FROM rc"""),
             ("rd", f"""SELECT *,
                  {_student_assumed('greatest(amount, STU5020)')} AS pre_payment,
                  {_blended('amount', 'STU5020', 'offer_factor')} AS post_payment
                FROM rc2"""),
             ("rd2", f"""SELECT *, {_student_assumed('amount')} AS requested_payment,
                  CASE WHEN app_date < {bc} THEN {_student_assumed('amount')} ELSE pre_payment END AS pre_flow,
                  CASE WHEN app_date < {bc} THEN {rhu('amount * offer_factor', 3)} ELSE post_payment END AS post_flow
                FROM rd"""),
             ("re", f"""SELECT *, {_fcf('pre_flow')} AS pre_fcf, {_fcf('post_flow')} AS post_fcf,
                  {rhu('t_monthly_debt / nullif(calc_income, 0)', 4)} AS t_dti
                FROM rd2"""),
             ("rf", f"""SELECT *,
                  CASE WHEN hard_knock != 'True' AND t_monthly_debt / nullif(income, 0) > {P.REFI_MAX_DTI} AND is_approved
                         THEN 'Pre_Loan_DTI_Decline_Failure'
                       WHEN t_monthly_debt / nullif(income, 0) IS NULL THEN 'Unavailable' ELSE 'Pass' END AS dti_failure,
                  CASE WHEN hard_knock_failure = 'Pass' AND (t_monthly_debt / nullif(calc_income, 0) <= {P.REFI_MAX_DTI}
                            OR t_monthly_debt / nullif(calc_income, 0) IS NULL) AND post_fcf < {_f(P.FCF_FLOOR)} AND is_approved
                         THEN 'Post_Loan_FCF_Decline_Failure'
                       WHEN post_fcf IS NULL THEN 'Unavailable' ELSE 'Pass' END AS fcf_failure,
                  CASE WHEN {rhu('rec_revolving', 0)} = {rhu('z', 0)} THEN 'Match' WHEN {rhu('rec_revolving', 0)} != {rhu('z', 0)} THEN 'Unmatch' ELSE 'Unavailable' END AS card_debt_match,
                  CASE WHEN {rhu('rec_housing', 0)} = {rhu('t_housing', 0)} THEN 'Match' WHEN {rhu('rec_housing', 0)} != {rhu('t_housing', 0)} THEN 'Unmatch' ELSE 'Unavailable' END AS housing_match,
                  CASE WHEN {rhu('rec_dti', 2)} = {rhu('t_dti', 2)} THEN 'Match' WHEN {rhu('rec_dti', 2)} != {rhu('t_dti', 2)} THEN 'Unmatch' ELSE 'Unavailable' END AS dti_match,
                  CASE WHEN {rhu('rec_installment', 0)} = {rhu('t_installment_debt', 0)} THEN 'Match' WHEN {rhu('rec_installment', 0)} != {rhu('t_installment_debt', 0)} THEN 'Unmatch' ELSE 'Unavailable' END AS installment_match,
                  CASE WHEN {rhu('rec_transport', 0)} = {rhu('t_transport', 0)} THEN 'Match' WHEN {rhu('rec_transport', 0)} != {rhu('t_transport', 0)} THEN 'Unmatch' ELSE 'Unavailable' END AS transport_match,
                  CASE WHEN {rhu('rec_bureau_debt', 0)} = {rhu('t_other_debt', 0)} THEN 'Match' WHEN {rhu('rec_bureau_debt', 0)} != {rhu('t_other_debt', 0)} THEN 'Unmatch' ELSE 'Unavailable' END AS bureau_debt_match,
                  CASE WHEN {rhu('rec_student_payment', 0)} = {rhu('requested_payment', 0)} THEN 'Match' WHEN {rhu('rec_student_payment', 0)} != {rhu('requested_payment', 0)} THEN 'Unmatch' ELSE 'Unavailable' END AS student_payment_match,
                  CASE WHEN {rhu('rec_pre_fcf', 0)} = {rhu('pre_fcf', 0)} THEN 'Match' WHEN {rhu('rec_pre_fcf', 0)} != {rhu('pre_fcf', 0)} THEN 'Unmatch' ELSE 'Unavailable' END AS pre_fcf_match,
                  CASE WHEN {rhu('rec_post_fcf', 0)} = {rhu('post_fcf', 0)} THEN 'Match' WHEN {rhu('rec_post_fcf', 0)} != {rhu('post_fcf', 0)} THEN 'Unmatch' ELSE 'Unavailable' END AS post_fcf_match,
                  CASE WHEN {rhu('rec_total_revolving', 0)} = {rhu('t_revolving_debt', 0)} THEN 'Match' WHEN {rhu('rec_total_revolving', 0)} != {rhu('t_revolving_debt', 0)} THEN 'Unmatch' ELSE 'Unavailable' END AS total_revolving_match,
                  CASE WHEN {rhu('rec_mortgage', 0)} = {rhu('t_mortgage_debt', 0)} THEN 'Match' WHEN {rhu('rec_mortgage', 0)} != {rhu('t_mortgage_debt', 0)} THEN 'Unmatch' ELSE 'Unavailable' END AS mortgage_match,
                  CASE WHEN {rhu('rec_monthly_debt', 0)} = {rhu('t_monthly_debt', 0)} THEN 'Match' WHEN {rhu('rec_monthly_debt', 0)} != {rhu('t_monthly_debt', 0)} THEN 'Unmatch' ELSE 'Unavailable' END AS monthly_debt_match
                FROM re"""),
             ("refi", """SELECT *,
                  CASE WHEN (coalesce(ends_with(hard_knock_failure, 'Failure'), false) OR coalesce(ends_with(dti_failure, 'Failure'), false)
                             OR coalesce(ends_with(fcf_failure, 'Failure'), false)) AND status NOT IN ('DECLINED', 'CANCELLED')
                         THEN 'should have been declined'
                       WHEN coalesce(NOT ends_with(hard_knock_failure, 'Failure'), true) AND coalesce(NOT ends_with(dti_failure, 'Failure'), true)
                            AND coalesce(NOT ends_with(fcf_failure, 'Failure'), true) AND hard_knock != 'True'
                            AND decision = 'DECLINE' AND status = 'DECLINED' THEN 'should not have been declined'
                       ELSE 'Pass' END AS verdict
                FROM rf"""),
             ]
    return W("app", "bureau_raw", "decisions", extra=extra)


_R = refi_ctes()
REFI_MATCHES = ("card_debt_match, housing_match, dti_match, installment_match, transport_match, bureau_debt_match, "
                "student_payment_match, pre_fcf_match, post_fcf_match, total_revolving_match, mortgage_match, monthly_debt_match")
REFI_COLS = ("id, app_date, status, decision, packet_score, hard_knock, hard_knock_failure, dti_failure, fcf_failure, "
             f"t_monthly_debt, pre_fcf, post_fcf, {REFI_MATCHES}, verdict")
sql("q_refi_audit", _R + f"SELECT {REFI_COLS} FROM refi WHERE verdict != 'Pass'")
sql("q_battery", _R + "SELECT id, " + ", ".join(n for n, _ in REFI_RULES_SQL) + ", hard_knock, hard_knock_failure FROM rc")
sql("q_expenses", _R + f"SELECT id, {rhu('t_housing', 2)} AS t_housing, t_transport, t_other_debt FROM rc")
sql("q_income", _R + "SELECT id, income, verified_income, calc_income FROM rc")
sql("q_payment", _R + f"SELECT id, term_years, offer_rate, pre_payment, {rhu('amount * offer_factor', 2)} AS offer_payment FROM rd")
sql("q_blended", _R + "SELECT id, amount, STU5020, post_payment FROM rd")
sql("q_cash_flow", _R + "SELECT id, pre_fcf, post_fcf, t_dti FROM re")
sql("q_fcf_check", _R + "SELECT id, dti_failure, fcf_failure FROM rf")


# =============================================================================
# pricing (plans.pricing)
# =============================================================================
def _grid_values(rows) -> str:
    return ", ".join(f"({t}, {str(fl).upper()}, '{kind}', {_f(lo)}, {_f(hi)}, {slo}, {shi}, {_f(r)}, {prio})"
                     for t, fl, kind, lo, hi, slo, shi, r, prio in rows)


OFFERS = ("offers_flat", """SELECT id, seq, part, supp, event_ts, o.term AS o_term, o.rate AS o_rate, o.fee AS o_fee,
    o.kind AS o_kind, o.margin AS o_margin, o.index_rate AS o_index_rate, o.apr AS o_apr,
    o.non_autopay_rate AS o_non_autopay_rate FROM (SELECT id, seq, part, supp, event_ts, unnest(offers) AS o FROM decisions)""")
LATEST_OFFERS = ("offers_latest", OFFERS[1].replace("FROM decisions", "FROM latest_decision"))

def _grid_ctes(rows) -> list[tuple[str, str]]:
    return [OFFERS,
            ("grid", f"SELECT * FROM (VALUES {_grid_values(rows)}) t(term, first_lien, property_type, lo, hi, slo, shi, rate, prio)"),
            ("go", f"""SELECT l.id, seq, part, o_term, o_rate, a.score, a.person, a.app_date, p.n_liens <= 2 AS first_lien,
                  CASE WHEN p.land_use = 112 THEN 'CONDO' ELSE 'HOME' END AS property_type,
                  {rhu('p.owed / nullif(p.avm, 0)', 4)} AS cltv
               FROM offers_flat l JOIN app a ON l.id = a.id
               LEFT JOIN prop p ON l.id = p.id""")]


_GRID_FROM = W("app", "prop", "decisions", extra=[*_grid_ctes(P.rate_grid_rows()), ("go2", "SELECT *, row_number() OVER () AS n FROM go"),
    ("hit", """SELECT n, arg_min(rate, prio) AS expected_rate FROM go2 JOIN grid
               ON o_term = grid.term AND go2.first_lien = grid.first_lien AND go2.property_type = grid.property_type
                  AND cltv BETWEEN lo AND hi AND score BETWEEN slo AND shi GROUP BY n"""),
    ("priced", f"""SELECT go2.*, expected_rate, CASE WHEN expected_rate IS NULL THEN 'NO_GRID_CELL'
                      WHEN {rhu('o_rate', 4)} = {rhu('expected_rate', 4)} THEN 'OK' ELSE 'RATE_MISMATCH' END AS grid_check
                   FROM go2 LEFT JOIN hit ON hit.n = go2.n""")])
sql("q_grid_check", _GRID_FROM + """
SELECT id, seq, part, o_term AS term, first_lien, property_type, cltv, score, o_rate AS rate, expected_rate, grid_check FROM priced""")
sql("q_rate_mismatches", _GRID_FROM + f"""
SELECT id, person, app_date, seq, part, o_term AS term, o_rate AS rate, expected_rate, grid_check FROM priced
WHERE grid_check != 'OK' AND app_date >= {_d(P.REGIME_DATES['r1'])}""")


def _faulty_grid() -> list[tuple]:
    out = []
    for t, fl, kind, lo, hi, slo, shi, rate, prio in P.rate_grid_rows():
        if (t, lo, slo) != (5, 0.5, 700):
            out.append((t, fl, kind, lo, hi, slo, 729 if (t, lo, slo) == (15, 0.65, 680) else shi,
                        0.2 if (t, lo, slo) == (10, 0.6, 740) else rate, prio))
    return out


# Every position of the grid's edges is tried by a point inside it: the edge, or the middle to the next one.
sql("q_grid_faults", W("app", "prop", "decisions", extra=[*_grid_ctes(_faulty_grid()),
    ("ex", "SELECT e, row_number() OVER (ORDER BY e) - 1 AS i, lead(e) OVER (ORDER BY e) AS f FROM (SELECT lo AS e FROM grid UNION SELECT hi FROM grid)"),
    ("px", "SELECT CAST(2 * i AS INTEGER) AS x, e AS v FROM ex UNION ALL SELECT CAST(2 * i + 1 AS INTEGER), (e + f) / 2 FROM ex WHERE f IS NOT NULL"),
    ("ey", "SELECT e AS v, CAST(row_number() OVER (ORDER BY e) - 1 AS INTEGER) AS y FROM (SELECT slo AS e FROM grid UNION SELECT shi + 1 FROM grid)"),
    ("held", """SELECT term, first_lien, property_type, x, y, arg_min(rate, prio) AS rate, count(DISTINCT rate) AS rates
                FROM grid JOIN px ON px.v BETWEEN lo AND hi JOIN ey ON ey.v BETWEEN slo AND shi GROUP BY ALL"""),
    ("box", """SELECT a.term, a.first_lien, a.property_type, px.x, ey.y FROM (SELECT DISTINCT term, first_lien, property_type FROM grid) a, px, ey"""),
    ("gap", """SELECT b.* FROM box b WHERE NOT EXISTS (SELECT 1 FROM held h WHERE (h.term, h.first_lien, h.property_type, h.x, h.y) = (b.term, b.first_lien, b.property_type, b.x, b.y))
               AND ((EXISTS (SELECT 1 FROM held h WHERE (h.term, h.first_lien, h.property_type, h.x) = (b.term, b.first_lien, b.property_type, b.x) AND h.y < b.y)
                     AND EXISTS (SELECT 1 FROM held h WHERE (h.term, h.first_lien, h.property_type, h.x) = (b.term, b.first_lien, b.property_type, b.x) AND h.y > b.y))
                 OR (EXISTS (SELECT 1 FROM held h WHERE (h.term, h.first_lien, h.property_type, h.y) = (b.term, b.first_lien, b.property_type, b.y) AND h.x < b.x)
                     AND EXISTS (SELECT 1 FROM held h WHERE (h.term, h.first_lien, h.property_type, h.y) = (b.term, b.first_lien, b.property_type, b.y) AND h.x > b.x)))"""),
    ("fault", """SELECT term, first_lien, property_type, 'OVERLAP' AS kind, x, y FROM held WHERE x % 2 = 1 AND rates > 1
                 UNION ALL SELECT term, first_lien, property_type, 'GAP', x, y FROM gap
                 UNION ALL SELECT term, first_lien, property_type, 'ORDER', x, y FROM (
                     SELECT *, lag(rate) OVER (PARTITION BY term, first_lien, property_type, x ORDER BY y) AS before FROM held) WHERE rate > before"""),
    ("hits", """SELECT o_term, go.first_lien, go.property_type, x, y, count(*) AS offers FROM go
                JOIN (SELECT *, lead(v) OVER (ORDER BY x) AS next FROM px) p ON CASE WHEN x % 2 = 0 THEN cltv = v
                     ELSE cltv > (SELECT max(e) FROM ex WHERE e < v) AND cltv < (SELECT min(e) FROM ex WHERE e > v) END
                JOIN (SELECT *, lead(v) OVER (ORDER BY v) AS next FROM ey) s ON score >= s.v AND (score < s.next OR s.next IS NULL)
                GROUP BY ALL""")]) + """
SELECT f.term, f.first_lien, f.property_type, kind, f.x, f.y, CAST(coalesce(offers, 0) AS BIGINT) AS offers FROM fault f
LEFT JOIN hits h ON (h.o_term, h.first_lien, h.property_type, h.x, h.y) = (f.term, f.first_lien, f.property_type, f.x, f.y)""")

def _match(a: str, b: str) -> str:
    return (f"CASE WHEN {rhu(a, 4)} = {rhu(b, 4)} THEN 'Match' WHEN {rhu(a, 4)} != {rhu(b, 4)} THEN 'Unmatch' "
            "ELSE 'Unavailable' END")


_AUTO = ("CASE o_kind WHEN 'FIXED' THEN o_rate WHEN 'VARIABLE' THEN o_margin + coalesce(o_index_rate, 0.0::DOUBLE) "
         "- 0.0025::DOUBLE END")
_MANUAL = ("CASE o_kind WHEN 'FIXED' THEN o_non_autopay_rate WHEN 'VARIABLE' THEN o_margin + coalesce(o_index_rate, 0.0::DOUBLE) "
           "- 0.0::DOUBLE END")
_LATEST_OFFERS = W("decisions", extra=[LATEST_DECISION, LATEST_OFFERS])
sql("q_offer_rate", _LATEST_OFFERS + f"""
SELECT id, seq, part, o_term AS term, o_kind AS kind, o_fee AS fee, o_rate AS rate, {rhu(_AUTO, 4)} AS expected_rate,
       {_match('o_rate', _AUTO)} AS rate_match, o_non_autopay_rate AS manual_rate, {rhu(_MANUAL, 4)} AS expected_manual_rate,
       {_match('o_non_autopay_rate', _MANUAL)} AS manual_rate_match
FROM offers_latest""")
sql("q_usury_cap", _LATEST_OFFERS + f"""SELECT id, seq, part, o_term AS term, o_fee AS fee,
    {rhu('o_margin + coalesce(o_index_rate, 0.0::DOUBLE) + o_fee', 4)} AS usury_pct FROM offers_latest""")

_DIV = ", ".join(f"({t}, {_f(r)}, {_f(a)})" for t, r, a in P.BUYDOWN_DIVISORS)
_ER = rhu("base_rate - o_fee / rate_div", 5)
_EA = rhu("base_rate - o_fee / apr_div", 5)
sql("q_fee_buydown", W("decisions", extra=[LATEST_DECISION, LATEST_OFFERS,
    ("base", "SELECT id AS b_id, o_term AS b_term, o_rate AS base_rate FROM offers_latest WHERE o_fee = 0 AND o_kind = 'FIXED'"),
    ("div", f"SELECT * FROM (VALUES {_DIV}) t(d_term, rate_div, apr_div)")]) + f"""
SELECT id, seq, part, o_term AS term, o_fee AS fee, base_rate, o_rate AS rate, {_ER} AS expected_rate,
       {_match('o_rate', _ER)} AS rate_match, o_apr AS apr, {_EA} AS expected_apr, {_match('o_apr', _EA)} AS apr_match
FROM offers_latest LEFT JOIN (SELECT DISTINCT * FROM base) ON id = b_id AND o_term = b_term LEFT JOIN div ON o_term = d_term
WHERE o_kind = 'FIXED'""")


# =============================================================================
# liens (plans.liens)
# =============================================================================
sql("q_lien_position", W("decisions", extra=[LATEST_DECISION,
    ("items", LIEN_ITEMS), ("top", LIEN_TOP), ("best", LIEN_BEST)]) +
    "SELECT t.id, next_position, best_matched, best_match_type, best_balance FROM top t JOIN best b ON t.id = b.id")

_MS = ("ms", """SELECT m.*, s.app_date, coalesce(TRY_CAST(nullif(avm_sale_date, '') AS DATE),
                   TRY_CAST(nullif(transfer_sale_date, '') AS DATE), TRY_CAST(nullif(market_sale_date, '') AS DATE)) AS last_sale_date
               FROM mortgage_history m LEFT JOIN property_sale_dates s ON m.id = s.id""")
_ORIG, _REC = "TRY_CAST(nullif(origination_date, '') AS DATE)", "TRY_CAST(nullif(recording_date, '') AS DATE)"
sql("q_lien_title", W("mortgage_history", "property_sale_dates", extra=[_MS,
    ("title", f"""SELECT *, CASE WHEN date_diff('day', {_ORIG}, last_sale_date) > 7 OR date_diff('day', {_REC}, last_sale_date) > 7
                      OR (last_sale_date IS NULL AND payoff_date IS NOT NULL AND status_indicator != 'O')
                      OR origination_date IS NULL OR recording_date IS NULL OR amount IS NULL THEN 'Ignore' ELSE 'Show' END AS display
                  FROM ms""")]) + """
SELECT id, property_id, document_number, recording_date, origination_date, status_indicator, amount, last_sale_date, display FROM (
  SELECT *, row_number() OVER (PARTITION BY property_id, id, document_number, recording_date
      ORDER BY updated_seconds DESC, updated_nanos DESC, created_seconds DESC, created_nanos DESC, length(lender) DESC,
               origination_date DESC NULLS LAST, amount DESC NULLS LAST, status_indicator DESC, payoff_date DESC) AS r
  FROM title) WHERE r = 1""")
sql("q_lien_title_first", W("app", "bureau_raw", "mortgage_history", "property_sale_dates", "property_history", extra=[_MS, BUREAU_NORM,
    ("nested", """SELECT id, 'D' || CAST(f.lien_position AS VARCHAR) AS original_document_number,
                         TRY_CAST(f.origination_date AS DATE) AS first_mortgage_date
                  FROM property_history p LEFT JOIN LATERAL (SELECT unnest(p.financial_history.finance_history_attributes) AS f) ON TRUE""")]) + f"""
SELECT ms.id, ms.property_id, ms.amount, status_indicator, original_document_number, recording_date, origination_date, payoff_date,
       last_sale_date, first_mortgage_date, MTA5020 AS mortgage_balance,
       CASE WHEN date_diff('day', {_ORIG}, last_sale_date) > 7 OR date_diff('day', {_REC}, last_sale_date) > 7 OR last_sale_date IS NULL
                 OR origination_date IS NULL OR recording_date IS NULL OR ms.amount IS NULL THEN 'Ignore' ELSE 'Show' END AS display
FROM ms LEFT JOIN nested ON nested.id = ms.id LEFT JOIN app ON app.id = ms.id LEFT JOIN bureau ON bureau.person = app.person
WHERE status_indicator = 'O' AND length(payoff_date) < 1""")
sql("q_lien_open_gaps", W("mortgage_history", "property_sale_dates", extra=[_MS]) + f"""
SELECT id, app_date, origination_date, recording_date, amount, document_number, last_sale_date FROM ms
WHERE length(payoff_date) < 1 AND status_indicator = 'O'
  AND (date_diff('day', {_ORIG}, last_sale_date) > 7 OR date_diff('day', {_REC}, last_sale_date) > 7)""")
sql("q_lien_tx", W("mortgage_history") + """
SELECT id, t.doc_id AS doc_id, t.lien_position AS lien_position, t.loan_amount AS loan_amount,
       CAST(date_diff('day', t.tx_date, t.sale_date) AS INTEGER) AS sale_gap_days,
       CASE WHEN date_diff('day', t.tx_date, t.sale_date) > 7 OR t.lien_position IS NULL
                 OR (t.tx_date IS NULL AND t.recording_date IS NULL) OR t.loan_amount IS NULL THEN 'Ignore' ELSE 'Show' END AS display
FROM mortgage_history m LEFT JOIN LATERAL (SELECT unnest(m.transactions) AS t) u ON TRUE
WHERE t.type_description = 'FINANCE'""")
sql("q_tradeline_class", W("app", "tradelines", extra=[
    ("mort", "SELECT * FROM tradelines WHERE account_type IN ('26', '19')"),
    ("near", """SELECT m.id, max(CASE WHEN open THEN open_date END) AS last_open_date,
                  min(CASE WHEN NOT open THEN abs(date_diff('day', status_date, app_date)) END) AS closest_closed_days
                FROM mort m JOIN (SELECT id, app_date FROM app) a ON m.id = a.id GROUP BY m.id""")]) + """
SELECT m.id, a.app_date, account_type, status, open, open_date, status_date, balance,
       CASE WHEN account_type IN ('89', '47', '6D') THEN 'Exception1'
            WHEN status IN ('05', '10', '67', '69') THEN 'Exception2'
            WHEN (NOT open) AND (date_diff('day', last_open_date, a.app_date) <= 30 OR closest_closed_days <= 30)
              THEN 'Exception3' END AS display_class
FROM mort m JOIN (SELECT id, app_date FROM app) a ON m.id = a.id LEFT JOIN near n ON m.id = n.id""")


# =============================================================================
# operations scorecard (plans.scorecard)
# =============================================================================
from .plans import scorecard as _SC  # noqa: E402

_TS = lambda x: f"TIMESTAMP '{x}'"
_WIN = f"BETWEEN {_TS(_SC.WINDOW[0])} AND {_TS(_SC.WINDOW[1])}"
_DWIN = f"BETWEEN {_TS(_SC.DNC_WINDOW[0])} AND {_TS(_SC.DNC_WINDOW[1])}"


def _subtype_case() -> str:
    arms = " ".join(f"WHEN subtask_desc IN ({_in(raws)}) THEN '{canon}'" for canon, raws in P.SUBTASK_ALIASES)
    return f"CASE {arms} WHEN subtask_desc LIKE '%Email' THEN 'System' ELSE subtask_desc END"


def _outcome_case() -> str:
    g = dict(P.OUTCOME_GROUPS)
    return f"""CASE WHEN last_outcome = 'CANCEL_TASK' OR (last_outcome IS NULL AND last_status IN ('CANCELLED', '1', '2', NULL)) THEN 'SYSTEM_CANCEL_TASK'
      WHEN last_outcome IN ({_in(g['CLEARED'])}) THEN 'CLEARED'
      WHEN last_outcome IN ({_in(g['MANUAL_CANCEL'])}) THEN 'MANUAL_CANCEL'
      WHEN last_outcome = 'COMPLETE_TASK' OR (last_outcome IS NULL AND last_status = 'COMPLETE') THEN 'SYSTEM_COMPLETE_TASK'
      WHEN last_outcome IN ({_in(g['POTENTIAL_FRAUD'])}) THEN 'POTENTIAL_FRAUD'
      WHEN last_outcome IN ({_in(g['CONFIRM_FRAUD'])}) THEN 'CONFIRM_FRAUD'
      ELSE last_outcome END"""


_WEIGHTS = ", ".join(f"({_lit_s}, {w})" for _lit_s, w in ((f"'{l}'", w) for l, w in P.TASK_WEIGHTS))
SC_CTES = [
    ("a1", "SELECT 'C' || CAST(person AS VARCHAR) AS a_identity, 'O' || CAST(id AS VARCHAR) AS a_app, state AS a_state, app_date, id, term_years, status FROM app"),
    ("a_last", "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY a_identity ORDER BY app_date DESC, id DESC) AS r FROM a1) WHERE r = 1"),
    ("a_decl", "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY a_identity ORDER BY app_date DESC, id DESC) AS r FROM a1 WHERE status = 'DECLINED') WHERE r = 1"),
    ("identity_u", """SELECT a_app AS application_id, email, coalesce(a_identity, identity) AS identity_id, 'H' || CAST(id AS VARCHAR) AS short_id,
                       coalesce(a_state, state) AS state, first_name || ' ' || last_name AS borrower_name
                     FROM profile lp LEFT JOIN a1 ON lp.identity = a1.a_identity
                     UNION ALL
                     SELECT a_identity, email, coalesce(a_identity, identity), 'S' || CAST(id AS VARCHAR), coalesce(a_state, state), first_name || ' ' || last_name
                     FROM profile lp LEFT JOIN a_last ON lp.identity = a_last.a_identity
                     UNION ALL
                     SELECT 'R' || CAST(id AS VARCHAR), email, coalesce(a_identity, identity), 'L' || CAST(id AS VARCHAR), coalesce(a_state, state), first_name || ' ' || last_name
                     FROM profile lp LEFT JOIN (SELECT * FROM a1 WHERE term_years >= 15) a3 ON lp.identity = a3.a_identity
                     UNION ALL
                     SELECT a_identity, email, coalesce(a_identity, identity), 'M' || CAST(id AS VARCHAR), coalesce(a_state, state), first_name || ' ' || last_name
                     FROM profile lp LEFT JOIN a_decl ON lp.identity = a_decl.a_identity"""),
    ("cs", """SELECT application AS cs_application, string_agg(DISTINCT message, ' | ' ORDER BY message) AS cs_message FROM tasks
              WHERE last_status IN ('FAILED', 'CANCELLED') AND proficiencies = '[SUPERVISOR]' GROUP BY application"""),
    ("ntasks", f"""SELECT task_id, application, task_type,
                     CASE WHEN task_type = 'PROPERTY_OWNERSHIP_FRAUD_REVIEW' OR (task_type = 'FRAUD_REVIEW' AND message LIKE '%IDENTITY_FRAUD%')
                               OR (task_type = '4' AND message LIKE '%IDENTITY_FRAUD%') THEN 'PROPERTY_OWNERSHIP_FRAUD_REVIEW'
                          WHEN task_type = 'CREDIT_FRAUD_REVIEW' OR (task_type = 'FRAUD_REVIEW' AND message LIKE '%CREDIT_FRAUD%')
                               THEN 'EXPERIAN_FRAUD_SHIELD_REVIEW'
                          ELSE task_type END AS covt_task_type,
                     subtask_desc, {_subtype_case()} AS subtask_type,
                     CASE WHEN subtask_desc = 'Compliance Fraud Review' THEN cs_message ELSE message END AS message,
                     coalesce(comments, 'none') AS comments, last_status, {_outcome_case()} AS subtask_outcome,
                     completed_by, CASE WHEN subtask_desc = 'Compliance Fraud Review' THEN created_date ELSE ts END AS completed_date, proficiencies
                   FROM tasks t LEFT JOIN cs ON t.application = cs.cs_application"""),
    ("weights", f"SELECT * FROM (VALUES {_WEIGHTS}) t(w_label, weight)"),
    ("scores", f"""SELECT completed_by AS csa_name,
                     CAST(sum(CASE WHEN subtask_outcome = 'MANUAL_CANCEL' THEN 1 ELSE 0 END) AS BIGINT) AS tasks_cancelled,
                     CAST(sum(CASE WHEN subtask_outcome != 'MANUAL_CANCEL' THEN 1 ELSE 0 END) AS BIGINT) AS tasks_completed,
                     {rhu('count(subtask_type) * avg(coalesce(weight, 0))', 6)} AS score_obtained
                   FROM ntasks RIGHT JOIN (SELECT DISTINCT application_id FROM identity_u) f ON ntasks.application = f.application_id
                   LEFT JOIN weights ON subtask_type = w_label
                   WHERE task_id IS NOT NULL AND completed_by NOT IN ({_in(P.NON_AGENTS)})
                     AND proficiencies NOT IN ('[SYSTEM]', '[]', '[COMPLIANCE]') AND completed_date {_WIN}
                   GROUP BY completed_by"""),
    ("csp", f"""SELECT DISTINCT email AS csa_email, tasks_cancelled, tasks_completed, {rhu('score_obtained', 0)} AS score_obtained
                FROM (SELECT DISTINCT email, identity_id FROM identity_u) f JOIN scores s ON f.identity_id = s.csa_name"""),
    ("chatw", f"SELECT * FROM chat WHERE created_at {_WIN}"),
    ("replies", """SELECT chat_id, e.responder_id AS responder_id, count(e.text) AS replies
                   FROM (SELECT chat_id, unnest(events) AS e FROM chatw) WHERE e.type = 'msg_out' GROUP BY chat_id, e.responder_id"""),
    ("ratings", "SELECT chat_id, final_responder AS responder_id, rating FROM chatw WHERE rating IS NOT NULL"),
    ("firsts", f"""SELECT chat_id, initial_responder, rl.latency[1] AS initial_response
                   FROM (SELECT chat_id, initial_responder, unnest(response_latency) AS rl FROM chatw)
                   WHERE rl.responder_id = initial_responder AND rl.latency[1] < {_f(P.LATENCY_CAP)}"""),
    ("lat", f"""SELECT chat_id, responder_id, count(latency) AS cnt_latency,
                  CAST(sum(CAST(latency AS DECIMAL(18,2))) AS DOUBLE) AS sum_latency
                FROM (SELECT chat_id, rl.responder_id AS responder_id, unnest(rl.latency) AS latency
                      FROM (SELECT chat_id, unnest(response_latency) AS rl FROM chatw))
                WHERE latency < {_f(P.LATENCY_CAP)} GROUP BY chat_id, responder_id"""),
    ("emails", "SELECT DISTINCT m.id AS responder_id, m.id_map AS email FROM (SELECT unnest(id_mappings) AS m FROM chatw)"),
    ("mart", f"""SELECT em.email AS csas, CAST(sum(it.replies) AS BIGINT) AS total_replies, count(h.chat_id) AS total_conversations,
                   {rhu('avg(rt.rating)', 3)} AS avg_rating, {rhu('avg(ir.initial_response)', 3)} AS initial_response_time,
                   {rhu('sum(lt.sum_latency) / nullif(sum(lt.cnt_latency), 0)', 3)} AS average_response_time
                 FROM chatw h LEFT JOIN (SELECT chat_id, rating FROM ratings) rt ON h.chat_id = rt.chat_id
                 JOIN replies it ON it.chat_id = h.chat_id JOIN emails em ON it.responder_id = em.responder_id
                 JOIN (SELECT chat_id, initial_response FROM firsts) ir ON ir.chat_id = h.chat_id
                 LEFT JOIN lat lt ON lt.chat_id = h.chat_id AND lt.responder_id = em.responder_id
                 GROUP BY em.email"""),
    ("dnc_src", f"SELECT * REPLACE (coalesce(updated_by, 'Not Updated') AS updated_by) FROM contact_preferences WHERE created_ts {_DWIN}"),
    ("dnc", """SELECT csas, email, CAST(sum(dnc_num) AS BIGINT) AS dnc_num FROM (
                 SELECT created_by AS csas, email, count(*) AS dnc_num FROM dnc_src JOIN profile ON created_by = identity GROUP BY created_by, email
                 UNION ALL
                 SELECT updated_by, email, count(*) FROM dnc_src JOIN profile ON updated_by = identity GROUP BY updated_by, email)
               GROUP BY csas, email"""),
    ("cmp_src", f"SELECT * REPLACE (coalesce(approver, 'Not Approved') AS approver) FROM complaints WHERE created_ts {_DWIN}"),
    ("complaint", """SELECT csas, email, CAST(sum(complaint_num) AS BIGINT) AS complaint_num FROM (
                 SELECT creator AS csas, email, count(*) AS complaint_num FROM cmp_src JOIN profile ON creator = identity GROUP BY creator, email
                 UNION ALL
                 SELECT approver, email, count(*) FROM cmp_src JOIN profile ON approver = identity GROUP BY approver, email)
               GROUP BY csas, email"""),
    ("notary", f"""SELECT participant AS csas, email, count(room) AS notary_call_num,
                     {rhu("avg(date_sub('minute', call_started, call_ended))", 3)} AS notary_call_duration,
                     {rhu("avg(date_sub('minute', connected, disconnected))", 3)} AS notary_call_handle_time,
                     {rhu("avg(date_sub('minute', call_started, connected))", 3)} AS notary_call_speed_to_answer
                   FROM calls LEFT JOIN (SELECT identity, email FROM profile) lp ON participant = identity
                   WHERE email LIKE '{_SC.STAFF_DOMAIN}' AND call_started {_WIN}
                   GROUP BY participant, email"""),
]
_S = W("app", "profile", "tasks", "chat", "contact_preferences", "complaints", "calls", extra=SC_CTES)
sql("q_union_identity", _S + "SELECT * FROM identity_u")
sql("q_normalise", _S + "SELECT task_id, covt_task_type, subtask_type, subtask_outcome FROM ntasks")
sql("q_backfill", _S + "SELECT task_id, application, message, comments, completed_date FROM ntasks")
sql("q_task_score", _S + "SELECT * FROM scores")
sql("q_chat_replies", _S + "SELECT * FROM replies")
sql("q_first_response", _S + "SELECT * FROM firsts")
sql("q_latency", _S + "SELECT * FROM lat")
sql("q_ratings", _S + "SELECT * FROM ratings")
sql("q_responder_map", _S + "SELECT * FROM emails")
sql("q_chat_mart", _S + "SELECT * FROM mart")
sql("q_actor_counts", _S + "SELECT * FROM dnc")
sql("q_two_level_agg", _S + "SELECT * FROM complaint")
sql("q_call_stats", _S + "SELECT * FROM notary")
sql("q_scorecard", _S + f"""
SELECT ct.csa_email, tasks_cancelled_num, tasks_completed_num, total_score_obtained, total_replies, total_conversations,
       avg_rating, initial_response_time, average_response_time, dnc_num, complaint_num, notary_call_num,
       avg_notary_call_duration, notary_call_handle_time, avg_notary_call_speed_to_answer
FROM (SELECT csa_email, CAST(sum(tasks_cancelled) AS BIGINT) AS tasks_cancelled_num,
             CAST(sum(tasks_completed) AS BIGINT) AS tasks_completed_num, sum(score_obtained) AS total_score_obtained
      FROM csp GROUP BY csa_email) ct
LEFT JOIN (SELECT csas AS csa_email, total_replies, total_conversations, avg_rating, initial_response_time, average_response_time FROM mart) ic
  ON ic.csa_email = ct.csa_email
LEFT JOIN (SELECT email AS csa_email, CAST(sum(dnc_num) AS BIGINT) AS dnc_num FROM dnc GROUP BY email) dn ON dn.csa_email = ct.csa_email
LEFT JOIN (SELECT email AS csa_email, CAST(sum(complaint_num) AS BIGINT) AS complaint_num FROM complaint GROUP BY email) co
  ON co.csa_email = ct.csa_email
LEFT JOIN (SELECT email AS csa_email, CAST(sum(notary_call_num) AS BIGINT) AS notary_call_num,
                  {rhu('avg(notary_call_duration)', 3)} AS avg_notary_call_duration,
                  {rhu('avg(notary_call_handle_time)', 3)} AS notary_call_handle_time,
                  {rhu('avg(notary_call_speed_to_answer)', 3)} AS avg_notary_call_speed_to_answer
           FROM notary GROUP BY email) nt ON nt.csa_email = ct.csa_email""")


# =============================================================================
# scalar functions
# =============================================================================
sql("q_scalar_math", W("app") + f"""
SELECT id, {rhu('amount / 7', 0)} AS round0, {rhu('amount / 7', 2)} AS round2,
       {rhu('pow(CAST(1.01 AS DOUBLE), term_years)', 6)} AS growth, abs(amount - 100000) AS dist, -amount AS neg_amount,
       {rhu('amount / nullif(score - 600, 0)', 4)} AS ratio,
       CASE WHEN score > 700 OR score = 0 THEN 700 ELSE score END AS clamped,
       greatest(amount, income * 12) AS larger
FROM app""")
sql("q_scalar_dates", """
SELECT event_id, CAST(ts AS DATE) AS ts_date, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts_day_start,
       CAST(date_diff('day', CAST(ts AS DATE), DATE '2002-01-01') AS INTEGER) AS days_to_as_of,
       CAST(date_diff('month', DATE '2023-06-15', CAST(ts AS DATE)) AS INTEGER) AS months,
       CAST(date_diff('year', DATE '2019-12-31', CAST(ts AS DATE)) AS INTEGER) AS years,
       date_sub('minute', TIMESTAMP '2024-01-01 00:00:00', ts) AS minutes,
       CAST(ts AS DATE) >= DATE '2024-01-15' AS late_month,
       ts <= TIMESTAMP '2024-01-10 12:00:00' AS before_cutoff
FROM events""")
sql("q_scalar_strings", W("profile") + """
SELECT identity, lower(first_name) AS lower_name,
       first_name || ' ' || CASE WHEN state = 'NATION_3' THEN NULL ELSE state END AS name_state,
       CAST(length(email) AS INTEGER) AS email_len, email LIKE '%staff%' AS is_staff
FROM profile""")
sql("q_safe_cast", W("bureau_raw") + """
SELECT person, credit_type, CAST(person AS DOUBLE) AS person_num, TRY_CAST(MTA2126 AS DOUBLE) AS mta2126,
       coalesce(TRY_CAST(MTA2126 AS DOUBLE), 0.0) AS mta2126_or_zero,
       coalesce(TRY_CAST(MTA2126 AS DOUBLE), TRY_CAST(COL3211 AS DOUBLE), -1.0) AS first_known,
       coalesce(nullif(TRY_CAST(MTA2126 AS DOUBLE), 0.0), TRY_CAST(COL3211 AS DOUBLE)) AS nonzero_first,
       CASE WHEN TRY_CAST(MTA5830 AS DOUBLE) IN (999999998, 999999996) THEN 0.0 ELSE TRY_CAST(MTA5830 AS DOUBLE) END AS mta5830
FROM bureau_raw""")
sql("q_array_get", W("chat") + """
SELECT chat_id, lat[1] AS first_latency, lat[6] AS sixth_latency
FROM (SELECT chat_id, response_latency[1].latency AS lat FROM chat)""")
sql("q_epoch_order", W("mortgage_history") + """
SELECT id, document_number, created_seconds, created_nanos, created_seconds + created_nanos / 1e9 AS created_epoch
FROM mortgage_history""")


# =============================================================================
# credit-only audit, knockout flags, bad-date repair
# =============================================================================
sql("q_credit_audit", _H + "SELECT id, app_date, status, decision, fico, credit_check FROM chk1 WHERE credit_check != 'PASS'")


def _knockout_flags_sql() -> str:
    cols = [(label.replace("_Knockout_Failure", "").lower(), f"({fires}) AND is_approved")
            for label, fires, _, _ in _credit_rules_sql()]
    sel = ", ".join(f"CASE WHEN ({c}) IS TRUE THEN 'YES' ELSE 'NO' END AS {n}" for n, c in cols)
    anyf = " OR ".join(f"(({c}) IS TRUE)" for _, c in cols)
    return _H + f"SELECT id, {sel}, CASE WHEN {anyf} THEN 'FAIL' ELSE 'PASS' END AS knockout_result FROM inputs"


sql("q_knockout_flags", _knockout_flags_sql())
sql("q_date_repair", W("app", "decisions", extra=[LATEST_DECISION]) + f"""
SELECT id, app_date, repaired_date,
       CASE WHEN flag = 'Y' AND respond_by >= repaired_date THEN mail_date ELSE repaired_date END AS eff_date
FROM (SELECT a.id, a.app_date, a.mail_date, a.respond_by, a.flag,
             CASE WHEN a.app_date = {_d(P.BAD_APP_DATE)} THEN CAST(l.event_ts AS DATE) ELSE a.app_date END AS repaired_date
      FROM app a LEFT JOIN latest_decision l ON a.id = l.id)""")
sql("q_property_flags", W("app", "prop") + f"""
SELECT a.id,
       CASE WHEN (coalesce(prequal_avm, 0.0) = 0 AND coalesce(avm, 0.0) = 0) IS TRUE THEN 'YES' ELSE 'NO' END AS avm_knockout,
       CASE WHEN (land_use NOT IN ({_in(P.LAND_USE_BEFORE)})) IS TRUE THEN 'YES' ELSE 'NO' END AS land_use_code_knockout,
       CASE WHEN (acres > {_f(P.MAX_ACRES)}) IS TRUE THEN 'YES' ELSE 'NO' END AS acres_knockout,
       CASE WHEN (date_diff('day', last_sale, app_date) <= {P.RECENT_SALE_DAYS}) IS TRUE THEN 'YES' ELSE 'NO' END AS last_sale_date_knockout
FROM app a LEFT JOIN prop p ON a.id = p.id""")
sql("q_refi_reconcile", _R + f"SELECT id, {REFI_MATCHES} FROM refi")
