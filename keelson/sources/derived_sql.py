"""DuckDB SQL twins of the derived audit frames (oracle side).

Each entry is the body of a CTE; :func:`with_ctes` emits a ``WITH`` clause for
the requested frames and their dependencies in order.  The expressions mirror
``keelson.sources.derived`` one for one.
"""

from __future__ import annotations

from .bureau_codes import BUREAU_CODES
from .derived import (CATEGORY_BY_EVENT, LIEN_SHIFT, LIEN_STATES, N_AGENTS, OTHER_REASONS, RAW_OUTCOMES, TASK_STATUSES,
                      TASK_TYPE_BY_EVENT,
                      bureau_attr_sql, raw_subtasks)


def _lit(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _pick(vals, k: str) -> str:
    arr = "[" + ", ".join(_lit(v) for v in vals) + "]"
    if all(v is None for v in vals):
        arr = "CAST(" + arr + " AS VARCHAR[])"
    return f"({arr})[CAST(({k}) % {len(vals)} + 1 AS INTEGER)]"


def _task_type() -> str:
    arms = " ".join(f"WHEN event_type = '{s}' THEN '{d}'" for s, d in TASK_TYPE_BY_EVENT)
    return f"CASE {arms} ELSE '4' END"


def rhu(expr: str, digits: int) -> str:
    """SQL twin of functions.numeric.round_half_up."""
    return f"CAST(ROUND(CAST(({expr}) AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def _third_reason() -> str:
    codes = ", ".join(f"{{'code': '{x}', 'reason': '{x.lower()}'}}" for x in OTHER_REASONS)
    return f"([{codes}])[CAST(l_partkey % {len(OTHER_REASONS)} + 1 AS INT)]"


def _offer(term: int, bump: float, kind: str, paid: bool) -> str:
    b = f"(l_discount + CAST({bump} AS DOUBLE))"
    rate = f"({b} - CASE WHEN l_partkey % 2 = 0 THEN l_tax / 1.75::DOUBLE ELSE 0.0::DOUBLE END)" if paid and kind == "FIXED" else b
    return ("{" f"'term': CAST({term} AS INTEGER), 'rate': {rate}, 'fee': {'l_tax' if paid else 'l_tax * 0::DOUBLE'}, "
            f"'kind': CASE WHEN l_partkey % 29 != 0 THEN '{kind}' END, 'margin': l_discount / 2 + CAST(0.01 AS DOUBLE), "
            f"'index_rate': CASE WHEN l_partkey % 7 != 0 THEN l_discount / 2 + CAST({bump} AS DOUBLE) - CAST(0.01 AS DOUBLE) END, "
            f"'apr': CASE WHEN l_partkey % 3 = 0 THEN {b} - l_tax / 2.4::DOUBLE ELSE {b} + l_tax / 10 END, "
            f"'non_autopay_rate': {rate} + CASE WHEN l_partkey % 5 != 0 THEN 0.0025::DOUBLE ELSE 0.005::DOUBLE END" "}")


def _lien_category() -> str:
    arms = " ".join(f"WHEN event_type = '{s}' THEN '{d}'" for s, d in CATEGORY_BY_EVENT)
    return f"CASE {arms} ELSE 'NOTICE' END"


def _agent(k: str) -> str:
    return f"('S' || CAST((conv_id + {k}) % {N_AGENTS} AS VARCHAR))"


def _loan(k: int) -> str:
    taken = f"(CAST(l_shipdate AS DATE) - CAST((l_partkey + {7 * k}) % 80 AS INTEGER))"
    return (f"{{'status': CASE WHEN (l_partkey + {k}) % 31 = 0 THEN NULL WHEN (l_suppkey + {k}) % 6 = 0 THEN 'F' "
            f"WHEN (l_suppkey + {k}) % 6 = 1 THEN 'U' ELSE 'O' END, "
            f"'payoff_date': CASE WHEN (l_partkey + {k}) % 3 != 0 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END, "
            f"'origination_date': CASE WHEN (l_partkey + {k}) % 17 != 0 THEN CAST({taken} AS VARCHAR) END, "
            f"'recording_date': CASE WHEN (l_suppkey + {k}) % 11 != 0 THEN CAST({taken} + 5 AS VARCHAR) END, "
            f"'amount': CASE WHEN l_quantity <= 45 THEN l_extendedprice END, "
            f"'lien_position': CAST((l_suppkey + {k}) % 4 AS INTEGER)}}")


_BUREAU_COLS = lambda soft: ", ".join(
    f"{bureau_attr_sql(c, i, soft).replace(' AS STRING)', ' AS VARCHAR)')} AS {c}"
    for i, c in enumerate(BUREAU_CODES))

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "order_lines": ((), """
        SELECT l_orderkey AS id, count(*) AS n_lines,
               CAST(sum(l_quantity) AS BIGINT) AS qty,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS ext,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS disc_amt,
               max(l_quantity) AS max_qty, max(l_partkey) AS max_part,
               max(l_shipdate) AS last_ship, min(l_shipdate) AS first_ship,
               count_if(l_returnflag = 'R') AS n_r
        FROM lineitem GROUP BY l_orderkey"""),
    "app": ((), f"""
        SELECT *,
               CAST(CASE WHEN id % 13 = 0 THEN NULL WHEN id % 101 = 0 THEN 9000 + id % 4 ELSE score END AS DOUBLE) AS hard_score,
               CAST(score + id % 7 - 3 AS DOUBLE) AS soft_score,
               mail_date + 45 AS respond_by
        FROM (
          SELECT o_orderkey AS id, o_custkey AS person, CAST(o_orderdate AS DATE) AS app_date,
                 o_totalprice AS amount,
                 CASE WHEN o_orderstatus = 'F' THEN 'DECLINED' WHEN o_orderstatus = 'P' THEN 'CANCELLED' ELSE 'ACTIVE' END AS status,
                 CASE WHEN o_orderpriority = '1-URGENT' THEN 'DECLINE' ELSE 'APPROVE' END AS decision,
                 CAST(500 + floor((c_acctbal + 1000) / 11000 * 350) AS INTEGER) AS score,
                 n_name AS state, c_mktsegment AS segment,
                 CASE WHEN o_orderkey % 3 = 0 THEN 'Y' ELSE 'N' END AS flag,
                 CAST(o_orderdate AS DATE) - CAST(o_orderkey % 60 AS INTEGER) AS mail_date,
                 CAST(5 * (1 + o_orderkey % 4) AS INTEGER) AS term_years,
                 {rhu('o_totalprice / 30', 2)} AS income,
                 CAST(25 + o_custkey % 50 AS DOUBLE) AS age
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""),
    "prop": (("order_lines",), """
        SELECT id,
               CASE WHEN max_part % 17 = 0 THEN NULL ELSE ext * 3 END AS avm,
               CASE WHEN max_part % 11 = 0 THEN NULL ELSE ext * 2.9::DOUBLE END AS prequal_avm,
               CAST(qty % 30 AS DOUBLE) AS fsd,
               CASE WHEN max_part % 5 = 0 THEN 102 WHEN max_part % 5 = 1 THEN 112
                    WHEN max_part % 5 = 2 THEN 148 WHEN max_part % 5 = 3 THEN 163 ELSE 205 END AS land_use,
               max_qty / 2 AS acres,
               CAST(first_ship AS DATE) - CAST(qty % 200 AS INTEGER) AS last_sale,
               disc_amt * 20 AS owed,
               CAST(n_lines AS INTEGER) AS n_liens
        FROM order_lines"""),
    "bureau_raw": (("order_lines",), f"""
        SELECT * FROM (
          WITH per AS (
            SELECT o_custkey AS person, CAST(sum(qty) AS BIGINT) AS p_qty, CAST(sum(n_lines) AS BIGINT) AS p_lines
            FROM order_lines JOIN orders ON id = o_orderkey GROUP BY o_custkey)
          SELECT person, 'Hard Credit' AS credit_type, {_BUREAU_COLS(False)} FROM per WHERE person % 4 != 0
          UNION ALL
          SELECT person, 'Soft Credit' AS credit_type, {_BUREAU_COLS(True)} FROM per)"""),
    "decisions": ((), f"""
        SELECT l_orderkey AS id, l_shipdate AS event_ts, l_linenumber AS seq, l_partkey AS part,
               l_suppkey AS supp, l_extendedprice AS price,
               {{'credit_score': CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE CAST(500 + l_partkey % 351 AS VARCHAR) END,
                 'home_amount': l_extendedprice * 4,
                 'fsd': l_tax * 200,
                 'revolving_debt': {{'amount': {rhu('l_extendedprice * l_discount', 2)}}},
                 'installment_debt': {{'amount': l_quantity * 40}},
                 'monthly_income': {{'amount': l_quantity * 100 + 1000}},
                 'transportation_expense': {{'amount': CASE WHEN l_partkey % 3 = 0 THEN 350.0 ELSE l_quantity * 20 + 200 END}},
                 'bureau_debt': {{'amount': l_extendedprice / 50}},
                 'current_student_payment': {{'amount': l_quantity * 15}},
                 'pre_loan_cashflow': {{'amount': l_extendedprice / 20}},
                 'post_loan_cashflow': {{'amount': l_extendedprice / 25}}}} AS uw_packet,
               CASE WHEN l_linenumber = 7 AND l_returnflag = 'N' THEN NULL
                    ELSE list_filter([{_offer(5, 0.030, 'FIXED', False)}, {_offer(5, 0.030, 'FIXED', True)},
                                      {_offer(10, 0.035, 'VARIABLE', True)},
                                      {_offer(15, 0.040, 'FIXED', False)}, {_offer(15, 0.040, 'FIXED', True)},
                                      {_offer(20, 0.045, 'VARIABLE', True)}, {_offer(30, 0.050, 'FIXED', True)}],
                                     lambda o: o.term <= (l_linenumber - 1) * 5) END AS offers,
               CASE WHEN l_returnflag = 'R' THEN [{{'code': 'CLTV', 'reason': 'Combined LTV too high'}},
                                                  {{'code': 'DTI', 'reason': 'Debt to income too high'}}, {_third_reason()}]
                    WHEN l_returnflag = 'A' THEN [{{'code': 'LANDUSE', 'reason': 'Land use not eligible'}},
                                                  {{'code': 'INV_TAXLIEN', 'reason': 'Other: Involuntary lien'}}, {_third_reason()}]
                    ELSE list_filter([{{'code': 'X', 'reason': 'x'}}], lambda r: false) END AS decline_reasons
        FROM lineitem"""),
    "alerts": ((), """
        SELECT l_orderkey AS id, CASE l_partkey % 3 WHEN 0 THEN 'FACTA_HIT' WHEN 1 THEN 'FRAUD_HIT' ELSE 'OTHER_HIT' END AS type,
               CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE CAST(l_suppkey % 40 AS VARCHAR) END AS subcode,
               l_shipdate AS alert_ts, l_linenumber AS seq, l_partkey AS part
        FROM lineitem"""),
    "liens": ((), f"""
        SELECT event_id AS lien_id, user_id AS person,
               CASE WHEN event_id % 17 = 0 THEN NULL ELSE {_lien_category()} END AS category,
               CASE WHEN event_id % 17 = 0 THEN NULL
                    WHEN event_type = 'error' AND event_id % 2 = 1 THEN 'RELEASE'
                    ELSE {_lien_category()} END AS description,
               CASE WHEN event_id % 19 != 0 THEN CAST(ts AS DATE) - CAST(floor(value * 10) + {LIEN_SHIFT} AS INTEGER) END AS document_date,
               ([{', '.join(repr(x) for x in LIEN_STATES)}])[CAST(event_id % {len(LIEN_STATES)} + 1 AS INT)] AS state_code,
               user_id % 3 != 0 AS involuntary_on_property,
               user_id % 5 = 0 AS hoa_on_property,
               CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id % 2 = 0 END AS is_pace
        FROM events"""),
    "tasks": ((), f"""
        SELECT event_id AS task_id, 'C' || CAST(user_id AS VARCHAR) AS application,
               event_type, {_task_type()} AS task_type, value, ts, ts - to_hours(event_id % 48) AS created_date,
               'S' || CAST(event_id % {N_AGENTS} AS VARCHAR) AS completed_by,
               {_pick(raw_subtasks(), 'event_id')} AS subtask_desc,
               CASE WHEN event_id % 3 = 0 THEN 'IDENTITY_FRAUD detected' WHEN event_id % 3 = 1 THEN 'CREDIT_FRAUD alert'
                    ELSE 'routine' END AS message,
               {_pick(RAW_OUTCOMES, 'CAST(floor(value) AS BIGINT)')} AS last_outcome,
               {_pick(TASK_STATUSES, 'user_id')} AS last_status,
               CASE WHEN event_id % 5 = 0 THEN '[SUPERVISOR]' WHEN event_id % 5 = 1 THEN '[SYSTEM]' ELSE '[AGENT]' END AS proficiencies,
               CASE WHEN value > 100 THEN 'long task' END AS comments
        FROM events"""),
    "contact_preferences": ((), f"""
        SELECT o_orderdate AS created_ts, o_orderkey AS application,
               'S' || CAST(o_orderkey % {N_AGENTS} AS VARCHAR) AS created_by,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'S' || CAST(o_custkey % {N_AGENTS} AS VARCHAR) END AS updated_by
        FROM orders"""),
    "complaints": ((), f"""
        SELECT o_orderdate AS created_ts, o_orderkey AS complaint_id,
               'S' || CAST(o_custkey % {N_AGENTS} AS VARCHAR) AS creator,
               CASE WHEN o_orderstatus = 'O' THEN NULL ELSE 'S' || CAST(o_orderkey % 29 AS VARCHAR) END AS approver,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'Home Lease Back' WHEN o_orderpriority = '2-HIGH' THEN '--'
                    WHEN o_orderpriority = '3-MEDIUM' THEN ' ' ELSE 'HELOC' END AS product,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'F' END AS is_approved
        FROM orders"""),
    "calls": ((), f"""
        SELECT 'S' || CAST(user_id % {N_AGENTS} AS VARCHAR) AS participant, event_id AS room, ts AS call_started,
               ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) AS call_ended,
               ts + to_minutes(CAST(event_id % 5 AS BIGINT)) AS connected,
               ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) - to_minutes(CAST(event_id % 3 AS BIGINT)) AS disconnected
        FROM events"""),
    "chat": ((), f"""
        SELECT concat_ws('-', conv_id, turn) AS chat_id, conv_id,
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id * 37 + turn * 5 AS BIGINT)) AS created_at,
               CASE WHEN length(text) % 5 = 0 THEN NULL ELSE CAST(length(text) % 5 AS DOUBLE) END AS rating,
               {_agent('0')} AS initial_responder,
               {_agent('turn')} AS final_responder,
               list_transform(string_split(text, chr(10)), lambda s, i:
                   {{'type': CASE WHEN (i - 1) % 2 = 0 THEN 'msg_out' ELSE 'msg_in' END,
                     'responder_id': 'S' || CAST((conv_id + (i - 1)) % {N_AGENTS} AS VARCHAR),
                     'text': s}}) AS events,
               [{{'responder_id': {_agent('0')}, 'latency': list_transform(string_split(text, chr(10)), lambda s: CAST(length(s) * 3 AS DOUBLE))}},
                {{'responder_id': {_agent('1')}, 'latency': list_reverse(list_transform(string_split(text, chr(10)), lambda s: CAST(length(s) * 3 AS DOUBLE)))}}] AS response_latency,
               [{{'id': {_agent('0')}, 'id_map': {_agent('0')} || '@staff.example'}},
                {{'id': {_agent('1')}, 'id_map': {_agent('1')} || '@staff.example'}}] AS id_mappings
        FROM conversations"""),
    "mortgage_history": ((), """
        SELECT l_orderkey AS id, l_partkey % 2 AS property_id, l_linestatus AS status_indicator,
               CASE WHEN l_linestatus = 'O' THEN '' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS payoff_date,
               CASE WHEN l_partkey % 13 = 0 THEN NULL
                    ELSE CAST(CAST(l_shipdate AS DATE) - CAST(l_suppkey % 40 AS INTEGER) AS VARCHAR) END AS origination_date,
               CASE WHEN l_suppkey % 11 = 0 THEN ''
                    ELSE CAST(CAST(l_shipdate AS DATE) - CAST(l_partkey % 20 AS INTEGER) AS VARCHAR) END AS recording_date,
               CASE WHEN l_quantity > 48 THEN NULL ELSE l_extendedprice END AS amount,
               'D' || CAST(l_linenumber % 3 AS VARCHAR) AS document_number,
               'Lender ' || repeat('x', CAST(l_suppkey % 5 AS INTEGER)) AS lender,
               CAST(epoch(l_shipdate) AS BIGINT) AS created_seconds,
               l_partkey % 1000 AS created_nanos,
               CAST(epoch(l_shipdate) AS BIGINT) + l_suppkey AS updated_seconds,
               l_linenumber * 1000 AS updated_nanos,
               list_filter([""" + ", ".join(
                   "{'type_description': '%s', 'tx_date': CAST(l_shipdate AS DATE) - CAST(l_partkey %% %d AS INTEGER), "
                   "'sale_date': CAST(l_shipdate AS DATE) - CAST(l_suppkey %% 9 AS INTEGER), "
                   "'recording_date': CASE WHEN l_partkey %% 5 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) - CAST(l_suppkey %% 30 AS INTEGER) END, "
                   "'lien_position': CASE WHEN l_suppkey %% 6 = 0 THEN NULL ELSE CAST(%d AS INTEGER) END, "
                   "'loan_amount': CASE WHEN l_quantity > 45 THEN NULL ELSE l_extendedprice END, "
                   "'doc_id': 'T' || CAST(l_partkey AS VARCHAR)}" % (k, off, pos)
                   for k, off, pos in (("FINANCE", 15, 1), ("DEED", 3, 2), ("FINANCE", 7, 3))) + """],
                           lambda t: t.type_description = 'DEED' OR l_partkey % 4 != 0) AS transactions
        FROM lineitem"""),
    "property_history": ((), f"""
        SELECT l_orderkey AS id, l_partkey AS property_id,
               CASE WHEN l_partkey % 29 = 0 THEN 'unknown'
                    WHEN l_partkey % 23 != 0 THEN CAST(CAST(l_shipdate AS DATE) - CAST(l_suppkey % 60 AS INTEGER) AS VARCHAR) END AS last_sale_date,
               {{'finance_history_attributes': CASE WHEN l_partkey % 37 != 0 THEN
                   CASE l_linenumber % 3 WHEN 0 THEN list_filter([{_loan(1)}], lambda f: false) WHEN 1 THEN [{_loan(1)}]
                        ELSE [{_loan(1)}, {_loan(2)}] END END}} AS financial_history
        FROM lineitem"""),
    "property_sale_dates": (("app", "prop"), """
        SELECT a.id, a.app_date,
               CASE WHEN a.id % 5 = 0 THEN '' ELSE CAST(p.last_sale AS VARCHAR) END AS avm_sale_date,
               CASE WHEN a.id % 7 = 0 THEN NULL ELSE CAST(p.last_sale - 3 AS VARCHAR) END AS transfer_sale_date,
               CAST(a.app_date - 400 AS VARCHAR) AS market_sale_date
        FROM app a LEFT JOIN prop p ON a.id = p.id"""),
    "tradelines": ((), """
        SELECT l_orderkey AS id,
               CASE WHEN l_linenumber % 4 = 0 THEN '19' WHEN l_linenumber % 4 = 1 THEN '26'
                    WHEN l_linenumber % 4 = 2 THEN '47' ELSE '89' END AS account_type,
               lpad(CAST(l_partkey % 70 AS VARCHAR), 2, '0') AS status,
               l_linestatus = 'O' AS open,
               CAST(l_shipdate AS DATE) - CAST(l_suppkey % 60 + 20 AS INTEGER) AS open_date,
               CAST(l_shipdate AS DATE) - CAST(l_partkey % 45 + 10 AS INTEGER) AS status_date,
               l_extendedprice AS balance
        FROM lineitem"""),
    "profile": ((), """
        SELECT 'C' || CAST(c_custkey AS VARCHAR) AS identity,
               'user' || CAST(c_custkey AS VARCHAR) || '@mail.example' AS email,
               c_name AS first_name, c_mktsegment AS last_name, n_name AS state
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL
        SELECT 'S' || CAST(s_suppkey AS VARCHAR), 'S' || CAST(s_suppkey AS VARCHAR) || '@staff.example',
               s_name, 'Staff', n_name
        FROM supplier JOIN nation ON s_nationkey = n_nationkey"""),
}


def with_ctes(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause holding the named frames (dependencies first) plus extra CTEs."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][1]}\n)" for n in order]
    parts += [f"{n} AS ({body}\n)" for n, body in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n"
