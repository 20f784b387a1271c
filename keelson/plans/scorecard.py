"""Operations scorecard.

Branches (independent stages of one job):

* identity union (B48) — profiles left-joined to each product's applications;
* tasks (B49-B51) — label normalisation, compliance-message backfill, weighted
  task score per agent;
* chat (B52-B56) — replies, ratings, first-response and response latencies
  from nested arrays, joined into a per-agent chat mart;
* actor counts (B57) — do-not-contact and complaint records counted for both
  actor roles (aggregate, UNION ALL, re-aggregate);
* call statistics (B58);
* scorecard (B59) — every mart reduced to one row per agent e-mail *before*
  the final left joins, so no join can multiply sums (Q14).

All aggregations are partial + final hash aggregates: a hot agent holding a
third of all tasks costs one partial row per map task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..operators.latest import latest
from ..operators.nested import flatten
from ..operators.policy import broadcast_bounded
from ..sources import derived as D
from ..sources import policies as P
from ..sources.tables import small_frame

c = F.col
# Defaults of the job's reporting windows (inclusive at both ends, Q20), bound to the test data.
WINDOW = ("2024-01-01 00:00:00", "2024-01-20 00:00:00")
STAFF_DOMAIN = "%@staff.example%"
DNC_WINDOW = ("1996-01-01 00:00:00", "1999-12-31 00:00:00")


def _in_window(col, window: tuple[str, str]):
    start, end = window
    return col.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


# ---------------------------------------------------------------------------
# B48 identity union
# ---------------------------------------------------------------------------

def identity_union(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles x product applications, one branch per product, UNION ALL by position
    (column names come from the first branch, as in SQL).

    1. home-equity applications ('O' ids);
    2. the person's latest application, keyed by the identity id itself (Q16);
    3. long-term (refinance-style) applications, term >= 15 years ('R' ids);
    4. the person's latest declined application, keyed by the identity id (Q16).

    Each branch has the short id of its application beside the key (NULL where a profile has none).
    """
    lp = D.profile(spark, sf)
    a = D.app(spark, sf).select(F.concat(F.lit("C"), c("person").cast("string")).alias("a_identity"),
                                 F.concat(F.lit("O"), c("id").cast("string")).alias("a_app"),
                                 c("state").alias("a_state"), "app_date", "id", "term_years", "status")
    name = F.concat(c("first_name"), F.lit(" "), c("last_name"))

    def branch(products: DataFrame, app_id, product: str) -> DataFrame:
        return lp.join(products, lp.identity == products.a_identity, "left").select(
            app_id.alias("application_id"), "email",
            F.coalesce(c("a_identity"), c("identity")).alias("identity_id"),
            F.concat(F.lit(product), c("id").cast("string")).alias("short_id"),
            F.coalesce(c("a_state"), c("state")).alias("state"), name.alias("borrower_name"))

    newest = [c("app_date").desc(), c("id").desc()]
    b1 = branch(a, c("a_app"), "H")
    b2 = branch(latest(a, ["a_identity"], newest), c("a_identity"), "S")
    b3 = branch(a.where(c("term_years") >= 15), F.concat(F.lit("R"), c("id").cast("string")), "L")
    b4 = branch(latest(a.where(c("status") == "DECLINED"), ["a_identity"], newest), c("a_identity"), "M")
    return b1.union(b2).union(b3).union(b4)


def application_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The application ids of :func:`identity_union` (not distinct, NULL apart) from one pass over applications
    of people with a profile: their home-equity and long-term ids, and the identity itself, which the two
    identity-keyed branches give for whoever has an application at all."""
    a = D.app(spark, sf).select(F.concat(F.lit("C"), c("person").cast("string")).alias("identity"), "id", "term_years")
    known = a.join(D.profile(spark, sf).select("identity"), "identity", "left_semi")
    return known.select(F.explode(F.array(
        F.concat(F.lit("O"), c("id").cast("string")), c("identity"),
        F.when(c("term_years") >= 15, F.concat(F.lit("R"), c("id").cast("string"))))).alias("application_id")).where(
            c("application_id").isNotNull())


# ---------------------------------------------------------------------------
# B49-B51 tasks
# ---------------------------------------------------------------------------

def normalised_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """B49 + B51 — task type, sub-task and outcome labels; compliance message backfill."""
    t = D.tasks(spark, sf)
    tt, msg = c("task_type"), c("message")
    covt = (F.when((tt == "PROPERTY_OWNERSHIP_FRAUD_REVIEW") | ((tt == "FRAUD_REVIEW") & msg.like("%IDENTITY_FRAUD%"))
                   | ((tt == "4") & msg.like("%IDENTITY_FRAUD%")), "PROPERTY_OWNERSHIP_FRAUD_REVIEW")
             .when((tt == "CREDIT_FRAUD_REVIEW") | ((tt == "FRAUD_REVIEW") & msg.like("%CREDIT_FRAUD%")),
                   "EXPERIAN_FRAUD_SHIELD_REVIEW")
             .otherwise(tt))
    sub = c("subtask_desc")
    subtype = None
    for canon, raws in P.SUBTASK_ALIASES:
        cond = sub.isin(*raws)
        subtype = F.when(cond, canon) if subtype is None else subtype.when(cond, canon)
    subtype = subtype.when(sub.like("%Email"), "System").otherwise(sub)
    oc, st = c("last_outcome"), c("last_status")
    outcome = F.when((oc == "CANCEL_TASK") | (oc.isNull() & st.isin("CANCELLED", "1", "2", None)), "SYSTEM_CANCEL_TASK")
    for label, raws in P.OUTCOME_GROUPS:
        if label == "MANUAL_CANCEL":
            outcome = outcome.when(oc.isin(*raws), label)
            outcome = outcome.when((oc == "COMPLETE_TASK") | (oc.isNull() & (st == "COMPLETE")), "SYSTEM_COMPLETE_TASK")
        else:
            outcome = outcome.when(oc.isin(*raws), label)
    outcome = outcome.otherwise(oc)
    # Every distinct supervisor compliance message of failed / cancelled tasks of the same
    # application, joined in order into one text per application before the join (no fan-out).
    cs = (t.where(st.isin("FAILED", "CANCELLED") & (c("proficiencies") == "[SUPERVISOR]"))
           .groupBy(c("application").alias("cs_application"))
           .agg(F.array_join(F.sort_array(F.collect_set("message")), " | ").alias("cs_message")))
    j = t.join(cs, t.application == cs.cs_application, "left")
    return j.select(
        "task_id", "application", "task_type", covt.alias("covt_task_type"), "subtask_desc",
        subtype.alias("subtask_type"),
        F.when(sub == "Compliance Fraud Review", c("cs_message")).otherwise(msg).alias("message"),
        F.coalesce(c("comments"), F.lit("none")).alias("comments"),
        "last_status", outcome.alias("subtask_outcome"), "completed_by",
        F.when(sub == "Compliance Fraud Review", c("created_date")).otherwise(c("ts")).alias("completed_date"),
        "proficiencies")


def task_scores(spark: SparkSession, sf: str, window=WINDOW) -> DataFrame:
    """B50 — cancelled / completed counts and weighted score per agent."""
    ff = normalised_tasks(spark, sf)
    w = broadcast_bounded(small_frame(spark, "task_weights", P.TASK_WEIGHTS, "w_label string, weight int"),
                          len(P.TASK_WEIGHTS))
    kept = ff.where(c("task_id").isNotNull() & ~c("completed_by").isin(*P.NON_AGENTS)
                    & ~c("proficiencies").isin("[SYSTEM]", "[]", "[COMPLIANCE]") & _in_window(c("completed_date"), window))
    # A semi join: however often a key occurs, a task counts once.
    known = kept.join(application_keys(spark, sf), c("application") == c("application_id"), "left_semi")
    j = known.join(w, c("subtask_type") == w.w_label, "left")
    score = F.coalesce(c("weight"), F.lit(0))
    return j.groupBy(c("completed_by").alias("csa_name")).agg(
        F.sum(F.when(c("subtask_outcome") == "MANUAL_CANCEL", 1).otherwise(0)).cast("bigint").alias("tasks_cancelled"),
        F.sum(F.when(c("subtask_outcome") != "MANUAL_CANCEL", 1).otherwise(0)).cast("bigint").alias("tasks_completed"),
        round_half_up(F.count("subtask_type") * F.avg(score), 6).alias("score_obtained"))


def csp_tasks(spark: SparkSession, sf: str, window=WINDOW) -> DataFrame:
    """Agent e-mail with task counts: DISTINCT (e-mail, identity) of the identity union meets the scores.
    Every branch of the union keeps all profiles under their own identity, so profiles alone give these pairs."""
    f = D.profile(spark, sf).select("email", c("identity").alias("identity_id")).distinct()
    s = task_scores(spark, sf, window)
    return (f.join(s, f.identity_id == s.csa_name)
             .select(c("email").alias("csa_email"), "tasks_cancelled", "tasks_completed",
                     round_half_up(c("score_obtained"), 0).alias("score_obtained"))
             .distinct())


# ---------------------------------------------------------------------------
# B52-B56 chat
# ---------------------------------------------------------------------------

def _chat(spark: SparkSession, sf: str, window=WINDOW) -> DataFrame:
    return D.chat(spark, sf).where(_in_window(c("created_at"), window))


def chat_replies(spark: SparkSession, sf: str, window=WINDOW) -> DataFrame:
    """B52 — outgoing replies per (conversation, responder)."""
    e = flatten(_chat(spark, sf, window).select("chat_id", "events"), "events", "e", outer=False, prefix="e_")
    return (e.where(c("e_type") == "msg_out").groupBy("chat_id", c("e_responder_id").alias("responder_id"))
             .agg(F.count("e_text").alias("replies")))


def ratings(spark: SparkSession, sf: str, window=WINDOW) -> DataFrame:
    """B55 — conversation rating by the final responder."""
    return _chat(spark, sf, window).where(c("rating").isNotNull()).select(
        "chat_id", c("final_responder").alias("responder_id"), "rating")


def first_responses(spark: SparkSession, sf: str, window=WINDOW) -> DataFrame:
    """B53 — first latency of the initial responder, below the cap."""
    r = flatten(_chat(spark, sf, window).select("chat_id", "initial_responder", "response_latency"),
                "response_latency", "rl", outer=False, prefix="rl_")
    first = F.get(c("rl_latency"), 0)
    return (r.where((c("rl_responder_id") == c("initial_responder")) & (first < P.LATENCY_CAP))
             .select("chat_id", "initial_responder", first.alias("initial_response")))


def latency_sums(spark: SparkSession, sf: str, window=WINDOW) -> DataFrame:
    """B54 — count and sum of capped latencies per (conversation, responder)."""
    r = flatten(_chat(spark, sf, window).select("chat_id", "response_latency"), "response_latency", "rl",
                outer=False, prefix="rl_")
    r = flatten(r, "rl_latency", "latency", outer=False)
    return (r.where(c("latency") < P.LATENCY_CAP).groupBy("chat_id", c("rl_responder_id").alias("responder_id"))
             .agg(F.count("latency").alias("cnt_latency"),
                  F.sum(c("latency").cast("decimal(18,2)")).cast("double").alias("sum_latency")))


def responder_emails(spark: SparkSession, sf: str, window=WINDOW) -> DataFrame:
    """B55 — DISTINCT responder id -> e-mail map from the nested id mappings."""
    m = flatten(_chat(spark, sf, window).select("id_mappings"), "id_mappings", "m", outer=False, prefix="m_")
    return m.select(c("m_id").alias("responder_id"), c("m_id_map").alias("email")).distinct()


def chat_mart(spark: SparkSession, sf: str, window=WINDOW) -> DataFrame:
    """B56 — per agent e-mail: replies, conversations, rating, first-response and response times.

    Replies, first response and latencies of a conversation all lie in its own row, so they are taken
    there (one scan, no join of a conversation with itself); only the e-mail map is met from outside."""
    ch = _chat(spark, sf, window)
    out = F.filter("events", lambda e: e["type"] == "msg_out")
    firsts = F.transform(
        F.filter("response_latency", lambda r: (r["responder_id"] == c("initial_responder"))
                 & (F.get(r["latency"], 0) < P.LATENCY_CAP)), lambda r: F.get(r["latency"], 0))
    rows = (ch.select("chat_id", "rating", "response_latency", out.alias("out"), F.explode(firsts).alias("initial_response"))
              .select("*", F.explode(F.array_distinct(F.transform("out", lambda e: e["responder_id"]))).alias("responder_id")))
    own = F.flatten(F.transform(F.filter("response_latency", lambda r: r["responder_id"] == c("responder_id")),
                                lambda r: r["latency"]))
    rows = rows.select(
        "chat_id", "rating", "initial_response", "responder_id",
        F.size(F.filter("out", lambda e: (e["responder_id"] == c("responder_id")) & e["text"].isNotNull()))
         .cast("bigint").alias("replies"),
        F.filter(own, lambda x: x < P.LATENCY_CAP).alias("own"))
    total = F.aggregate("own", F.lit(0).cast("decimal(28,2)"),
                        lambda acc, x: (acc + x.cast("decimal(18,2)")).cast("decimal(28,2)")).cast("double")
    rows = rows.withColumns({"cnt_latency": F.when(F.size("own") > 0, F.size("own")),
                             "sum_latency": F.when(F.size("own") > 0, total)})
    j = rows.join(responder_emails(spark, sf, window), "responder_id")
    return j.groupBy(c("email").alias("csas")).agg(
        F.sum("replies").alias("total_replies"),
        F.count("chat_id").alias("total_conversations"),
        round_half_up(F.avg("rating"), 3).alias("avg_rating"),
        round_half_up(F.avg("initial_response"), 3).alias("initial_response_time"),
        round_half_up(F.try_divide(F.sum("sum_latency"), F.sum("cnt_latency")), 3).alias("average_response_time"))


# ---------------------------------------------------------------------------
# B57 actor counts, B58 calls
# ---------------------------------------------------------------------------

def _two_role_counts(df: DataFrame, first: str, second: str, profile: DataFrame, out: str) -> DataFrame:
    """Count records per (actor, e-mail) for two actor columns.

    One pass: each record is one row per role, rows are counted per actor (partial sums first, so a
    hot actor costs one row per map task) and only the counts meet the profile."""
    per = (df.select(F.explode(F.array(first, second)).alias("csas"))
             .groupBy("csas").agg(F.count(F.lit(1)).alias("n")))
    return (per.join(profile, per.csas == profile.identity)
               .groupBy("csas", "email").agg(F.sum("n").alias(out)))


def dnc_counts(spark: SparkSession, sf: str, window=DNC_WINDOW) -> DataFrame:
    d = D.contact_preferences(spark, sf).where(_in_window(c("created_ts"), window))
    d = d.withColumn("updated_by", F.coalesce(c("updated_by"), F.lit("Not Updated")))
    lp = D.profile(spark, sf).select("identity", "email")
    return _two_role_counts(d, "created_by", "updated_by", lp, "dnc_num")


def complaint_counts(spark: SparkSession, sf: str, window=DNC_WINDOW) -> DataFrame:
    cp = D.complaints(spark, sf).where(_in_window(c("created_ts"), window))
    cp = cp.withColumns({
        "approver": F.coalesce(c("approver"), F.lit("Not Approved")),
        "product_type": F.when(c("product") == "Home Lease Back", "Home Lease Back")
                         .when(c("product").isin("--", " "), "Not Specified").otherwise("Home Equity Line"),
        "approved": F.when(c("is_approved") == F.lit(False), "No").when(c("is_approved") == F.lit(True), "Yes"),
    })
    lp = D.profile(spark, sf).select("identity", "email")
    return _two_role_counts(cp, "creator", "approver", lp, "complaint_num")


def call_stats(spark: SparkSession, sf: str, window=WINDOW) -> DataFrame:
    """B58 — notary calls per agent: count, average duration / handle time / speed to answer (minutes)."""
    cl = D.calls(spark, sf)
    lp = D.profile(spark, sf).select("identity", "email")
    j = cl.join(lp, cl.participant == lp.identity, "left").where(
        c("email").like(STAFF_DOMAIN) & _in_window(c("call_started"), window))
    mins = lambda a, b: F.timestamp_diff("MINUTE", c(a), c(b))
    return j.groupBy(c("participant").alias("csas"), "email").agg(
        F.count("room").alias("notary_call_num"),
        round_half_up(F.avg(mins("call_started", "call_ended")), 3).alias("notary_call_duration"),
        round_half_up(F.avg(mins("connected", "disconnected")), 3).alias("notary_call_handle_time"),
        round_half_up(F.avg(mins("call_started", "connected")), 3).alias("notary_call_speed_to_answer"))


# ---------------------------------------------------------------------------
# B59 scorecard
# ---------------------------------------------------------------------------

def scorecard(spark: SparkSession, sf: str, window=WINDOW, record_window=DNC_WINDOW) -> DataFrame:
    """Per agent e-mail roll-up of every mart (each mart pre-aggregated to e-mail: no fan-out).

    ``window`` bounds tasks, chats and calls, ``record_window`` do-not-contact and complaint records."""
    ct = csp_tasks(spark, sf, window).groupBy("csa_email").agg(
        F.sum("tasks_cancelled").alias("tasks_cancelled_num"), F.sum("tasks_completed").alias("tasks_completed_num"),
        F.sum("score_obtained").alias("total_score_obtained"))
    ic = chat_mart(spark, sf, window).withColumnRenamed("csas", "csa_email")
    dn = dnc_counts(spark, sf, record_window).groupBy(c("email").alias("csa_email")).agg(F.sum("dnc_num").alias("dnc_num"))
    co = complaint_counts(spark, sf, record_window).groupBy(c("email").alias("csa_email")).agg(
        F.sum("complaint_num").alias("complaint_num"))
    nt = call_stats(spark, sf, window).groupBy(c("email").alias("csa_email")).agg(
        F.sum("notary_call_num").alias("notary_call_num"),
        round_half_up(F.avg("notary_call_duration"), 3).alias("avg_notary_call_duration"),
        round_half_up(F.avg("notary_call_handle_time"), 3).alias("notary_call_handle_time"),
        round_half_up(F.avg("notary_call_speed_to_answer"), 3).alias("avg_notary_call_speed_to_answer"))
    return (ct.join(ic, "csa_email", "left").join(dn, "csa_email", "left")
              .join(co, "csa_email", "left").join(nt, "csa_email", "left"))
