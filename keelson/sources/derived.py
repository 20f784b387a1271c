"""Derived audit frames over the provided test tables.

The audited jobs read loan-application marts, decision events with nested
offers, bureau attributes, lien records, task and chat logs.  The test data are
TPC-H-like tables, so each audit input is *derived* from them by a fixed rule
whole tables, so its work grows with the data; nested arrays are built per row
from that row's own columns (never by collecting an unbounded group).

The DuckDB oracle repeats the same derivations in ``keelson.sources.derived_sql``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from .bureau_codes import BUREAU_CODES
from .tables import frame, table

# Date the lien ages are measured from when no application date applies.
AS_OF = "2024-02-01"
# Agents (operations staff) are suppliers; work is spread over this many ids.
N_AGENTS = 37

# Days that test lien documents precede their events, so that they precede the applications too.
LIEN_SHIFT = 9700
# States of test liens: some of each age group, one of none.
LIEN_STATES = ("CA", "MD", "AL", "SD", "TX", "WY", "NY", "MI", "NJ", "GA")

CATEGORY_BY_EVENT = [("click", "FEDERAL TAX LIEN"), ("view", "MECHANICS LIEN"),
                     ("purchase", "STATE TAX LIEN"), ("signup", "JUDGMENT")]


def bureau_test_ranges() -> dict[str, tuple[int, int]]:
    """(modulus, shift) per bureau code for the synthetic attribute rule.

    value = greatest(((qty * a + lines * b) % modulus) - shift, 0) with a, b
    derived from the code's position; chosen so each threshold fires sometimes.
    """
    special = {
        "MTA2126": (25, 22), "COL3211": (30, 28), "ALM6270": (70, 0), "IQT9425": (10, 0),
        "IQM9415": (3, 0), "IQA9415": (3, 0), "IQF9415": (4, 0), "ALL9220": (400, 0),
        "MTF8169": (500, 0), "BCC5830": (20000, 0), "BCC5838": (600, 0), "BCX5830": (22000, 0),
        "ALX5830": (3000, 0), "ILN5824": (400, 0), "BAX5030": (30000, 0), "BCX5030": (25000, 0),
        "RTR5030": (3000, 0), "ILN5820": (1200, 0), "AUA5820": (500, 0), "STU5020": (60000, 0),
        "STU5820": (400, 0), "MTF5820": (2500, 0), "MTS5820": (600, 0), "HLC5820": (300, 0),
        "MTA5020": (400000, 0), "IQT9416": (6, 0), "ALS8220": (240, 0), "ALX8220": (240, 0),
        "STU8151": (400, 0), "STU6200": (4000, 0), "ALL0400": (40, 0), "ALL0337": (12, 0),
        "REV2326": (30, 28), "ILN2326": (30, 28), "MTA2326": (30, 28), "ALL9221": (600, 0),
        "ALL9120": (3, 0), "ALL9121": (2, 0), "ALL9122": (2, 0), "COL5064": (200, 0),
        "COL5067": (200, 0), "COL5068": (200, 0), "COL5069": (200, 0), "ALL5361": (2000, 0),
        "ALL5830": (4000, 0), "MTA5830": (3000, 0), "MTX5839": (2500, 0), "AUT5820": (700, 0),
        "MTJ0416": (3, 0),
    }
    return {c: special[c] for c in BUREAU_CODES}


def bureau_attr_sql(code: str, idx: int, soft: bool | str) -> str:
    """SQL text (valid in Spark SQL and DuckDB) of one synthetic bureau attribute as STRING.

    ``soft`` is a bool or the name of a 0/1 column (soft pull = 1).  Injects the
    three kinds of bad input the normaliser must handle: a sentinel code, an
    unparsable string and NULL.
    """
    m, s = bureau_test_ranges()[code]
    soft_term = (" + 1" if soft else "") if isinstance(soft, bool) else f" + {soft}"
    a, b = f"({7 + 2 * idx}{soft_term})", 3 + idx
    key = f"(p_qty + {idx})"
    val = f"greatest(((p_qty * {a} + p_lines * {b}) % {m}) - {s}, 0)"
    return (f"CASE WHEN {key} % 23 = 0 THEN '999999998' "
            f"WHEN {key} % 29 = 0 THEN 'N/A' "
            f"WHEN {key} % 31 = 0 THEN NULL "
            f"ELSE CAST({val} AS STRING) END")


# ---------------------------------------------------------------------------
# order-level line aggregates (shared by property, bureau)
# ---------------------------------------------------------------------------

@frame
def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: line aggregates (partial + final hash aggregate)."""
    li = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return li.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("l_quantity").cast("bigint").alias("qty"),
        F.sum(price).cast("double").alias("ext"),
        F.sum(price * F.col("l_discount").cast("decimal(18,2)")).cast("double").alias("disc_amt"),
        F.max("l_quantity").alias("max_qty"),
        F.max("l_partkey").alias("max_part"),
        F.max("l_shipdate").alias("last_ship"),
        F.min("l_shipdate").alias("first_ship"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_r"),
    )


# ---------------------------------------------------------------------------
# application mart
# ---------------------------------------------------------------------------

@frame
def app(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loan applications: orders joined to customer and nation."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    idc = F.col("o_orderkey")
    score = (F.lit(500) + F.floor((F.col("c_acctbal") + 1000) / 11000 * 350)).cast("int")
    base = j.select(
        idc.alias("id"),
        F.col("o_custkey").alias("person"),
        F.to_date("o_orderdate").alias("app_date"),
        F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_orderstatus") == "F", "DECLINED")
         .when(F.col("o_orderstatus") == "P", "CANCELLED").otherwise("ACTIVE").alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "DECLINE").otherwise("APPROVE").alias("decision"),
        score.alias("score"),
        F.col("n_name").alias("state"),
        F.col("c_mktsegment").alias("segment"),
        F.when(idc % 3 == 0, "Y").otherwise("N").alias("flag"),
        F.date_sub(F.to_date("o_orderdate"), (idc % 60).cast("int")).alias("mail_date"),
        (5 * (1 + idc % 4)).cast("int").alias("term_years"),
        round_half_up(F.col("o_totalprice") / 30, 2).alias("income"),
        (25 + F.col("o_custkey") % 50).cast("double").alias("age"),
    )
    return base.select(
        "*",
        F.when(F.col("id") % 13 == 0, F.lit(None))
         .when(F.col("id") % 101 == 0, 9000 + F.col("id") % 4)
         .otherwise(F.col("score")).cast("double").alias("hard_score"),
        (F.col("score") + F.col("id") % 7 - 3).cast("double").alias("soft_score"),
        F.date_add("mail_date", 45).alias("respond_by"),
    )


@frame
def prop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property record per application (valuation, land use, acreage, sale date, owed)."""
    ol = order_lines(spark, sf_dir)
    return ol.select(
        "id",
        F.when(F.col("max_part") % 17 == 0, F.lit(None)).otherwise(F.col("ext") * 3).alias("avm"),
        F.when(F.col("max_part") % 11 == 0, F.lit(None)).otherwise(F.col("ext") * 2.9).alias("prequal_avm"),
        (F.col("qty") % 30).cast("double").alias("fsd"),
        F.when(F.col("max_part") % 5 == 0, 102).when(F.col("max_part") % 5 == 1, 112)
         .when(F.col("max_part") % 5 == 2, 148).when(F.col("max_part") % 5 == 3, 163)
         .otherwise(205).alias("land_use"),
        (F.col("max_qty") / 2).alias("acres"),
        F.date_sub(F.to_date("first_ship"), (F.col("qty") % 200).cast("int")).alias("last_sale"),
        (F.col("disc_amt") * 20).alias("owed"),
        F.col("n_lines").cast("int").alias("n_liens"),
    )


@frame
def bureau_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bureau attributes per (person, credit type), coded as strings.

    Person-level aggregates come from the order-line aggregate joined to orders
    (pre-aggregated per order before the join, then per person).  Every person
    has a soft pull; three in four also have a hard pull.  Both pulls are
    generated from ONE aggregate pass (explode of the credit types), not a
    union of two aggregates.
    """
    ol = order_lines(spark, sf_dir).select("id", "n_lines", "qty")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    per = (ol.join(o, ol.id == o.o_orderkey)
             .groupBy(F.col("o_custkey").alias("person"))
             .agg(F.sum("qty").cast("bigint").alias("p_qty"),
                  F.sum("n_lines").cast("bigint").alias("p_lines")))
    pulls = per.select("*", F.explode(F.array(F.lit("Hard Credit"), F.lit("Soft Credit"))).alias("credit_type")) \
               .where((F.col("credit_type") == "Soft Credit") | (F.col("person") % 4 != 0)) \
               .withColumn("is_soft", (F.col("credit_type") == "Soft Credit").cast("int"))
    return pulls.select("person", "credit_type",
                        *[F.expr(bureau_attr_sql(c, i, "is_soft")).alias(c) for i, c in enumerate(BUREAU_CODES)])


# ---------------------------------------------------------------------------
# decision events with nested packet, offers and decline reasons
# ---------------------------------------------------------------------------

@frame
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision events (application x event) with nested ``uw_packet``, ``offers``, ``decline_reasons``."""
    return decision_record(table(spark, sf_dir, "lineitem"))


#: Third decline reason of a test event, by part key.
OTHER_REASONS = ("NOAVMRETURNED", "PROPERTY_ACRES", "LIEN_POSITION", "LAST_SALE_DATE", "FORECLOSURE", "CREDITSCORE",
                 "MORT_TRADES_DELQ", "COLLECTION", "DELQ60_12", "INQ3MONTHS", "BANKRUPTCY", "FACTA_HIT", "FRAUD")


@frame
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft-eligibility alerts (application x sub-code x event): type, sub-code as text, time."""
    part = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.when(part % 3 == 0, "FACTA_HIT").when(part % 3 == 1, "FRAUD_HIT").otherwise("OTHER_HIT").alias("type"),
        F.when(F.col("l_suppkey") % 13 == 0, F.lit(None)).otherwise((F.col("l_suppkey") % 40).cast("string")).alias("subcode"),
        F.col("l_shipdate").alias("alert_ts"), F.col("l_linenumber").alias("seq"), part.alias("part"))


#: Offers of a test event in their order: term, rate bump, kind, whether a fee is paid.
OFFERS = ((5, 0.030, "FIXED", False), (5, 0.030, "FIXED", True), (10, 0.035, "VARIABLE", True), (15, 0.040, "FIXED", False),
          (15, 0.040, "FIXED", True), (20, 0.045, "VARIABLE", True), (30, 0.050, "FIXED", True))


def offer_count() -> Column:
    """Offers of a test event: those with term <= (line number - 1) * 5 (terms ascend); none where the array is NULL."""
    ln = F.col("l_linenumber")
    n = F.when(ln >= 7, 7).when(ln >= 5, 6).when(ln == 4, 5).when(ln == 3, 3).when(ln == 2, 2).otherwise(0)
    return F.when((ln == 7) & (F.col("l_returnflag") == "N"), 0).otherwise(n)


def offer_terms(df: DataFrame) -> DataFrame:
    """One row per offer of line-item-shaped rows, with ``o_term`` and ``o_rate`` alone: offers come from their
    number, so no row builds the whole array to be read for two fields."""
    n, k = offer_count(), F.col("_k")
    rows = df.withColumn("_n", n).where("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    bump = term = None
    for i, (t, b, _, _) in enumerate(OFFERS, 1):
        term = F.when(k == i, t) if term is None else term.when(k == i, t)
        bump = F.when(k == i, F.lit(b)) if bump is None else bump.when(k == i, F.lit(b))
    bought = k.isin(*[i for i, (_, _, kind, paid) in enumerate(OFFERS, 1) if paid and kind == "FIXED"])
    base = F.col("l_discount") + bump
    rate = F.when(bought, base - F.when(F.col("l_partkey") % 2 == 0, F.col("l_tax") / 1.75).otherwise(F.lit(0.0))).otherwise(base)
    return rows.withColumns({"o_term": term.cast("int"), "o_rate": rate}).drop("_n", "_k")


def decision_record(li: DataFrame) -> DataFrame:
    """Nested decision record of each line-item-shaped row.

    The offers array holds up to five offers built from the line's own values;
    it is empty for some events and NULL for others.  Row-wise, so it can be
    applied after ranking (build the wide record only for surviving rows).
    """
    ln = F.col("l_linenumber")
    disc, tax = F.col("l_discount"), F.col("l_tax")

    part = F.col("l_partkey")

    def offer(term, bump, kind, paid):
        base = disc + F.lit(bump)
        # A paid fee buys the rate down; some test offers are priced by the right divisor, some not.
        rate = base - F.when(part % 2 == 0, tax / 1.75).otherwise(F.lit(0.0)) if paid and kind == "FIXED" else base
        apr = F.when(part % 3 == 0, base - tax / 2.4).otherwise(base + tax / 10)
        return F.struct(
            F.lit(term).cast("int").alias("term"),
            rate.alias("rate"),
            (tax if paid else tax * 0).alias("fee"),
            F.when(part % 29 == 0, F.lit(None)).otherwise(F.lit(kind)).alias("kind"),
            (disc / 2 + 0.01).alias("margin"),
            F.when(part % 7 != 0, disc / 2 + F.lit(bump) - 0.01).alias("index_rate"),
            apr.alias("apr"),
            (rate + F.when(part % 5 != 0, 0.0025).otherwise(0.005)).alias("non_autopay_rate"),
        )

    # A prefix slice: code-generated, unlike a lambda filter.
    offers = F.slice(F.array(*[offer(*spec) for spec in OFFERS]), 1, offer_count())
    offers = F.when((ln == 7) & (F.col("l_returnflag") == "N"), F.lit(None)).otherwise(offers)
    reason = lambda code, text: F.struct(F.lit(code).alias("code"), F.lit(text).alias("reason"))
    third = F.element_at(F.array(*[reason(code, code.lower()) for code in OTHER_REASONS]),
                         (F.col("l_partkey") % len(OTHER_REASONS) + 1).cast("int"))
    reasons = (F.when(F.col("l_returnflag") == "R", F.array(reason("CLTV", "Combined LTV too high"),
                                                            reason("DTI", "Debt to income too high"), third))
                .when(F.col("l_returnflag") == "A", F.array(reason("LANDUSE", "Land use not eligible"),
                                                            reason("INV_TAXLIEN", "Other: Involuntary lien"), third))
                .otherwise(F.slice(F.array(reason("X", "x")), 1, 0)))
    return li.select(
        F.col("l_orderkey").alias("id"),
        F.col("l_shipdate").alias("event_ts"),
        ln.alias("seq"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_extendedprice").alias("price"),
        F.struct(
            F.when(F.col("l_partkey") % 19 == 0, F.lit(None))
             .otherwise((500 + F.col("l_partkey") % 351).cast("string")).alias("credit_score"),
            (F.col("l_extendedprice") * 4).alias("home_amount"),
            (tax * 200).alias("fsd"),
            F.struct(round_half_up(F.col("l_extendedprice") * disc, 2).alias("amount")).alias("revolving_debt"),
            F.struct((F.col("l_quantity") * 40).alias("amount")).alias("installment_debt"),
            F.struct((F.col("l_quantity") * 100 + 1000).alias("amount")).alias("monthly_income"),
            F.struct(F.when(F.col("l_partkey") % 3 == 0, F.lit(350.0))
                     .otherwise(F.col("l_quantity") * 20 + 200).alias("amount")).alias("transportation_expense"),
            F.struct((F.col("l_extendedprice") / 50).alias("amount")).alias("bureau_debt"),
            F.struct((F.col("l_quantity") * 15).alias("amount")).alias("current_student_payment"),
            F.struct((F.col("l_extendedprice") / 20).alias("amount")).alias("pre_loan_cashflow"),
            F.struct((F.col("l_extendedprice") / 25).alias("amount")).alias("post_loan_cashflow"),
        ).alias("uw_packet"),
        offers.alias("offers"),
        reasons.alias("decline_reasons"),
    )


# ---------------------------------------------------------------------------
# liens, tasks, chat, staff profile
# ---------------------------------------------------------------------------

@frame
def liens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Involuntary-lien items per person with their state, and summary flags."""
    ev = table(spark, sf_dir, "events")
    et = F.col("event_type")
    cat = F.lit("NOTICE")
    for src, dst in reversed(CATEGORY_BY_EVENT):
        cat = F.when(et == src, dst).otherwise(cat)
    missing = F.col("event_id") % 17 == 0
    uid = F.col("user_id")
    return ev.select(
        F.col("event_id").alias("lien_id"),
        uid.alias("person"),
        F.when(missing, F.lit(None)).otherwise(cat).alias("category"),
        F.when(missing, F.lit(None))
         .when((et == "error") & (F.col("event_id") % 2 == 1), "RELEASE")
         .otherwise(cat).alias("description"),
        F.when(F.col("event_id") % 19 != 0, F.date_sub(F.to_date("ts"), F.floor(F.col("value") * 10).cast("int") + LIEN_SHIFT))
         .alias("document_date"),
        F.element_at(F.array(*[F.lit(x) for x in LIEN_STATES]), (F.col("event_id") % len(LIEN_STATES) + 1).cast("int"))
         .alias("state_code"),
        (uid % 3 != 0).alias("involuntary_on_property"),
        (uid % 5 == 0).alias("hoa_on_property"),
        F.when(uid % 7 == 0, F.lit(None)).otherwise(uid % 2 == 0).alias("is_pace"),
    )


def raw_subtasks() -> list[str]:
    """Raw sub-task labels the test tasks cycle through: every alias, every weighted
    label, one unknown label and one e-mail task (built from the policy tables)."""
    from .policies import SUBTASK_ALIASES, TASK_WEIGHTS
    out: list[str] = []
    for _, raws in SUBTASK_ALIASES:
        out += [r for r in raws if r not in out]
    out += [w for w, _ in TASK_WEIGHTS if w not in out]
    return out + ["Unlisted Review", "Send Welcome Email"]


# Raw outcomes (NULL included) and task statuses the test tasks cycle through.
RAW_OUTCOMES = ["CANCEL_TASK", "FIXED", "NO_DISCREPANCY", "CANCEL", "COMPLETE_TASK", "FRAUD_SUSPECTED",
                "CONFIRM_FRAUD", "FRAUD_FOUND", "REASSIGNED", None]
TASK_STATUSES = ["COMPLETE", "CANCELLED", "FAILED", "OPEN", "1"]
TASK_TYPE_BY_EVENT = [("click", "PROPERTY_OWNERSHIP_FRAUD_REVIEW"), ("view", "FRAUD_REVIEW"),
                      ("purchase", "CREDIT_FRAUD_REVIEW"), ("signup", "DOCUMENT_REVIEW")]


@frame
def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations tasks (task x sub-task): one per event, completed by one of the agents."""
    ev = table(spark, sf_dir, "events")
    eid, et = F.col("event_id"), F.col("event_type")
    subs = raw_subtasks()
    ttype = F.lit("4")
    for src, dst in reversed(TASK_TYPE_BY_EVENT):
        ttype = F.when(et == src, dst).otherwise(ttype)
    pick = lambda vals, k: F.element_at(F.array(*[F.lit(v) for v in vals]), (k % len(vals) + 1).cast("int"))
    return ev.select(
        eid.alias("task_id"),
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("application"),
        et.alias("event_type"),
        ttype.alias("task_type"),
        F.col("value"),
        F.col("ts"),
        F.timestamp_add("HOUR", -(eid % 48), F.col("ts")).alias("created_date"),
        F.concat(F.lit("S"), (eid % N_AGENTS).cast("string")).alias("completed_by"),
        pick(subs, eid).alias("subtask_desc"),
        F.when(eid % 3 == 0, "IDENTITY_FRAUD detected").when(eid % 3 == 1, "CREDIT_FRAUD alert")
         .otherwise("routine").alias("message"),
        pick(RAW_OUTCOMES, F.floor(F.col("value")).cast("bigint")).alias("last_outcome"),
        pick(TASK_STATUSES, F.col("user_id")).alias("last_status"),
        F.when(eid % 5 == 0, "[SUPERVISOR]").when(eid % 5 == 1, "[SYSTEM]").otherwise("[AGENT]").alias("proficiencies"),
        F.when(F.col("value") > 100, "long task").alias("comments"),
    )


@frame
def contact_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do-not-contact records: created by one agent, maybe updated by another."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderdate").alias("created_ts"),
        F.col("o_orderkey").alias("application"),
        F.concat(F.lit("S"), (F.col("o_orderkey") % N_AGENTS).cast("string")).alias("created_by"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit(None))
         .otherwise(F.concat(F.lit("S"), (F.col("o_custkey") % N_AGENTS).cast("string"))).alias("updated_by"))


@frame
def complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complaint records: creator, optional approver, product, approval flag."""
    o = table(spark, sf_dir, "orders")
    pr = F.col("o_orderpriority")
    return o.select(
        F.col("o_orderdate").alias("created_ts"),
        F.col("o_orderkey").alias("complaint_id"),
        F.concat(F.lit("S"), (F.col("o_custkey") % N_AGENTS).cast("string")).alias("creator"),
        F.when(F.col("o_orderstatus") == "O", F.lit(None))
         .otherwise(F.concat(F.lit("S"), (F.col("o_orderkey") % 29).cast("string"))).alias("approver"),
        F.when(pr == "1-URGENT", "Home Lease Back").when(pr == "2-HIGH", "--").when(pr == "3-MEDIUM", " ")
         .otherwise("HELOC").alias("product"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.col("o_orderstatus") == "F").alias("is_approved"))


@frame
def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notary call statistics (call x participant)."""
    ev = table(spark, sf_dir, "events")
    ts, eid = F.col("ts"), F.col("event_id")
    ended = F.timestamp_add("SECOND", F.floor(F.col("value") * 60).cast("bigint"), ts)
    return ev.select(
        F.concat(F.lit("S"), (F.col("user_id") % N_AGENTS).cast("string")).alias("participant"),
        eid.alias("room"),
        ts.alias("call_started"),
        ended.alias("call_ended"),
        F.timestamp_add("MINUTE", eid % 5, ts).alias("connected"),
        F.timestamp_add("MINUTE", -(eid % 3), ended).alias("disconnected"))


@frame
def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat records (one per conversation turn) with nested events / latencies / id maps."""
    cv = table(spark, sf_dir, "conversations")
    cid = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    agent = lambda k: F.concat(F.lit("S"), ((F.col("conv_id") + k) % N_AGENTS).cast("string"))
    lines = F.split(F.col("text"), "\n")
    lat = F.transform(lines, lambda s: (F.length(s) * 3).cast("double"))
    return cv.select(
        cid.alias("chat_id"),
        F.col("conv_id"),
        F.timestamp_add("MINUTE", F.col("conv_id") * 37 + F.col("turn") * 5,
                        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("created_at"),
        F.when(F.length("text") % 5 == 0, F.lit(None)).otherwise((F.length("text") % 5).cast("double")).alias("rating"),
        agent(0).alias("initial_responder"),
        agent(F.col("turn")).alias("final_responder"),
        F.transform(lines, lambda s, i: F.struct(
            F.when(i % 2 == 0, "msg_out").otherwise("msg_in").alias("type"),
            F.concat(F.lit("S"), ((F.col("conv_id") + i) % N_AGENTS).cast("string")).alias("responder_id"),
            s.alias("text"))).alias("events"),
        F.array(F.struct(agent(0).alias("responder_id"), lat.alias("latency")),
                F.struct(agent(1).alias("responder_id"), F.reverse(lat).alias("latency"))).alias("response_latency"),
        F.array(F.struct(agent(0).alias("id"), F.concat(agent(0), F.lit("@staff.example")).alias("id_map")),
                F.struct(agent(1).alias("id"), F.concat(agent(1), F.lit("@staff.example")).alias("id_map"))).alias("id_mappings"),
    )


@frame
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity profiles: borrowers (customers, 'C' ids) and staff (suppliers, 'S' ids)."""
    c = table(spark, sf_dir, "customer")
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cust = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("identity"),
        F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@mail.example")).alias("email"),
        F.col("c_name").alias("first_name"), F.col("c_mktsegment").alias("last_name"),
        F.col("n_name").alias("state"))
    staff = s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("identity"),
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit("@staff.example")).alias("email"),
        F.col("s_name").alias("first_name"), F.lit("Staff").alias("last_name"),
        F.col("n_name").alias("state"))
    return cust.unionByName(staff)


@frame
def mortgage_history(spark: SparkSession, sf: str) -> DataFrame:
    """Mortgage / title records (application x mortgage) with a nested transaction array.

    Dates arrive as strings where '' means "none" (as in the title feeds); the
    property's three sale-date sources come from the application.
    """
    li = table(spark, sf, "lineitem")
    ship = F.to_date("l_shipdate")
    pk, sk, ln = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    # Epoch seconds of the (time-zone-less) ship timestamp, independent of the session zone.
    epoch_s = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("l_shipdate"))
    tx = lambda kind, off, pos: F.struct(
        F.lit(kind).alias("type_description"),
        F.date_sub(ship, (pk % off).cast("int")).alias("tx_date"),
        F.date_sub(ship, (sk % 9).cast("int")).alias("sale_date"),
        F.when(pk % 5 == 0, F.lit(None)).otherwise(F.date_sub(ship, (sk % 30).cast("int"))).alias("recording_date"),
        F.when(sk % 6 == 0, F.lit(None)).otherwise(F.lit(pos)).cast("int").alias("lien_position"),
        F.when(F.col("l_quantity") > 45, F.lit(None)).otherwise(F.col("l_extendedprice")).alias("loan_amount"),
        F.concat(F.lit("T"), pk.cast("string")).alias("doc_id"))
    return li.select(
        F.col("l_orderkey").alias("id"),
        (pk % 2).alias("property_id"),
        F.col("l_linestatus").alias("status_indicator"),
        F.when(F.col("l_linestatus") == "O", F.lit("")).otherwise(ship.cast("string")).alias("payoff_date"),
        F.when(pk % 13 == 0, F.lit(None)).otherwise(F.date_sub(ship, (sk % 40).cast("int")).cast("string")).alias("origination_date"),
        F.when(sk % 11 == 0, F.lit("")).otherwise(F.date_sub(ship, (pk % 20).cast("int")).cast("string")).alias("recording_date"),
        F.when(F.col("l_quantity") > 48, F.lit(None)).otherwise(F.col("l_extendedprice")).alias("amount"),
        F.concat(F.lit("D"), (ln % 3).cast("string")).alias("document_number"),
        F.concat(F.lit("Lender "), F.repeat(F.lit("x"), (sk % 5).cast("int"))).alias("lender"),
        epoch_s.alias("created_seconds"),
        (pk % 1000).alias("created_nanos"),
        (epoch_s + sk).alias("updated_seconds"),
        (ln * 1000).alias("updated_nanos"),
        F.when(pk % 4 == 0, F.array(tx("DEED", 3, 2)))
         .otherwise(F.array(tx("FINANCE", 15, 1), tx("DEED", 3, 2), tx("FINANCE", 7, 3))).alias("transactions"),
    )


@frame
def property_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property records (application x property): last sale date as text, and the finance history nested under a
    struct, none to two loans built from the row's own values (NULL for some properties)."""
    li = table(spark, sf_dir, "lineitem")
    ship = F.to_date("l_shipdate")
    pk, sk = F.col("l_partkey"), F.col("l_suppkey")

    def loan(k):
        taken = F.date_sub(ship, ((pk + 7 * k) % 80).cast("int"))
        return F.struct(
            F.when((pk + k) % 31 == 0, F.lit(None)).when((sk + k) % 6 == 0, "F").when((sk + k) % 6 == 1, "U").otherwise("O").alias("status"),
            F.when((pk + k) % 3 != 0, ship.cast("string")).alias("payoff_date"),
            F.when((pk + k) % 17 != 0, taken.cast("string")).alias("origination_date"),
            F.when((sk + k) % 11 != 0, F.date_add(taken, 5).cast("string")).alias("recording_date"),
            F.when(F.col("l_quantity") <= 45, F.col("l_extendedprice")).alias("amount"),
            ((sk + k) % 4).cast("int").alias("lien_position"))

    loans = F.slice(F.array(loan(1), loan(2)), 1, (F.col("l_linenumber") % 3).cast("int"))
    sale = F.when(pk % 29 == 0, "unknown").when(pk % 23 != 0, F.date_sub(ship, (sk % 60).cast("int")).cast("string"))
    return li.select(F.col("l_orderkey").alias("id"), pk.alias("property_id"), sale.alias("last_sale_date"),
                     F.struct(F.when(pk % 37 != 0, loans).alias("finance_history_attributes")).alias("financial_history"))


@frame
def property_sale_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Three sale-date sources per application, as strings ('' or NULL when missing)."""
    a = app(spark, sf).select("id", "app_date")
    p = prop(spark, sf).select("id", "last_sale")
    j = a.join(p, "id", "left")
    return j.select(
        "id", "app_date",
        F.when(F.col("id") % 5 == 0, F.lit("")).otherwise(F.col("last_sale").cast("string")).alias("avm_sale_date"),
        F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.date_sub("last_sale", 3).cast("string")).alias("transfer_sale_date"),
        F.date_sub("app_date", 400).cast("string").alias("market_sale_date"),
    )


@frame
def tradelines(spark: SparkSession, sf: str) -> DataFrame:
    """Credit tradelines (application x tradeline)."""
    li = table(spark, sf, "lineitem")
    ship = F.to_date("l_shipdate")
    pk, sk, ln = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    acct = (F.when(ln % 4 == 0, "19").when(ln % 4 == 1, "26").when(ln % 4 == 2, "47").otherwise("89"))
    return li.select(
        F.col("l_orderkey").alias("id"),
        acct.alias("account_type"),
        F.lpad((pk % 70).cast("string"), 2, "0").alias("status"),
        (F.col("l_linestatus") == "O").alias("open"),
        F.date_sub(ship, (sk % 60).cast("int") + 20).alias("open_date"),
        F.date_sub(ship, (pk % 45).cast("int") + 10).alias("status_date"),
        F.col("l_extendedprice").alias("balance"),
    )
