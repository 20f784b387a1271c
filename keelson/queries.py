"""

Every function takes ``(spark, sf_dir)`` and returns a DataFrame whose columns
carry the same names as the matching DuckDB SQL in ``keelson.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import finance as FN
from .functions.dates import day_diff, minute_diff, month_diff, year_diff
from .functions.numeric import is_false, is_true, round_half_up, safe_div, sentinel_to_zero
from .operators.latest import latest
from .operators.membership import cohort, member_flag, not_in
from .operators.nested import flatten
from .operators.policy import effective_date, repair_date
from .operators.reconcile import mismatches
from .operators.asof import asof_join
from .operators.rangejoin import range_join
from .operators.rules import battery, version_difference
from .plans import heloc as H
from .plans import liens as LZ
from .plans import pricing as PR
from .plans import refi as R
from .plans import scorecard as SC
from .sources import derived as D
from .sources import policies as P
from .sources.sinks import replace_partitions, scratch
from .sources.tables import table

QUERIES: dict = {}
#: Bin of the range join of calls: about the length of a call.
CALL_BIN_SECONDS = 3600


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------------------
# scans, projection, predicates
# ---------------------------------------------------------------------------

@register
def q_scan_project(spark: SparkSession, sf: str) -> DataFrame:
    """Derived application mart (subquery scan + computed columns)."""
    return D.app(spark, sf)


@register
def q_filter_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Comparisons, BETWEEN, IN / NOT IN, LIKE, NULL tests."""
    a = D.app(spark, sf)
    cond = (F.col("amount").between(50000, 250000)
            & F.col("app_date").between(F.lit("1996-01-01").cast("date"), F.lit("1998-12-31").cast("date"))
            & ~F.col("status").isin("CANCELLED")
            & (F.col("segment").like("%BUILD%") | F.col("segment").like("AUTO%") | F.col("segment").endswith("TURE"))
            & ~F.col("segment").like("%MACH%")
            & F.col("hard_score").isNotNull()
            & (F.col("score") != 700))
    return a.where(cond).select(
        "id", "amount", "state", "status", "segment",
        (F.col("amount") > 200000).alias("is_large"),
        (F.length("flag") < 1).alias("empty_flag"),
        F.when(F.col("state").isin("NATION_1", None), "in").otherwise("out").alias("in_with_null"),
    )


@register
def q_case_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """First-match CASE, CASE without ELSE, simple CASE on a boolean, IS TRUE / IS FALSE."""
    a = D.app(spark, sf)
    hi = F.col("hard_score") >= 700
    return a.select(
        "id",
        F.when(F.col("score") >= 760, "A").when(F.col("score") >= 680, "B")
         .when(F.col("score") >= 620, "C").otherwise("D").alias("tier"),
        F.when(F.col("flag") == "Y", "promo").alias("promo"),
        F.when(hi == F.lit(False), "low").when(hi == F.lit(True), "high").alias("score_band"),
        is_true(hi).alias("hi_is_true"),
        is_false(hi).alias("hi_is_false"),
    )


@register
def q_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """SELECT DISTINCT over three columns."""
    return D.app(spark, sf).select("state", "status", "decision").distinct()


@register
def q_struct_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Struct-path projection through nested structs."""
    d = D.decisions(spark, sf)
    return d.select(
        "id", "seq", "part",
        F.col("uw_packet.credit_score").alias("credit_score"),
        F.col("uw_packet.revolving_debt.amount").alias("revolving_debt"),
        F.col("uw_packet.monthly_income.amount").alias("monthly_income"),
    )


# ---------------------------------------------------------------------------
# joins (J1-J4, J10, J14)
# ---------------------------------------------------------------------------

@register
def q_inner_join(spark: SparkSession, sf: str) -> DataFrame:
    """Inner equi-join application x property."""
    a, p = D.app(spark, sf), D.prop(spark, sf)
    return a.join(p, "id").select("id", "amount", "avm", "land_use")


@register
def q_left_join(spark: SparkSession, sf: str) -> DataFrame:
    """Left outer join keeps applications without a property record."""
    a, p = D.app(spark, sf), D.prop(spark, sf)
    return a.join(p, "id", "left").select("id", "status", "avm", "land_use")


@register
def q_right_join_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Right outer join made inner by a null-rejecting WHERE (Catalyst rewrites it)."""
    a, p = D.app(spark, sf), D.prop(spark, sf)
    j = p.join(a, "id", "right").where(F.col("land_use").isNotNull())
    return j.select("id", "land_use", "status")


@register
def q_multikey_join(spark: SparkSession, sf: str) -> DataFrame:
    """Join on (application, sequence) — duplicate events fan out as in SQL."""
    d = D.decisions(spark, sf).select("id", "seq", "price")
    cnt = d.groupBy("id", "seq").agg(F.count(F.lit(1)).alias("dup_count"))
    return d.join(cnt, ["id", "seq"]).select("id", "seq", "price", "dup_count")


@register
def q_self_join(spark: SparkSession, sf: str) -> DataFrame:
    """Two subqueries over the same table (first and latest application per person)."""
    a = D.app(spark, sf).select("person", "id", "app_date")
    last = latest(a, ["person"], [F.col("app_date").desc(), F.col("id").desc()])
    first = latest(a, ["person"], [F.col("app_date").asc(), F.col("id").asc()])
    return (last.alias("l").join(first.alias("f"), "person")
            .select("person", F.col("l.id").alias("latest_id"), F.col("f.id").alias("first_id"),
                    F.datediff(F.col("l.app_date"), F.col("f.app_date")).alias("span_days")))


@register
def q_lookup_join(spark: SparkSession, sf: str) -> DataFrame:
    """Lookup of code tables (state -> nation -> region)."""
    a = D.app(spark, sf).select("id", "state")
    n = table(spark, sf, "nation").select("n_name", "n_regionkey")
    r = table(spark, sf, "region").select("r_regionkey", "r_name")
    return (a.join(n, a.state == n.n_name).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("id", "state", F.col("r_name").alias("region")))


# ---------------------------------------------------------------------------
# semi / anti / membership
# ---------------------------------------------------------------------------

@register
def q_semi_cohort(spark: SparkSession, sf: str) -> DataFrame:
    """Restrict applications to a cohort given as a table of ids."""
    ids = table(spark, sf, "labels").where(F.col("quality") == 1).select(F.col("doc_id").alias("id"))
    return cohort(D.app(spark, sf), ids, "id").select("id", "person", "status")


@register
def q_anti_null_aware(spark: SparkSession, sf: str) -> DataFrame:
    """NOT IN (subquery) with SQL NULL semantics."""
    a = D.app(spark, sf).select("id", "person")
    sub = D.liens(spark, sf).where(F.col("category") == "FEDERAL TAX LIEN").select("person")
    return not_in(a, "person", sub, "person")


@register
def q_member_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Three-valued IN (subquery) flags, one subquery holding NULLs."""
    a = D.app(spark, sf).select("id", "person")
    lz = D.liens(spark, sf)
    with_null = lz.where((F.col("description") == "RELEASE") | F.col("category").isNull()) \
                  .select(F.when(F.col("category").isNull(), F.lit(None)).otherwise(F.col("person")).alias("k"))
    clean = lz.where(F.col("category") == "MECHANICS LIEN").select(F.col("person").alias("k"))
    out = member_flag(a, "person", with_null, "k", "in_release")
    out = member_flag(out, "person", clean, "k", "in_mechanics")
    return out.select("id", "in_release", is_false(F.col("in_release")).alias("release_is_false"),
                      "in_mechanics", is_false(F.col("in_mechanics")).alias("mechanics_is_false"))


# ---------------------------------------------------------------------------
# flatten (J5-J8, B2)
# ---------------------------------------------------------------------------

@register
def q_flatten_outer(spark: SparkSession, sf: str) -> DataFrame:
    """LEFT JOIN UNNEST — events with NULL / empty offer arrays keep one row."""
    d = D.decisions(spark, sf).select("id", "seq", "part", "offers")
    f = flatten(d, "offers", "o", outer=True, prefix="o_")
    return f.select("id", "seq", "part", "o_term", "o_rate", "o_kind")


@register
def q_flatten_inner(spark: SparkSession, sf: str) -> DataFrame:
    """CROSS JOIN UNNEST of chat events."""
    c = D.chat(spark, sf).select("chat_id", "events")
    f = flatten(c, "events", "e", outer=False, prefix="e_")
    return f.select("chat_id", "e_type", "e_responder_id", F.length("e_text").alias("chars"))


@register
def q_flatten_chained(spark: SparkSession, sf: str) -> DataFrame:
    """UNNEST of an array inside a struct inside an array."""
    c = D.chat(spark, sf).select("chat_id", "response_latency")
    f = flatten(c, "response_latency", "rl", outer=False, prefix="rl_")
    f = flatten(f, "rl_latency", "latency", outer=False)
    return f.select("chat_id", "rl_responder_id", "latency")


@register
def q_flatten_cross(spark: SparkSession, sf: str) -> DataFrame:
    """Latest event per application first, then offers x decline reasons."""
    d = _latest_decision(spark, sf).select("id", "offers", "decline_reasons")
    f = flatten(d, "offers", "o", outer=True, prefix="o_")
    f = flatten(f, "decline_reasons", "r", outer=True, prefix="r_")
    return f.select("id", "o_term", "o_rate", "r_code")


# ---------------------------------------------------------------------------
# latest record
# ---------------------------------------------------------------------------

def _latest_decision(spark: SparkSession, sf: str) -> DataFrame:
    from .plans.heloc import latest_decision
    return latest_decision(spark, sf)


@register
def q_latest_single(spark: SparkSession, sf: str) -> DataFrame:
    """Latest decision event per application (full tie-break)."""
    return _latest_decision(spark, sf).select("id", "event_ts", "seq", "part", "supp", "price")


@register
def q_latest_multi(spark: SparkSession, sf: str) -> DataFrame:
    """Multi-column partition, expression ordering."""
    a = D.app(spark, sf)
    out = latest(a, ["person", "status"], [(F.col("amount") * F.col("term_years")).desc(),
                                            F.length("segment").desc()], [F.col("id").desc()])
    return out.select("person", "status", "id", "amount", "term_years")


@register
def q_latest_priority(spark: SparkSession, sf: str) -> DataFrame:
    """Ascending order as a priority choice (hard pull before soft pull)."""
    b = D.bureau_raw(spark, sf).select("person", "credit_type", "MTA2126")
    return latest(b, ["person"], [F.col("credit_type").asc()])


# ---------------------------------------------------------------------------
# aggregation, union, sort
# ---------------------------------------------------------------------------

@register
def q_group_agg(spark: SparkSession, sf: str) -> DataFrame:
    """A1, A3-A5: GROUP BY with SUM / AVG / COUNT."""
    t = D.tasks(spark, sf)
    return t.groupBy("completed_by", "task_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("value").alias("n_value"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("sum_value"),
        round_half_up(F.avg(F.col("value").cast("decimal(18,2)")), 4).alias("avg_value"),
    )


@register
def q_cond_count(spark: SparkSession, sf: str) -> DataFrame:
    """Conditional counts as SUM(CASE 1/0) and COUNT_IF."""
    t = D.tasks(spark, sf)
    return t.groupBy("completed_by").agg(
        F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).cast("bigint").alias("clicks"),
        F.sum(F.when(F.col("event_type") != "click", 1).otherwise(0)).cast("bigint").alias("non_clicks"),
        F.count_if(F.col("value") > 100).alias("big_values"),
    )


@register
def q_ratio_of_sums(spark: SparkSession, sf: str) -> DataFrame:
    """SUM/SUM ratio, COUNT*AVG product, rounded AVG of a time difference."""
    t = D.tasks(spark, sf)
    v = F.col("value").cast("decimal(18,2)")
    mins = F.timestamp_diff("MINUTE", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return t.groupBy("completed_by").agg(
        round_half_up(F.try_divide(F.sum(F.when(F.col("event_type") == "purchase", v)), F.sum(v)), 6).alias("purchase_share"),
        round_half_up(F.count("task_type") * F.avg(v), 2).alias("score_obtained"),
        round_half_up(F.avg(mins), 3).alias("avg_minutes"),
    )


@register
def q_sink_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """S6 - a partitioned table written, one partition restated twice by the same batch, read again."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = scratch(spark, "sink-partitions")
    replace_partitions(o, path, ["o_orderstatus"])
    restated = o.where(F.col("o_orderstatus") == "F").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    for _ in range(2):
        replace_partitions(restated, path, ["o_orderstatus"])
    return spark.read.schema(o.schema).parquet(path).select("o_orderkey", "o_orderstatus", "o_totalprice")


@register
def q_sort_final(spark: SparkSession, sf: str) -> DataFrame:
    """O1: final ORDER BY several keys (DESC / ASC)."""
    a = D.app(spark, sf).select("id", "app_date", "state", "amount")
    return a.orderBy(F.col("app_date").desc(), F.col("state").asc(), F.col("id").asc())


# ---------------------------------------------------------------------------
# home-equity decision audit (flagship) and its stages
# ---------------------------------------------------------------------------


@register
def q_heloc_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: home-equity decision audit (credit, property, lien, CLTV, DTI; verdict)."""
    return H.heloc_audit(spark, sf)


def _app_bureau(spark: SparkSession, sf: str) -> DataFrame:
    a = D.app(spark, sf)
    df = a.join(H.bureau(spark, sf), "person", "left")
    return df.withColumn("fico", FN.resolve_score(F.col("hard_score"), F.col("soft_score")))


@register
def q_bureau_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """Coded strings -> double, sentinels -> 0, preferred credit type per person."""
    return H.bureau(spark, sf)


@register
def q_score_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Hard score, else soft score."""
    a = D.app(spark, sf)
    return a.select("id", "hard_score", "soft_score",
                    FN.resolve_score(F.col("hard_score"), F.col("soft_score")).alias("fico"))


@register
def q_effective_date(spark: SparkSession, sf: str) -> DataFrame:
    """Promotional mail date when the promo is valid, else application date; regime of that date."""
    a = D.app(spark, sf)
    eff = effective_date(F.col("app_date"), F.col("mail_date"), F.col("respond_by"), F.col("flag"))
    return a.select("id", "app_date", "flag", eff.alias("eff_date"), H.regime_col(eff).alias("regime"))


@register
def q_policy_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Policy rows in force on the effective date, by state group or score band (dated tables)."""
    df = H.ratio_checks(spark, sf)
    return df.select("id", "fico", "regime", "cltv_limit", "dti_limit", "score_floor", "max_loan")


@register
def q_asof_lien(spark: SparkSession, sf: str) -> DataFrame:
    """As-of join of two data-sized sides, the person's last lien document not after the application date."""
    app = D.app(spark, sf).select("id", "person", "app_date")
    return asof_join(app, D.liens(spark, sf), ["person"], "app_date", "document_date", ["lien_id", "category"])


@register
def q_range_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Range join without an equi key of two data-sized sides, the tasks completed while each call ran."""
    done = D.tasks(spark, sf).select("task_id", F.col("ts").alias("done_at"))
    calls = D.calls(spark, sf).select("room", "call_started", "call_ended")
    return range_join(done, calls, ("done_at", "done_at"), ("call_started", "call_ended"), CALL_BIN_SECONDS, per=["room"],
                      totals={"tasks": ("count", "task_id"), "first_task": ("min", "task_id"), "last_done_at": ("max", "done_at")})


@register
def q_cascade_credit(spark: SparkSession, sf: str) -> DataFrame:
    """First-match credit knockout cascade over every application."""
    df = H.with_credit(H.heloc_inputs(spark, sf, with_lien_items=False))
    return df.select("id", "fico", "credit_check")


@register
def q_property_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Two-directional property eligibility rules."""
    df = H.with_property(H.heloc_inputs(spark, sf, with_lien_items=False))
    return df.select("id", "land_use", "acres", "property_check")


@register
def q_title_history(spark: SparkSession, sf: str) -> DataFrame:
    """Three-valued EXISTS / FOR ALL over nested loans, and the reason flags."""
    return H.heloc_inputs(spark, sf, with_lien_items=False).select(
        "id", "foreclosure_open", "foreclosure_open_any_amount", "recorded_position_high", "foreclosure_settled",
        "foreclosure_settled_credit", "lien_reason_flag", "foreclosure_reason_flag")


@register
def q_rule_versions(spark: SparkSession, sf: str) -> DataFrame:
    """B14 by version: applications whose fired property rules change from the version of May to that of June."""
    df = H.heloc_inputs(spark, sf, with_lien_items=False)
    return version_difference(df.withColumn("march_check", H.PROPERTY_RULES["march"].label(df)), ["id", "march_check"],
                              H.PROPERTY_RULES["may"], H.PROPERTY_RULES["june"])


@register
def q_lien_exceptions(spark: SparkSession, sf: str) -> DataFrame:
    """Involuntary-lien exceptions summarised per application, both versions of the item rule."""
    return H.lien_summary(spark, sf)


@register
def q_lien_decline(spark: SparkSession, sf: str) -> DataFrame:
    """Lien decline check (DT returns / no returns, both directions), both versions of the item rule."""
    df = H.with_liens(H.heloc_inputs(spark, sf), "any").withColumnRenamed("lien_check", "lien_check_any")
    return H.with_liens(df, "all").select("id", "lien_exists", "lien_fails_any", "lien_fails_all", "lien_no_record",
                                          "lien_reason_flag", "lien_check_any", "lien_check")


@register
def q_debt_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Revolving payment estimate and monthly debt parts by score tier."""
    df = _app_bureau(spark, sf)
    df = df.withColumns(FN.monthly_debt_parts(F.col("fico"), 620, 740))
    return df.select("id", round_half_up(FN.revolving_payment(), 4).alias("z"),
                     "t_revolving_debt", "t_installment_debt", "t_mortgage_debt")


@register
def q_total_debt(spark: SparkSession, sf: str) -> DataFrame:
    """Total monthly debt, zero-filled and NULL-propagating variants."""
    df = _app_bureau(spark, sf).withColumns(FN.monthly_debt_parts(F.col("fico"), 620, 740))
    parts = [F.col("t_revolving_debt"), F.col("t_installment_debt"), F.col("t_mortgage_debt")]
    return df.select("id",
                     round_half_up(FN.total_monthly_debt(*parts, null_as_zero=True), 4).alias("debt_zero_filled"),
                     round_half_up(FN.total_monthly_debt(*parts, null_as_zero=False), 4).alias("debt_null_propagating"))


@register
def q_collateral(spark: SparkSession, sf: str) -> DataFrame:
    """Collateral value and haircut."""
    df = H.ratio_checks(spark, sf)
    return df.select("id", round_half_up(F.col("t_collateral"), 4).alias("t_collateral"),
                     round_half_up(F.col("t_adj_collateral"), 4).alias("t_adj_collateral"))


@register
def q_cltv(spark: SparkSession, sf: str) -> DataFrame:
    """Raw and adjusted CLTV."""
    return H.ratio_checks(spark, sf).select("id", "owed", "t_cltv", "t_adj_cltv")


@register
def q_cltv_check(spark: SparkSession, sf: str) -> DataFrame:
    """CLTV limit check by score band and regime (both directions)."""
    return H.ratio_checks(spark, sf).select("id", "regime", "cltv_limit", "cltv_check")


@register
def q_assets_dti(spark: SparkSession, sf: str) -> DataFrame:
    """Assets with retirement cut, DTI with asset annuity."""
    df = H.ratio_checks(spark, sf)
    return df.select("id", round_half_up(F.col("t_assets"), 2).alias("t_assets"),
                     round_half_up(F.col("t_monthly_debt"), 4).alias("t_monthly_debt"), "t_dti")


@register
def q_dti_check(spark: SparkSession, sf: str) -> DataFrame:
    """DTI limit check by band and regime."""
    return H.ratio_checks(spark, sf).select("id", "dti_limit", "dti_check")


@register
def q_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Recomputed vs recorded CLTV / DTI at 3-digit tolerance."""
    return H.heloc_checks(spark, sf).select("id", "cltv_match", "dti_match")


@register
def q_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """Applications with any unmatched reconciliation."""
    df = mismatches(H.heloc_checks(spark, sf), ["cltv_match", "dti_match"])
    return df.select("id", "cltv_match", "dti_match")


@register
def q_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Decision verdict for every application."""
    return H.heloc_checks(spark, sf).select("id", "verdict")


@register
def q_two_way(spark: SparkSession, sf: str) -> DataFrame:
    """Two-directional rules (missed decline '1' / wrong decline '2')."""
    return H.ratio_checks(spark, sf).select("id", "is_approved", "is_declined", F.array_join("decline_codes", ",").alias("decline_codes"),
                                            "cltv_check", "dti_check")


# ---------------------------------------------------------------------------
# refinance audit and its stages
# ---------------------------------------------------------------------------


@register
def q_refi_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Refinance decision audit: battery, cascade, debts, cash flow, checks, reconciliations, verdict."""
    return R.refi_audit(spark, sf)


@register
def q_battery(spark: SparkSession, sf: str) -> DataFrame:
    """Rejection battery (one boolean per rule), any-true flag and first-failure label."""
    df = R.refi_knockouts(spark, sf, keep_rules=True)
    return df.select("id", *[n for n, _ in R.refi_rules()], "hard_knock", "hard_knock_failure")


@register
def q_expenses(spark: SparkSession, sf: str) -> DataFrame:
    """Housing, transportation and other bureau debt by regime."""
    df = R.refi_checks(spark, sf)
    return df.select("id", round_half_up(F.col("t_housing"), 2).alias("t_housing"), "t_transport", "t_other_debt")


@register
def q_income(spark: SparkSession, sf: str) -> DataFrame:
    """Verified income unless zero or above stated."""
    return R.refi_checks(spark, sf).select("id", "income", "verified_income", "calc_income")


@register
def q_payment(spark: SparkSession, sf: str) -> DataFrame:
    """Amortised payments (assumed student terms; offer rate and term)."""
    df = R.refi_checks(spark, sf)
    pay = round_half_up(F.col("amount") * F.col("offer_factor"), 2)
    return df.select("id", "term_years", "offer_rate", "pre_payment", pay.alias("offer_payment"))


@register
def q_blended(spark: SparkSession, sf: str) -> DataFrame:
    """Blended payment after a full or partial refinance."""
    return R.refi_checks(spark, sf).select("id", "amount", "STU5020", "post_payment")


@register
def q_cash_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Pre / post-loan free cash flow by regime."""
    return R.refi_checks(spark, sf).select("id", "pre_fcf", "post_fcf", "t_dti")


@register
def q_fcf_check(spark: SparkSession, sf: str) -> DataFrame:
    """DTI and free-cash-flow decline checks (three-state)."""
    return R.refi_checks(spark, sf).select("id", "dti_failure", "fcf_failure")


# ---------------------------------------------------------------------------
# pricing (B40-B43)
# ---------------------------------------------------------------------------


@register
def q_grid_check(spark: SparkSession, sf: str) -> DataFrame:
    """Offer rate vs rate-grid cell (broadcast equi + band join)."""
    return PR.grid_check(spark, sf)


@register
def q_grid_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps, overlaps and order of a grid with the offers that fall there; the policy's grid with a hole, a band
    that overlaps its neighbours and a rate out of order."""
    grid = PR.rate_grid(spark)
    hole = (F.col("term") == 5) & (F.col("lo") == 0.5) & (F.col("from") == 700)
    wrong = (F.col("term") == 10) & (F.col("lo") == 0.6) & (F.col("from") == 740)
    wide = (F.col("term") == 15) & (F.col("lo") == 0.65) & (F.col("from") == 680)
    cells = grid.where(~hole).withColumns({"value": F.when(wrong, 0.2).otherwise(F.col("value")), "to": F.when(wide, 729).otherwise(F.col("to"))})
    return PR.grid_faults(spark, sf, cells)


@register
def q_rate_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """Offers whose rate is not the one of their grid cell, from a date on."""
    return PR.rate_mismatches(spark, sf)


@register
def q_offer_rate(spark: SparkSession, sf: str) -> DataFrame:
    """fixed = quoted; floating = margin + index - autopay discount; autopay and manual rates."""
    return PR.offer_checks(spark, sf).drop("usury_pct")


@register
def q_usury_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Margin + index + fee per offer."""
    return PR.offer_checks(spark, sf).select("id", "seq", "part", "term", "fee", "usury_pct")


@register
def q_fee_buydown(spark: SparkSession, sf: str) -> DataFrame:
    """Fee buy-down against the no-fee base offer of the same (application, term)."""
    return PR.fee_buydown(spark, sf)


# ---------------------------------------------------------------------------
# liens (B15, B16, B44-B46)
# ---------------------------------------------------------------------------


@register
def q_lien_position(spark: SparkSession, sf: str) -> DataFrame:
    """Next lien position and best-matched lien of the latest decision."""
    return LZ.lien_position(spark, sf)


@register
def q_lien_title(spark: SparkSession, sf: str) -> DataFrame:
    """Title-record lien display with the latest record per document."""
    return LZ.title_display(spark, sf)


@register
def q_lien_title_first(spark: SparkSession, sf: str) -> DataFrame:
    """Open title records beside the nested records of their application (first display variant)."""
    return LZ.title_first(spark, sf)


@register
def q_lien_open_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Open liens without payoff whose dates are > 7 days from the sale date."""
    return LZ.open_lien_gaps(spark, sf)


@register
def q_lien_tx(spark: SparkSession, sf: str) -> DataFrame:
    """Transaction-report lien display (flattened nested array)."""
    return LZ.tx_display(spark, sf)


@register
def q_tradeline_class(spark: SparkSession, sf: str) -> DataFrame:
    """Tradeline exception classes (per-application aggregates instead of self-join fan-out)."""
    return LZ.tradeline_class(spark, sf)


# ---------------------------------------------------------------------------
# operations scorecard
# ---------------------------------------------------------------------------


@register
def q_union_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Identity union of profiles x product applications."""
    return SC.identity_union(spark, sf)


@register
def q_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """Task type, sub-task and outcome normalisation."""
    return SC.normalised_tasks(spark, sf).select("task_id", "covt_task_type", "subtask_type", "subtask_outcome")


@register
def q_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Compliance-message backfill from failed / cancelled supervisor tasks."""
    return SC.normalised_tasks(spark, sf).select("task_id", "application", "message", "comments",
                                                   "completed_date")


@register
def q_task_score(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted task score per agent."""
    return SC.task_scores(spark, sf)


@register
def q_chat_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Outgoing replies per conversation and responder."""
    return SC.chat_replies(spark, sf)


@register
def q_first_response(spark: SparkSession, sf: str) -> DataFrame:
    """First latency of the initial responder below the cap."""
    return SC.first_responses(spark, sf)


@register
def q_latency(spark: SparkSession, sf: str) -> DataFrame:
    """Count / sum of capped latencies (array inside struct inside array)."""
    return SC.latency_sums(spark, sf)


@register
def q_ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation ratings."""
    return SC.ratings(spark, sf)


@register
def q_responder_map(spark: SparkSession, sf: str) -> DataFrame:
    """DISTINCT responder -> e-mail map."""
    return SC.responder_emails(spark, sf)


@register
def q_chat_mart(spark: SparkSession, sf: str) -> DataFrame:
    """Per-agent chat mart."""
    return SC.chat_mart(spark, sf)


@register
def q_actor_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Do-not-contact counts for creator and updater roles."""
    return SC.dnc_counts(spark, sf)


@register
def q_two_level_agg(spark: SparkSession, sf: str) -> DataFrame:
    """Complaint counts for creator and approver (aggregate, union, re-aggregate)."""
    return SC.complaint_counts(spark, sf)


@register
def q_call_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Notary call statistics per agent."""
    return SC.call_stats(spark, sf)


@register
def q_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """Per-agent scorecard (marts pre-aggregated to e-mail)."""
    return SC.scorecard(spark, sf)


# ---------------------------------------------------------------------------
# scalar functions
# ---------------------------------------------------------------------------

AS_OF_DATE = "2002-01-01"


@register
def q_scalar_math(spark: SparkSession, sf: str) -> DataFrame:
    """Rounding, POW, ABS, arithmetic, zero-guarded ratio, clamp and larger-of."""
    a = D.app(spark, sf)
    sc = F.col("score")
    return a.select(
        "id",
        round_half_up(F.col("amount") / 7, 0).alias("round0"),
        round_half_up(F.col("amount") / 7, 2).alias("round2"),
        round_half_up(F.pow(F.lit(1.01), F.col("term_years")), 6).alias("growth"),
        F.abs(F.col("amount") - 100000).alias("dist"),
        (-F.col("amount")).alias("neg_amount"),
        round_half_up(safe_div(F.col("amount"), sc - 600), 4).alias("ratio"),
        F.when((sc > 700) | (sc == 0), F.lit(700)).otherwise(sc).alias("clamped"),
        F.greatest(F.col("amount"), F.col("income") * 12).alias("larger"),
    )


@register
def q_scalar_dates(spark: SparkSession, sf: str) -> DataFrame:
    """DATE(ts), DATETIME, as-of date, day / month / year boundaries, minutes, date literals."""
    e = table(spark, sf, "events").select("event_id", "ts")
    d = F.to_date("ts")
    ref = F.lit("2023-06-15").cast("date")
    return e.select(
        "event_id", d.alias("ts_date"),
        d.cast("timestamp_ntz").alias("ts_day_start"),
        day_diff(F.lit(AS_OF_DATE).cast("date"), d).alias("days_to_as_of"),
        month_diff(d, ref).alias("months"),
        year_diff(d, F.lit("2019-12-31").cast("date")).alias("years"),
        minute_diff(F.col("ts"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("minutes"),
        (d >= F.lit("2024-01-15").cast("date")).alias("late_month"),
        (F.col("ts") <= F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")).alias("before_cutoff"),
    )


@register
def q_scalar_strings(spark: SparkSession, sf: str) -> DataFrame:
    """LOWER, CONCAT (NULL-propagating), LENGTH, LIKE."""
    p = D.profile(spark, sf)
    nullable = F.when(F.col("state") == "NATION_3", F.lit(None)).otherwise(F.col("state"))
    return p.select(
        "identity", F.lower("first_name").alias("lower_name"),
        F.concat(F.col("first_name"), F.lit(" "), nullable).alias("name_state"),
        F.length("email").alias("email_len"),
        F.col("email").like("%staff%").alias("is_staff"),
    )


@register
def q_safe_cast(spark: SparkSession, sf: str) -> DataFrame:
    """CAST, SAFE_CAST, IFNULL, n-ary COALESCE, NULLIF in COALESCE, sentinel replacement."""
    b = D.bureau_raw(spark, sf)
    mta = F.col("MTA2126").try_cast("double")
    col = F.col("COL3211").try_cast("double")
    return b.select(
        "person", "credit_type",
        F.col("person").cast("double").alias("person_num"),
        mta.alias("mta2126"),
        F.coalesce(mta, F.lit(0.0)).alias("mta2126_or_zero"),
        F.coalesce(mta, col, F.lit(-1.0)).alias("first_known"),
        F.coalesce(F.nullif(mta, F.lit(0.0)), col).alias("nonzero_first"),
        sentinel_to_zero(F.col("MTA5830").try_cast("double")).alias("mta5830"),
    )


@register
def q_array_get(spark: SparkSession, sf: str) -> DataFrame:
    """safe array subscript (out of range -> NULL); epoch seconds + nanos / 1e9."""
    c = D.chat(spark, sf).select("chat_id", F.get(F.col("response_latency"), 0)["latency"].alias("lat"))
    first = c.select("chat_id", F.get(F.col("lat"), 0).alias("first_latency"),
                     F.get(F.col("lat"), 5).alias("sixth_latency"))
    return first


@register
def q_epoch_order(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds + nanos / 1e9 as one ordering value, next to the (seconds, nanos) pair."""
    m = D.mortgage_history(spark, sf)
    return m.select("id", "document_number", "created_seconds", "created_nanos",
                    (F.col("created_seconds") + F.col("created_nanos") / 1e9).alias("created_epoch"))


# ---------------------------------------------------------------------------
# credit-only audit, knockout flags, bad-date repair
# ---------------------------------------------------------------------------


@register
def q_credit_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Credit knockout audit — applications failing a credit knockout."""
    df = H.with_credit(H.heloc_inputs(spark, sf, with_lien_items=False))
    return df.where(F.col("credit_check") != "PASS").select("id", "app_date", "status", "decision", "fico",
                                                          "credit_check")


@register
def q_knockout_flags(spark: SparkSession, sf: str) -> DataFrame:
    """B8 (YES/NO style): one flag per knockout rule plus an overall result."""
    df = H.heloc_inputs(spark, sf, with_lien_items=False)
    rules = [(label.replace("_Knockout_Failure", "").lower(), missed) for label, missed, _ in H.credit_rules()]
    out = battery(df, rules, style="yesno")
    names = [n for n, _ in rules]
    anyf = F.lit(False)
    for n in names:
        anyf = anyf | (F.col(n) == "YES")
    return out.select("id", *names, F.when(anyf, "FAIL").otherwise("PASS").alias("knockout_result"))


@register
def q_date_repair(spark: SparkSession, sf: str) -> DataFrame:
    """B5 (bad-date repair): a bulk-overwritten application date replaced by the decision date."""
    a = D.app(spark, sf).select("id", "app_date", "mail_date", "respond_by", "flag")
    ld = H.latest_decision(spark, sf).select("id", F.to_date("event_ts").alias("decision_date"))
    j = a.join(ld, "id", "left")
    fixed = repair_date(F.col("app_date"), P.BAD_APP_DATE, F.col("decision_date"))
    return j.select("id", "app_date", fixed.alias("repaired_date"),
                    effective_date(fixed, F.col("mail_date"), F.col("respond_by"), F.col("flag")).alias("eff_date"))


@register
def q_property_flags(spark: SparkSession, sf: str) -> DataFrame:
    """B8, B14, F12, F13 (YES/NO style): property knockout flags against an as-of date (the application date)."""
    df = D.app(spark, sf).select("id", "app_date").join(D.prop(spark, sf), "id", "left")
    rules = [
        ("avm_knockout", (F.coalesce(F.col("prequal_avm"), F.lit(0.0)) == 0) & (F.coalesce(F.col("avm"), F.lit(0.0)) == 0)),
        ("land_use_code_knockout", ~F.col("land_use").isin(*P.LAND_USE_BEFORE)),
        ("acres_knockout", F.col("acres") > P.MAX_ACRES),
        ("last_sale_date_knockout", day_diff(F.col("app_date"), F.col("last_sale")) <= P.RECENT_SALE_DAYS),
    ]
    out = battery(df, rules, style="yesno")
    return out.select("id", *[n for n, _ in rules])


@register
def q_refi_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve recomputed-vs-recorded refinance figures at whole-dollar / 2-digit tolerance."""
    return R.refi_checks(spark, sf).select("id", *R.MATCH_COLUMNS)
