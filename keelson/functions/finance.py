"""Loan mathematics as Column expressions.

Everything here is a pure expression over columns of one row, evaluated in
whole-stage codegen.  Rounding goes through ``round_half_up`` (DECIMAL) and
divisions through ``safe_div`` (NULL on a zero divisor).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.latest import latest
from ..sources import policies as P
from ..sources.bureau_codes import SENTINEL_CODES, SENTINELS
from .numeric import _c, round_half_up, safe_div

# ---------------------------------------------------------------------------
# B3, B4 — bureau normalisation and score resolution
# ---------------------------------------------------------------------------


def bureau_normalise(df: DataFrame, cols: Sequence[str], key: str = "person",
                     prefer_col: str = "credit_type", sentinels=SENTINELS, sentinel_cols=SENTINEL_CODES,
                     only_type: str | None = None) -> DataFrame:
    """Coded string attributes -> DOUBLE (unparsable -> NULL), one row per key.

    A "not available" sentinel counts as 0 only for ``sentinel_cols``; elsewhere it stays the
    large number it is, so "months since" rules read it as long ago, never as just now.

    With ``only_type`` the rows are filtered to that credit type; otherwise the
    alphabetically first credit type per key is kept ('Hard Credit' before
    'Soft Credit').
    """
    conv = {}
    for c in cols:
        v = F.col(c).try_cast("double")
        conv[c] = F.when(v.isin(*[float(s) for s in sentinels]), F.lit(0.0)).otherwise(v) if c in sentinel_cols else v
    out = df.withColumns(conv)
    if only_type is not None:
        return out.where(F.col(prefer_col) == only_type)
    return latest(out, [key], [F.col(prefer_col).asc()])


def resolve_score(hard: Column, soft: Column) -> Column:
    """B4 — hard-pull score, else soft-pull score."""
    return F.coalesce(hard, soft)


# ---------------------------------------------------------------------------
# B19-B21 — monthly debts
# ---------------------------------------------------------------------------


def revolving_payment(bcc5830="BCC5830", bcc5838="BCC5838", bcx5830="BCX5830") -> Column:
    """B19 — estimated revolving payment Z."""
    bal, pay, opn = _c(bcc5830), _c(bcc5838), _c(bcx5830)
    return (((bal - pay) / 0.04) * 0.025 + pay) - (bal - opn)


def monthly_debt_parts(score: Column, tier_lo: int = 620, tier_split: int = 740) -> dict[str, Column]:
    """B20 — (revolving, installment, mortgage) monthly debt by score tier.

    Only defined when the bankcard balance does not exceed the open balance;
    tier 1 is ``[tier_lo, tier_split)``, tier 2 is ``>= tier_split``; NULL otherwise.
    """
    c = F.col
    ok = c("BCC5830") <= c("BCX5830")
    t1 = ok & score.between(tier_lo, tier_split - 1)
    t2 = ok & (score >= tier_split)
    z = revolving_payment()
    rev = (F.when(t1, round_half_up(z + (c("BAX5030") - c("BCX5030")) * 0.025 + c("RTR5030") * 0.025, 4))
             .when(t2, round_half_up(z + c("RTR5030") * 0.025, 4)))
    inst = (F.when(t1, round_half_up(c("ILN5820") - c("ILN5824"), 4))
              .when(t2, round_half_up(c("AUA5820") + c("STU5020") * 0.0035
                                      + (c("ILN5820") - (c("STU5820") + c("AUA5820"))) - c("ILN5824"), 4)))
    mort = F.when(t1 | t2, round_half_up(c("MTF5820") + c("MTS5820") + c("HLC5820"), 4))
    return {"t_revolving_debt": rev, "t_installment_debt": inst, "t_mortgage_debt": mort}


def total_monthly_debt(rev: Column, inst: Column, mort: Column, extra: Column | None = None,
                       null_as_zero: bool = True) -> Column:
    """B21 — bureau short-cut (ALX5830 - ILN5824) when BCC5830 > BCX5830, else the sum of parts.

    ``null_as_zero`` zero-fills missing parts (home-equity versions); without it
    a missing part makes the total NULL (refinance versions).
    """
    parts = [rev, inst, mort] + ([extra] if extra is not None else [])
    if null_as_zero:
        parts = [F.coalesce(p, F.lit(0.0)) for p in parts]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    shortcut = F.col("ALX5830") - F.col("ILN5824")
    return F.when(F.col("BCC5830") > F.col("BCX5830"), shortcut).otherwise(total)


# ---------------------------------------------------------------------------
# B22, B23 — expenses and income
# ---------------------------------------------------------------------------


def housing_expense(app_date: Column, recorded: Column) -> Column:
    """B22 — mortgage-based housing expense; halved for joint mortgages before the cut-off."""
    mtx, mtj = F.col("MTX5839"), F.col("MTJ0416")
    before = app_date < F.lit(P.REFI_HOUSING_CUTOFF)
    return (F.when((mtx > 0) & ~before, mtx)
             .when((mtx > 0) & (mtj > 0) & before, mtx * 0.5)
             .when((mtx > 0) & (mtj <= 0) & before, mtx)
             .otherwise(recorded))


def transportation_expense() -> Column:
    """B22 — auto payment + 200, or a flat 350 without one."""
    aut = F.col("AUT5820")
    return F.when(aut > 0, aut + 200).otherwise(F.lit(350.0))


def other_bureau_debt(app_date: Column) -> Column:
    """B22 — bureau debt outside housing/student loans, by regime."""
    c = F.col
    mta_new = c("MTA5830")  # sentinels already mapped to 0 by bureau_normalise
    return (F.when(app_date >= F.lit(P.REFI_BUREAU_CUTOFF), c("ALL5830") - mta_new - c("STU5820"))
             .when(app_date >= F.lit(P.REFI_HOUSING_CUTOFF), c("ALL5830") - mta_new - c("AUT5820") - c("STU5820"))
             .otherwise(c("ALL5830") - c("MTX5839") - c("AUT5820")))


def calc_income(verified: Column, stated: Column) -> Column:
    """B23 — verified income unless it is 0 or above the stated income."""
    return F.when((verified > stated) | (verified == 0), stated).otherwise(verified)


# ---------------------------------------------------------------------------
# B24-B30 — collateral, assets, CLTV, DTI
# ---------------------------------------------------------------------------


def collateral_value(avm: Column, stated: Column) -> Column:
    """B24 — lower of AVM and stated value (stated when AVM is missing)."""
    return F.when(avm.isNull() | (avm >= stated), round_half_up(stated, 4)).otherwise(round_half_up(avm, 4))


def collateral_haircut(value: Column, fsd: Column, land_use: Column, eff: Column) -> Column:
    """B25 — value after the haircut for its forecast deviation, by regime of the effective date.

    Below the low-value limit half counts. Before the land-use cut-off and from the relaxed regime on, a
    deviation above the full-value limit takes half of it off; in between, a wide deviation or the
    listed land use takes all of it off."""
    strict = (eff >= F.lit(P.LAND_USE_CUTOFF)) & (eff < F.lit(P.REGIME_DATES["r3"]))
    whole = (land_use == P.HAIRCUT_LAND_USE) | (fsd > P.HAIRCUT_FSD_HALF)
    return (F.when(value < P.HAIRCUT_LOW_VALUE, value * P.HAIRCUT_LOW_FACTOR)
             .when(strict & land_use.isNull(), F.lit(None))
             .when(strict & whole, value * (1 - fsd / 100))
             .when(eff.isNotNull() & (fsd <= P.HAIRCUT_FSD_FULL), value)
             .when(eff.isNotNull() & (fsd > P.HAIRCUT_FSD_FULL), value * (1 - fsd / 200)))


def asset_total(age: Column, retirement: Column, investment: Column, savings: Column) -> Column:
    """B26 — assets with a 30 % retirement cut at age <= 59.5."""
    return (F.when(age <= P.RETIREMENT_AGE, retirement * P.RETIREMENT_FACTOR + investment + savings)
             .otherwise(retirement + investment + savings))


def cltv(owed: Column, value: Column) -> Column:
    """B27 — owed / value rounded to 4 digits; NULL when value is 0 or NULL."""
    return F.when(F.coalesce(value, F.lit(0.0)) != 0, round_half_up(safe_div(owed, value), 4))


def asset_annuity(assets: Column, term_years: Column, rate: float = P.ASSET_RATE) -> Column:
    """Monthly income imputed from assets: T*r/12 / (1 - (1 + r/12)^(-12n))."""
    return safe_div(assets * (rate / 12), 1 - F.pow(F.lit(1 + rate / 12), -term_years * 12))


def dti(monthly_debt: Column, income: Column, assets: Column, term_years: Column) -> Column:
    """B29 — debt / (income + asset annuity); debt / income when the term is 0."""
    inc_ok = F.coalesce(income, F.lit(0.0)) != 0
    term = F.coalesce(term_years, F.lit(0))
    return (F.when(inc_ok & (term != 0),
                   round_half_up(safe_div(monthly_debt, income + asset_annuity(assets, term_years)), 4))
             .when(inc_ok & (term == 0), round_half_up(safe_div(monthly_debt, income), 4)))


# ---------------------------------------------------------------------------
# B31-B34 — payments and cash flow
# ---------------------------------------------------------------------------


def amortisation_factor(rate: Column | float, months: Column | int) -> Column:
    """Level-payment factor r/12 / (1 - (1 + r/12)^-n); NULL when r or n is 0 (or NULL)."""
    r, n = _c(rate), _c(months)
    return F.when((r != 0) & (n != 0), safe_div(r / 12, 1 - F.pow(1 + r / 12, -n)))


def _constant_factor(rate: float, months: int) -> float:
    return (rate / 12) / (1 - (1 + rate / 12) ** -months)


# Payment factor at the assumed pre-refinance student-loan terms (a constant).
STUDENT_FACTOR = _constant_factor(P.STUDENT_RATE, P.STUDENT_MONTHS)


def amortised_payment(principal: Column, rate: Column | float, months: Column | int) -> Column:
    """B31 — level payment P * factor(r, n); NULL when r or n is 0."""
    return principal * amortisation_factor(rate, months)


def student_payment_assumed(principal: Column) -> Column:
    """Pre-refinance student-loan payment at the assumed 6.38 % over 120 months, 3 digits."""
    return round_half_up(principal * F.lit(STUDENT_FACTOR), 3)


def blended_payment(refi: Column, balance: Column, factor: Column) -> Column:
    """B32 — payment after a full or partial refinance of the student balance.

    ``factor`` is the offer's amortisation factor (NULL when rate or term is 0).
    """
    full = round_half_up(refi * factor, 3)
    part = round_half_up(balance * factor, 3) + student_payment_assumed(balance) * (1 - safe_div(refi, balance))
    return F.when(factor.isNotNull() & (refi >= balance), full).when(factor.isNotNull() & (refi < balance), part)


def cash_before_loan(income: Column, tax_factor: Column | float, housing: Column, other_debt: Column) -> Column:
    """Income after tax minus housing and other bureau debt (shared part of B33)."""
    return income * tax_factor - housing - other_debt


def free_cash_flow(base: Column, transport: Column, student_payment: Column, app_date: Column) -> Column:
    """B33 — ``cash_before_loan`` minus the student payment (and transport before the cut-off)."""
    after = base - student_payment
    return (F.when(app_date >= F.lit(P.REFI_BUREAU_CUTOFF), round_half_up(after, 3))
             .when(app_date < F.lit(P.REFI_BUREAU_CUTOFF), round_half_up(after - transport, 3)))


def usury_cap(margin: Column, index_rate: Column, fee: Column) -> Column:
    """B43 — all-in percentage margin + index (none counts as 0) + fee."""
    return margin + F.coalesce(index_rate, F.lit(0.0)) + fee


def offer_rate(kind: Column, rate: Column, margin: Column, index_rate: Column, discount: Column | float) -> Column:
    """B41 — expected rate: a fixed offer's own, a floating one's margin + index - discount (no index
    counts as 0). An offer without a kind has no expected rate."""
    floating = margin + F.coalesce(index_rate, F.lit(0.0)) - discount
    return F.when(kind == "FIXED", rate).when(kind == "VARIABLE", floating)
