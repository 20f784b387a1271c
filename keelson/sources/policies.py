"""Policy tables: thresholds, bands, regimes, grids and weights as data.

Rule values that must equal the audited policy are listed plainly under
``FIXED VALUES`` comments.  Regime *dates* are bound to the test data's date
range (1995-2001) and are parameters, not policy.

Every table here is a handful of rows built on the driver; its size is fixed by
the policy, not by the data, which is what makes broadcasting it safe.
"""

from __future__ import annotations

import datetime as dt

# Regime boundaries for the test binding (half-open [from, to)).
REGIME_DATES = {
    "r1": dt.date(1996, 7, 1),   # first tightening
    "r2": dt.date(1997, 7, 1),   # second tightening
    "r3": dt.date(1999, 1, 1),   # relaxed regime
}
LAND_USE_CUTOFF = dt.date(1998, 3, 21)
BANKRUPTCY_CUTOFF = dt.date(1997, 4, 2)
REFI_HOUSING_CUTOFF = dt.date(1997, 1, 17)
REFI_BUREAU_CUTOFF = dt.date(1997, 1, 24)
LIEN_POSITION_CUTOFF = dt.date(1996, 3, 1)
RECORDED_POSITION_CUTOFF = REGIME_DATES["r2"]
# The day on which the earlier versions of the rules ran (they measure sales from it).
AUDIT_DATE = dt.date(1999, 6, 1)
MIN_DATE, MAX_DATE = dt.date(1900, 1, 1), dt.date(9999, 12, 31)
# A day on which application dates were overwritten in bulk (test binding); repaired
# from the decision event date.
BAD_APP_DATE = dt.date(1998, 3, 26)

# FIXED VALUES: loan size limits by score band (min amount; max per band)
LOAN_MIN = 15000.0
LOAN_MAX_BY_SCORE = [  # (score_lo inclusive, score_hi exclusive, max amount)
    (620, 680, 50000.0),
    (680, 760, 100000.0),
    (760, 100000, 150000.0),
]
# FIXED VALUES: refinance loan size bounds and thresholds
REFI_LOAN_MIN, REFI_LOAN_MAX = 5000.0, 250000.0
REFI_MIN_SCORE = 680
REFI_MAX_DTI = 0.65
FCF_FLOOR = 1500.0

# FIXED VALUES: score codes that mean "no usable score"
SCORE_CODES = (9000, 9001, 9002, 9003)
SCORE_MAX = 850

# Score floor by regime (regime dates are test binding; floors are policy values).
# FIXED VALUES: floors 620 / 680 (720 in the strict state group) / 640 (720 in the strict state group)
SCORE_FLOOR = [  # (state_group, valid_from, valid_to, floor)
    ("standard", MIN_DATE, REGIME_DATES["r2"], 620.0),
    ("standard", REGIME_DATES["r2"], REGIME_DATES["r3"], 680.0),
    ("standard", REGIME_DATES["r3"], MAX_DATE, 640.0),
    ("strict", MIN_DATE, REGIME_DATES["r2"], 620.0),
    ("strict", REGIME_DATES["r2"], REGIME_DATES["r3"], 720.0),
    ("strict", REGIME_DATES["r3"], MAX_DATE, 720.0),
]
STRICT_STATES = ("NATION_7",)

# FIXED VALUES: bureau knockout thresholds
DELINQUENCY_MAX = 0          # MTA2126 > 0 fails
COLLECTIONS_MAX = 0          # COL3211 > 0 fails
WORST_TRADE_MIN = 60         # ALM6270 >= 60 fails
INQUIRIES_MIN = 6            # IQT9425 - (IQM9415 + IQA9415) >= 6 fails
FINANCE_INQUIRIES_MAX = 2    # IQF9415 > 2 fails
BANKRUPTCY_MONTHS = (24, 60)  # months since the last one: ALL9220 <= 24 before the cut-off, <= 60 from it
LOAN_SIZE_DTI = 0.43         # a DTI decline below this recorded ratio is wrong for the loan size rule
FORECLOSURE_MONTHS = 60      # MTF8169 <= 60 fails
# FIXED VALUES: alert sub-codes (numeric set) and fraud-shield message sub-codes
ALERT_SUBCODES = (16, 23, 26, 28, 31, 33)
FRAUD_SHIELD_SUBCODES = (5, 25, 13, 14, 27)

# FIXED VALUES: eligible land-use codes before / from the cut-off
LAND_USE_BEFORE = (102, 112, 148, 163)
LAND_USE_FROM = (102, 112, 163)
MAX_ACRES = 20.0
RECENT_SALE_DAYS = 90
MAX_LIEN_POSITION = 3
MAX_MORTGAGE_COUNT = 2
# FIXED VALUES: an earlier version of the rules took a recorded position above this one, from its own date
MAX_RECORDED_POSITION = 2
FORECLOSURE_STATUSES = ("F", "U")

# FIXED VALUES: a lien older than this many months is excepted (categories, states or any, months)
LIEN_AGE_LIMITS = [
    (("FEDERAL TAX LIEN",), None, 120),
    (("MECHANICS LIEN",), None, 24),
    (("STATE TAX LIEN",), ("NH", "IL", "CA", "NJ", "VA", "WI", "FL", "HI", "CT", "OH", "VT", "IA", "KY", "LA", "MD"), 240),
    (("STATE TAX LIEN",), ("AL", "AZ", "AR", "DE", "IN", "ME", "MA", "MN", "NM", "TN", "WA", "WY", "WV", "KS", "SC", "GA",
                           "OK", "NE"), 120),
    (("STATE TAX LIEN",), ("SD", "UT", "ID", "CO", "MI", "MS"), 84),
    (("JUDGMENT", "LIEN"), ("MD", "DC", "NM", "KY", "ME", "MA", "CT", "NJ", "RI"), 240),
    (("JUDGMENT", "LIEN"), ("AR", "AL", "IA", "DE", "IN", "MN", "TN", "WA", "WV", "SC", "CA", "FL", "VA", "WI", "SD", "LA",
                            "TX", "MT", "NC", "OR", "MO", "AZ", "UT", "VT", "AK"), 120),
    (("JUDGMENT", "LIEN"), ("WY", "KS", "OK", "OH", "ID", "MI", "PA", "NE", "NH", "CO", "NV", "GA", "IL"), 84),
]
LIEN_EXCEPTION_SCORE = 680
LIEN_CATEGORIES = ("FEDERAL TAX LIEN", "MECHANICS LIEN", "STATE TAX LIEN", "JUDGMENT", "LIEN")


# FIXED VALUES: CLTV limit when nothing is owed
CLTV_ZERO_OWED = 0.5
# CLTV limits by score band and regime (limits are policy values; regimes bound to test dates)
CLTV_LIMITS = [  # (regime, score_lo, score_hi exclusive, limit)
    ("r0", 620, 680, 0.80), ("r0", 680, 720, 0.95), ("r0", 720, 851, 0.95),
    ("r1", 620, 680, 0.75), ("r1", 680, 720, 0.90), ("r1", 720, 851, 0.95),
    ("r2", 620, 660, 0.65), ("r2", 660, 680, 0.75), ("r2", 680, 720, 0.85),
    ("r2", 720, 760, 0.90), ("r2", 760, 851, 0.95),
    ("r3", 640, 680, 0.65), ("r3", 680, 720, 0.80), ("r3", 720, 760, 0.80), ("r3", 760, 851, 0.80),
]
# FIXED VALUES: DTI limits by score band; each date starts a version of the whole table
DTI_LIMITS = [  # (valid_from, score_lo, score_hi exclusive, limit)
    (MIN_DATE, 620, 740, 0.43), (MIN_DATE, 740, 100000, 0.50),
    (REGIME_DATES["r3"], 620, 740, 0.45), (REGIME_DATES["r3"], 740, 100000, 0.50),
]
# FIXED VALUES: collateral haircut parameters
HAIRCUT_LOW_VALUE = 100000.0
HAIRCUT_LOW_FACTOR = 0.5
HAIRCUT_FSD_FULL = 13.0
HAIRCUT_FSD_HALF = 20.0
HAIRCUT_LAND_USE = 112
# FIXED VALUES: asset rules and DTI annuity
RETIREMENT_AGE = 59.5
RETIREMENT_FACTOR = 0.7
ASSET_RATE = 0.04
# FIXED VALUES: assumed pre-refinance student-loan terms
STUDENT_RATE = 0.0638
STUDENT_MONTHS = 120

# FIXED VALUES: fee buy-down divisors by term (years): (rate divisor, APR divisor)
BUYDOWN_DIVISORS = [(5, 1.75, 2.4), (7, 2.0, 3.3), (10, 2.5, 4.6), (15, 3.0, 6.7), (20, 3.25, 8.5)]
AUTOPAY_DISCOUNT = 0.0025

# FIXED VALUES: task weights by normalised sub-task label
TASK_WEIGHTS = [
    ("Call applicant -- ID Upload", 6), ("Call applicant -- Notary", 6),
    ("Call applicant -- Bank Account", 6), ("Call applicant -- Sign promissory Note", 6),
    ("Call applicant -- Additional Signer", 6), ("Review Fraud Alert", 6),
    ("Upload Property Legal Description", 5), ("Verify Deed Names/Addresses", 6),
    ("Call applicant -- 1st attempt", 6), ("Call applicant -- 2nd attempt", 6),
    ("Generate Pre-Populated Deed", 4), ("Upload Notarized Deed", 5), ("Contact Applicant", 6),
    ("Order Appraisal", 5), ("Upload Appraisal", 2), ("Upload Recorded Deed", 2),
    ("Call applicant - Plaid Account Link", 6), ("Call applicant -- Income Verification", 6),
    ("Review OFAC Alert", 8), ("FUND", 1), ("RESCISSION", 0),
    ("Upload and Review Identity Document", 6), ("First Lien Insurance Review", 8),
    ("Compliance Fraud Review", 9), ("Create Risk On SUI", 8), ("SUI Risk Review", 6),
    ("Review Trust Requirements", 6), ("Multiple Properties Found", 6),
    ("Call Applicant - Update Trust Doc", 6), ("Order Home Inspection", 5),
    ("Review Income/Asset Documentation", 5), ("Confirm Initial Purchase Offer", 5),
    ("Document Upload", 5),
]
# FIXED VALUES: sub-task label normalisation (raw label -> normalised label)
SUBTASK_ALIASES = [
    ("Call applicant -- ID Upload", ("Call applicant -- ID Upload", "Call applicant 1 -- ID Upload",
                                     "Call applicant 2 -- ID Upload", "Call applicant 3 -- ID Upload",
                                     "Call applicant 4 -- ID Upload")),
    ("Call applicant -- Notary", ("Call applicant -- Notary", "Call applicant 1 -- Notary",
                                  "Call applicant 2 -- Notary", "Call applicant 3 -- Notary",
                                  "Call applicant 4 -- Notary")),
    ("Call applicant -- Bank Account", ("Call applicant -- Bank Account", "Call applicant 1 -- Bank Account",
                                        "Call applicant 2 -- Bank Account", "Call applicant 3 -- Bank Account",
                                        "Call applicant 4 -- Bank Account")),
    ("Call applicant -- Sign promissory Note", ("Call applicant -- Sign promissory Note",
                                                "Call applicant 1 -- Sign promissory Note",
                                                "Call applicant 2 -- Sign promissory Note",
                                                "Call applicant 3 -- Sign promissory Note",
                                                "Call applicant 4 -- Sign promissory Note")),
    ("Call applicant -- Additional Signer", ("Call applicant -- Additional Signer",
                                             "Call applicant 1 -- Additional Signer",
                                             "Call applicant 2 -- Additional Signer",
                                             "Call applicant 3 -- Additional Signer",
                                             "Call applicant 4 -- Additional Signer")),
    ("Review Fraud Alert", ("Review Property Ownership", "Review Fraud Alert", "Review Fraud Ownership",
                            "Review Bank Account Ownership")),
    ("Call applicant -- 1st attempt", ("Call applicant -- 1st attempt", "Call Borrower")),
    ("Call applicant -- 2nd attempt", ("Call applicant -- 2nd attempt", "Call borrower for the 2nd time")),
    ("Upload and Review Identity Document", ("Upload and Review Identity Document", "Review Jumio Failure")),
]
# FIXED VALUES: outcome normalisation
OUTCOME_GROUPS = [
    ("CLEARED", ("FIXED", "NO_DISCREPANCY", "CONFIRMED_APPLICATION", "FRAUD_NOT_FOUND")),
    ("MANUAL_CANCEL", ("CANCEL",)),
    ("POTENTIAL_FRAUD", ("FRAUD_SUSPECTED", "POTENTIAL_FRAUD", "DISCREPANCY")),
    ("CONFIRM_FRAUD", ("CONFIRM_FRAUD", "FRAUD_FOUND")),
]
# FIXED VALUES: agent names that are not people
NON_AGENTS = ("In progress", "System", "Fraud Processor", "CSC Processor", "SYSTEM_CANCEL_TASK", "",
              "SYSTEM_COMPLETE_TASK")
LATENCY_CAP = 1200.0


# ---------------------------------------------------------------------------
# rate grid, built from a rule (base by term and lien position, steps by band)
# ---------------------------------------------------------------------------
CLTV_BANDS = [(0.0, 0.5), (0.5, 0.6), (0.6, 0.65), (0.65, 0.75), (0.75, 0.8), (0.8, 0.85),
              (0.85, 0.9), (0.9, 0.95)]
SCORE_BANDS = [(600, 619), (620, 639), (640, 659), (660, 679), (680, 699), (700, 719),
               (720, 739), (740, 759), (760, 799), (800, 850)]
GRID_BASE = {(5, False): 0.0600, (10, False): 0.0650, (15, False): 0.0700,
             (5, True): 0.0550, (10, True): 0.0600, (15, True): 0.0650, (30, True): 0.0700}
GRID_COLUMNS = "term int, first_lien boolean, property_type string, lo double, hi double, `from` int, `to` int, value double, priority int"


def rate_grid_rows() -> list[tuple]:
    """Rows of ``GRID_COLUMNS``, first listed first in priority: bands are closed, so neighbours share an edge.

    Rate = base(term, lien) + 0.0025 per CLTV band + 0.0030 per score band below the top, for homes. A CLTV band
    starts 20 points of score above the one below it. The longest term ends at 0.8 and merges two score bands
    while CLTV is at most 0.6.
    """
    rows = []
    for (term, first), base in GRID_BASE.items():
        for bi, (lo, hi) in enumerate(CLTV_BANDS):
            for si, (slo, shi) in enumerate(SCORE_BANDS):
                if slo < 600 + 20 * bi or (term == 30 and hi > 0.8):
                    continue
                if term == 30 and hi <= 0.6 and slo in (700, 720):
                    if slo == 720:
                        continue
                    shi = 739
                rate = round(base + 0.0025 * bi + 0.0030 * (len(SCORE_BANDS) - 1 - si), 4)
                rows.append((term, first, "HOME", lo, hi, slo, shi, rate, len(rows)))
    return rows
