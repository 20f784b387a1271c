"""Credit-bureau attribute codes used by the audited rule sets.

FIXED VALUES — these attribute codes are the column names the lender's
bureau tables carry and the rule sets reference; they must be spelled exactly
like this for the rules to resolve. Listed in natural order with the meaning
each rule gives them.
"""

# FIXED VALUES (bureau attribute codes, as referenced by the decision rules)
BUREAU_CODES = [
    "MTA2126",  # mortgage trades 30+ days delinquent in 6 months
    "COL3211",  # non-medical collections
    "ALM6270",  # worst trade status in 12 months (non-medical)
    "IQT9425",  # inquiries in 6 months
    "IQM9415",  # mortgage inquiries in 6 months
    "IQA9415",  # auto inquiries in 6 months
    "IQF9415",  # finance inquiries in 6 months
    "ALL9220",  # months since most recent bankruptcy
    "MTF8169",  # months since most recent foreclosure
    "BCC5830",  # bankcard balance
    "BCC5838",  # bankcard monthly payment
    "BCX5830",  # open bankcard balance
    "ALX5830",  # total monthly payment, open trades
    "ILN5824",  # installment payment excluding student loans
    "BAX5030",  # open bankcard limit
    "BCX5030",  # bankcard limit
    "RTR5030",  # retail balance
    "ILN5820",  # installment monthly payment
    "AUA5820",  # auto monthly payment
    "STU5020",  # student loan balance
    "STU5820",  # student loan monthly payment
    "MTF5820",  # first mortgage monthly payment
    "MTS5820",  # second mortgage monthly payment
    "HLC5820",  # home-equity line monthly payment
    "MTA5020",  # mortgage balance
    "IQT9416",  # inquiries in 3 months
    "ALS8220",  # months since oldest trade opened
    "ALX8220",  # months since oldest open trade opened
    "STU8151",  # worst student-loan status
    "STU6200",  # months since student-loan status
    "ALL0400",  # total trades
    "ALL0337",  # trades opened recently
    "REV2326",  # revolving past-due amount
    "ILN2326",  # installment past-due amount
    "MTA2326",  # mortgage past-due amount
    "ALL9221",  # months since bankruptcy (any)
    "ALL9120",  # bankruptcies
    "ALL9121",  # bankruptcies discharged
    "ALL9122",  # bankruptcies dismissed
    "COL5064",  # collections amount, group 1
    "COL5067",  # collections amount, group 2
    "COL5068",  # collections amount, group 3
    "COL5069",  # collections amount, group 4
    "ALL5361",  # major derogatory amount
    "ALL5830",  # total monthly payment
    "MTA5830",  # mortgage monthly payment (sentinel-coded)
    "MTX5839",  # mortgage payment excluding joint
    "AUT5820",  # auto and lease monthly payment
    "MTJ0416",  # joint mortgage trades
]

# FIXED VALUES: bureau "not available" sentinels
SENTINELS = (999999998, 999999996)
# FIXED VALUES: codes whose sentinel counts as 0
SENTINEL_CODES = ("MTA5830",)
