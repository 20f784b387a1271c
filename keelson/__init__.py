"""keelson — lending-decision audits and operations scorecards as Spark DataFrame jobs.

Sub-packages:
  sources    table loading, derived test frames, policy tables
  operators  reusable DataFrame operators (latest record, flatten, membership,
             policy lookup, rule cascades, reconciliation, verdicts)
  functions  Column expression library (rounding, date arithmetic, loan maths)
  plans      composite jobs (home-equity audit, refinance audit, lien
             waterfall, pricing checks, operations scorecard)
  streaming  nothing: the audited workloads are batch only
"""

__all__ = ["session"]
