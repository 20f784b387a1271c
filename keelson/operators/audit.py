"""B37 — decision verdicts over a set of check columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SHOULD_DECLINE = "should have been declined"
SHOULD_NOT_DECLINE = "should not have been declined"
CORRECT = "correct"
DECLINED_STATUSES = ("DECLINED", "CANCELLED")


def declined(status: Column, decision: Column) -> Column:
    """Application ended declined (decision DECLINE and status declined/cancelled)."""
    return (decision == "DECLINE") & status.isin(*DECLINED_STATUSES)


def approved(status: Column, decision: Column) -> Column:
    """Application went through (decision not DECLINE and status not declined/cancelled)."""
    return (decision != "DECLINE") & ~status.isin(*DECLINED_STATUSES)


def verdict(checks: Sequence[Column]) -> Column:
    """Two-directional verdict over labelled checks (each ending in '1', '2' or PASS-like).

    Any check ending in '1' -> should have been declined; otherwise any check
    ending in '2' -> should not have been declined; otherwise correct (Q9: one
    wrong-decline label suffices, no missed-decline label may be present).
    """
    miss = F.lit(False)
    wrong = F.lit(False)
    for c in checks:
        miss = miss | F.coalesce(c.endswith("1"), F.lit(False))
        wrong = wrong | F.coalesce(c.endswith("2"), F.lit(False))
    return F.when(miss, SHOULD_DECLINE).when(wrong, SHOULD_NOT_DECLINE).otherwise(CORRECT)


def failure_verdict(failures: Sequence[Column], hard_clear: Column, status: Column,
                    decision: Column, pass_label: str = "Pass") -> Column:
    """Refinance-style verdict: any failure label on a live app -> should decline;
    all checks clear on a declined app -> should not have declined (Q6: only a
    real failure label counts, 'Unavailable' does not)."""
    any_fail = F.lit(False)
    all_pass = F.lit(True)
    for f in failures:
        any_fail = any_fail | F.coalesce(f.endswith("Failure"), F.lit(False))
        all_pass = all_pass & F.coalesce(~f.endswith("Failure"), F.lit(True))
    live = ~status.isin(*DECLINED_STATUSES)
    return (F.when(any_fail & live, SHOULD_DECLINE)
             .when(all_pass & hard_clear & (decision == "DECLINE") & (status == "DECLINED"), SHOULD_NOT_DECLINE)
             .otherwise(pass_label))
