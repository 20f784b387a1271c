"""B7, B8, B38 — rule cascades, rule batteries, two-directional rules and versions of rule sets.

Rules are ``(label, Column)`` pairs; a cascade folds them into one
``CASE WHEN`` (first true rule wins), a battery materialises one boolean or
YES/NO column per rule.  All of it stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import is_true

Rule = tuple[str, Column]


def cascade(rules: Sequence[Rule], default: str | None = "PASS") -> Column:
    """First-match label of ``rules``; ``default`` when none is true (NULL conditions do not fire)."""
    if not rules:
        return F.lit(default)
    expr = F.when(rules[0][1], F.lit(rules[0][0]))
    for label, cond in rules[1:]:
        expr = expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def battery(df: DataFrame, rules: Sequence[Rule], style: str = "bool") -> DataFrame:
    """Add one column per rule: raw boolean (``bool``) or 'YES'/'NO' (``yesno``, NULL -> 'NO')."""
    cols = {}
    for label, cond in rules:
        cols[label] = cond if style == "bool" else F.when(is_true(cond), "YES").otherwise("NO")
    return df.withColumns(cols)


def any_true(conds: Sequence[Column]) -> Column:
    """OR of ``c IS TRUE`` over the conditions (never NULL)."""
    out = F.lit(False)
    for c in conds:
        out = out | is_true(c)
    return out


def two_way(label: str, fires: Column, clears: Column, approved: Column, declined: Column,
            declined_for: Column) -> Column:
    """Two-directional rule.

    ``<label>1`` — the rule fires but the application went through (missed decline);
    ``<label>2`` — the rule is clear but the application ended declined and this reason is among
    its decline reasons (wrong decline); NULL otherwise, to be chained in a cascade. An application
    that neither went through nor ended declined gets no label.
    """
    return (F.when(fires & approved, F.lit(f"{label}1"))
             .when(clears & declined & declined_for, F.lit(f"{label}2")))


def first_label(*labels: Column, default: str = "PASS") -> Column:
    """First non-NULL label of several two-way rules, else ``default``."""
    return F.coalesce(*labels, F.lit(default))


@dataclass(frozen=True)
class RuleSet:
    """One version of an audit's rules: ``rules()`` gives (rule name, label, condition) in their order;
    ``inputs`` are the columns they read."""
    version: str
    inputs: tuple[str, ...]
    rules: Callable[[], list[tuple[str, str, Column]]]

    def checked(self, df: DataFrame) -> list[tuple[str, str, Column]]:
        missing = [c for c in self.inputs if c not in df.columns]
        if missing:
            raise ValueError(f"rules of {self.version} read columns that are not there: {', '.join(missing)}")
        return self.rules()

    def label(self, df: DataFrame) -> Column:
        """First-match label of the version."""
        return cascade([(label, cond) for _, label, cond in self.checked(df)])

    def fired(self, df: DataFrame) -> Column:
        """Names of all rules that fire, sorted, each once."""
        names = F.array(*[F.when(is_true(cond), F.lit(name)) for name, _, cond in self.checked(df)])
        return F.array_sort(F.array_distinct(F.array_compact(names)))


def version_difference(df: DataFrame, keys: Sequence[str], old: RuleSet, new: RuleSet) -> DataFrame:
    """Rows whose fired rules differ between two versions: keys, both labels, rules only one of them fires."""
    both = df.select(*keys, old.label(df).alias("old_check"), new.label(df).alias("new_check"),
                     old.fired(df).alias("_old"), new.fired(df).alias("_new"))
    both = both.withColumns({"only_old": F.array_join(F.array_except("_old", "_new"), ","),
                             "only_new": F.array_join(F.array_except("_new", "_old"), ",")})
    return both.where((F.col("only_old") != "") | (F.col("only_new") != "")).drop("_old", "_new")
