"""Operator-written review rules: conditions over ledger fields that lead to an outcome.

Rules come as a short list from a person. Each becomes a boolean expression, so testing them all is one projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOMES = ("non_recurring", "human_review", "recurring", "flag")
MATCHES = ("contains", "equals", "regex", "on_or_after", "before", "on_or_before", "after")


@dataclass(frozen=True)
class Condition:
    """`field` may list several names with `|`; any hit counts. `fallback` stands in where the first is missing."""

    field: str
    match: str
    value: str
    fallback: str | None = None
    case_sensitive: bool = False

    def __post_init__(self) -> None:
        if self.match not in MATCHES:
            raise ValueError(f"unknown match {self.match!r}")


@dataclass(frozen=True)
class Rule:
    """`mode` all_of: every condition must hold; any_of: one is enough."""

    rule_id: str
    outcome: str
    mode: str
    conditions: tuple[Condition, ...]

    def __post_init__(self) -> None:
        if self.outcome not in OUTCOMES or self.mode not in ("all_of", "any_of") or not self.conditions:
            raise ValueError(f"rule {self.rule_id!r} is malformed")


def _test(value: Column, condition: Condition) -> Column:
    wanted = condition.value
    if condition.match in ("contains", "equals"):
        text, wanted = (value, wanted) if condition.case_sensitive else (F.lower(value), wanted.lower())
        return text.contains(wanted) if condition.match == "contains" else text == wanted
    if condition.match == "regex":
        return value.rlike(wanted if condition.case_sensitive else f"(?i){wanted}")
    day, limit = value.try_cast("date"), F.lit(wanted).cast("date")
    return {
        "on_or_after": day >= limit, "after": day > limit, "on_or_before": day <= limit, "before": day < limit,
    }[condition.match]


def condition_holds(condition: Condition, columns: list[str]) -> Column:
    """False where the tested fields are missing."""
    def field(name: str) -> Column:
        return F.col(name).cast("string") if name in columns else F.lit(None).cast("string")

    result = F.lit(False)
    for name in condition.field.split("|"):
        value = field(name)
        if condition.fallback:
            value = F.coalesce(value, field(condition.fallback))
        result = result | F.coalesce(_test(value, condition), F.lit(False))
    return result


def rule_holds(rule: Rule, columns: list[str]) -> Column:
    tests = [condition_holds(c, columns) for c in rule.conditions]
    result = tests[0]
    for test in tests[1:]:
        result = (result & test) if rule.mode == "all_of" else (result | test)
    return result


def apply_rules(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds `rules_fired` (in rule order) and `rule_outcome`, the outcome of the first one."""
    fired = F.array(*[
        F.when(rule_holds(r, rows.columns), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.outcome).alias("outcome")))
        for r in rules
    ])
    hits = F.filter(fired, lambda h: h.isNotNull())
    return rows.withColumn("_hits", hits).withColumns({
        "rules_fired": F.transform("_hits", lambda h: h["rule_id"]), "rule_outcome": F.get("_hits", F.lit(0))["outcome"],
    }).drop("_hits")
