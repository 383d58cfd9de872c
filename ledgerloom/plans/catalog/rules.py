"""Operator rules over the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators.rules import Condition, Rule, apply_rules
from ..registry import query

#: Words the rule `counterparty` and its checking SQL look for.
COUNTERPARTY = "depot"

RULES = [
    Rule("post_sale", "non_recurring", "all_of", (
        Condition("entityid|descrptn|adddesc", "contains", "project nation_1"),
        Condition("invoice_date", "on_or_after", "1998-03-31", fallback="entrdate"),
    )),
    Rule("counterparty", "flag", "any_of", (
        Condition("descrptn|adddesc", "contains", COUNTERPARTY.title()), Condition("category", "equals", "acquisition costs"),
    )),
    Rule("miscoded", "human_review", "all_of", (
        Condition("acctnum", "equals", "MR70000005"), Condition("entrdate", "on_or_after", "1997-03-01"),
        Condition("entrdate", "on_or_before", "1998-03-31"),
    )),
    Rule("early_rent", "recurring", "all_of", (
        Condition("descrptn", "regex", "^monthly +rent$"), Condition("entrdate", "before", "1999-01-01"),
        Condition("source", "equals", "O", case_sensitive=True),
    )),
]


@query("j14_operator_rules", "ledger", check=f"""
select row_idx, array_to_string(list_filter(fired, lambda f: f is not null), ',') as rules_fired,
 case when fired[1] is not null then 'non_recurring' when fired[2] is not null then 'flag' when fired[3] is not null then 'human_review' when fired[4] is not null then 'recurring' end as rule_outcome
from (select row_idx, list_value(
  case when (lower(entityid) like '%project nation\\_1%' escape '\\' or lower(descrptn) like '%project nation\\_1%' escape '\\' or lower(adddesc) like '%project nation\\_1%' escape '\\') and entrdate >= '1998-03-31' then 'post_sale' end,
  case when descrptn ilike '%{COUNTERPARTY}%' or adddesc ilike '%{COUNTERPARTY}%' or lower(category) = 'acquisition costs' then 'counterparty' end,
  case when acctnum = 'MR70000005' and entrdate between '1997-03-01' and '1998-03-31' then 'miscoded' end,
  case when regexp_matches(descrptn, '(?i)^monthly +rent$') and entrdate < '1999-01-01' and source = 'O' then 'early_rent' end) as fired from ledger) t""")
def operator_rules(ctx):
    return apply_rules(ctx.view("ledger"), RULES).select(
        "row_idx", F.array_join("rules_fired", ",").alias("rules_fired"), "rule_outcome"
    )
